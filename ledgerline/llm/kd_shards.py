"""Sharding by a k-d tree over document metadata, with DataFrame functions only.

Every node is split at the byte-weighted median of its widest dimension until the leaves reach the target size.
The medians of all nodes of a level are found together: three rounds of a histogram over the next 12 bits of a
36-bit key (16 bits of the coordinate, 20 bits of a tie-break), each a partial aggregation before the shuffle
of at most 4096 rows per node and task. No node is ever sorted or gathered.

Dimensions: size (logarithmic), source, language and a content fingerprint. Copies of a text take the
metadata of their first document and one tie-break, so they stay together; only a group of copies of more bytes than a
shard's share is sliced, by a hash of the document id, so that it can be split like any other weight.

The law is `bytes`: every split leaves the two sides within the weight of one 36-bit key of each other.

Cases: null texts weigh 1 byte; null lang or source is a value of its own; repeated rows count each, those with
one id are numbered by the content of their text; a table with
fewer rows than shards leaves shards empty; an empty table gives an empty table; a null id is an id like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

BITS, ROUNDS, TIE_BITS = 12, 3, 20
#: Slices of a group that had all bytes.
SLICES = 1024
#: Cuts (three numbers each) up to which they are broadcast.
MOST_SENT = 1 << 16
#: Rows per block in which slots are counted one by one.
BLOCK_ROWS = 4096


def _unit(hashed: Column) -> Column:
    """A hash as a coordinate of 16 bits."""
    return F.pmod(hashed, F.lit(1 << 16))


def light_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(id, size, crc, h, meta): a row per document without its text, staged in the shared folder."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return staged(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("h"), F.struct(F.col(id_col).alias("id"), *[F.xxhash64(F.lit(n), F.col(c)).alias(f"x{n}") for n, c in enumerate(dims)]).alias("meta")), "kd-light")


def coordinates(light: DataFrame, total: int, shards: int, n_dims: int) -> DataFrame:
    """(id, size, crc, d0..dn, tie) of light_rows() of `total` bytes that go to so many shards."""
    groups = light.groupBy("h", "size").agg(F.count("*").alias("copies"), F.min("meta").alias("first"))
    weight = F.col("copies") * F.col("size")
    slices = F.when(weight * shards <= total, F.lit(1)).otherwise(F.ceil(weight * SLICES / F.lit(float(total))))
    rows = light.join(groups, ["h", "size"])
    part = F.when(slices <= 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), slices))
    size = F.least(F.floor(F.log2(F.col("size").cast("double")) * 2048), F.lit((1 << 16) - 1))
    out = rows.select(
        "id", "size", "crc", size.cast("long").alias("d0"), _unit(F.xxhash64("h", part)).alias("d1"),
        *[_unit(F.col(f"first.x{n}")).alias(f"d{n + 2}") for n in range(n_dims)],
        F.pmod(F.xxhash64("h", F.lit(7), part), F.lit(1 << TIE_BITS)).alias("tie"))
    return staged(out, "kd-rows")


def _digit(key: Column, n: int) -> Column:
    return F.shiftright(key, BITS * (ROUNDS - 1 - n)).bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))


def _median_bins(bins: DataFrame, by: list[str], last: bool) -> DataFrame:
    """One row per node: the bin of (node, digit, w) in which half of the weight is reached, with what lies below it. `prefix` is that of the
    key so far; in the last round it is the bound. Bins are 4096 per node at most."""
    upto = F.col("below") + F.sum("w").over(Window.partitionBy("node").orderBy("digit"))
    reached = bins.withColumn("upto", upto).where(F.col("upto") * 2 >= F.col("weight"))
    first = reached.groupBy("node").agg(F.min_by(F.struct("digit", "w", "upto", *by), "digit").alias("b"))
    here = F.col("b.prefix") * (1 << BITS) + F.col("b.digit")
    if last:  # the last bin is one key: it goes to the side that leaves the smaller difference
        over, under = F.col("b.upto") * 2 - F.col("b.weight"), F.col("b.weight") - (F.col("b.upto") - F.col("b.w")) * 2
        here = here + F.when(over <= under, 1).otherwise(0)
    return staged(first.select("node", F.col("b.weight").alias("weight"), F.col("b.dim").alias("dim"), (F.col("b.upto") - F.col("b.w")).alias("below"), here.alias("prefix")), "kd-cuts")


def _split(rows: DataFrame, n_dims: int, level: int) -> DataFrame:
    """(node, dim, bound): keys of the node's widest dimension below bound go left. One row per node with rows.

    The first of the rounds counts all dimensions at once, by the upper 12 bits of their coordinates beside the extremes, and
    the widest dimension is chosen from the counts.
    """
    upper = BITS * (ROUNDS - 1) - TIE_BITS  # bits of a coordinate below its first digit
    each = rows.select("node", "size", F.explode(F.array(*[F.struct(F.lit(n).alias("dim"), F.col(f"d{n}").alias("d")) for n in range(n_dims)])).alias("x"))
    digit = F.shiftright("d", upper)
    counts = each.select("node", "size", "x.*").groupBy("node", "dim", digit.alias("digit")).agg(F.sum("size").alias("w"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    # n_dims x 4096 rows per node at most
    counts = staged(counts, "kd-counts")
    span = counts.groupBy("node", "dim").agg(F.sum("w").alias("weight"), (F.max("hi") - F.min("lo")).alias("span"))
    widest = span.groupBy("node").agg(F.max_by(F.struct("dim", "weight"), F.struct("span", -F.col("dim"))).alias("x")).select("node", "x.dim", "x.weight")
    zero = F.lit(0).cast("long")
    bins = counts.join(widest, ["node", "dim"]).withColumns({"below": zero, "prefix": zero})
    found = _median_bins(bins, ["dim", "weight", "prefix"], ROUNDS == 1)
    for n in range(1, ROUNDS):
        keyed = _keyed(rows, found, n_dims, level).where(F.shiftright("key", BITS * (ROUNDS - n)) == F.col("prefix"))
        bins = keyed.groupBy("node", "dim", "weight", "below", "prefix", _digit(F.col("key"), n).alias("digit")).agg(F.sum("size").alias("w"))
        found = _median_bins(bins, ["dim", "weight", "prefix"], n + 1 == ROUNDS)
    return found.select("node", "dim", F.col("prefix").alias("bound"))


def _keyed(rows: DataFrame, cuts: DataFrame, n_dims: int, level: int) -> DataFrame:
    """rows with the key of their node's dimension. There are 2**level cuts at most: few are broadcast, else rows
    and cuts meet by node, of which there are then enough to spread."""
    if 1 << level <= MOST_SENT:
        cuts = F.broadcast(cuts)
    coordinate = F.element_at(F.array(*[F.col(f"d{n}") for n in range(n_dims)]), F.col("dim") + 1)
    return rows.join(cuts, "node").withColumn("key", F.shiftleft(coordinate, TIE_BITS) + F.col("tie"))


def kd_assign(rows: DataFrame, depth: int, n_dims: int) -> DataFrame:
    """rows of coordinates() with `node`, the leaf from 0 to 2**depth - 1. Cut tables have a row per node; each level's nodes are
    staged, so that the next one reads them and joins once."""
    out = rows.withColumn("node", F.lit(0))
    for level in range(depth):
        cuts = _split(out, n_dims, level)
        keyed = _keyed(out, cuts, n_dims, level)
        out = keyed.withColumn("node", (F.col("node") * 2 + (F.col("key") >= F.col("bound")).cast("int"))).drop("dim", "bound", "key")
        if level + 1 < depth:
            out = staged(out, f"kd-level{level}")
    return out


def with_slots(rows: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """`slot`: gapless from 0 in each shard. Rows are numbered in blocks of bounded size; blocks get offsets."""
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    rows = rows.withColumn("__ll_block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    sizes = rows.groupBy(shard, "__ll_block").agg(F.count("*").alias("__ll_n"))
    # blocks per shard: one row for each 4096 rows of the table
    before = F.sum("__ll_n").over(Window.partitionBy(shard).orderBy("__ll_block")) - F.col("__ll_n")
    offsets = sizes.select(shard, "__ll_block", before.alias("__ll_before"))
    at = F.row_number().over(Window.partitionBy(shard, "__ll_block").orderBy(*order)) - 1
    return rows.withColumn("__ll_at", at).join(offsets, [shard, "__ll_block"]).withColumn("slot", F.col("__ll_before") + F.col("__ll_at")).drop("__ll_block", "__ll_before", "__ll_at")


def kd_shards(docs: DataFrame, target_bytes: int | None = None, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(id, size, crc, shard, slot) of each document. Give target_bytes (largest leaf) or shards, a power of two."""
    light = light_rows(docs, id_col, text_col, dims)
    total = light.agg(F.sum("size")).first()[0] or 1
    if shards is None:
        shards = 1 << max(0, (-(-total // target_bytes) - 1).bit_length())
    if shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    rows = coordinates(light, total, shards, len(dims))
    leaves = kd_assign(rows, shards.bit_length() - 1, 2 + len(dims)).select("id", "size", "crc", F.col("node").alias("shard"))
    return with_slots(staged(leaves, "kd-leaves"), "shard", ["id", "crc", "size"])


def op9_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), shards=16)
    return out.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
