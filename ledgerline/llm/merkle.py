"""Merkle manifest of a dataset: a tree of digests per group, a tree over the groups' roots, and a proof per row.

Levels are reduced by superblocks: nodes are numbered gapless within their tree, nodes with one number div fanout^k go to one
bucket, and one call of applyInPandas collapses k levels of a bucket into its root. The buckets' roots, a
fanout^k-th of the nodes, are reduced in the same way until a tree has one node. A row's proof is put together from the top: the
path of a bucket's root within the bucket above it, upward, is appended to the path of the row within its own bucket.

What is shuffled is digests, never texts: once by range to number them, once by bucket. Buckets hold at most fanout^k
digests, so no tree, however large, and no group, however hot, is one task's work; the
driver holds a few numbers. Numbers, buckets and roots are staged in the shared folder, so lost executors cost only tasks.

Digests are lower-case hex SHA-256; a parent is the digest of its children's hex text, one after the other. A leaf is the
digest of its fields, each `-` if null, else its length in UTF-8 bytes, `:` and the value (numbers in decimal).

Cases: a null group is one of its own and comes first; a null id comes before the others; rows with one id are ordered by
their leaf, equal rows are leaves each; one row makes a tree that is its leaf; a last run may have one node, which is
digested alone while its level has others; an empty table has no rows and no root; columns of any name may be fields.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import staged, table

FANOUT = 8
#: Levels that one bucket collapses: 512 nodes at a fanout of 8.
LEVELS = 3

PATH = "array<struct<place: int, siblings: array<string>>>"


def leaf(fields: list[Column]) -> Column:
    """The digest of a row's fields."""
    def one(c: Column) -> Column:
        s = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))

    return F.sha2(F.concat(*[one(c) for c in fields]).cast("binary"), 256)


def fold(digest: Column, path: Column) -> Column:
    """The root that a digest and the siblings along its path give."""
    def step(acc: Column, s: Column) -> Column:
        run = F.concat(F.slice(s["siblings"], 1, s["place"]), F.array(acc), F.slice(s["siblings"], s["place"] + 1, F.size(s["siblings"])))
        return F.sha2(F.array_join(run, "").cast("binary"), 256)

    return F.aggregate(path, digest, step)


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, bottom up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.array_join(s["siblings"], "")), "").cast("binary"), 256)


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with `n`, gapless from 0 within `group` (null being one) in ascending `order`, staged; and `total`, the group's rows.

    A sort by range deals the rows out; tasks number theirs, and running sums over a count per task and group say where
    each begins. Rows alike in all of `order` are dealt by their place in the input, so that no value is one task's.
    """
    spark = rows.sparkSession
    schema = rows.select("*", F.lit(0).cast("long").alias("local"), F.lit(0).alias("part")).schema
    cores = spark.sparkContext.defaultParallelism
    parts = max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def number(batches):
        from pyspark import TaskContext

        part, known, n = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            local = []
            for g in batch.column(group).to_pylist():
                known, n = (g, n + 1) if g == known else (g, 1)
                local.append(n - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local, pa.int64()), pa.array([part] * len(local), pa.int32())], names=[f.name for f in schema])

    tie = F.monotonically_increasing_id()
    dealt = rows.withColumn("__ll_tie", tie).repartitionByRange(parts, group, *order, "__ll_tie").sortWithinPartitions(group, *order)
    own = staged(dealt.drop("__ll_tie").mapInArrow(number, schema), name)
    # one row per task and group of its rows
    sizes = own.groupBy("part", group).agg(F.count("*").alias("c"))
    w = Window.partitionBy(group)
    starts = sizes.select(F.col("part").alias("p"), F.col(group).alias("__g"), (F.sum("c").over(w.orderBy("part")) - F.col("c")).alias("start"), F.sum("c").over(w).alias("total"))
    joined = own.join(starts, (F.col("part") == F.col("p")) & F.col(group).eqNullSafe(F.col("__g")))
    return joined.select(*rows.columns, (F.col("start") + F.col("local")).alias("n"), "total")


def _reduced(nodes: list[str], fanout: int, levels: int) -> list[list[str]]:
    """The levels above nodes, `levels` of them, bottom first."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([hashlib.sha256("".join(below[k:k + fanout]).encode()).hexdigest() for k in range(0, len(below), fanout)])
    return out


def _levels(total: int, fanout: int, most: int) -> int:
    """Levels that a bucket of a tree of `total` nodes collapses now."""
    n, levels = total, 0
    while n > 1 and levels < most:
        n, levels = -(-n // fanout), levels + 1
    return levels


def superblocks(nodes: DataFrame, group: str, carried: list[str], fanout: int, levels: int) -> DataFrame:
    """One row per bucket of fanout^levels nodes of nodes (group, n, total, node, carried...), staged: group, n (the
    bucket's number), total (buckets of the group), root, and, in the nodes' order, `nodes` and the carried strings as arrays."""
    size = fanout ** levels
    kind = nodes.schema[group].dataType.simpleString()
    schema = f"`{group}` {kind}, n long, total long, root string, nodes array<string>" + "".join(f", `{c}` array<string>" for c in carried)

    def collapse(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("at")
        total, own = int(block["total"].iloc[0]), block["node"].tolist()
        root = _reduced(own, fanout, _levels(total, fanout, levels))[-1][0]
        row = {group: block[group].iloc[0], "n": int(block["bucket"].iloc[0]), "total": -(-total // size), "root": root, "nodes": own}
        return pd.DataFrame([row | {c: block[c].tolist() for c in carried}])

    place = [(F.col("n") % size).alias("at"), F.floor(F.col("n") / size).alias("bucket")]
    blocks = nodes.select(group, "total", "node", *carried, *place).groupBy(group, "bucket")
    return staged(blocks.applyInPandas(collapse, schema), "merkle-buckets")


def reduced(nodes: DataFrame, group: str, carried: list[str], fanout: int, levels: int) -> list[DataFrame]:
    """superblocks() of nodes, of their roots, and so on until every group has one bucket; the number of rounds is that of
    the largest group's digits to the base fanout^levels."""
    out = [superblocks(nodes, group, carried, fanout, levels)]
    while (out[-1].agg(F.max("total")).first()[0] or 0) > 1:
        out.append(superblocks(out[-1].select(group, "n", "total", F.col("root").alias("node")), group, [], fanout, levels))
    return out


def _expanded(buckets: DataFrame, group: str, carried: list[str], fanout: int, levels: int) -> DataFrame:
    """(group, n, node, subroot, root, path, carried...) of every node of buckets that have `up`, the path of the bucket's
    root to the top, its group's root and the top. A record batch holds the nodes of one bucket."""
    size = fanout ** levels
    schema = buckets.select(group, "n", F.lit("").alias("node"), "subroot", "top", F.col("up").alias("path"), *[F.lit("").alias(c) for c in carried]).schema
    # what is carried, and a group, may be null
    schema = StructType([StructField(f.name, f.dataType) for f in schema])
    rows = buckets.select(group, "n", "count", "nodes", "subroot", "top", "up", *carried)

    def run(batches):
        for batch in batches:
            kind, path = batch.schema.field(group).type, batch.schema.field("up").type
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                steps = _reduced(row["nodes"], fanout, _levels(row["count"], fanout, levels))[:-1]
                paths = []
                for k in range(len(row["nodes"])):
                    own = []
                    for level in steps:
                        first = k // fanout * fanout
                        siblings = level[first:first + fanout]
                        del siblings[k - first]
                        own.append({"place": k - first, "siblings": siblings})
                        k //= fanout
                    paths.append(own + row["up"])
                m = len(paths)
                cols = [pa.array([row[group]] * m, kind), pa.array(range(row["n"] * size, row["n"] * size + m), pa.int64()), pa.array(row["nodes"]), pa.array([row["subroot"]] * m), pa.array([row["top"]] * m), pa.array(paths, path)]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.array(row[c], pa.string()) for c in carried]], names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)


def _count_below(rounds: list[DataFrame], k: int, sizes: DataFrame, group: str) -> DataFrame:
    """rounds[k] with `count`, the nodes of its group in the round below (rows of the group for the first)."""
    below = sizes if k == 0 else rounds[k - 1].select(group, "total")
    counts = below.groupBy(F.col(group).alias("__g")).agg(F.max("total").alias("count"))
    return rounds[k].join(counts, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def proofs(rounds: list[DataFrame], sizes: DataFrame, group: str, top: DataFrame, carried: list[str], fanout: int, levels: int) -> DataFrame:
    """(group, n, node, subroot, top, path, carried...) of the nodes that rounds (of reduced()) began with. `sizes` has the group's rows
    as `total`; `top` has, per group, `up` (the path of the group's root) and `top`, the root of all."""
    none = top.select(F.col(group).alias("__g"), F.lit(0).cast("long").alias("__n"), F.col("up"), F.col("top"), F.lit(None).cast("string").alias("known"))
    for k in reversed(range(len(rounds))):
        met = F.col(group).eqNullSafe(F.col("__g")) & (F.col("n") == F.col("__n"))
        buckets = _count_below(rounds, k, sizes, group).join(none, met).withColumn("subroot", F.coalesce("known", "root"))
        nodes = _expanded(buckets, group, carried if k == 0 else [], fanout, levels)
        none = nodes.select(F.col(group).alias("__g"), F.col("n").alias("__n"), F.col("path").alias("up"), "top", F.col("subroot").alias("known"))
    return nodes


def manifest(docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "lang", carry: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(id, group, n, leaf, subroot, root, path, carry...) of each row: its number within its group, the digest of
    `fields`, the roots of its group's tree and of all, and the siblings along its path, bottom up. `carry` names digests
    or other strings to take along, computed beside the leaf."""
    carry = carry or {}
    names = {c: f"c{k}" for k, c in enumerate(carry)}
    ordered = staged(docs.select(F.col(group_col).alias("g"), F.col(id_col).alias("id"), leaf([F.col(c) for c in fields]).alias("node"), *[v.alias(names[c]) for c, v in carry.items()]), "merkle-leaves")
    nodes = numbered(ordered, "g", ["id", "node"], "merkle-numbered").withColumn("id", F.col("id").cast("string"))
    rounds = reduced(nodes, "g", ["id", *names.values()], fanout, levels)
    sizes = nodes.select("g", "total")
    # one node per group from here on
    roots = rounds[-1].select(F.lit(0).alias("all"), "g", F.col("root").alias("node"))
    tops = numbered(roots, "all", ["g"], "merkle-groups").withColumn("name", F.to_json(F.struct("g")))
    above = reduced(tops, "all", ["name"], fanout, levels)
    start = above[-1].select("all", F.array().cast(PATH).alias("up"), F.col("root").alias("top"))
    group = docs.select(F.col(group_col).alias("g")).schema
    per_group = proofs(above, tops.select("all", "total"), "all", start, ["name"], fanout, levels)
    top = per_group.select(F.from_json("name", group)["g"].alias("g"), F.col("path").alias("up"), "top")
    out = proofs(rounds, sizes, "g", top, ["id", *names.values()], fanout, levels)
    return out.select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("g").alias(group_col), "n", F.col("node").alias("leaf"), "subroot",
        F.col("top").alias("root"), "path", *[F.col(n).alias(c) for c, n in names.items()])


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = leaf([F.when(chosen, lower).otherwise(F.col(c)) if c == "text" else F.col(c) for c in fields])
    rows = manifest(docs.select(*fields), fields, carry={"tampered": tampered})
    out = rows.withColumn("folded_root", fold(F.col("tampered"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: Both trees by recursion over levels, every leaf folded by recursion over its path.
ORACLE = """
WITH RECURSIVE bits AS (
  SELECT list(c ORDER BY k) AS crc FROM (
    SELECT k, list_reduce(list_prepend(k, range(8)), lambda v, z: xor(v >> 1, (v & 1) * 3988292384)) AS c FROM (SELECT unnest(range(256)) AS k))),
h AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
    lambda v, c: xor(v >> 8, crc[(xor(v, c) & 255) + 1]))) AS h FROM documents, bits),
d AS (
  SELECT doc_id, lang, concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head, text,
    CASE WHEN h % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM h),
e AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS tampered FROM d),
n AS (SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS size FROM e),
t(lang, level, i, node, size) AS (
  SELECT lang, 0, i, leaf, size FROM n
  UNION ALL
  SELECT lang, level + 1, i // 8, sha256(string_agg(node, '' ORDER BY i)), any_value((size + 7) // 8) FROM t WHERE size > 1 GROUP BY lang, level, i // 8),
g AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS gi, count(*) OVER () AS gn FROM t WHERE size = 1),
u(level, i, node, size) AS (
  SELECT 0, gi, subroot, gn FROM g
  UNION ALL
  SELECT level + 1, i // 8, sha256(string_agg(node, '' ORDER BY i)), any_value((size + 7) // 8) FROM u WHERE size > 1 GROUP BY level, i // 8),
s AS (
  SELECT lang, level, i, coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
    coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM t WINDOW w AS (PARTITION BY lang, level, i // 8 ORDER BY i)),
v AS (
  SELECT level, i, coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
    coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM u WINDOW w AS (PARTITION BY level, i // 8 ORDER BY i)),
f(rid, lang, level, i, size, acc, proof) AS (
  SELECT rid, lang, 0, i, size, tampered, '' FROM n
  UNION ALL
  SELECT rid, f.lang, f.level + 1, f.i // 8, (size + 7) // 8, sha256(b || acc || a), proof || b || a
  FROM f JOIN s ON f.lang IS NOT DISTINCT FROM s.lang AND f.level = s.level AND f.i = s.i WHERE size > 1),
k(rid, level, i, size, acc, proof) AS (
  SELECT rid, 0, gi, gn, acc, proof FROM f JOIN g ON f.lang IS NOT DISTINCT FROM g.lang WHERE size = 1
  UNION ALL
  SELECT rid, k.level + 1, k.i // 8, (size + 7) // 8, sha256(b || acc || a), proof || b || a FROM k JOIN v ON k.level = v.level AND k.i = v.i WHERE size > 1)
SELECT doc_id, leaf, subroot, z.node AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = z.node AS verified
FROM (SELECT node FROM u WHERE size = 1) z, n JOIN k USING (rid) JOIN g ON n.lang IS NOT DISTINCT FROM g.lang WHERE k.size = 1
"""
