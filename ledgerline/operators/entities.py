"""Names of a table found in texts by an automaton: all occurrences in one pass of a text, the longest ones kept.

Names are compiled to an Aho-Corasick automaton of at most `chunk_bytes` of names, which bounds what is broadcast; texts stream
through it in Arrow batches. A table of more names has several automata: texts are then read once for each, only the
places found are shuffled, by row.
"""

from __future__ import annotations

import pickle

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

#: UTF-8 bytes of the names of one automaton (some 40 bytes of memory each).
CHUNK_BYTES = 1 << 20
MENTIONS = "array<struct<start: int, end: int, entity: bigint>>"
_KIND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("entity", pa.int64())]))


def folded(c: Column) -> Column:
    """Text as names are compared: A-Z lower-cased, null as empty."""
    return F.translate(F.coalesce(c, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_short_forms(entities: DataFrame, id_col: str, name_col: str, suffix: str, least: int = 2) -> DataFrame:
    """(id, name) of entities and of their names without `suffix`, where `least` characters are left."""
    short = F.when(F.endswith(name_col, F.lit(suffix)), F.expr(f"left(`{name_col}`, char_length(`{name_col}`) - {len(suffix)})"))
    names = F.array_compact(F.array(F.col(name_col), F.when(F.char_length(short) >= least, short)))
    return entities.select(id_col, F.explode(names).alias(name_col))


def longest_first(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (start, end, entity) those kept from left to right: at each place the longest, then the smallest entity; none overlap."""
    out, upto = [], -1
    for start, end, entity in sorted(found, key=lambda m: (m[0], -m[1], m[2])):
        if start >= upto:
            out.append((start, end, entity))
            upto = end
    return out


def _automata(entities: DataFrame, id_col: str, name_col: str, chunk_bytes: int):
    """(how many, pickled automaton) one after the other, each of about chunk_bytes of names. A name of several entities is that
    of the smallest."""
    names = entities.select(folded(F.col(name_col)).alias("name"), F.col(id_col).cast("long").alias("id")).where("name <> '' AND id IS NOT NULL")
    names = names.groupBy("name").agg(F.min("id").alias("id"))
    names = checkpointed(names)
    size = names.agg(F.sum(F.octet_length("name"))).first()[0] or 0
    chunks = -(-size // chunk_bytes)
    for k in range(chunks):
        own = ahocorasick.Automaton()
        for r in names.where(F.pmod(F.xxhash64("name"), F.lit(chunks)) == k).toLocalIterator():
            own.add_word(r.name, (len(r.name), r.id))
        if len(own):
            own.make_automaton()
        yield chunks, pickle.dumps(own) if len(own) else None


def mentions(docs: DataFrame, entities: DataFrame, text_col: str = "text", id_col: str = "entity", name_col: str = "name", out_col: str = "mentions", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs with out_col: the places (start and end in characters, from 0) of the entities' names in the text, in order and without
    overlap: from left to right, at each place the longest name, then the entity with the smallest id. Case of A-Z does not count.

    Null and empty texts have none, nor have names that are null or empty; an empty table of entities finds nothing. What is
    broadcast is one automaton at a time.
    """
    spark = docs.sparkSession
    base = docs.drop(out_col)
    none = F.array().cast(MENTIONS)
    def finder(shared, cols: list[str], keep_all: bool):
        def run(batches):
            own = pickle.loads(shared.value)
            for batch in batches:
                out = []
                for text in batch.column("__text").to_pylist():
                    found = [(end + 1 - n, end + 1, entity) for end, (n, entity) in own.iter(text)]
                    out.append([dict(zip(("start", "end", "entity"), m)) for m in (found if keep_all else longest_first(found))])
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in range(batch.num_columns) if batch.schema.names[c] != "__text"], pa.array(out, _KIND)], names=[*cols, out_col])

        return run

    context = spark.sparkContext
    rows = texts = found = None
    for chunks, one in _automata(entities, id_col, name_col, chunk_bytes):
        if chunks == 1:
            schema = base.withColumn(out_col, none).schema
            return base.withColumn("__text", folded(F.col(text_col))).mapInArrow(finder(context.broadcast(one), base.columns, False), schema)
        if rows is None:
            rows = checkpointed(base.withColumn("__row", F.monotonically_increasing_id()))
            texts = rows.select("__row", folded(F.col(text_col)).alias("__text"))
        if one:
            shared = context.broadcast(one)
            part = checkpointed(texts.mapInArrow(finder(shared, ["__row"], True), f"__row long, `{out_col}` {MENTIONS}").where(F.size(out_col) > 0))
            shared.destroy()  # the places are written
            found = part if found is None else found.unionByName(part)
    if found is None:
        return base.withColumn(out_col, none)
    # longest_first() over what all automata found in a row
    order = F.array_sort(F.transform(F.flatten(F.collect_list(out_col)), lambda m: F.struct(m["start"].alias("start"), (-m["end"]).alias("back"), m["entity"].alias("entity"))))
    gathered = found.groupBy("__row").agg(order.alias("__all"))
    step = lambda acc, m: F.when((F.size(acc) == 0) | (m["start"] >= F.element_at(acc, -1)["end"]), F.array_append(acc, F.struct(m["start"].alias("start"), (-m["back"]).alias("end"), m["entity"].alias("entity")))).otherwise(acc)
    kept = gathered.select(F.col("__row").alias("__r"), F.when(F.size("__all") > 0, F.aggregate("__all", none, step)).alias("__kept"))
    out = rows.join(kept, F.col("__row") == F.col("__r"), "left")
    return out.select(*[F.col(f"`{c}`") for c in base.columns], F.coalesce("__kept", none).alias(out_col))


def scope(found: Column, foreign: Column) -> Column:
    """What a text is about: its only entity; null without any, with several, or with one of the `foreign` ids (an array)."""
    ids = F.array_distinct(F.transform(found, lambda m: m["entity"]))
    return F.when((F.size(ids) == 1) & ~F.arrays_overlap(ids, foreign), ids[0])
