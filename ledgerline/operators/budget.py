"""Files of a group's members within a compressed size: the most that fits, found by compressing, not by adding up sizes."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Compression of the files: gzip at the usual level.
LEVEL, GZIP = 6, 31


def within_gzip(df: DataFrame, group: str, order: list[Column], line: str, budget: int) -> DataFrame:
    """(group, file, members, kept, dropped, bytes): per group a gzip file of the lines of its members, each followed by a line feed,
    in `order`, as many from the first on as compress to at most `budget` bytes; the others, last ones first, are dropped.

    Every prefix is judged by its real compressed size: the stream is copied and finished after each member. What a stream
    has put out never shrinks, so once that exceeds the budget no longer prefix fits and the rest of the group is only counted.
    A group streams through one task in order and is never held: memory is that of the file and the stream.

    Lines that are null count as members and are empty lines; a group whose first line does not fit has an empty file (null)
    and keeps none; null groups are one; groups are as many as there are files.
    """
    kind = df.schema[group].dataType.simpleString()
    rows = df.repartition(group).sortWithinPartitions(F.col(group), *order).select(group, F.coalesce(F.col(line), F.lit("")).cast("binary").alias("__line"))
    schema = pa.schema([("members", pa.int64()), ("kept", pa.int64()), ("file", pa.binary())])

    def run(batches):
        known, started = None, False
        stream = out = best = None
        members = kept = 0
        full = False
        group_type = None

        def row() -> pa.RecordBatch:
            cols = [pa.array([known], group_type), *[pa.array([v], f.type) for v, f in zip((members, kept, best), schema)]]
            return pa.RecordBatch.from_arrays(cols, names=[group, *schema.names])

        for batch in batches:
            group_type = batch.column(group).type
            for g, data in zip(batch.column(group).to_pylist(), batch.column("__line").to_pylist()):
                if not started or g != known:
                    if started:
                        yield row()
                    known, started, full = g, True, False
                    stream, out, best, members, kept = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), bytearray(), None, 0, 0
                members += 1
                if full:
                    continue
                out += stream.compress(data + b"\n")
                if len(out) > budget:
                    full, stream = True, None
                    continue
                whole = bytes(out) + stream.copy().flush()
                if len(whole) <= budget:
                    best, kept = whole, members
        if started:
            yield row()

    found = rows.mapInArrow(run, f"`{group}` {kind}, members long, kept long, file binary")
    return found.select(group, "file", "members", "kept", (F.col("members") - F.col("kept")).alias("dropped"), F.coalesce(F.octet_length("file"), F.lit(0)).cast("long").alias("bytes"))
