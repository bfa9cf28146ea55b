"""Slot files as a Spark data source: one JSON file per (kind, district, month), read and written in parallel.

    spark.read.format("slots").option("path", root).load()                          a row per item; broken files as rows
    spark.read.format("slots").option("path", root).option("what", "slots").load()  a row per slot, with its counts
    rows.write.format("slots").mode("append").save(root)                            slots whose content changed

Files are named {root}/{kind}/{district}-{yyyymm}.json. Reading lists names on the driver; filters on kind, district and yearMonth are
answered from the names, so other files are not opened. Files are planned newest month first, then by district and kind, into
partitions of about `partitionBytes` each.

A reader makes the columns of the schema that it is given: read_items() and read_catalogue() take those that a caller needs, and a row's
key, which takes the longest, is made for `key` and `arrived` only. A batch holds the rows of as many slots as fit in.

Writing needs a slot's rows in one task (write_slots() deals them so, as lines that Spark's own functions make). A task writes files
under names of its attempt and says so in its commit message; only the driver's commit renames the files of committed attempts, so a
lost or repeated task leaves no slot twice. A slot whose rows, totals and state equal the stored ones keeps its file; in one that
changed, rows keep the day they were first seen and new rows get the day of observedAt.

Cases: an unreadable file is a row with state `broken`; a slot that says it failed is `failed`, one with fewer rows than its total
`partial`; null keys in rows to write are refused; an empty table writes nothing; an empty or absent folder reads as no rows.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

ITEMS = "kind string, district string, yearMonth string, state string, ord int, item map<string,string>, key string, arrived string, cancelled boolean"
SLOTS = "kind string, district string, yearMonth string, state string, count bigint, totalCount bigint, cancelled bigint, observedAt string"
#: Bytes of files that a task reads.
PARTITION_BYTES = 16 << 20
#: Rows of a batch that a reader makes at once.
BATCH_ROWS = 4096
_NAME = re.compile(r"([^/]+)/([^/]+)-(\d{6})\.json$")
_KEYS = ("kind", "district", "yearMonth")
_TESTS = {
    EqualTo: lambda v, w: v == w, GreaterThan: lambda v, w: v > w, GreaterThanOrEqual: lambda v, w: v >= w, LessThan: lambda v, w: v < w, LessThanOrEqual: lambda v, w: v <= w,
    In: lambda v, w: v in w,
}


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it."""
    if path.startswith("file:"):
        path = "file:///" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


_encode = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode
_string = json.encoder.encode_basestring
_decode = json.JSONDecoder(parse_int=str, parse_float=str).decode


def line_of(item: dict) -> str:
    """A row as it stands in a file: keys in order, no spaces."""
    try:
        return "{" + ",".join([_string(k) + ":" + ("null" if v is None else _string(v)) for k, v in sorted(item.items())]) + "}"
    except TypeError:  # values or keys that are no text
        return _encode(item)


def line_column(item: Column) -> Column:
    """line_of() of a map<string,string>. Left to _lines(): the letters of \\u00.., which Spark writes large, and maps that hold a key twice,
    which start with a space here."""
    line = F.to_json(F.map_from_entries(F.sort_array(F.map_entries(item))), {"ignoreNullFields": "false"})
    once = F.size(F.array_distinct(F.map_keys(item))) == F.size(item)
    return F.when(once, line).otherwise(F.concat(F.lit(" "), F.to_json(item, {"ignoreNullFields": "false"})))


def _key(line: str) -> str:
    return hashlib.sha1(line.encode()).hexdigest()[:12]


def key_of(item: dict) -> str:
    return _key(line_of(item))


def is_cancelled(item: dict) -> bool:
    kind, day = item.get("cdealType"), item.get("cdealDay")
    return bool(kind and kind.strip() or day and day.strip())


def read_file(store_: fs.FileSystem, path: str) -> dict | None:
    """A slot's content, values as text; None if there is no file or it is no slot."""
    try:
        with store_.open_input_stream(path) as f:
            slot = _decode(f.read().decode("utf-8"))
        if not {str, type(None)}.issuperset(map(type, chain.from_iterable(map(dict.values, slot["items"])))):
            for x in slot["items"]:
                x |= {k: json.dumps(v) for k, v in x.items() if not isinstance(v, str | None)}
        slot["arrivals"] = dict(slot.get("arrivals") or {})
        slot["count"], slot["totalCount"] = int(slot["count"]), int(slot["totalCount"])
        return slot
    except (OSError, ValueError, KeyError, TypeError, AttributeError):
        return None


def state_of(slot: dict | None) -> str:
    if slot is None:
        return "broken"
    return "failed" if slot.get("ok") is False else "partial" if slot["count"] != slot["totalCount"] else "ok"


@dataclass
class SlotFiles(InputPartition):
    """Files of one task: (kind, district, yearMonth, path)."""

    files: list[tuple[str, str, str, str]]

    def __init__(self, files: list[tuple[str, str, str, str]]):
        super().__init__(0)
        self.files = files


class SlotReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str] | None = None):
        self.path, self.what = options["path"], options.get("what", "items")
        self.schema = _arrow(ITEMS if self.what == "items" else SLOTS, columns)
        self.bytes = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in _KEYS:
                self.filters.append(f)
            else:
                yield f

    def files(self) -> list[tuple[str, str, str, str, int]]:
        """The files that the filters leave, in their order, with their sizes."""
        where, root = store(self.path)
        kinds = [f.value for f in self.filters if isinstance(f, EqualTo) and f.attribute[0] == "kind"]
        folder = f"{root}/{kinds[0]}" if kinds else root
        found = where.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        out = []
        for info in found:
            m = _NAME.search(info.path)
            if info.type != fs.FileType.File or not m or "/_attempts/" in info.path:
                continue
            at = dict(zip(_KEYS, m.groups()))
            if all(_TESTS[type(f)](at[f.attribute[0]], f.value) for f in self.filters):
                out.append((*m.groups(), info.path, info.size or 0))
        return sorted(out, key=lambda x: (-int(x[2]), x[1], x[0]))

    def partitions(self) -> list[SlotFiles]:
        out, size = [], self.bytes
        for *file, n in self.files():
            if size + n > self.bytes or not out:
                out.append(SlotFiles([]))
                size = 0
            out[-1].files.append(tuple(file))
            size += n
        return out or [SlotFiles([])]

    def read(self, partition: SlotFiles) -> Iterator[pa.RecordBatch]:
        return (self._items if self.what == "items" else self._slots)(partition)

    def _opened(self, partition: SlotFiles) -> Iterator[tuple[dict, dict | None]]:
        """Each file's own columns and content, of which one is held at a time."""
        where, _ = store(self.path)
        for kind, district, month, path in partition.files:
            slot = read_file(where, path)
            yield {"kind": kind, "district": district, "yearMonth": month, "state": state_of(slot)}, slot
            del slot

    def _slots(self, partition: SlotFiles) -> Iterator[pa.RecordBatch]:
        rows = []
        for row, slot in self._opened(partition):
            if slot is not None:
                row |= {"count": slot["count"], "totalCount": slot["totalCount"], "observedAt": slot.get("observedAt")}
                if "cancelled" in self.schema.names:
                    row["cancelled"] = sum(map(is_cancelled, slot["items"]))
            del slot
            rows.append(row)
            if len(rows) == BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema=self.schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=self.schema)

    def _items(self, partition: SlotFiles) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for own, slot in self._opened(partition):
            items, arrivals, at = ([None], {}, 0) if slot is None else (slot["items"], slot["arrivals"], 0)
            del slot
            while at < len(items):
                held.append((own, arrivals, at, items[at:at + BATCH_ROWS - n]))
                n, at = n + len(held[-1][3]), at + len(held[-1][3])
                if n == BATCH_ROWS:
                    yield _batch(held, self.schema)
                    held, n = [], 0
            del items
        if held:
            yield _batch(held, self.schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """The rows of held, stretches (own columns, arrivals, place of the first, items) of slots, column by column; the item of a broken slot
    is None."""
    items = [x for *_, own in held for x in own]
    none = np.array([x is None for x in items])
    of = pa.array(np.repeat(np.arange(len(held)), [len(own) for *_, own in held]))
    columns = {c: pa.array([own[c] for own, *_ in held], pa.string()).take(of) for c in (*_KEYS, "state") if c in schema.names}
    if "ord" in schema.names:
        columns["ord"] = pa.array(np.concatenate([np.arange(at, at + len(own), dtype=np.int32) for *_, at, own in held]), mask=none)
    if "item" in schema.names:
        full = [x or {} for x in items]
        ends = pa.array(np.cumsum([0, *map(len, full)], dtype=np.int32), mask=np.append(none, False))
        names, values = chain.from_iterable(full), chain.from_iterable(map(dict.values, full))
        columns["item"] = pa.MapArray.from_arrays(ends, pa.array([*names], pa.string()), pa.array([*values], pa.string()))
    if "cancelled" in schema.names:
        columns["cancelled"] = pa.array([x if x is None else is_cancelled(x) for x in items], pa.bool_())
    if "key" in schema.names or "arrived" in schema.names:
        keys = [x if x is None else key_of(x) for x in items]
        columns["key"] = pa.array(keys, pa.string())
        columns["arrived"] = pa.array([held[i][1].get(k) for i, k in zip(of.to_pylist(), keys)], pa.string())
    return pa.RecordBatch.from_arrays([columns[c] for c in schema.names], schema=schema)


def _arrow(ddl: str, columns: list[str] | None = None) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    known = {c: kinds[k] for c, k in (x.split(" ") for x in ddl.split(", "))}
    return pa.schema([(c, known[c]) for c in columns or known])


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: (slot, attempt's path or None if the content was stored already, rows first seen)."""

    slots: list[tuple[str, str | None, int]]


def _dicts(maps: pa.MapArray) -> list[dict]:
    """A column of maps as dicts; a null map is refused."""
    if maps.null_count:
        raise ValueError("no item")
    ends, start = maps.offsets.to_pylist(), maps.offsets[0].as_py() if len(maps) else 0
    pairs = list(zip(maps.keys.to_pylist(), maps.items.to_pylist()))
    start = 0 if len(pairs) >= (ends[-1] if ends else 0) else start
    return [dict(pairs[a - start:b - start]) for a, b in zip(ends, ends[1:])]


def _lines(batch: pa.RecordBatch) -> list[str]:
    """The lines of a batch's rows: of its items, or as line_column() made them."""
    if "item" in batch.schema.names:
        return list(map(line_of, _dicts(batch.column("item"))))
    made = batch.column("line")
    if made.null_count:
        raise ValueError("no item")
    lines = made.to_numpy(zero_copy_only=False).tolist()
    for k in np.flatnonzero(pc.or_(pc.match_substring(made, "\\u00"), pc.starts_with(made, " "))):
        lines[k] = line_of(json.loads(lines[k]))
    return lines


def _stretches(batches) -> Iterator[tuple[tuple, list[str], int | None]]:
    """(slot, lines, total) of each stretch of a batch's rows that are of one slot; single rows do as well."""
    for batch in batches:
        if not isinstance(batch, pa.RecordBatch):
            yield tuple(batch[c] for c in _KEYS), [line_of(dict(batch["item"]))], batch["totalCount"] if "totalCount" in batch else None
            continue
        lines, keys = _lines(batch), [batch.column(c) for c in _KEYS]
        totals = batch.column("totalCount") if "totalCount" in batch.schema.names else None
        other = [pc.fill_null(pc.not_equal(c[1:], c[:-1]), True).to_numpy(zero_copy_only=False) for c in keys]
        starts = np.flatnonzero(np.any(other, axis=0)) + 1
        for a, b in pairwise([0, *starts.tolist(), len(lines)] if lines else []):
            yield tuple(c[a].as_py() for c in keys), lines[a:b], None if totals is None else totals[b - 1].as_py()


class SlotWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.seen = options["path"], options["observedat"] if "observedat" in options else options["observedAt"]

    def write(self, iterator) -> Written:
        where, root = store(self.path)
        attempt, done = f"{root}/_attempts/{uuid.uuid4().hex}", []

        def flush(slot: tuple, items: list[str], total: int | None) -> None:
            name = "{}/{}-{}.json".format(*slot)
            before = read_file(where, f"{root}/{name}")
            items.sort()
            new = {"kind": slot[0], "district": slot[1], "yearMonth": slot[2], "ok": True, "resultCode": 0, "count": len(items), "totalCount": len(items) if total is None else total}
            if before and state_of(before) != "failed" and [line_of(x) for x in before["items"]] == items and before["totalCount"] == new["totalCount"]:
                done.append((name, None, 0))
                return
            known = {key_of(x) for x in before["items"]} if before else None
            arrivals = {}
            for k in map(_key, items) if before else ():
                day = before["arrivals"].get(k) or (None if k in known else self.seen[:10])
                if day:
                    arrivals[k] = day
            new |= {"observedAt": self.seen, "previousObservedAt": before and before.get("observedAt"), "arrivals": arrivals}
            path = f"{attempt}/{name}"
            where.create_dir(path.rpartition("/")[0], recursive=True)
            head = json.dumps(new, ensure_ascii=False, separators=(",", ":"))[:-1]
            body = ",\n".join(items)
            with where.open_output_stream(path) as f:
                f.write(f'{head},"items":[\n{body}\n]}}\n'.encode())
            done.append((name, path, len(set(arrivals) - (known or set()))))

        slot, items, total = None, [], None
        for here, lines, own_total in _stretches(iterator):
            if here != slot:
                if None in here or not re.fullmatch(r"\d{6}", here[2]):
                    raise ValueError(f"no slot: {here}")
                if slot is not None:
                    flush(slot, items, total)
                    items = []
            slot, total = here, own_total
            items += lines
        if slot is not None:
            flush(slot, items, total)
        return Written(done)

    def commit(self, messages) -> None:
        where, root = store(self.path)
        names = [name for m in messages if m for name, _, _ in m.slots]
        twice = {n for n in names if names.count(n) > 1} if len(set(names)) < len(names) else set()
        if twice:
            self.abort(messages)
            raise ValueError(f"slots in more than one task: {sorted(twice)[:3]}; use write_slots()")
        for m in messages:
            for name, path, _ in m.slots if m else []:
                if path:
                    where.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
                    where.move(path, f"{root}/{name}")
        self._clear(where, root)

    def abort(self, messages) -> None:
        where, _ = store(self.path)
        for m in messages:
            for _, path, _ in m.slots if m else []:
                if path and where.get_file_info(path).type == fs.FileType.File:
                    where.delete_file(path)

    @staticmethod
    def _clear(where: fs.FileSystem, root: str) -> None:
        """Remove folders of attempts that hold no file any more; files of attempts that were lost stay for the operator."""
        info = where.get_file_info(fs.FileSelector(f"{root}/_attempts", recursive=True, allow_not_found=True))
        held = [i.path for i in info if i.type == fs.FileType.File]
        for i in info:
            if i.type == fs.FileType.Directory and i.path.count("/") == root.count("/") + 2 and not any(p.startswith(i.path + "/") for p in held):
                where.delete_dir(i.path)


class SlotSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "slots"

    def schema(self) -> str:
        return SLOTS if self.options.get("what") == "slots" else ITEMS

    def reader(self, schema) -> SlotReader:
        return SlotReader(dict(self.options), schema.fieldNames())

    def writer(self, schema, overwrite: bool) -> SlotWriter:
        if overwrite:
            raise ValueError("slots are replaced one by one as their content changes: use mode('append')")
        return SlotWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make format("slots") known to the session, with filters answered by the source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SlotSource)


def _read(spark: SparkSession, root: str, what: str, ddl: str, columns: tuple[str, ...]) -> DataFrame:
    register(spark)
    own = ", ".join(x for x in ddl.split(", ") if not columns or x.split(" ")[0] in columns)
    return spark.read.format("slots").schema(own).option("path", root).option("what", what).load()


def read_items(spark: SparkSession, root: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """A row per item of the slots under root, with all columns of ITEMS or these."""
    return _read(spark, root, "items", ITEMS, columns)


def read_catalogue(spark: SparkSession, root: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """A row per slot under root: state, counts, cancelled rows; with all columns of SLOTS or these."""
    return _read(spark, root, "slots", SLOTS, columns)


def write_slots(rows: DataFrame, root: str, observed_at: dt.datetime | str) -> None:
    """Write rows (kind, district, yearMonth, item map<string,string> and, if given, totalCount) as slots under root."""
    register(rows.sparkSession)
    if rows.schema["item"].dataType.simpleString() == "map<string,string>":
        rows = rows.select(*_KEYS, line_column(F.col("item")).alias("line"), *[c for c in rows.columns if c == "totalCount"])
    dealt = rows.repartition(*_KEYS).sortWithinPartitions(*_KEYS)
    dealt.write.format("slots").mode("append").option("path", root).option("observedAt", str(observed_at)).save()


def window_months(now: Column, size: int) -> Column:
    """The yyyymm of the `size` months that end with now's, as an array of text."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.date_format(F.add_months(F.trunc(now, "month"), -k), "yyyyMM"))


def plan(catalogue: DataFrame, wanted: DataFrame, now: Column, size: int, refresh: int = 2, grace_days: int = 3) -> DataFrame:
    """(kind, district, yearMonth, state): what to do with each slot of wanted (kind, district) x the window of `size` months, and
    with stored slots outside it. stale: to be read again, as its month is one of the `refresh` newest, or one more in the first
    grace_days of a month; broken: unreadable or failed; partial; missing; frozen: left alone; expired: outside the window.
    """
    fresh = F.when(F.dayofmonth(now) <= grace_days, refresh + 1).otherwise(refresh)
    grid = wanted.select("kind", "district").distinct().select("kind", "district", F.posexplode(window_months(now, size)).alias("age", "yearMonth"))
    grid = grid.select(*_KEYS, (F.col("age") < fresh).alias("again"))
    have = catalogue.select(*_KEYS, F.col("state").alias("__have"))
    both = grid.join(have, list(_KEYS), "full")
    state = (F.when(F.col("again").isNull(), "expired").when(F.col("__have").isNull(), "missing").when(F.col("__have").isin("broken", "failed"), "broken")
             .when(F.col("again"), "stale").when(F.col("__have") == "partial", "partial").otherwise("frozen"))
    return both.select(*_KEYS, state.alias("state"))


def expire(root: str, slots: list[tuple[str, str, str]]) -> int:
    """Delete the files of these slots; how many there were."""
    where, base = store(root)
    n = 0
    for slot in slots:
        path = "{}/{}/{}-{}.json".format(base, *slot)
        if where.get_file_info(path).type == fs.FileType.File:
            where.delete_file(path)
            n += 1
    return n
