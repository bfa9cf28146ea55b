"""WARC archives with a two-level capture index.

Pages become WARC/1.1 records, each a gzip member of its own, in files under one folder of the shared store. Equal
payloads of at least `min_bytes` are kept once: the record with the smallest page id is the response, the others are
revisits that name it.

The index has a line per record, keyed by the reversed host and the rest of the URL, then the page id. Lines are sorted
over all records, cut into blocks of `BLOCK_LINES` and compressed. Each index file ends with its sparse directory, the
first key and place of each of its blocks, and as files are ranges of the sort, a row per file completes the directory.
A lookup bisects the files' first keys, then that file's directory, then the lines of one block, and reads the record's
bytes. `resolve` does that for a table of keys in tasks; a read uses it to find the responses that revisits refer to.
A full read takes all blocks in order and reads the archives in ranges; tasks hold READ_BYTES of archives each.

Files are written with pyarrow.fs under names of their own for each attempt; only entries that Spark commits count,
so lost executors and repeated attempts leave nothing double.

Cases: null html is an empty payload; null or hostless URLs have the empty host; null page ids are no key of a
revisit and stay responses; repeated rows are records of their own, under one WARC-Record-ID if their page id is one;
rows with one page id and several payloads are each judged by their own payload; a URL that a header cannot hold as it is
stands percent-encoded there and as it is in a header beside it; an empty table makes an empty archive.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, staged, table
from .token_files import _open, as_uri

MIN_BYTES = 100
BLOCK_LINES = 256
#: Gap up to which neighbouring ranges of a file are read at once, and the most read at once.
GAP, MOST = 64 << 10, 4 << 20
#: Bytes of archives that a task reads, and index blocks that a search keeps.
READ_BYTES, KEPT = 64 << 20, 64
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n"

ENTRIES = "key string, page_id long, url string, type string, file string, offset long, length long"
DIRECTORY = "first_key string, last_key string, file string, offset long, length long, n int, foot long, foot_length long"
FOUND = "key string, page_id long, file string, offset long, length long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


class Archive(NamedTuple):
    """entries: a row per record; directory: a row per index block."""

    root: str
    entries: DataFrame
    directory: DataFrame


def url_key(url: Column) -> Column:
    """Reversed host, `)`, and the rest of the URL without its fragment."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", ""), r"#.*$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def sort_key(key: str, page_id: int | None) -> str:
    """The index's order as text: the URL key, a separator below all others, the page id in fixed width."""
    return f"{key}\x00{-1 if page_id is None else page_id:020d}"


def _record(page_id: int | None, url: str | None, digest: str, payload: bytes | None, n: int, refers_to: int | None, refers_key: str | None) -> bytes:
    """One record; payload is None for a revisit, n the bytes of the full payload."""
    http = HTTP.format(n=n).encode()
    block = http if refers_to is not None else http + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:{f'uuid:{uuid.uuid4()}' if page_id is None else f'page:{page_id}'}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {urllib.parse.quote(url, safe=SAFE)}")
        if lines[-1][17:] != url:
            lines.append(f"X-Page-URL: {json.dumps(url)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"X-Refers-To-Key: {json.dumps(refers_key)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


#: Characters of a URL that a header line keeps as they are.
SAFE = "".join(chr(c) for c in range(0x21, 0x7F))


def parse(record: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(headers in lower case, HTTP header, payload) of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    block = rest[:int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def with_revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, url, payload, n, digest, refers_to, refers_key): payload is null for revisits."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("payload"), F.octet_length(html).cast("long").alias("n"), F.sha2(html, 256).alias("digest"))
    light = staged(base.where((F.col("n") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", "digest", url_key(F.col("url")).alias("key")), "warc-digests")
    least = F.min(F.struct("page_id", "key"))
    first = light.groupBy("digest").agg(least.alias("first"), F.count("*").alias("copies")).where("copies > 1")
    # ids of the revisits only; the join with the pages is by page id and digest, which no hot payload skews
    again = light.join(first, "digest").where("page_id > first.page_id").select("page_id", "digest", F.col("first.page_id").alias("refers_to"), F.col("first.key").alias("refers_key"))
    out = base.join(again.distinct(), ["page_id", "digest"], "left")
    return out.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))


def write(pages: DataFrame, root: str | None = None, min_bytes: int = MIN_BYTES) -> Archive:
    """Write the archives and their index under root."""
    spark = pages.sparkSession
    root = root or scratch(spark, "warc")
    uri = as_uri(root)
    records = with_revisits(pages, min_bytes).withColumn("key", url_key(F.col("url")))

    def put(batches):
        from pyspark import TaskContext

        path, out, at = f"{uri}/archive/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                data = gzip.compress(_record(r["page_id"], r["url"], r["digest"], r["payload"], r["n"], r["refers_to"], r["refers_key"]), 4, mtime=0)
                out = out or _open(path, True)
                out.write(data)
                rows.append({"key": r["key"], "page_id": r["page_id"], "url": r["url"], "type": "response" if r["refers_to"] is None else "revisit", "file": path, "offset": at, "length": len(data)})
                at += len(data)
            yield pa.RecordBatch.from_pylist(rows, schema=_arrow(ENTRIES))
        if out:
            out.close()

    records.mapInArrow(put, ENTRIES).write.parquet(f"{root}/entries")
    entries = spark.read.schema(ENTRIES).parquet(f"{root}/entries")

    def index(batches):
        from pyspark import TaskContext

        path, out, at, lines, rows = f"{uri}/index/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.idx", None, 0, [], []

        def block():
            nonlocal out, at, lines
            data = zlib.compress("\n".join(json.dumps(x, separators=(",", ":")) for x in lines).encode())
            out = out or _open(path, True)
            out.write(data)
            rows.append({"first_key": sort_key(*lines[0][:2]), "last_key": sort_key(*lines[-1][:2]), "file": path, "offset": at, "length": len(data), "n": len(lines)})
            at, lines = at + len(data), []

        for batch in batches:
            for r in batch.to_pylist():
                lines.append([r["key"], r["page_id"], r["type"], r["file"], r["offset"], r["length"]])
                if len(lines) == BLOCK_LINES:
                    block()
        if lines:
            block()
        if out:
            foot = zlib.compress(json.dumps([[r["first_key"], r["offset"], r["length"]] for r in rows]).encode())
            out.write(foot)
            out.close()
            rows = [r | {"foot": at, "foot_length": len(foot)} for r in rows]
        yield pa.RecordBatch.from_pylist(rows, schema=_arrow(DIRECTORY))

    ordered = entries.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    ordered.mapInArrow(index, DIRECTORY).write.parquet(f"{root}/directory")
    return Archive(root, entries, spark.read.schema(DIRECTORY).parquet(f"{root}/directory"))


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def _range(path: str, offset: int, length: int) -> bytes:
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    with store.open_input_file(inner) as f:
        f.seek(offset)
        return f.read(length)


def _ranges(rows: list[tuple[str, int, int]]) -> Iterator[bytes]:
    """The bytes of (file, offset, length) in that order; neighbouring ranges of a file are read together."""
    a = 0
    while a < len(rows):
        file, start, length = rows[a]
        b, end = a + 1, start + length
        while b < len(rows) and rows[b][0] == file and 0 <= rows[b][1] - end <= GAP and rows[b][1] + rows[b][2] - start <= MOST:
            end = rows[b][1] + rows[b][2]
            b += 1
        data = _range(file, start, end - start)
        for _, offset, n in rows[a:b]:
            yield data[offset - start:offset - start + n]
        a = b


def _lines(data: bytes) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(data).decode().split("\n")]


def _files(archive: Archive) -> list[tuple[str, str, int, int]]:
    """(first key, file, place and length of its directory) of the index files in order: a row per task that wrote one."""
    of = archive.directory.groupBy("file").agg(F.min("first_key").alias("first_key"), F.max("foot").alias("foot"), F.max("foot_length").alias("foot_length"))
    return sorted((r.first_key, r.file, r.foot, r.foot_length) for r in of.collect())


class Search:
    """Binary searches of the index: files, then a file's directory, then a block's lines."""

    def __init__(self, files: list[tuple[str, str, int, int]]):
        self.files, self.firsts = files, [f[0] for f in files]
        self.directory = lru_cache(maxsize=KEPT)(lambda k: json.loads(zlib.decompress(_range(*self.files[k][1:]))))
        self.block = lru_cache(maxsize=KEPT)(lambda file, offset, length: _lines(_range(file, offset, length)))

    def lines(self, low: str, high: str) -> Iterator[list]:
        """The lines whose sort keys are from low to below high."""
        k = max(0, bisect.bisect_left(self.firsts, low) - 1)
        while k < len(self.files) and self.firsts[k] < high:
            blocks = self.directory(k)
            b = max(0, bisect.bisect_left(blocks, low, key=lambda x: x[0]) - 1)
            while b < len(blocks) and blocks[b][0] < high:
                lines = self.block(self.files[k][1], *blocks[b][1:])
                at = bisect.bisect_left(lines, low, key=lambda x: sort_key(x[0], x[1]))
                while at < len(lines) and sort_key(lines[at][0], lines[at][1]) < high:
                    yield lines[at]
                    at += 1
                b += 1
            k += 1


def index_lines(archive: Archive) -> DataFrame:
    """All lines of the index, read by the directory's blocks."""
    def run(batches):
        for batch in batches:
            rows = [(r["file"], r["offset"], r["length"]) for r in batch.to_pylist()]
            for data in _ranges(rows):
                lines = _lines(data)
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in lines], t) for k, t in zip((0, 1, 2, 3, 4, 5), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["key", "page_id", "type", "file", "offset", "length"])

    blocks = archive.directory.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset").select("file", "offset", "length")
    return blocks.mapInArrow(run, "key string, page_id long, type string, file string, offset long, length long")


def _read(record: bytes, with_payload: bool) -> dict:
    headers, http, payload = parse(gzip.decompress(record))
    url = json.loads(headers["x-page-url"]) if "x-page-url" in headers else headers.get("warc-target-uri")
    row = {"page_id": _page(headers["warc-record-id"]), "url": url, "record_type": headers["warc-type"], "refers_to": _page(headers.get("warc-refers-to"))}
    if row["record_type"] == "response":
        row |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest(), "refers_key": None}
        if with_payload:
            row["payload"] = payload
    else:  # the block of a revisit is the HTTP header of the full payload
        n = re.search(rb"(?im)^content-length: *(\d+)", http)
        row |= {"payload_bytes": int(n[1]), "payload_digest": headers["warc-payload-digest"].partition(":")[2], "refers_key": json.loads(headers["x-refers-to-key"])}
    return row


def _tasks(archive: Archive) -> int:
    """Tasks for a read of all archives."""
    size = archive.entries.agg(F.sum("length")).first()[0] or 0
    return int(max(1, -(-size // READ_BYTES), min(archive.entries.sparkSession.sparkContext.defaultParallelism, size >> 20)))


def resolve(archive: Archive, wanted: DataFrame) -> DataFrame:
    """FOUND for each row of wanted (key, page_id) that the index has: where its responses are."""
    files = archive.entries.sparkSession.sparkContext.broadcast(_files(archive))

    def run(batches):
        search = Search(files.value)
        for batch in batches:
            rows = []
            for key, page in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id"))):
                low = sort_key(key, page)
                hits = [x for x in search.lines(low, low + "\x01") if x[2] == "response"]
                rows += [{"key": key, "page_id": page, "file": x[3], "offset": x[4], "length": x[5]} for x in hits]
            yield pa.RecordBatch.from_pylist(rows, schema=_arrow(FOUND))

    # neighbours in the index are searched together, so a block is read once or twice
    return wanted.select("key", "page_id").distinct().repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id").mapInArrow(run, FOUND)


def read(archive: Archive, with_payload: bool = False) -> DataFrame:
    """Every record, read from the archives by the index: RECORDS, and the payload of responses if asked for. A revisit
    has the size and digest of its response, which is looked up; where that is missing, those of its own header."""
    schema = RECORDS + ", refers_key string" + (", payload binary" if with_payload else "")

    def records(where: DataFrame, schema: str, tasks: int) -> DataFrame:
        kind = _arrow(schema)

        def run(batches):
            for batch in batches:
                rows = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))))
                yield pa.RecordBatch.from_pylist([_read(x, with_payload) for x in _ranges(rows)], schema=kind)

        return where.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset").select("file", "offset", "length").mapInArrow(run, schema)

    tasks = _tasks(archive)
    every = staged(records(index_lines(archive), schema, tasks), "warc-records")
    found = resolve(archive, every.where("record_type = 'revisit'").select(F.col("refers_key").alias("key"), F.col("refers_to").alias("page_id")))
    first = records(found, RECORDS + ", refers_key string", tasks).groupBy("page_id", "payload_digest").agg(F.first("payload_bytes").alias("first_bytes"))
    first = first.select(F.col("page_id").alias("refers_to"), "payload_digest", "first_bytes")
    out = every.join(first, ["refers_to", "payload_digest"], "left").withColumn("payload_bytes", F.coalesce("first_bytes", "payload_bytes"))
    return out.select(*[f.split()[0] for f in (RECORDS + (", payload binary" if with_payload else "")).split(", ")])


def lookup(archive: Archive, url: str) -> list[dict]:
    """The captures of one URL with their payloads: binary searches and range reads."""
    key = archive.directory.sparkSession.range(1).select(url_key(F.lit(url))).first()[0]
    return [_read(_range(*x[3:]), True) for x in Search(_files(archive)).lines(sort_key(key, None), f"{key}\x01")]


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = write(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
