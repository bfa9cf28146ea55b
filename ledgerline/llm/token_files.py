"""Token-id files: frequency-ranked ids, byte-aligned variable length, control bytes apart from data bytes.

Ids are replaced by their rank by frequency over the whole corpus, so that frequent ids take one byte. Four ranks
share a control byte (two bits each: bytes of the rank less one); data bytes follow in a stream of their own. Decoding
is a lookup of each control byte's four lengths, a running sum and four masked gathers, all in numpy.

File (little-endian): blocks of `head` (magic, documents, ranks, control bytes, data bytes), document ids (int64), their
validity (uint8), ranks per document (int64), control bytes, data bytes. A file holds a range of document ids,
ascending; the file number follows the range. The manifest and the rank table are Parquet beside the files.

Writers put each attempt in a file of its own name and only the manifest, committed by Spark, says which files count:
lost executors and repeated attempts leave no double rows. Files go through pyarrow.fs, to any store it knows.

Cases: null and empty texts have only the end id; null ids come first and keep a null; repeated rows keep a
place each, in the order of their content; an empty table writes no files and reads as an empty table.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, spread, staged, table, utf8

HEAD = "<4sIQQQ"
MAGIC = b"LTK1"
FILE_BYTES = 32 << 20
#: Entries of a generation of a Python worker's word cache, and text encoded at once.
CACHED_WORDS, BATCH_BYTES = 400_000, 16 << 20

#: Bytes of each of the four values of a control byte.
_LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.uint8)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit ranks."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    padded[:len(ranks)] = size - 1
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    used = np.arange(4, dtype=np.uint8)[None, :] < size[:, None]
    return control.astype(np.uint8).tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = _LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    stop = np.cumsum(size, dtype=np.int64)
    start = stop - size
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    out = raw[start].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(size > k)
        out[longer] |= raw[start[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class _Cache(dict):
    """make(key) for each key, kept in two generations: a full one becomes the old one, which is looked into first."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class WordEncoder:
    """Ids of texts by a `tokenizers` model that normalises and splits at white space.

    White space never lies within a word of such a model, so the ids of a text are those of its chunks in order. The
    chunks of a batch are reduced to distinct ones; those of ASCII and Latin letters are split by the
    tokenizer's own pattern and each word goes to its BPE model (words are cached), any other goes through the whole
    tokenizer. The texts' ids are then gathered by numpy.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        parts = model["pre_tokenizer"]["pretokenizers"]
        # Arrow splits at these, the tokenizer doesn't; added tokens may stand within a word, and only as written
        self.odd = "|".join(["[\x1c-\x1f]", *("(?i:" + re.escape(x["content"]) + ")" for x in model.get("added_tokens", []))])
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in parts if p["type"] == "Split"))
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.raw = [np.array(k, dtype=self.dtype).tobytes() for k in range(size)]
        self.words = _Cache(self._word, CACHED_WORDS)
        # the printable stand-ins of bytes in byte-level vocabularies
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        other = iter(range(0x100, 0x200))
        self.stand_in = {b: chr(b if b in plain else next(other)) for b in range(256)}
        self.latin = re.compile(r"[\x00-\u024f]*")

    def encode(self, text: str) -> bytes:
        return self.encode_batch(pa.array([text.encode()], pa.binary()))[0]

    def encode_batch(self, texts: pa.Array, end: bytes = b"") -> list[bytes]:
        """The ids of UTF-8 texts, `end` after each."""
        out: list[bytes] = []
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(texts):
            n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), BATCH_BYTES, side="right")))
            out += self._some(texts.slice(at, n).cast(pa.string()), end)
            at += n
        return out

    def _some(self, texts: pa.Array, end: bytes) -> list[bytes]:
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        lists = pc.utf8_split_whitespace(pc.ascii_lower(texts))
        coded = pc.dictionary_encode(lists.flatten())
        distinct = [self._chunk(c) for c in coded.dictionary.to_pylist()]
        size = np.array([len(x) for x in distinct], dtype=np.int64) // self.dtype.itemsize
        flat = np.frombuffer(b"".join(distinct), dtype=self.dtype)
        begin = np.cumsum(size) - size
        index = coded.indices.to_numpy(zero_copy_only=False)
        n = size[index]
        upto = np.concatenate(([0], np.cumsum(n)))
        # the ids of each chunk in turn: its beginning among the distinct ids, counted on
        ids = flat[np.repeat(begin[index] - upto[:-1], n) + np.arange(upto[-1])].tobytes() if len(index) else b""
        ends = (upto[lists.offsets.to_numpy() - lists.offsets[0].as_py()] * self.dtype.itemsize).tolist()
        out = [ids[a:b] + end for a, b in zip(ends, ends[1:])]
        for k in np.flatnonzero(odd).tolist():
            out[k] = self._whole(texts[k].as_py()) + end
        return out

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if len(chunk) > 200 or not self.latin.fullmatch(chunk):
            return self._whole(chunk)
        low = (chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk)).lower()
        return self.words[low] if low.isalpha() else b"".join([self.words[w] for w in self.pattern.findall(low)])

    def _word(self, word: str) -> bytes:
        mapped = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.stand_in)
        raw = self.raw
        return b"".join([raw[t.id] for t in self.tokenizer.model.tokenize(mapped)])


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of each text and the end id, as unsigned integers of the encoder's width."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))

    def run(batches):
        own = encoder(path)
        end = np.array([end_id], dtype=own.dtype).tobytes()
        for batch in batches:
            ids = own.encode_batch(batch.column("text"), end)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return plain.mapInArrow(run, "doc_id long, ids binary")


def rank_table(tokens: DataFrame, width: int) -> DataFrame:
    """(id, rank): ids by falling frequency over all rows. Tasks count first; a row per id and task is shuffled."""
    def count(batches):
        seen = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for x in batch.column("ids").to_pylist():
                n = np.bincount(np.frombuffer(x, dtype=f"<u{width}"), minlength=len(seen))
                n[:len(seen)] += seen
                seen = n
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], names=["id", "n"])

    counts = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # one row per id of the vocabulary, whatever the corpus
    return counts.select("id", (F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1).alias("rank"))


def _open(path: str, write: bool):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    if write:
        store.create_dir(inner.rpartition("/")[0], recursive=True)
        return store.open_output_stream(inner, compression=None)
    return store.open_input_stream(inner, compression=None)


def as_uri(path: str) -> str:
    """file:/x, as Hadoop writes it, with the slashes that pyarrow wants."""
    return "file:///" + path[5:].lstrip("/") if path.startswith("file:") else path


def write_files(tokens: DataFrame, ranks: DataFrame, root: str, width: int, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the files under root; the committed manifest (file, path, n_docs, n_tokens, start) is returned."""
    spark = tokens.sparkSession
    total = tokens.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    files = max(1, -(-total // file_bytes), min(spark.sparkContext.defaultParallelism, total >> 20))
    rows = ranks.collect()  # the vocabulary's size at most
    to_rank = np.zeros(max([r.id for r in rows], default=0) + 1, dtype=np.uint32)
    to_rank[[r.id for r in rows]] = [r["rank"] for r in rows]
    shared = spark.sparkContext.broadcast(to_rank)
    uri = as_uri(root)

    def run(batches):
        from pyspark import TaskContext

        file = TaskContext.get().partitionId()
        path, out = f"{uri}/files/part-{file:06d}-{uuid.uuid4().hex}.tok", None
        n_docs = n_tokens = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column("ids").to_pylist()
            counts = np.array([len(x) // width for x in raw], dtype="<i8")
            control, data = pack(shared.value[np.frombuffer(b"".join(raw), dtype=f"<u{width}")])
            ids = batch.column("doc_id")
            out = out or _open(path, True)
            out.write(struct.pack(HEAD, MAGIC, len(raw), int(counts.sum()), len(control), len(data)))
            out.write(np.asarray(ids.fill_null(0).to_numpy(zero_copy_only=False), dtype="<i8").tobytes())
            out.write(np.asarray(ids.is_valid().to_numpy(zero_copy_only=False), dtype=np.uint8).tobytes())
            for part in (counts.tobytes(), control, data):
                out.write(part)
            n_docs, n_tokens = n_docs + len(raw), n_tokens + int(counts.sum())
        if out:
            out.close()
            yield pa.RecordBatch.from_pylist([{"file": file, "path": path, "n_docs": n_docs, "n_tokens": n_tokens}], schema=pa.schema([("file", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    ordered = tokens.repartitionByRange(int(files), "doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(run, "file int, path string, n_docs long, n_tokens long").write.parquet(f"{root}/manifest")
    # one row per file
    manifest = spark.read.schema("file int, path string, n_docs long, n_tokens long").parquet(f"{root}/manifest")
    return manifest.withColumn("start", F.sum("n_tokens").over(Window.orderBy("file")) - F.col("n_tokens"))


def read_files(manifest: DataFrame, ranks: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, in file order within each task."""
    spark = manifest.sparkSession
    rows = ranks.collect()  # the vocabulary's size at most
    to_id = np.zeros(len(rows), dtype=np.uint32)
    to_id[[r["rank"] for r in rows]] = [r.id for r in rows]
    shared = spark.sparkContext.broadcast(to_id)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def blocks(path: str, start: int):
        with _open(path, False) as f:
            while head := f.read(struct.calcsize(HEAD)):
                magic, n, n_ranks, n_control, n_data = struct.unpack(HEAD, head)
                if magic != MAGIC:
                    raise ValueError(f"{path}: not a block of token ids")
                doc = np.frombuffer(f.read(8 * n), dtype="<i8")
                valid = np.frombuffer(f.read(n), dtype=np.uint8).astype(bool)
                counts = np.frombuffer(f.read(8 * n), dtype="<i8")
                ids = shared.value[unpack(f.read(n_control), f.read(n_data), n_ranks)].astype("<u4")
                ends = np.cumsum(counts)
                parts = [ids[b - c:b].tobytes() for b, c in zip(ends.tolist(), counts.tolist())]
                cols = [pa.array(doc, mask=~valid), pa.array(start + ends - counts), pa.array(counts), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array(parts, pa.binary())] if with_ids else [])], names=["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])
                start += n_ranks

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                yield from blocks(path, start)

    files = manifest.select("path", "start", "file")
    n = max(1, manifest.count())
    return files.repartitionByRange(n, "file").select("path", "start").mapInArrow(run, schema)


def token_files(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Write docs as token-id files under root; (manifest, ranks), which read_files() takes."""
    spark = docs.sparkSession
    root = root or scratch(spark, "tokens")
    width = encoder(path).dtype.itemsize
    tokens = staged(encode(docs, path, end_id, id_col, text_col), "token-ids")
    rank_table(tokens, width).coalesce(1).write.parquet(f"{root}/ranks")
    ranks = spark.read.schema("id long, rank int").parquet(f"{root}/ranks")
    return write_files(tokens, ranks, root, width), ranks


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest, ranks = token_files(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), public_tokenizers.path("word_bpe_49k.json"), 2)
    return read_files(manifest, ranks)
