"""BPE with word ends as a tree of concatenations: encodings of neighbouring stretches of a text are joined exactly.

A normalised text is halved down to leaves, wherever the middle falls; leaves are encoded by the library's own split and
merges, and neighbours are joined up the tree. E(a, b), the encoding of a stretch, is that of the stretch as a text of its
own, but that a word which goes on beyond b has no word end yet. A join re-encodes a window around the boundary, first
from white space to white space where that is near, else some tokens of each side and then twice as many each time, until
both sides agree exactly: each edge of the window is

* the stretch's own end, or a place where a match of the split pattern ends whatever stands around it (white space on
  either side, a digit on either side, or a change between letters and other characters, unless the latter end in an
  apostrophe, which may begin a contraction), or
* inside a run of letters or of others, four of the same class on both sides, with the window's outermost token equal to
  the side's own there. The merges choose by rank and then by place, so a sequence whose neighbouring tokens each
  stay apart when merged by themselves is the encoding; neighbours within an encoding do, and the equal token keeps them.

Texts above `part_chars` are halved over tasks too: their normalised parts are rows that any executor encodes, and one
task per text joins the parts by the same windows. Decoding concatenates tokens up a tree of halves.

Cases: null and empty texts have no tokens; added tokens in a text become their ids, as in the library's plain call, and
part the text; a text without white space is a word of any length; repeated rows are texts each; an empty table gives
an empty table; columns beside the text pass through, clashing names of the new columns excepted, which are replaced.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread, staged, table, utf8

#: Characters (or ids, in decoding) up to which a stretch is not halved.
LEAF = 1 << 9
#: Characters within which the first window of a join reaches for white space on both sides.
NEAR = 64
#: Tokens of each side in the next window, where there is none.
FIRST_WINDOW = 2
#: Characters of one class that must stand on both sides of an edge within a run; contractions have three.
RUN = 4
#: Characters up to which a text is encoded by one task.
PART_CHARS = 1 << 16
#: Words whose ids a Python worker remembers, and the characters of the longest one.
CACHED_WORDS, LONGEST_CACHED = 200_000, 200


@lru_cache(maxsize=2)
def codec(path: str) -> "WordBpe":
    return WordBpe(path)


class _Remembered(dict):
    """make(key) for each key; those of up to LONGEST_CACHED characters are kept until there are too many."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= LONGEST_CACHED:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[key] = value
        return value


class WordBpe:
    """A `tokenizers` model of BPE with word ends, whose pre-tokenizer drops white space."""

    def __init__(self, path: str, leaf: int = LEAF, first_window: int = FIRST_WINDOW):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        # the same merges for words that go on beyond their stretch
        self.open_model = models.BPE(model["vocab"], [tuple(m) for m in model["merges"]])
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.adding = re.compile("(" + "|".join(re.escape(x) for x in self.added) + ")") if self.added else None
        self.names = [self.tokenizer.id_to_token(k) or "" for k in range(self.tokenizer.get_vocab_size())]
        self.size_of = [len(x) - (len(suffix) if x.endswith(suffix) and len(x) > len(suffix) else 0) for x in self.names]
        self.leaf, self.first_window = leaf, first_window
        self._probe = [(k, pre_tokenizers.Split(Regex(p), "removed")) for k, p in (("S", r"\s"), ("L", r"\p{L}"), ("N", r"\p{N}"))]
        self._kinds: dict[str, str] = {}
        self._chunks = _Remembered(self._chunk_ids)

    @staticmethod
    def _ids(model, words: list[str]) -> bytes:
        ids = [t.id for w in words for t in model.tokenize(w)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _split(self, s: str) -> list[str]:
        return [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(s)]

    def _chunk_ids(self, s: str) -> bytes:
        """The ids of what stands between spaces."""
        # one word of ASCII letters is its own split and its own bytes
        return self._ids(self.tokenizer.model, [s] if s.isascii() and s.isalpha() else self._split(s))

    def kind(self, c: str) -> str:
        """Space, letter, number or other, by the library's own patterns."""
        known = self._kinds.get(c)
        if known is None:
            known = self._kinds[c] = next((k for k, p in self._probe if not p.pre_tokenize_str(c)), "O")
        return known

    def hard(self, x: str, y: str) -> bool:
        """Whether a match of the split always ends between characters x and y."""
        a, b = self.kind(x), self.kind(y)
        if a == b:
            return a in "SN"
        return not (x == "'" and b == "L")

    def segments(self, text: str) -> list[tuple[int | None, str]]:
        """(added id, "") and (None, normalised stretch) in order."""
        pieces = self.adding.split(text) if self.adding else [text]
        return [(self.added[x], "") if k % 2 else (None, self.normalised(x)) for k, x in enumerate(pieces) if x]

    def normalised(self, s: str) -> str:
        """The library's normal form; of ASCII, which only lower case and white space change, without white space at the ends."""
        if s.isascii():
            return b" ".join(s.encode().lower().split()).decode()
        return self.tokenizer.normalizer.normalize_str(s)

    def encode(self, text: str) -> np.ndarray:
        parts = [np.array([own], dtype="<u4") if own is not None else self.tree(s, 0, len(s)) for own, s in self.segments(text)]
        return np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")

    def fragment(self, s: str, a: int, b: int) -> np.ndarray:
        """E(a, b) by the library. Normalised white space is one space, where every match ends."""
        chunks = s[a:b].split(" ")
        last = b""
        if chunks[-1] and b < len(s) and not self.hard(s[b - 1], s[b]):
            words = self._split(chunks.pop())
            last = self._ids(self.tokenizer.model, words[:-1]) + self._ids(self.open_model, words[-1:])
        return np.frombuffer(b"".join(map(self._chunks.__getitem__, chunks)) + last, dtype="<u4")

    def tree(self, s: str, a: int, b: int) -> np.ndarray:
        """E(a, b) from those of the halves."""
        if b - a <= self.leaf:
            return self.fragment(s, a, b) if b > a else np.zeros(0, dtype="<u4")
        mid = (a + b) // 2
        return self.join(s, a, mid, b, self.tree(s, a, mid), self.tree(s, mid, b))

    def join(self, s: str, a: int, mid: int, b: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """E(a, b) from E(a, mid) and E(mid, b)."""
        if self.hard(s[mid - 1], s[mid]):
            return np.concatenate((left, right))
        k = 0
        while True:
            lo, n_left = self._edge(s, mid, a, left, k, -1)
            hi, n_right = self._edge(s, mid, b, right, k, 1)
            k = k * 2 or self.first_window
            if lo is None or hi is None:
                continue
            inner = self.fragment(s, lo, hi)
            if lo != a and not self.hard(s[lo - 1], s[lo]) and not (self._within(s, a, lo, b) and inner[0] == left[len(left) - n_left]):
                continue
            if hi != b and not self.hard(s[hi - 1], s[hi]) and not (self._within(s, a, hi, b) and inner[-1] == right[n_right - 1]):
                continue
            return np.concatenate((left[:len(left) - n_left], inner, right[n_right:]))

    def _within(self, s: str, a: int, at: int, b: int) -> bool:
        """Whether `at` lies inside a run of letters or others, RUN characters from its ends."""
        if at - RUN < a or at + RUN > b:
            return False
        kinds = {self.kind(c) for c in s[at - RUN:at + RUN]}
        return kinds == {"L"} or kinds == {"O"}

    def _edge(self, s: str, mid: int, end: int, tokens: np.ndarray, k: int, way: int) -> tuple[int | None, int]:
        """(place, tokens between it and mid): the k-th token's far edge, or the next one's that is an edge of characters;
        for k = 0 that of the word's end, if it lies within NEAR characters."""
        if k == 0:
            at = s.rfind(" ", max(end, mid - NEAR), mid) + 1 if way < 0 else s.find(" ", mid, min(end, mid + NEAR))
            if at <= 0:
                return None, 0
            owed, n = len((s[at:mid] if way < 0 else s[mid:at]).encode()), 0
            while owed > 0:
                owed -= self.size_of[tokens[-1 - n if way < 0 else n]]
                n += 1
            return at, n
        at, n, owed = mid, 0, 0
        while n < len(tokens) and (n < k or owed):
            owed += self.size_of[tokens[-1 - n if way < 0 else n]]
            n += 1
            while owed > 0:
                c = s[at - 1 if way < 0 else at]
                at += way
                if self.kind(c) != "S":
                    owed -= len(c.encode())
        return (end, n) if n == len(tokens) else (at, n)

    def join_parts(self, parts: list[str], ids: list[np.ndarray]) -> np.ndarray:
        """The encoding of a text from those of its consecutive parts."""
        s = "".join(parts)
        at = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).tolist()

        def up(i: int, j: int) -> np.ndarray:
            if j - i == 1:
                return ids[i]
            m = (i + j) // 2
            return self.join(s, at[i], at[m], at[j], up(i, m), up(m, j))

        return up(0, len(parts))

    def decode(self, ids: np.ndarray) -> str:
        """The tokens of ids with a space between them, as the library gives them without a decoder."""
        if len(ids) <= self.leaf:
            names = self.names
            return " ".join([names[i] for i in ids.tolist()])
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + " " + self.decode(ids[mid:])


def _new_columns(ids_col: str, decoded_col: str | None) -> dict:
    return {ids_col: F.lit(b""), "n_tokens": F.lit(0).cast("long")} | ({decoded_col: F.lit("")} if decoded_col else {})


def _arrays(own: WordBpe, ids: list[np.ndarray], decoded: bool) -> list[pa.Array]:
    cols = [pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64())]
    return [*cols, *([pa.array([own.decode(x) for x in ids], pa.string())] if decoded else [])]


def _long_texts(docs: DataFrame, path: str, text_col: str, ids_col: str, decoded_col: str | None, part_chars: int) -> DataFrame:
    """Rows with long texts, encoded in parts by whichever tasks, the parts joined by one task per text."""
    whole = staged(docs.withColumn("__ll_key", F.monotonically_increasing_id()), "long-texts")

    def cut(batches):
        own = codec(path)
        for batch in batches:
            for key, data in zip(batch.column("__ll_key").to_pylist(), batch.column("__ll_text")):
                rows, seq = [], 0
                for n, (added, s) in enumerate(own.segments(data.as_py().decode("utf-8", "replace"))):
                    for a in range(0, max(1, len(s)), part_chars):
                        rows.append({"key": key, "segment": n, "seq": seq, "added": added, "part": s[a:a + part_chars], "after": s[a + part_chars:a + part_chars + 1]})
                        seq += 1
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("key", pa.int64()), ("segment", pa.int32()), ("seq", pa.int32()), ("added", pa.int64()), ("part", pa.string()), ("after", pa.string())]))

    def code(batches):
        own = codec(path)
        for batch in batches:
            ids = []
            for added, part, after in zip(*(batch.column(c).to_pylist() for c in ("added", "part", "after"))):
                x = np.array([added], dtype="<u4") if added is not None else own.tree(part + after, 0, len(part))
                ids.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], names=[*batch.schema.names, "ids"])

    def join(parts: pa.Table) -> pa.Table:
        own = codec(path)
        rows = sorted(parts.to_pylist(), key=lambda r: r["seq"])
        out, at = [], 0
        while at < len(rows):
            stop = next((k for k in range(at, len(rows)) if rows[k]["segment"] != rows[at]["segment"]), len(rows))
            ids = [np.frombuffer(r["ids"], dtype="<u4") for r in rows[at:stop]]
            out.append(ids[0] if stop - at == 1 else own.join_parts([r["part"] for r in rows[at:stop]], ids))
            at = stop
        new = _arrays(own, [np.concatenate(out)], decoded_col is not None)
        return pa.table([pa.array([rows[0]["key"]], pa.int64()), *new], names=["__ll_key", ids_col, "n_tokens", *([decoded_col] if decoded_col else [])])

    parts = whole.select("__ll_key", utf8(text_col).alias("__ll_text")).mapInArrow(cut, "key long, segment int, seq int, added long, part string, after string")
    coded = parts.repartition(parts.sparkSession.sparkContext.defaultParallelism, "key", "seq").mapInArrow(code, "key long, segment int, seq int, added long, part string, after string, ids binary")
    schema = f"__ll_key long, `{ids_col}` binary, n_tokens long" + (f", `{decoded_col}` string" if decoded_col else "")
    return whole.join(coded.groupBy("key").applyInArrow(join, schema), "__ll_key").drop("__ll_key")


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "token_ids", decoded_col: str | None = None, part_chars: int = PART_CHARS) -> DataFrame:
    """docs with ids_col: the ids as little-endian unsigned 32-bit integers, and n_tokens; with decoded_col, if given,
    what decode() gives for them. Texts of at most part_chars characters are not shuffled; docs is read twice."""
    base = docs.drop(*_new_columns(ids_col, decoded_col))
    size = F.coalesce(F.char_length(text_col), F.lit(0))
    short = base.where(size <= part_chars).withColumn("__ll_text", utf8(text_col))
    out_schema = base.withColumns(_new_columns(ids_col, decoded_col)).schema

    def run(batches):
        own = codec(path)
        for batch in batches:
            ids = [own.encode(x.as_py().decode("utf-8", "replace")) for x in batch.column("__ll_text")]
            keep = [k for k, n in enumerate(batch.schema.names) if n != "__ll_text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], *_arrays(own, ids, decoded_col is not None)], names=[f.name for f in out_schema])

    long = _long_texts(base.where(size > part_chars), path, text_col, ids_col, decoded_col, part_chars)
    return short.mapInArrow(run, out_schema).unionByName(long)


def decode(tokens: DataFrame, path: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """tokens with out_col, the decoded text of ids_col; null ids are none."""
    base = tokens.drop(out_col)

    def run(batches):
        own = codec(path)
        for batch in batches:
            texts = [own.decode(np.frombuffer(x or b"", dtype="<u4")) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out_col])

    return base.mapInArrow(run, base.withColumn(out_col, F.lit("")).schema)


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = encode(docs, public_tokenizers.path("word_bpe_49k.json"), decoded_col="decoded")
    return out.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
