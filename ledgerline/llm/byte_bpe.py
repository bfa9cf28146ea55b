"""Byte-level BPE as a monoid: encodings of neighbouring stretches of text can be joined exactly.

A text is halved down to leaves, leaves are encoded, and neighbours are joined up the tree. A join re-encodes a
window around the boundary and keeps all tokens outside it. A window's edge is one of two kinds:

* hard: a place where the split pattern always ends a match, whatever stands around it. Between characters of the
  classes space (S), letter (L), number (N), other (O) that holds for nonspace|S, L|N, N|L, L|O, N|O, O|N, and O|L
  unless the O is an apostrophe (contractions). Tokens never cross such a place and don't depend on the other side.
* soft: inside a run of one class, a token boundary at which the two tokens that meet are what the merges give for
  their own bytes. A token sequence of a match whose adjacent pairs all have this property is its encoding.

The window grows (doubles) until both edges are proven or the whole of a side is in it. Decoding concatenates the
tokens' bytes up the tree of halves.

Cases: null and empty texts have no tokens; special-token strings are ordinary text; a text of any length
is handled by its own task in memory proportional to it; other columns pass through.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread, table, trimmed, utf8

#: Characters (or ids, in decoding) up to which a part is not halved.
LEAF = 1 << 8
#: Characters in which a hard edge is looked for at first; more bytes than any token has.
WINDOW = 256


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> "ByteBpe":
    return ByteBpe(path, pattern)


class ByteBpe:
    def __init__(self, path: str, pattern: str, leaf: int = LEAF, window: int = WINDOW):
        import regex
        import tiktoken

        table = ranks(path)
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.leaf, self.window = leaf, window
        self.bytes_of = [b""] * (max(table.values()) + 1)
        for token, n in table.items():
            self.bytes_of[n] = token
        self.size_of = np.array([len(x) for x in self.bytes_of], dtype=np.int64)
        self._class = [(k, regex.compile(p)) for k, p in (("S", r"\s"), ("L", r"\p{L}"), ("N", r"\p{N}"))]
        self._kinds: dict[str, str] = {}

    def kind(self, c: str) -> str:
        known = self._kinds.get(c)
        if known is None:
            known = self._kinds[c] = next((k for k, p in self._class if p.match(c)), "O")
        return known

    def hard(self, a: str, b: str) -> bool:
        """Whether a match of the pattern always ends between characters a and b."""
        x, y = self.kind(a), self.kind(b)
        if x == "S" or x == y:
            return False
        return not (x == "O" and y == "L" and a == "'")

    def encode(self, text: str) -> np.ndarray:
        return self._tree(text, 0, len(text))

    def _tree(self, text: str, a: int, b: int) -> np.ndarray:
        if b - a <= self.leaf:
            return np.array(self.encoding.encode_ordinary(text[a:b]), dtype=np.uint32)
        mid = (a + b) // 2
        return self.join(text, a, mid, b, self._tree(text, a, mid), self._tree(text, mid, b))

    def join(self, text: str, a: int, mid: int, b: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Tokens of text[a:b] from those of text[a:mid] and text[mid:b]."""
        if not len(left) or not len(right):
            return np.concatenate((left, right))
        if self.hard(text[mid - 1], text[mid]):
            return np.concatenate((left, right))
        width = self.window
        while True:
            edges = self._left_edge(text, a, mid, left, width), self._right_edge(text, mid, b, right, width)
            width *= 2
            if None in edges:
                continue
            (lo, n_left, soft_left), (hi, n_right, soft_right) = edges
            inner = np.array(self.encoding.encode_ordinary(text[lo:hi]), dtype=np.uint32)
            stable = len(inner) and (not soft_left or self._pair(left[n_left - 1], inner[0])) and (not soft_right or self._pair(inner[-1], right[n_right]))
            if stable or (lo == a and hi == b):
                return np.concatenate((left[:n_left], inner, right[n_right:]))

    def _pair(self, x: int, y: int) -> bool:
        """Whether the merges keep tokens x and y apart."""
        return self.encoding._encode_single_piece(self.bytes_of[x] + self.bytes_of[y]) == [x, y]

    def _left_edge(self, text: str, a: int, mid: int, left: np.ndarray, width: int) -> tuple[int, int, bool] | None:
        """(place in the text, tokens of left before it, whether soft); None if the window must grow."""
        stop = max(a, mid - width)
        for p in range(mid - 1, stop, -1):
            if self.hard(text[p - 1], text[p]):
                return p, len(left) - self._tokens_of(left[::-1], len(text[p:mid].encode())), False
        if stop == a:
            return a, 0, False
        return self._soft(text, mid, left, stop, -1, a)

    def _right_edge(self, text: str, mid: int, b: int, right: np.ndarray, width: int) -> tuple[int, int, bool] | None:
        stop = min(b, mid + width)
        for p in range(mid + 1, stop):
            if self.hard(text[p - 1], text[p]):
                return p, self._tokens_of(right, len(text[mid:p].encode())), False
        if stop == b:
            return b, len(right), False
        return self._soft(text, mid, right, stop, 1, b)

    def _tokens_of(self, tokens: np.ndarray, n_bytes: int) -> int:
        """How many of the first tokens make up n_bytes."""
        k = n = 0
        while n < n_bytes:
            n += int(self.size_of[tokens[k]])
            k += 1
        return k

    def _soft(self, text: str, mid: int, tokens: np.ndarray, stop: int, way: int, end: int) -> tuple[int, int, bool] | None:
        """The first token boundary at or beyond `stop` that is one of characters, if all from mid to four characters
        beyond it are of one class: then no match begins or ends near the edge."""
        kind = self.kind(text[mid - 1 if way < 0 else mid])
        if any(self.kind(c) != kind for c in set(text[min(stop, mid):max(stop, mid)])):
            return None
        seen = tokens[::-1] if way < 0 else tokens
        at, n_at, n = mid, 0, 0
        for k, token in enumerate(seen, 1):
            n += int(self.size_of[token])
            while n_at < n:
                n_at += len((text[at - 1] if way < 0 else text[at]).encode())
                at += way
            if n_at == n and (at - stop) * way >= 0:
                beyond = text[max(end, at - 4):at] if way < 0 else text[at:min(end, at + 4)]
                between = text[min(at, stop):max(at, stop)] + beyond
                if len(beyond) < 4 or any(self.kind(c) != kind for c in between):
                    return None
                return at, len(tokens) - k if way < 0 else k, True
        return None

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, concatenated up a tree of halves."""
        if len(ids) <= self.leaf:
            table = self.bytes_of
            return b"".join([table[i] for i in ids.tolist()])
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids", decoded_col: str | None = None) -> DataFrame:
    """docs with ids_col: the ids as little-endian unsigned 32-bit integers, and n_tokens; with decoded_col, if given,
    the bytes that decode() gives for those ids, in the same pass over the rows. Nothing is shuffled."""
    base = docs.drop(ids_col, "n_tokens", *([decoded_col] if decoded_col else []))
    plain = base.withColumn("__ll_text", utf8(text_col))
    schema = base.withColumns({ids_col: F.lit(b""), "n_tokens": F.lit(0).cast("long")} | ({decoded_col: F.lit(b"")} if decoded_col else {})).schema

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            # texts one at a time: a batch's ids are kept as bytes only
            coded, counts, decoded = [], [], []
            for t in batch.column("__ll_text"):
                ids = own.encode(t.as_py().decode("utf-8", "replace"))
                coded.append(ids.astype("<u4").tobytes())
                counts.append(len(ids))
                if decoded_col:
                    decoded.append(own.decode(ids))
            cols = [batch.column(k) for k, n in enumerate(batch.schema.names) if n != "__ll_text"]
            names = [n for n in batch.schema.names if n != "__ll_text"]
            new = [pa.array(coded, pa.binary()), pa.array(counts, pa.int64()), *([pa.array(decoded, pa.binary())] if decoded_col else [])]
            yield pa.RecordBatch.from_arrays([*cols, *new], names=[*names, ids_col, "n_tokens", *([decoded_col] if decoded_col else [])])

    return plain.mapInArrow(trimmed(run), schema)


def decode(tokens: DataFrame, path: str, pattern: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """tokens with out_col, the decoded bytes, in place of ids_col."""
    base = tokens.drop(out_col)
    schema = base.withColumn(out_col, F.lit(b"")).schema

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            ids = batch.column(ids_col).to_pylist()
            out = pa.array([own.decode(np.frombuffer(x or b"", dtype="<u4")) for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, out_col])

    return base.mapInArrow(trimmed(run), schema)


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256."""
    both = encode(docs, path, pattern, text_col, "__ll_ids", "__ll_decoded")
    return both.withColumns({"ids_sha256": F.sha2("__ll_ids", 256), "decoded_sha256": F.sha2("__ll_decoded", 256)}).drop("__ll_ids", "__ll_decoded")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def sha256_of_ids(ids: list[int]) -> str:
    """The digest of ids as op1 gives it."""
    return hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
