"""Benchmark decontamination by a generalised suffix automaton of the benchmark's words.

The automaton of a chunk of items (at most `chunk_words` words, so what a task holds has a fixed bound) is built on
the driver and written to the shared folder as flat arrays. Documents stream their words through it; at each word the
automaton's state and matching length say which windows end there. Items beyond one chunk get automata of their own: a task
takes some 32 MB of texts through one after the other. The documents are read once, nothing is shuffled or broadcast.

A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. A word of
a document inside an occurrence of a window is hit.

Cases: null and empty texts have no words and are clean; items without words match nothing; repeated items
count each; item ids that are null are ignored; other columns pass through; an empty benchmark leaves all clean.
"""

from __future__ import annotations

import hashlib
import pickle
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _NOT_WORD, plain_words, scratch, spread, table, trimmed, utf8
from .token_files import _open as open_file
from .token_files import as_uri

WINDOW = 10
CHUNK_WORDS = 250_000
#: Bytes of texts that a task takes through all automata, if there are several.
GATHERED = 32 << 20


class SuffixAutomaton:
    """Generalised suffix automaton over word ids.

    go: transitions by state; link and length as usual; whole: by state, the items (by number) that have the
    window-long suffix of this state as a window; short: by state, the (words, items) of items that end here.
    """

    def __init__(self, items: list[list[bytes]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.go: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [[self.ids.setdefault(w, len(self.ids)) for w in item] for item in items]
        for words in coded:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self._mark(coded)
        self._flatten()
        self.pairs = np.unique(np.array([a * len(self.ids) + b for words in coded for a, b in zip(words, words[1:])], dtype=np.int64))
        self.singles = any(len(words) == 1 for words in coded)

    def _state(self, length: int, go: dict[int, int], link: int) -> int:
        self.go.append(go)
        self.length.append(length)
        self.link.append(link)
        return len(self.go) - 1

    def _extend(self, last: int, w: int) -> int:
        """The state of the item read so far, with w appended."""
        if w in self.go[last]:
            known = self.go[last][w]
            return known if self.length[known] == self.length[last] + 1 else self._clone(last, w, known)
        new = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and w not in self.go[at]:
            self.go[at][w] = new
            at = self.link[at]
        if at >= 0:
            known = self.go[at][w]
            self.link[new] = known if self.length[known] == self.length[at] + 1 else self._clone(at, w, known)
        return new

    def _clone(self, at: int, w: int, known: int) -> int:
        copy = self._state(self.length[at] + 1, dict(self.go[known]), self.link[known])
        self.link[known] = copy
        while at >= 0 and self.go[at].get(w) == known:
            self.go[at][w] = copy
            at = self.link[at]
        return copy

    def _mark(self, coded: list[list[int]]) -> None:
        whole: list[set[int]] = [set() for _ in self.go]
        self.short: list[tuple[int, tuple[int, ...]] | None] = [None] * len(self.go)
        ends: dict[int, set[int]] = {}
        for n, words in enumerate(coded):
            state = 0
            for k, w in enumerate(words):
                state = self.go[state][w]
                at = state  # where the last `window` words end
                while self.length[self.link[at]] >= self.window if at else False:
                    at = self.link[at]
                if k + 1 >= self.window:
                    whole[at].add(n)
            if 0 < len(words) < self.window:
                ends.setdefault(state, set()).add(n)
        for state, own in ends.items():
            self.short[state] = (self.length[state], tuple(own))
        # the state whose lengths include `window`, for all states at or below it
        self.full: list[int] = [0] * len(self.go)
        self.near: list[int] = [0] * len(self.go)  # next state up the links, itself included, where short items end
        for state in sorted(range(1, len(self.go)), key=self.length.__getitem__):
            up = self.link[state]
            self.full[state] = 0 if self.length[state] < self.window else state if self.length[up] < self.window else self.full[up]
            self.near[state] = state if self.short[state] else self.near[up]
        self.whole = [tuple(x) for x in whole]

    def _flatten(self) -> None:
        """Transitions as sorted numbers, state * words + word, beside the states they lead to; the rest as arrays too:
        12 bytes a transition and 16 a state, where dictionaries take hundreds."""
        n = len(self.ids)
        edges = sorted((state * n + w, to) for state, own in enumerate(self.go) for w, to in own.items())
        self.edge, self.to = array("q", [e for e, _ in edges]), array("i", [t for _, t in edges])
        self.link, self.length, self.full, self.near = (array("i", x) for x in (self.link, self.length, self.full, self.near))
        self.whole = {k: x for k, x in enumerate(self.whole) if x}
        self.short = {k: x for k, x in enumerate(self.short) if x}
        del self.go

    def _next(self, state: int, w: int) -> int | None:
        key = state * len(self.ids) + w
        at = bisect_left(self.edge, key)
        return self.to[at] if at < len(self.edge) and self.edge[at] == key else None

    def hits(self, words: list[bytes], found: set[int]) -> list[tuple[int, int]]:
        """Ranges [from, to) of the words that are hit, merged and in order; found gets the items."""
        if not words or not self.ids:
            return []
        get, n_ids = self.ids.get, len(self.ids)
        code = np.array([get(w, -1) for w in words], dtype=np.int64)
        # a match longer than one word stays within a stretch of word pairs that items have
        known = code >= 0
        if len(self.pairs):
            pair = np.where(known[:-1] & known[1:], code[:-1] * n_ids + code[1:], -1)
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            linked = self.pairs[at] == pair
        else:
            linked = np.zeros(len(code) - 1, dtype=bool)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], linked.astype(np.int8), [0]))))
        stretches = [(a, b + 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if self.shortest <= b + 1 - a]
        if self.singles:
            stretches += [(i, i + 1) for i in np.flatnonzero(known).tolist()]
        out: list[tuple[int, int]] = []
        for a, b in sorted(stretches):
            self._stream(code[a:b].tolist(), a, out, found)
        out.sort()
        merged: list[tuple[int, int]] = []
        for a, b in out:
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged

    @property
    def shortest(self) -> int:
        """Words of the shortest window of two words or more."""
        if not hasattr(self, "_shortest"):
            self._shortest = min([self.window, *(x[0] for x in self.short.values() if x[0] > 1)])
        return self._shortest

    def _stream(self, code: list[int], offset: int, out: list[tuple[int, int]], found: set[int]) -> None:
        step, link, length, window = self._next, self.link, self.length, self.window
        state = n = 0
        for i, w in enumerate(code, offset + 1):
            nxt = step(state, w)
            while nxt is None and state:
                state = link[state]
                n = length[state]
                nxt = step(state, w)
            if nxt is None:
                continue
            state, n = nxt, n + 1
            if n >= window:
                at = self.full[state]
                if at in self.whole:
                    found.update(self.whole[at])
                    out.append((i - window, i))
            near = self.near[state]
            while near:
                size, items = self.short[near]
                if size <= n:
                    found.update(items)
                    out.append((i - size, i))
                near = self.near[link[near]]


def _chunks(benchmark: DataFrame, id_col: str, text_col: str, chunk_words: int) -> Iterator[tuple[list, list[list[bytes]]]]:
    """(item ids, their words), at most about chunk_words words at a time; repeated rows of an item are one."""
    items = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // (2 * chunk_words)))  # a word has two bytes at least
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).orderBy("id").collect()
        yield [r.id for r in rows], [plain_words(r.text.encode()) for r in rows]


def find_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, item_id: str = "item_id", item_text: str = "text", chunk_words: int = CHUNK_WORDS, prefix: str = "") -> DataFrame:
    """docs with `hit_from`, `hit_to` (arrays of word ranges), `cut_from`, `cut_to` (the same as byte ranges), `hit_items`
    (sorted distinct ids as strings), `n_words`; the new names begin with `prefix`."""
    ints = F.array().cast("array<int>")
    new_cols = {"hit_from": ints, "hit_to": ints, "cut_from": ints, "cut_to": ints, "hit_items": F.array().cast("array<string>"), "n_words": F.lit(0).cast("long")}
    new_cols = {prefix + c: x for c, x in new_cols.items()}
    kinds = (*[pa.list_(pa.int32())] * 4, pa.list_(pa.string()), pa.int64())
    new_names = list(new_cols)
    folder, paths = scratch(docs.sparkSession, "automata"), []
    for k, (ids, words) in enumerate(_chunks(benchmark, item_id, item_text, chunk_words)):
        paths.append(f"{folder}/{k:06d}")
        with open_file(as_uri(paths[-1]), True) as f:
            f.write(pickle.dumps((SuffixAutomaton(words, window), [str(i) for i in ids])))

    def run(batches):
        loaded = None, None  # the last automaton, let go with the task
        for held in _gathered(batches, len(paths)):
            texts = [t for batch in held for t in batch.column("__ll_text").to_pylist()]
            rows: list[tuple[list, set]] = [([], set()) for _ in texts]
            words = []
            for n, path in enumerate(paths):
                if loaded[0] != path:
                    loaded = path, _load(path)
                automaton, names = loaded[1]
                for k, data in enumerate(texts):
                    split = plain_words(data)
                    if not n:
                        words.append(len(split))
                    found: set[int] = set()
                    hits = automaton.hits(split, found)
                    if hits:
                        rows[k] = (_union(rows[k][0] + hits) if rows[k][0] else hits, rows[k][1] | {names[i] for i in found})
            at = 0
            for batch in held:
                new = []
                for (hits, items), data, n in zip(rows[at:at + batch.num_rows], texts[at:at + batch.num_rows], words[at:at + batch.num_rows]):
                    starts, stops = [x for x, _ in hits], [y for _, y in hits]
                    new.append((starts, stops, *(_places(data, starts, stops) if hits else ([], [])), sorted(items), n))
                at += batch.num_rows
                cols = [pa.array(x, type=t) for x, t in zip(zip(*new) if new else [[]] * 6, kinds)]
                keep = [k for k, c in enumerate(batch.schema.names) if c != "__ll_text"]
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], *cols], names=[*[batch.schema.names[k] for k in keep], *new_names])

    base = docs.drop(*new_cols)
    return base.withColumn("__ll_text", utf8(text_col)).mapInArrow(trimmed(run), base.withColumns(new_cols).schema)


def _load(path: str) -> tuple[SuffixAutomaton, list[str]]:
    with open_file(as_uri(path), False) as f:
        return pickle.loads(f.read())


def _gathered(batches, automata: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches one by one for one automaton; for several as many as hold GATHERED bytes, as each automaton is loaded anew for them."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if automata == 1 or size >= GATHERED:
            yield held
            held, size = [], 0
    if held:
        yield held


def _union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _places(data: bytes, starts: list[int], stops: list[int]) -> tuple[list[int], list[int]]:
    """The bytes [from, to) of the words of the given ranges and what stands between them."""
    mask = np.frombuffer(data.lower().translate(_NOT_WORD), dtype=np.uint8) != 0x20
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return begin[starts].tolist(), end[np.array(stops, dtype=np.int64) - 1].tolist()


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, max_coverage: float = 0.5, **options) -> DataFrame:
    """docs without the hit spans; documents whose words are hit for more than max_coverage are dropped whole."""
    found = find_hits(docs, benchmark, text_col, window, prefix="__ll_", **options)
    hit = F.aggregate(F.zip_with("__ll_hit_from", "__ll_hit_to", lambda a, b: b - a), F.lit(0), lambda x, y: x + y)
    found = found.where(hit <= F.col("__ll_n_words") * F.lit(max_coverage))

    data = F.col(text_col).cast("binary")
    begin = F.concat(F.array(F.lit(0)), F.col("__ll_cut_to"))
    end = F.concat(F.col("__ll_cut_from"), F.array(F.octet_length(data)))
    # separators are ASCII, so every piece is whole characters
    parts = F.transform(F.arrays_zip(begin.alias("a"), end.alias("b")), lambda x: F.substring(data, x["a"] + 1, x["b"] - x["a"]).cast("string"))
    clean = F.when(F.size("__ll_cut_from") == 0, F.col(text_col)).otherwise(F.array_join(parts, ""))
    return found.withColumn(text_col, clean).select(*[f"`{c}`" for c in docs.columns])


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_hits(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.zip_with("hit_from", "hit_to", lambda a, b: b - a), F.lit(0), lambda x, y: x + y).cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def items_sha256(ids: list) -> str:
    """The digest of a list of item ids, as op10 gives it."""
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
