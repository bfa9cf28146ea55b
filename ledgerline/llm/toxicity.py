"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are all three-byte pieces of the words of a text, a space before and after each word; a term's weight is
tf ** 0.7 * idf ** 1.5 and vectors have length 1. Pieces rather than whole words, because an insult in another form
shares pieces with the known ones, while a word that no example has can never be near any (README has both figures).
Every term of every example is indexed. Terms of more than an eighth of the examples are kept as dense rows, all others
as posting lists cut into blocks of examples, with each term's largest weight in each block. A text's bound for a block
is the largest dense product in it plus the product with those maxima; blocks are scored by falling bound, and the
search ends when the next bound is below the k-th best similarity so far, which rises from block to block. So the k
nearest are exact. They vote with their squared similarity; a logistic curve fitted on the examples' own votes, each
without itself, calibrates the vote. The neighbours are the evidence.

Cases: null and empty texts and texts without a term have no neighbours and get the score of that; similarities are
compared to nine digits, ties go to the earlier example; without labelled rows of both classes every score is the share
of toxic labels; texts of any length are read whole, examples too, of which only counts of terms are gathered; other
columns pass through, own output columns are replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _NOT_WORD, scratch, spread, table, trimmed, utf8
from .labelled import arrow_rows, class_counts, fold, picked, platt, weights
from .token_files import _open as open_file
from .token_files import as_uri

NEIGHBOURS = 5
BLOCK = 64
#: Terms of at least this share of the examples are kept dense; texts whose dense products are made at once.
DENSE, AT_ONCE = 1 / 8, 32
#: Bytes of a text whose pieces are counted at once.
PIECE = 1 << 20
TF, IDF = 0.7, 1.5
#: Similarity's weight that stands for no evidence.
PRIOR = 0.1
THRESHOLD = 0.3
#: Differences of similarities that count as none.
SAME = 1e-9

Vector = tuple[np.ndarray, np.ndarray]


def grams(text: bytes) -> Vector:
    """(ascending codes, counts) of the three-byte pieces that have no space in the middle."""
    words = b" " + b" ".join(text.lower().translate(_NOT_WORD).split()) + b" "
    data = np.frombuffer(words, dtype=np.uint8)
    codes, counts = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
    for at in range(0, max(0, len(data) - 2), PIECE):
        part = data[at:at + PIECE + 2].astype(np.int32)
        code = (part[:-2] << 16 | part[1:-1] << 8 | part[2:])[part[1:-1] != 0x20]
        c, n = np.unique(code, return_counts=True)
        codes, back = np.unique(np.concatenate((codes, c)), return_inverse=True)
        counts = np.bincount(back, np.concatenate((counts, n)), minlength=len(codes)).astype(np.int64)
    return codes, counts


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of the ranges [start, start + size), one after the other."""
    upto = np.cumsum(size)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(start - upto + size, size)


class BlockMaxIndex:
    """Unit vectors: dense rows of frequent terms; posting lists in blocks, with maxima, of the others."""

    def __init__(self, vectors: list[Vector], n_terms: int, block: int = BLOCK, dense: float = DENSE):
        self.n, self.block = len(vectors), block
        self.n_blocks = -(-self.n // block)
        term = np.concatenate([t for t, _ in vectors] or [np.zeros(0, np.int32)])
        example = np.repeat(np.arange(self.n, dtype=np.int32), [len(t) for t, _ in vectors])
        weight = np.concatenate([w for _, w in vectors] or [np.zeros(0)])
        often = np.bincount(term, minlength=n_terms) > dense * self.n
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        self.dense = np.zeros((int(often.sum()), self.n_blocks * block))
        own = often[term]
        self.dense[self.row[term[own]], example[own]] = weight[own]
        term, example, weight = term[~own], example[~own], weight[~own]
        order = np.lexsort((example, term))
        term, self.example, self.weight = term[order].astype(np.int64), example[order], weight[order]
        # a spot is a term in a block: where its postings begin, and the largest weight
        at = term * max(1, self.n_blocks) + self.example // block
        begin = np.flatnonzero(np.diff(at, prepend=-1))
        self.begin = np.concatenate((begin, [len(at)]))
        self.most = np.maximum.reduceat(self.weight, begin) if len(begin) else np.zeros(0)
        self.in_block = self.example[begin] // block
        self.spots = np.searchsorted(term[begin], np.arange(n_terms + 1))

    def dense_products(self, queries: list[Vector]) -> np.ndarray:
        """A row per query: products over the dense terms with all examples."""
        q = np.zeros((len(queries), len(self.dense)))
        for x, (terms, values) in zip(q, queries):
            row = self.row[terms]
            x[row[row >= 0]] = values[row >= 0]
        return q @ self.dense

    def nearest(self, terms: np.ndarray, values: np.ndarray, k: int, skip: int = -1, base: np.ndarray | None = None) -> list[tuple[float, int]]:
        """The k examples of the largest positive products, (product, example); base: dense_products of the query."""
        if not self.n:
            return []
        base = self.dense_products([(terms, values)])[0] if base is None else base
        rare = self.row[terms] < 0
        first, stop = self.spots[terms[rare]], self.spots[terms[rare] + 1]
        spots = _ranges(first, stop - first)
        value = np.repeat(values[rare], stop - first)
        block = self.in_block[spots]
        bound = base.reshape(self.n_blocks, self.block).max(1) + np.bincount(block, self.most[spots] * value, minlength=self.n_blocks)
        order = np.argsort(-bound, kind="stable")
        bound = bound[order]
        rank = np.empty(self.n_blocks, dtype=np.int64)
        rank[order] = np.arange(self.n_blocks)
        # spots by the turn of their blocks
        turn = rank[block]
        by_turn = np.argsort(turn, kind="stable")
        spots, value, turn = spots[by_turn], value[by_turn], turn[by_turn]
        scores, least, at, step = base.copy(), 0.0, 0, 4
        scored = np.zeros(0)
        while at < self.n_blocks and bound[at] > 0 and bound[at] >= least - SAME:
            upto = min(self.n_blocks, at + step)
            a, b = np.searchsorted(turn, (at, upto))
            begin = self.begin[spots[a:b]]
            size = self.begin[spots[a:b] + 1] - begin
            rows = _ranges(begin, size)
            scores += np.bincount(self.example[rows], self.weight[rows] * np.repeat(value[a:b], size), minlength=len(scores))
            if skip >= 0:
                scores[skip] = 0
            scored = np.concatenate((scored, scores.reshape(self.n_blocks, self.block)[order[at:upto]].ravel()))
            if len(scored) > k:
                scored = np.partition(scored, len(scored) - k)[len(scored) - k:]
                least = scored.min()
            at, step = upto, step * 2
        done = np.zeros(self.n_blocks, dtype=bool)
        done[order[:at]] = True
        found = np.flatnonzero((scores > 0) & (scores >= least - SAME) & np.repeat(done, self.block))
        found = found[np.lexsort((found, -np.round(scores[found] / SAME)))[:k]]
        return list(zip(scores[found].tolist(), found.tolist()))


class Model:
    """examples: (grams, label) of labelled texts, a list that is used up; counts: labelled rows of each class; ids: what the
    examples are known by, in evidence only."""

    def __init__(self, examples: list[tuple[Vector, int]], counts: tuple[int, int], ids: list[str] | None = None):
        self.share = counts[1] / sum(counts) if sum(counts) else 0.0
        self.slope, self.offset = 0.0, float(np.log((self.share + 1e-6) / (1 - self.share + 1e-6)))
        self.labels = np.array([y for _, y in examples], dtype=np.int8)
        self.ids = list(ids) if ids else [str(i) for i in range(len(examples))]
        self.terms, self.idf = np.zeros(0, dtype=np.int32), np.zeros(0)
        self.index = BlockMaxIndex([], 0)
        if {y for _, y in examples} != {0, 1}:
            return
        self.terms, df = np.unique(np.concatenate([c for (c, _), _ in examples]), return_counts=True)
        self.idf = np.log(1 + len(examples) / (df + 0.5)) ** IDF
        own = []
        for i in range(len(examples)):  # what is counted is let go as its vector is made
            own.append(self.vector(examples[i][0]))
            examples[i] = None
        # examples with the same leading term stand together, so that blocks differ in their maxima
        lead = [int(t[np.argmax(v)]) if len(t) else len(self.terms) for t, v in own]
        order = sorted(range(len(own)), key=lambda i: (lead[i], i))
        self.labels, self.ids, own = self.labels[order], [self.ids[i] for i in order], [own[i] for i in order]
        self.index = BlockMaxIndex(own, len(self.terms))
        votes = np.array([self.vote(near) for near in self._nearest(own, own_place=True)])
        self.slope, self.offset = platt(votes * 4, self.labels.astype(float), weights(self.labels, counts))

    def vector(self, counted: Vector) -> Vector:
        """(terms, unit weights) of grams that any example has."""
        codes, counts = counted
        at = np.minimum(np.searchsorted(self.terms, codes), max(0, len(self.terms) - 1))
        known = self.terms[at] == codes if len(self.terms) else np.zeros(len(codes), dtype=bool)
        terms = at[known].astype(np.int32)
        values = counts[known] ** TF * self.idf[terms]
        return terms, values / max(1e-300, np.sqrt((values * values).sum()))

    def vote(self, near: list[tuple[float, int]]) -> float:
        weight = sum(s * s for s, _ in near)
        return (sum(s * s for s, i in near if self.labels[i]) + PRIOR * self.share) / (weight + PRIOR)

    def _nearest(self, queries: list[Vector], own_place: bool = False) -> Iterator[list[tuple[float, int]]]:
        """The nearest examples of each query; own_place: query i is example i and not its own neighbour."""
        for a in range(0, len(queries), AT_ONCE):
            some = queries[a:a + AT_ONCE]
            for i, ((terms, values), base) in enumerate(zip(some, self.index.dense_products(some)), a):
                yield self.index.nearest(terms, values, NEIGHBOURS, skip=i if own_place else -1, base=base) if len(terms) else []

    def neighbours(self, texts: list[bytes]) -> list[list[tuple[float, int]]]:
        """The nearest examples of each text."""
        return list(self._nearest([self.vector(grams(t)) for t in texts]))

    def probability(self, near: list[tuple[float, int]]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * 4 * self.vote(near) + self.offset, -30, 30))))

    def score(self, text: bytes) -> float:
        return self.probability(self.neighbours([text])[0])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", **options) -> Model:
    """The model of a bounded sample; a task counts the terms of its texts, so no text is gathered."""
    rows = picked(docs, labels, label, learn, longest=None, **options)

    def run(batches):
        for batch, texts in arrow_rows(batches, "text"):
            counted = list(zip(*map(grams, texts))) or [(), ()]
            # bytes, as the driver would hold an object for each number of an array
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x.tobytes() for x in c], pa.binary()) for c in counted)], names=[*batch.schema.names, "codes", "counts"])

    got = rows.mapInArrow(run, "place long, id string, digest string, label int, codes binary, counts binary").collect()
    got.sort(key=lambda r: (r.place, r.id, r.digest))
    examples = [((np.frombuffer(r.codes, dtype=np.int32), np.frombuffer(r["counts"], dtype=np.int64)), r.label) for r in got]
    ids = [r.id for r in got]
    del got
    return Model(examples, class_counts(labels, label, learn), ids)


def toxicity(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "toxicity", evidence_col: str | None = "evidence") -> DataFrame:
    """docs with score_col and evidence_col, if given: the neighbours' (similarity, label, example: the id
    of the labelled text), nearest first."""
    path = f"{scratch(docs.sparkSession, 'toxicity')}/model"
    with open_file(as_uri(path), True) as f:
        f.write(pickle.dumps(model))
    base = docs.drop(score_col, *([evidence_col] if evidence_col else []))
    evidence = {evidence_col: F.array().cast("array<struct<similarity:double,label:int,example:string>>")} if evidence_col else {}
    schema = base.withColumns({score_col: F.lit(0.0)} | evidence).schema

    def run(batches):
        with open_file(as_uri(path), False) as f:
            own = pickle.loads(f.read())  # let go with the task
        kind = pa.list_(pa.struct([("similarity", pa.float64()), ("label", pa.int32()), ("example", pa.string())]))
        for batch, texts in arrow_rows(batches, "__ll_text"):
            near = own.neighbours(texts)
            new = [pa.array([own.probability(x) for x in near], pa.float64())]
            if evidence_col:
                new.append(pa.array([[{"similarity": s, "label": int(own.labels[i]), "example": own.ids[i]} for s, i in x] for x in near], kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, score_col, *([evidence_col] if evidence_col else [])])

    return base.withColumn("__ll_text", utf8(text_col)).mapInArrow(trimmed(run), schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    out = toxicity(spread(docs), model, score_col="score").drop("text")
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
