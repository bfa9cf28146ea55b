"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are read once per chunk of queries (a chunk has a fixed number of queries, so its broadcast has a fixed bound;
chunks run one after the other, each staged) and are never shuffled. In each Arrow batch vectors are grouped into buckets of nearly equal length, longest first.
The k-th best score so far of a query, over its length and the bucket's largest, is the cosine that a vector of the
bucket must reach. Where that is above 1 the bucket, and with it all shorter ones, is pruned by length; where it is
high the query's largest coordinates bound the coordinates of a match and only vectors within are verified; else
the prefix of long enough vectors is. Verification is the exact integer product. Each task starts from the scores that
a bounded set of the longest vectors gives, and returns k candidates per query at most; a window takes the best.

Cases: vectors that are null or hold null or non-finite components take no part; missing components of a shorter
vector count as 0; ties go to the smaller id; fewer than k candidates give fewer rows; rows with the query's id are
its own; null ids take no part. Scores are exact while sums of products stay below 2**53.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import spread, staged, table

SCALE = 256.0
CHUNK = 16_384
#: Queries whose scores are held at once in a task.
AT_ONCE = 256
#: Longest vectors whose scores give the first thresholds.
SEEDS = 2_048
#: Largest ratio of lengths in a bucket, and the local cosine from which coordinates prune.
RATIO, BY_COORDINATE = 1.05, 0.9
FOCUS = 2


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec double[]) of the rows that take part."""
    bad = F.exists(F.col(vec_col), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))


def whole(vectors: list[np.ndarray] | pa.Array, width: int) -> np.ndarray:
    """floor(256 * x) in rows of `width`; longer vectors are cut, as the rest meets only zeros."""
    if isinstance(vectors, pa.Array):
        size = np.diff(vectors.offsets.to_numpy())
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        if len(size) and (size == width).all():
            return np.floor(flat.reshape(-1, width) * SCALE)
        ends = np.cumsum(size)
        vectors = [flat[b - n:b] for b, n in zip(ends, size)]
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[:min(width, len(v))] = np.floor(np.asarray(v[:width]) * SCALE)
    return out


class Search:
    """The best k of a chunk of queries over all batches that it is given."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None):
        self.ids, self.queries, self.k = ids, queries, k
        self.length = np.sqrt((queries * queries).sum(1))
        self.unit = queries / np.maximum(self.length, 1e-300)[:, None]
        self.focus = np.argsort(-np.abs(self.unit), axis=1)[:, :FOCUS]
        self.floor = np.full(len(ids), -np.inf) if floors is None else floors.copy()
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        length = np.sqrt((vectors * vectors).sum(1))
        order = np.argsort(-length, kind="stable")
        ids, vectors, length = ids[order], vectors[order], length[order]
        at = 0
        while at < len(ids):
            end = int(np.searchsorted(-length, -length[at] / RATIO, side="right")) if length[at] > 0 else len(ids)
            end = max(end, at + 1)
            if not self._bucket(ids[at:end], vectors[at:end], length[at:end]):
                break
            at = end

    def _bucket(self, ids: np.ndarray, vectors: np.ndarray, length: np.ndarray) -> bool:
        """Search one bucket; False if no query can gain from it or from shorter vectors."""
        most = self.length * length[0]
        open_ = self.floor <= most * (1 + 1e-9)
        if not open_.any():
            return bool((self.floor < 0).any())
        local = np.where(most > 0, self.floor / np.maximum(most, 1e-300), -1)
        by_coordinate = open_ & (local >= BY_COORDINATE)
        by_length = np.flatnonzero(open_ & ~by_coordinate)
        if by_coordinate.any():
            unit = vectors / np.maximum(length, 1e-300)[:, None]
            for q in np.flatnonzero(by_coordinate).tolist():
                keep = np.ones(len(ids), dtype=bool)
                for f in self.focus[q].tolist():
                    x, t = self.unit[q, f], local[q]
                    slack = np.sqrt(max(0.0, (1 - t * t) * (1 - x * x))) + 1e-9
                    # a unit vector whose product with the query is at least t has this coordinate within
                    keep &= (unit[:, f] >= x * t - slack) if x > 0 else (unit[:, f] <= x * t + slack)
                rows = np.flatnonzero(keep)
                if len(rows):
                    self._take(np.array([q]), ids[rows], self.queries[[q]] @ vectors[rows].T)
        for a in range(0, len(by_length), AT_ONCE):
            own = by_length[a:a + AT_ONCE]
            need = self.floor[own] / np.maximum(self.length[own], 1e-300)
            enough = len(ids) if need.min() <= 0 else max(1, int(np.searchsorted(-length, -need.min() * (1 - 1e-9), side="right")))
            self._take(own, ids[:enough], self.queries[own] @ vectors[:enough].T)
        return True

    def _take(self, own: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        scores[self.ids[own][:, None] == ids[None, :]] = -np.inf
        q, c = np.nonzero((scores >= self.floor[own][:, None]) & (scores > -np.inf))
        if not len(q):
            return
        touched = np.unique(q)
        rows = own[touched]
        query = np.concatenate((own[q], np.repeat(rows, self.k)))
        score = np.concatenate((scores[q, c], self.score[rows].ravel()))
        found = np.concatenate((ids[c], self.found[rows].ravel()))
        order = np.lexsort((found, -score, query))
        query, score, found = query[order], score[order], found[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        top = place < self.k
        self.score[query[top], place[top]] = score[top]
        self.found[query[top], place[top]] = found[top]
        self.floor[rows] = np.maximum(self.floor[rows], self.score[rows, -1])

    def rows(self) -> pa.RecordBatch:
        q, k = np.nonzero(self.score > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(self.found[q, k]), pa.array(self.score[q, k].astype(np.int64))], names=["query_id", "vec_id", "score"])


def _best(found: DataFrame, k: int) -> DataFrame:
    """The first k of each query: of k rows per query and task at most, which Spark prunes again before the shuffle."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", "vec_id", "score").withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer products of each row where is_query holds."""
    spark = vectors.sparkSession
    asked = usable(vectors.where(is_query), id_col, vec_col)
    rows = usable(vectors, id_col, vec_col)
    chunks = max(1, -(-asked.count() // chunk))
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    seeds = rows.orderBy(F.desc(norm), "id").limit(SEEDS).toArrow()
    rows = spread(rows)
    out = None
    for n in range(chunks):
        own = asked.where(F.pmod(F.xxhash64("id"), F.lit(chunks)) == n).orderBy("id").toArrow().combine_chunks()
        ids = own["id"].to_numpy()
        width = int(max([len(v) for v in own["vec"].to_pylist()], default=0))
        queries = whole(own["vec"].to_pylist(), width)
        first = Search(ids, queries, k)
        first.add(seeds["id"].to_numpy(), whole(seeds["vec"].to_pylist(), width))
        shared = spark.sparkContext.broadcast((ids, queries, first.floor))

        def run(batches, shared=shared, width=width):
            ids, queries, floors = shared.value
            search = Search(ids, queries, k, floors)
            for batch in batches:
                if batch.num_rows:
                    search.add(batch.column("id").to_numpy(zero_copy_only=False), whole(batch.column("vec"), width))
            yield search.rows()

        part = rows.mapInArrow(run, "query_id long, vec_id long, score long")
        if chunks > 1:  # one chunk after the other, so that one is held at a time
            part = staged(_best(part, k), "topk")
            shared.unpersist()
        out = part if out is None else out.unionByName(part)
    return _best(out, k)


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
