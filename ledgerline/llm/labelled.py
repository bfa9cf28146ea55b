"""Bounded samples of labelled texts and the calibration that the two classifiers share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled texts of each class that a model is fitted on, and, where their text is gathered, the longest in bytes.
PER_CLASS = 3000
LONGEST = 1 << 18


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids are in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)), F.lit(0))


def _known(labels: DataFrame, label: str, learn: Column, id_col: str) -> DataFrame:
    """(id, label) of labelled ids where `learn` holds; contradicting labels of one id count as 1."""
    rows = labels.where(learn & F.col(label).isin(0, 1) & F.col(id_col).isNotNull())
    return rows.groupBy(F.col(id_col).alias("__ll_id")).agg(F.max(label).cast("int").alias("label"))


def class_counts(labels: DataFrame, label: str, learn: Column, id_col: str = "doc_id") -> tuple[int, int]:
    """(ids labelled 0, ids labelled 1) where `learn` holds."""
    counts = {r["label"]: r["n"] for r in _known(labels, label, learn, id_col).groupBy("label").agg(F.count("*").alias("n")).collect()}
    return counts.get(0, 0), counts.get(1, 0)


def picked(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int = PER_CLASS, longest: int | None = LONGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(place, id, digest, text, label) of the sample: of each class the first per_class ids by a hash, of those that
    have a text (of at most `longest` bytes). An id with several texts has each, but 2 * per_class rows are the most."""
    fit = docs.where(F.col(text_col).isNotNull() if longest is None else F.octet_length(text_col) <= longest)
    ids = _known(labels, label, learn, id_col).join(fit.select(F.col(id_col).alias("__ll_id")).distinct(), "__ll_id")
    chosen = None
    for y in (0, 1):
        part = ids.where(F.col("label") == y).orderBy(F.xxhash64("__ll_id"), "__ll_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = fit.select(F.col(id_col).alias("__ll_id"), F.col(text_col).cast("binary").alias("text"))
    # 2 * per_class rows of two numbers: a fixed bound
    rows = texts.join(F.broadcast(chosen), "__ll_id").select(F.xxhash64("__ll_id").alias("place"), F.col("__ll_id").cast("string").alias("id"), F.sha2("text", 256).alias("digest"), "text", "label")
    return rows.orderBy("place", "id", "digest").limit(2 * per_class)


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, **options) -> tuple[list[tuple[bytes, int]], tuple[int, int]]:
    """([(text, label)] of picked(), class_counts())."""
    rows = sorted(picked(docs, labels, label, learn, **options).collect(), key=lambda r: (r.place, r.id, r.digest))
    return [(bytes(r.text), r.label) for r in rows], class_counts(labels, label, learn, options.get("id_col", "doc_id"))


def platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[float, float]:
    """(slope, offset) of the logistic curve through weighted labels, by Newton steps; x near unit scale."""
    features = np.column_stack((x, np.ones(len(x))))
    beta = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(features @ beta, -30, 30)))
        grad = features.T @ (weight * (p - y)) + ridge * beta
        hess = (features * (weight * p * (1 - p))[:, None]).T @ features + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def weights(y: np.ndarray, counts: tuple[int, int]) -> np.ndarray:
    """Weights that give the sampled classes the shares they have among all labelled rows."""
    own = np.array([max(1, int((y == k).sum())) for k in (0, 1)], dtype=float)
    share = np.array(counts, dtype=float) / max(1, sum(counts))
    return (share / own)[y.astype(int)] * len(y)


def arrow_rows(batches, column: str) -> Iterator:
    """(batch without column, its values)."""
    for batch in batches:
        keep = [k for k, n in enumerate(batch.schema.names) if n != column]
        yield batch.select(keep), batch.column(column).to_pylist()
