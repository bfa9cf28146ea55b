"""Correlations of all pairs of series over the places that both have, without joining rows with rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Places times series that a task holds at once.
CELLS = 1 << 22


def pair_correlations(df: DataFrame, series: str, at: str, value: str, block: int = 256) -> DataFrame:
    """(a, b, n, corr) for all pairs a < b of series: Pearson's correlation over the places both have a value, null where one is constant.

    Series are numbered and dealt into blocks of `block`. Rows are shuffled once by place; a task adds the products of the places it
    has, CELLS of places times series at a time, to one matrix per pair of blocks and sends a row per pair of series that
    meet; what is shuffled is linear in the rows and in the pairs of the result. Values of a series
    at one place are averaged; null and non-finite values count nowhere.
    """
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))).groupBy(series, at).agg(F.avg(value).alias("v"))
    # centred on the series' own mean, so that sums of squares keep their digits
    means = clean.groupBy(series).agg(F.avg("v").alias("mean"))
    kind = df.schema[series].dataType.simpleString()
    rows = clean.join(means, series).select(F.col(series).alias("s"), at, (F.col("v") - F.col("mean")).alias("v"))
    by_place = rows.groupBy(at).agg(F.sort_array(F.collect_list(F.struct("s", "v"))).alias("own"))

    def products(places: list[list[tuple]], label: list):
        v, m = np.zeros((len(places), len(label))), np.zeros((len(places), len(label)))
        for k, own in enumerate(places):
            for s, x in own:
                v[k, s], m[k, s] = x, 1
        for i in range(0, len(label), block):
            for j in range(0, len(label), block):
                vi, mi, vj, mj = v[:, i:i + block], m[:, i:i + block], v[:, j:j + block], m[:, j:j + block]
                n = mi.T @ mj
                sums = [n, vi.T @ mj, mi.T @ vj, vi.T @ vj, (vi * vi).T @ mj, mi.T @ (vj * vj)]
                a, b = np.nonzero(n)
                keep = [k for k in range(len(a)) if label[i + a[k]] < label[j + b[k]]]
                a, b = a[keep], b[keep]
                if len(a):
                    cols = [pa.array([label[i + k] for k in a.tolist()]), pa.array([label[j + k] for k in b.tolist()]), *[pa.array(x[a, b]) for x in sums]]
                    yield pa.RecordBatch.from_arrays(cols, names=["a", "b", "n", "sa", "sb", "ab", "aa", "bb"])

    def add(batches):
        places: list[list[tuple]] = []
        names: dict = {}
        for batch in batches:
            for own in batch.column("own").to_pylist():
                places.append([(names.setdefault(x["s"], len(names)), x["v"]) for x in own])
                if len(places) * len(names) > CELLS:
                    yield from products(places, list(names))
                    places, names = [], {}
        yield from products(places, list(names))

    parts = by_place.select("own").mapInArrow(add, f"a {kind}, b {kind}, n double, sa double, sb double, ab double, aa double, bb double")
    total = parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "ab", "aa", "bb")])
    top = F.col("ab") - F.col("sa") * F.col("sb") / F.col("n")
    low = (F.col("aa") - F.col("sa") * F.col("sa") / F.col("n")) * (F.col("bb") - F.col("sb") * F.col("sb") / F.col("n"))
    return total.select("a", "b", F.col("n").cast("long").alias("n"), F.when(low > 1e-30, top / F.sqrt(low)).alias("corr"))
