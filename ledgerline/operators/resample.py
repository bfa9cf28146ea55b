"""Resampling intervals and regressions per group, as numpy kernels in tasks.

A group is what one interval or fit is made of: values of one district, one region's series. Kernels over arrays hold a group's
values (8 bytes each) in the order of a key; class_sums() and median_rounds() need only counts, so a group may be of any size.
Results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Fixed values in all generators and defaults below: the multiplier and increment of the generator, the seed
# 20261001, 400 rounds, blocks of 12 months.


def lcg(seed: int, n: int) -> np.ndarray:
    """n draws in [0, 1) of x -> (1664525 x + 1013904223) mod 2**32."""
    out = np.empty(n, dtype=np.uint64)
    x = np.uint64(seed % 2**32)
    a, c, m = np.uint64(1664525), np.uint64(1013904223), np.uint64(2**32 - 1)
    for i in range(n):
        x = (x * a + c) & m
        out[i] = x
    return out / 2.0**32


def jumped(seed: int, k: int) -> int:
    """The state of lcg's generator k draws after seed."""
    m = (1 << 32) - 1
    a, c, x = 1664525, 1013904223, seed & m
    while k:
        if k & 1:
            x = (a * x + c) & m
        a, c, k = a * a & m, (a + 1) * c & m, k >> 1
    return x


def draws(seed: int, rounds: int, n: int, scaled: bool = True) -> np.ndarray:
    """rounds x n row numbers below n (not scaled: draws in [0, 1)); blocks of the generator are jumped to, so all
    rounds are made at once."""
    total = rounds * n
    step = 1 << 12
    first = np.empty(min(step, total), dtype=np.uint64)
    m = (1 << 32) - 1
    x = seed & m
    for i in range(len(first)):
        x = (x * 1664525 + 1013904223) & m
        first[i] = x
    # x_{i+step} = A x_i + C
    a, c = 1, 0
    for _ in range(step):
        a, c = a * 1664525 & m, (c * 1664525 + 1013904223) & m
    parts, part = [first], first
    for _ in range(-(-total // step) - 1):
        part = (part * np.uint64(a) + np.uint64(c)) & np.uint64(m)
        parts.append(part)
    u = np.concatenate(parts)[:total] / 2.0**32
    return (u * n).astype(np.int64).reshape(rounds, n) if scaled else u.reshape(rounds, n)


#: Values that a kernel draws at once.
AT_ONCE = 1 << 21


def _uniform(seed: int, skip: int, n: int) -> np.ndarray:
    """n draws of lcg's generator in [0, 1), `skip` draws after seed."""
    return draws(jumped(seed, skip), 1, n, scaled=False)[0]


def median_sims(a: int, b: int, values: np.ndarray, seed: int = 20261001) -> np.ndarray:
    """Medians of resampled values in rounds a to b."""
    n, out = len(values), np.empty(b - a)
    step = max(1, AT_ONCE // max(1, n))
    for x in range(a, b, step):
        y = min(b, x + step)
        rows = draws(jumped(seed, x * n), y - x, n)
        out[x - a:y - a] = np.median(values[rows], axis=1)
    return out


def median_interval(values: np.ndarray, rounds: int = 400, seed: int = 20261001, tail: float = 0.05) -> tuple[float, float]:
    """The percentile interval of the median over resampled values."""
    if not len(values):
        return np.nan, np.nan
    medians = np.sort(median_sims(0, rounds, values, seed))
    return float(medians[int(rounds * tail)]), float(medians[int(rounds * (1 - tail))])


def level_gap(recent_a: np.ndarray, log_a: np.ndarray, recent_b: np.ndarray, log_b: np.ndarray, area: float = 84.0) -> np.ndarray:
    """How much the gap of b over a grew, row by row: a level is a median, its base the level before the median change."""
    def level(recent, log):
        now = np.median(recent, axis=-1) * area
        return now, now / np.exp(np.median(log, axis=-1))

    (now_a, was_a), (now_b, was_b) = level(recent_a, log_a), level(recent_b, log_b)
    return now_b - now_a - (was_b - was_a)


def gap_sims(a: int, b: int, recent_a: np.ndarray, log_a: np.ndarray, recent_b: np.ndarray, log_b: np.ndarray, seed: int = 20261001) -> np.ndarray:
    """level_gap in rounds a to b; a round draws the cells of a, then those of b."""
    n_a, n_b, out = len(recent_a), len(recent_b), np.empty(b - a)
    n = n_a + n_b
    step = max(1, AT_ONCE // n)
    for x in range(a, b, step):
        y = min(b, x + step)
        u = _uniform(seed, x * n, (y - x) * n).reshape(y - x, n)
        i, j = (u[:, :n_a] * n_a).astype(np.int64), (u[:, n_a:] * n_b).astype(np.int64)
        out[x - a:y - a] = level_gap(recent_a[i], log_a[i], recent_b[j], log_b[j])
    return out


def stratum_sums(a: int, b: int, hit: np.ndarray, low: np.ndarray, high: np.ndarray, skip: int, total: int, seed: int = 20261001) -> np.ndarray:
    """For rounds a to b, four columns: of the stratum's rows in the low and in the high band, how far their hits exceed
    what the stratum's share gives, and their number. skip: rows of earlier strata; total: rows of all."""
    n, out = len(hit), np.empty((b - a, 4))
    for x in range(a, b):
        rows = (_uniform(seed, x * total + skip, n) * n).astype(np.int64)
        h, base = hit[rows], hit[rows].mean()
        out[x - a] = [v for band in (low[rows], high[rows]) for v in ((h[band] - base).sum(), band.sum())]
    return out


def mersenne(seed: int, n: int) -> np.ndarray:
    """The first n draws of random.Random(seed).random()."""
    return np.random.RandomState([seed]).random_sample(n)


def cluster_sims(a: int, b: int, values: np.ndarray, sizes: np.ndarray, seed: int = 1) -> np.ndarray:
    """Medians of the values of whole clusters drawn with replacement, rounds a to b; values stand cluster by cluster."""
    k, begin = len(sizes), np.cumsum(sizes) - sizes
    picked = (mersenne(seed, b * k)[a * k:] * k).astype(np.int64).reshape(b - a, k)
    out = np.empty(b - a)
    for x, own in enumerate(picked):
        n = sizes[own]
        out[x] = np.median(values[np.repeat(begin[own] - np.cumsum(n) + n, n) + np.arange(n.sum())])
    return out


def jitter(values: np.ndarray, sizes: np.ndarray, seed: int = 2, rounds: int = 50, drop: float = 0.1) -> float:
    """The range of the median over rounds that leave out a tenth of the clusters."""
    import random

    rng, of, k = random.Random(seed), np.repeat(np.arange(len(sizes)), sizes), len(sizes)
    medians = []
    for _ in range(rounds):
        left = np.ones(k, dtype=bool)
        left[rng.sample(range(k), int(k * drop))] = False
        medians.append(np.median(values[left[of]]))
    return float(max(medians) - min(medians))


# The constants of mulberry32 and of 32-bit FNV-1a.
STEP, FNV_START, FNV_PRIME = 0x6D2B79F5, 0x811C9DC5, 0x01000193


def key_seed(key: str, seed: int) -> int:
    """A seed for a key: FNV-1a over its characters from a start that depends on `seed`."""
    h = (FNV_START ^ seed) & 0xFFFFFFFF
    for c in key:
        h = (h ^ ord(c)) * FNV_PRIME & 0xFFFFFFFF
    return h


def mulberry(seed: int, skip: int, n: int) -> np.ndarray:
    """n draws of mulberry32 after `skip`; each depends on its number alone."""
    m = np.uint64(0xFFFFFFFF)
    a = (np.uint64(seed) + np.arange(skip + 1, skip + n + 1, dtype=np.uint64) * np.uint64(STEP)) & m
    t = (a ^ a >> np.uint64(15)) * (a | np.uint64(1)) & m
    t ^= t + ((t ^ t >> np.uint64(7)) * (t | np.uint64(61)) & m) & m
    return ((t ^ t >> np.uint64(14)) & m) / 2.0**32


def yoy_sims(a: int, b: int, was: np.ndarray, now: np.ndarray, rate_was: float, rate_now: float, seed: int) -> np.ndarray:
    """Relative change of the median's cost in rounds a to b; a round draws the earlier values, then the later."""
    n, m = len(was), len(now)
    u = mulberry(seed, a * (n + m), (b - a) * (n + m)).reshape(b - a, n + m)
    before, after = np.median(was[(u[:, :n] * n).astype(np.int64)], axis=1), np.median(now[(u[:, n:] * m).astype(np.int64)], axis=1)
    return after * rate_now / (before * rate_was) - 1


def middle_places(uniform: Callable[[int, int], np.ndarray], n: int, at_once: int = AT_ONCE) -> tuple[int, int]:
    """The two middle ones (one and the same for odd n) of n places drawn below n; uniform(skip, k) gives draws in [0, 1).

    Places are counted in ranges, then those of the ranges that hold the middle are counted one by one from the same draws again:
    memory is bounded by at_once, whatever n.
    """
    ks = ((n - 1) // 2, n // 2)
    if n <= at_once:
        picks = (uniform(0, n) * n).astype(np.int64)
        picks = np.partition(picks, ks)
        return int(picks[ks[0]]), int(picks[ks[1]])
    width = -(-n // (1 << 16))
    counts = np.zeros(-(-n // width), dtype=np.int64)
    for x in range(0, n, at_once):
        counts += np.bincount((uniform(x, min(at_once, n - x)) * n).astype(np.int64) // width, minlength=len(counts))
    upto = np.cumsum(counts)
    ranges = sorted({int(np.searchsorted(upto, k, side="right")) for k in ks})
    fine = {r: np.zeros(width, dtype=np.int64) for r in ranges}
    for x in range(0, n, at_once):
        picks = (uniform(x, min(at_once, n - x)) * n).astype(np.int64)
        for r in ranges:
            fine[r] += np.bincount(picks[picks // width == r] - r * width, minlength=width)
    out = []
    for k in ks:
        r = int(np.searchsorted(upto, k, side="right"))
        out.append(r * width + int(np.searchsorted(np.cumsum(fine[r]), k - (upto[r] - counts[r]), side="right")))
    return out[0], out[1]


def class_sums(a: int, b: int, counts: np.ndarray, hit: np.ndarray, low: np.ndarray, high: np.ndarray, skip: int, total: int, seed: int = 20261001, at_once: int = AT_ONCE) -> np.ndarray:
    """stratum_sums() of a stratum whose rows stand class by class: so many rows of each (hit, low, high). Rows are not needed."""
    n, ends, out = int(counts.sum()), np.cumsum(counts), np.empty((b - a, 4))
    for x in range(a, b):
        picked = np.zeros(len(counts), dtype=np.int64)
        for k in range(0, n, at_once):
            m = min(at_once, n - k)
            places = (_uniform(seed, x * total + skip + k, m) * n).astype(np.int64)
            picked += np.bincount(np.searchsorted(ends, places, side="right"), minlength=len(counts))
        base = (picked * hit).sum() / n
        out[x - a] = [v for band in (low, high) for v in ((picked * band * (hit - base)).sum(), (picked * band).sum())]
    return out


def _log_gamma(n: np.ndarray) -> np.ndarray:
    """ln(gamma(n)) of whole numbers: looked up by distinct value."""
    from math import lgamma

    values, at = np.unique(n, return_inverse=True)
    return np.array([lgamma(v) for v in values.tolist()])[at]


def beta_share(x: np.ndarray, a: np.ndarray, b: np.ndarray, steps: int = 300) -> np.ndarray:
    """The regularised incomplete beta function for whole a, b >= 1, all at once, by its continued fraction."""
    front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(x) + b * np.log1p(-x))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    keep = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(z), 1 / keep(1 - (p + q) * z / (p + 1))
    h = d.copy()
    for m in range(1, steps):
        for top in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / keep(1 + top * d)
            c = keep(1 + top / c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    value = front * h / p
    return np.where(swap, 1 - value, value)


def binomial_interval(k: np.ndarray, n: np.ndarray, level: float = 0.95, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Clopper and Pearson's exact interval of shares k / n: bisection on the beta function, all rows at once. No trials give 0 to 1."""
    k, n = np.asarray(k, dtype=np.int64), np.asarray(n, dtype=np.int64)

    def solve(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
        lo, hi = np.zeros(len(a)), np.ones(len(a))
        for _ in range(steps):
            mid = (lo + hi) / 2
            below = beta_share(mid, a, b) < share
            lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
        return (lo + hi) / 2

    low, high = np.zeros(len(k)), np.ones(len(k))
    some, rest = k > 0, k < n
    if some.any():
        low[some] = solve(k[some], n[some] - k[some] + 1, (1 - level) / 2)
    if rest.any():
        high[rest] = solve(k[rest] + 1, n[rest] - k[rest], (1 + level) / 2)
    return low, high


def intervals(groups: DataFrame, keys: list[str], arrays: list[str], kernel: Callable[..., np.ndarray], rounds: int, tail: float = 0.05) -> DataFrame:
    """(keys, low, high): the percentile interval of kernel(0, rounds, *arrays) for each group, a row with its values as arrays. A task
    holds one group's values, 8 bytes each, and AT_ONCE draws."""
    kinds = {f.name: f.dataType.simpleString() for f in groups.schema.fields}

    def run(batches):
        for batch in batches:
            low, high = [], []
            for row in zip(*(batch.column(c).to_pylist() for c in arrays)):
                sims = np.sort(kernel(0, rounds, *[np.asarray(v) if isinstance(v, list) else v for v in row]))
                low.append(float(sims[int(rounds * tail)]))
                high.append(float(sims[int(rounds * (1 - tail))]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], pa.array(low), pa.array(high)], names=[*keys, "low", "high"])

    dealt = groups.select(*dict.fromkeys([*keys, *arrays])).repartition(groups.sparkSession.sparkContext.defaultParallelism, *keys)
    return dealt.mapInArrow(run, ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["low double", "high double"]))


def median_rounds(sizes: DataFrame, key: str, values: DataFrame, value: str, rounds: int, seed_of: Callable[[str], int], names: list[str], slice_: int = 20) -> DataFrame:
    """(key, round, and a column per name) of medians over resampled values of each group in each round, whatever the groups' sizes.

    sizes has a row per key with n_<name> for each name; values has (key, side, rank, value), ranks 1 to n_<name> by value. A round
    draws the names' values one after the other from the generator of seed_of(key). As values stand in order, the median of
    a round is that of the places drawn: tasks know only n, find the places, and the values at these are joined.
    """
    dealt = sizes.withColumn("__a", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1), F.lit(slice_))))
    dealt = dealt.select(key, "__a", *[f"n_{c}" for c in names]).repartition(sizes.sparkSession.sparkContext.defaultParallelism, key, "__a")
    kind = sizes.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for k, first, *ns in zip(*(batch.column(c).to_pylist() for c in [key, "__a", *[f"n_{c}" for c in names]])):
                seed, total = seed_of(k), sum(ns)
                for x in range(first, min(rounds, first + slice_)):
                    before = x * total
                    for name, n in zip(names, ns):
                        lo, hi = middle_places(lambda skip, m, before=before: mulberry(seed, before + skip, m), n)
                        rows += [{"k": k, "round": x, "side": name, "place": p + 1} for p in (lo, hi)]
                        before += n
            out = pa.RecordBatch.from_pylist(rows, schema=pa.schema([("k", batch.schema.field(key).type), ("round", pa.int32()), ("side", pa.string()), ("place", pa.int64())]))
            yield out

    places = dealt.mapInArrow(run, f"k {kind}, round int, side string, place bigint")
    at = values.select(F.col(key).alias("k"), "side", F.col("rank").alias("place"), F.col(value).alias("v"))
    met = places.join(at, ["k", "side", "place"])
    return met.groupBy(F.col("k").alias(key), "round").agg(*[F.avg(F.when(F.col("side") == c, F.col("v"))).alias(c) for c in names])


def by_slices(groups: DataFrame, keys: list[str], arrays: list[str], kernel: Callable[..., np.ndarray], rounds: int, slices: int = 4) -> DataFrame:
    """(keys, sims): kernel(a, b, *arrays) over slices of rounds, each in a task of its own, put together in order.

    groups has a row per group with its values as arrays; a group's values and `rounds` results are held at once.
    """
    kinds = {f.name: f.dataType.simpleString() for f in groups.schema.fields}
    step = -(-rounds // slices)
    rows = groups.select(*keys, *arrays, F.explode(F.sequence(F.lit(0), F.lit(rounds - 1), F.lit(step))).alias("__a"))
    cores = groups.sparkSession.sparkContext.defaultParallelism

    def run(batches):
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in batch.schema.names]
            sims = []
            for row in zip(*cols):
                own = [np.asarray(v) if isinstance(v, list) else v for v in row[len(keys):-1]]
                sims.append(kernel(row[-1], min(rounds, row[-1] + step), *own))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], batch.column("__a"), pa.array(sims, pa.list_(pa.float64()))], names=[*keys, "__a", "sims"])

    out = rows.repartition(cores, *keys, "__a").mapInArrow(run, ", ".join([f"{k} {kinds[k]}" for k in keys] + ["__a int", "sims array<double>"]))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__a", "sims"))), lambda x: x["sims"]))
    return out.groupBy(*keys).agg(whole.alias("sims"))


def interval(sims: str, rounds: int, tail: float = 0.05) -> tuple[Column, Column]:
    """The percentile interval of simulated values."""
    own = F.array_sort(sims)
    return F.element_at(own, int(rounds * tail) + 1), F.element_at(own, int(rounds * (1 - tail)) + 1)


def block_win_share(differences: np.ndarray, rounds: int = 1000, block: int = 12, seed: int = 20261001) -> float:
    """The share of block resamples in which the mean difference is positive."""
    n = len(differences)
    if n < block:
        return float("nan")
    per = -(-n // block)
    start = (lcg(seed, rounds * per) * (n - block + 1)).astype(np.int64).reshape(rounds, per)
    rows = (start[:, :, None] + np.arange(block)).reshape(rounds, -1)[:, :n]
    return float((differences[rows].mean(axis=1) > 0).mean())


def least_squares(x: np.ndarray, y: np.ndarray) -> np.ndarray | None:
    """Coefficients by the normal equations; None if they are singular."""
    a = x.T @ x
    if np.linalg.matrix_rank(a) < a.shape[0]:
        return None
    return np.linalg.solve(a, x.T @ y)


def backtest(logs: np.ndarray, horizon: int, least: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """(errors of an autoregression, errors of no change): expanding windows over a series of log changes.

    Features at t: 1, r(t), r(t-1), the mean of the four before; target: the sum of the next `horizon` changes.
    """
    n = len(logs)
    at = np.arange(5, n)
    if not len(at):
        return np.zeros(0), np.zeros(0)
    x = np.column_stack((np.ones(len(at)), logs[at], logs[at - 1], (logs[at - 2] + logs[at - 3] + logs[at - 4] + logs[at - 5]) / 4))
    total = np.concatenate(([0.0], np.cumsum(logs)))
    model, still = [], []
    for k, t in enumerate(at):
        if t + horizon >= n:
            break
        known = k - horizon + 1  # targets that have ended by t
        if known < least:
            continue
        y = total[at[:known] + horizon + 1] - total[at[:known] + 1]
        beta = least_squares(x[:known], y)
        if beta is None:
            continue
        truth = total[t + horizon + 1] - total[t + 1]
        model.append(truth - x[k] @ beta)
        still.append(truth)
    return np.array(model), np.array(still)


def per_group(df: DataFrame, keys: list[str], order: list[str], out: dict[str, str], kernel: Callable[[pd.DataFrame], dict]) -> DataFrame:
    """One row per group: kernel of the group's rows in order. out: names and types of its values."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"{k} {v}" for k, v in out.items()])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([dict(zip(keys, key)) | kernel(rows.sort_values(order, kind="stable"))])[[*keys, *out]]

    return df.groupBy(*keys).applyInPandas(run, schema)
