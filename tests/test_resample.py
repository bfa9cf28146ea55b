"""Resampling kernels against loops that follow the definitions one draw at a time."""

import math
import random
import statistics

import numpy as np
import pytest

from ledgerline import catalog
from ledgerline.operators import resample

SF = "/root/testdata/sf0.001"


class Lcg:
    def __init__(self, seed):
        self.x = seed

    def next(self):
        self.x = (self.x * 1664525 + 1013904223) % 2**32
        return self.x / 2**32


def test_medians_and_gaps():
    rnd = np.random.default_rng(1)
    a, b = [rnd.normal(5, 1, n) for n in (7, 7)], [rnd.normal(6, 1, n) for n in (10, 10)]
    g, want = Lcg(20261001), []
    for _ in range(30):
        want.append(statistics.median([a[0][int(g.next() * 7)] for _ in range(7)]))
    assert np.allclose(np.concatenate((resample.median_sims(0, 11, a[0]), resample.median_sims(11, 30, a[0]))), want)
    g, want = Lcg(20261001), []
    for _ in range(30):
        i, j = [int(g.next() * 7) for _ in range(7)], [int(g.next() * 10) for _ in range(10)]
        level = lambda s, k: (84 * statistics.median(s[0][k]), 84 * statistics.median(s[0][k]) / math.exp(statistics.median(s[1][k])))
        (na, wa), (nb, wb) = level(a, i), level(b, j)
        want.append(nb - na - (wb - wa))
    assert np.allclose(np.concatenate((resample.gap_sims(0, 4, *a, *b), resample.gap_sims(4, 30, *a, *b))), want)


def test_strata():
    rnd = np.random.default_rng(2)
    strata = [(rnd.integers(0, 2, n).astype(float), rnd.random(n) < 0.4, rnd.random(n) < 0.4) for n in (9, 14)]
    g, want = Lcg(5), []
    for _ in range(12):
        sums = [0.0] * 4
        for hit, low, high in strata:
            rows = [int(g.next() * len(hit)) for _ in hit]
            base = sum(hit[i] for i in rows) / len(rows)
            for k, band in ((0, low), (2, high)):
                own = [i for i in rows if band[i]]
                sums[k] += sum(hit[i] - base for i in own)
                sums[k + 1] += len(own)
        want.append(sums)
    got = resample.stratum_sums(0, 12, *strata[0], 0, 23, 5) + resample.stratum_sums(0, 12, *strata[1], 9, 23, 5)
    assert np.allclose(got, want)


def test_clusters_and_jitter():
    rnd = np.random.default_rng(3)
    sizes = rnd.integers(1, 4, 25)
    values = rnd.normal(size=sizes.sum())
    units = np.split(values, np.cumsum(sizes)[:-1])
    rng = random.Random(1)
    want = [statistics.median(np.concatenate(rng.choices(units, k=25)).tolist()) for _ in range(40)]
    assert np.allclose(np.concatenate((resample.cluster_sims(0, 15, values, sizes), resample.cluster_sims(15, 40, values, sizes))), want)
    rng, medians = random.Random(2), []
    for _ in range(50):
        gone = set(rng.sample(range(25), 2))
        medians.append(statistics.median(x for i, u in enumerate(units) if i not in gone for x in u.tolist()))
    assert math.isclose(resample.jitter(values, sizes), max(medians) - min(medians))


def test_keyed_draws():
    def one(seed):
        a = seed
        while True:
            a = (a + 0x6D2B79F5) % 2**32
            t = (a ^ a >> 15) * (a | 1) % 2**32
            t ^= (t + (t ^ t >> 7) * (t | 61) % 2**32) % 2**32
            yield ((t ^ t >> 14) % 2**32) / 2**32

    seed = resample.key_seed("구|band", 7)
    g = one(seed)
    want = [next(g) for _ in range(50)]
    assert np.allclose(resample.mulberry(seed, 0, 50), want) and np.allclose(resample.mulberry(seed, 20, 30), want[20:])
    assert resample.key_seed("", 0) == 0x811C9DC5 and resample.key_seed("a", 0) == 0xE40C292C
    was, now, g = np.arange(1.0, 6), np.arange(2.0, 9), one(seed)
    for x in resample.yoy_sims(0, 9, was, now, 4.0, 5.0, seed):
        i, j = [int(next(g) * 5) for _ in range(5)], [int(next(g) * 7) for _ in range(7)]
        assert math.isclose(x, statistics.median(now[j]) * 5 / (statistics.median(was[i]) * 4) - 1)


def test_binomial_interval():
    low, high = resample.binomial_interval(np.array([0, 3, 10]), np.array([10, 10, 10]))
    tail = lambda p, ks: sum(math.comb(10, k) * p**k * (1 - p) ** (10 - k) for k in ks)
    assert low[0] == 0 and high[2] == 1
    assert math.isclose(tail(low[1], range(3, 11)), 0.025, rel_tol=1e-6) and math.isclose(tail(high[1], range(4)), 0.025, rel_tol=1e-6)
    assert math.isclose((1 - high[0]) ** 10, 0.025, rel_tol=1e-6)


def test_change_intervals_by_brand(spark):
    from ledgerline.plans.kernels import _brand_changes

    values = {}
    for r in sorted(_brand_changes(spark, SF).collect(), key=lambda r: r.l_partkey):
        values.setdefault(r.p_brand, []).append(r.change)
    got = {r.p_brand: r for r in catalog.queries()["change_intervals"](spark, SF).collect()}
    assert set(got) == set(values)
    for brand, own in values.items():
        low, high = resample.median_interval(np.array(own))
        assert got[brand].n == len(own) and got[brand].low == pytest.approx(low) and got[brand].high == pytest.approx(high)
        assert got[brand].median == pytest.approx(statistics.median(own))


def test_middle_places_in_pieces():
    for n in (1, 2, 7, 1000, 1001, 200_003):
        g = lambda skip, k: resample.mulberry(99, skip, k)
        picks = np.sort((g(0, n) * n).astype(int))
        assert resample.middle_places(g, n) == resample.middle_places(g, n, 500) == (picks[(n - 1) // 2], picks[n // 2])


def test_classes_are_rows_in_order():
    rng = np.random.default_rng(5)
    rows = sorted((float(rng.integers(0, 2)), bool(rng.random() < 0.4), bool(rng.random() < 0.3)) for _ in range(61))
    kinds = sorted(set(rows))
    counts = np.array([rows.count(k) for k in kinds])
    hit, low, high = (np.array([k[c] for k in kinds]) for c in range(3))
    want = resample.stratum_sums(3, 9, *[np.array([r[c] for r in rows]) for c in range(3)], 40, 200)
    for at_once in (1 << 21, 7):
        assert np.allclose(resample.class_sums(3, 9, counts, hit, low, high, 40, 200, at_once=at_once), want)


def test_binomial_intervals_of_many():
    k = np.array([0, 1, 5, 50, 400, 999, 1000, 0])
    n = np.array([1, 1, 9, 1000, 1000, 1000, 1000, 0])
    low, high = resample.binomial_interval(k, n)
    for x, m, a, b in zip(k.tolist(), n.tolist(), low, high):
        upper = lambda p: sum(math.exp(math.lgamma(m + 1) - math.lgamma(j + 1) - math.lgamma(m - j + 1) + j * math.log(p) + (m - j) * math.log1p(-p)) for j in range(x, m + 1))
        lower = lambda p: sum(math.exp(math.lgamma(m + 1) - math.lgamma(j + 1) - math.lgamma(m - j + 1) + j * math.log(p) + (m - j) * math.log1p(-p)) for j in range(x + 1))
        assert a == 0 if x == 0 else math.isclose(upper(a), 0.025, rel_tol=1e-6)
        assert b == 1 if x == m else math.isclose(lower(b), 0.025, rel_tol=1e-6)


# the registered queries against loops over their own rows


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def brand_rows(spark):
    """{brand: [(part, 1996's median, 1997's)]} in the order of parts."""
    prices, out = {}, {}
    for r in table(spark, "lineitem").collect():
        if r.l_shipdate.year in (1996, 1997):
            prices.setdefault(r.l_partkey, {}).setdefault(r.l_shipdate.year, []).append(r.l_extendedprice / r.l_quantity)
    for r in sorted(table(spark, "part").collect(), key=lambda r: r.p_partkey):
        own = prices.get(r.p_partkey, {})
        if len(own) == 2:
            out.setdefault(r.p_brand, []).append((r.p_partkey, statistics.median(own[1996]), statistics.median(own[1997])))
    return out


def test_gap_intervals_query(spark):
    rows = brand_rows(spark)
    arrays = {b: (np.array([x[2] for x in v]), np.log([x[2] / x[1] for x in v])) for b, v in rows.items()}
    got = {(r.a, r.b): (r.low, r.high) for r in catalog.queries()["gap_intervals"](spark, SF).collect()}
    assert got.keys() == {(a, b) for a in rows for b in rows if a < b}
    for (a, b), own in list(got.items())[::17]:
        sims = np.sort(resample.gap_sims(0, 200, *arrays[a], *arrays[b]))
        assert own == (math.floor(sims[10] + 0.5), math.floor(sims[190] + 0.5))


def test_stratified_intervals_query(spark):
    months = {}
    for r in table(spark, "lineitem").collect():
        months.setdefault((r.l_shipdate.year, r.l_shipdate.month), []).append((float(r.l_returnflag == "R"), r.l_extendedprice <= 20_000, r.l_extendedprice > 60_000))
    total, skip, sums = sum(map(len, months.values())), 0, np.zeros((100, 4))
    for m in sorted(months):
        own = sorted(months[m])
        sums += resample.stratum_sums(0, 100, *[np.array([r[c] for r in own]) for c in range(3)], skip, total)
        skip += len(own)
    x = np.sort(sums[:, 2] / sums[:, 3] - sums[:, 0] / sums[:, 1])
    (r,) = catalog.queries()["stratified_intervals"](spark, SF).collect()
    assert math.isclose(r.low, round(x[5], 6), abs_tol=2e-6) and math.isclose(r.high, round(x[95], 6), abs_tol=2e-6)


def test_cluster_intervals_query(spark):
    last, logs = {}, {}
    brand = {r.p_partkey: r.p_brand for r in table(spark, "part").collect()}
    rows = [(r.l_partkey, r.l_suppkey, r.l_shipdate, r.l_orderkey, r.l_extendedprice / r.l_quantity) for r in table(spark, "lineitem").collect() if r.l_shipdate.year >= 1997]
    for part, supp, _, _, unit in sorted(rows):
        if (part, supp) in last:
            logs.setdefault(brand[part], {}).setdefault(part, []).append(math.log(unit / last[part, supp]))
        last[part, supp] = unit
    got = {r.p_brand: r for r in catalog.queries()["cluster_intervals"](spark, SF).collect()}
    assert got.keys() == {b for b, parts in logs.items() if len(parts) >= 2}
    for b, r in got.items():
        units = [sorted(logs[b][p]) for p in sorted(logs[b])]
        values, sizes = np.concatenate(units), np.array([len(u) for u in units])
        sims = np.sort(resample.cluster_sims(0, 400, values, sizes))
        assert math.isclose(r.low, sims[20], abs_tol=1e-8) and math.isclose(r.high, sims[380], abs_tol=1e-8) and math.isclose(r.jitter, resample.jitter(values, sizes), abs_tol=1e-8)


def test_keyed_intervals_query(spark):
    sides = {}
    for r in sorted(table(spark, "customer").collect(), key=lambda r: (r.c_acctbal, r.c_custkey)):
        if r.c_acctbal > 0:
            sides.setdefault(r.c_mktsegment, ([], []))[r.c_custkey % 2].append(r.c_acctbal)
    got = {r.c_mktsegment: r for r in catalog.queries()["keyed_intervals"](spark, SF).collect()}
    assert got.keys() == set(sides)
    for name, (was, now) in sides.items():
        sims = resample.yoy_sims(0, 300, np.array(was), np.array(now), 4.2, 4.0, resample.key_seed(name, 1))
        assert np.allclose([got[name].low, got[name].high], np.quantile(sims, [0.025, 0.975]), atol=1e-8)


def test_binomial_intervals_query(spark):
    years = {}
    for r in table(spark, "lineitem").collect():
        years.setdefault(r.l_suppkey, {}).setdefault(r.l_shipdate.year, []).append(r.l_returnflag == "R")
    got = {r.l_suppkey: (r.k, r.n, r.low, r.high) for r in catalog.queries()["binomial_intervals"](spark, SF).collect()}
    assert got.keys() == years.keys()
    for s, own in years.items():
        first = own[min(own)]
        low, high = resample.binomial_interval(np.array([sum(first)]), np.array([len(first)]))
        assert got[s][:2] == (sum(first), len(first)) and np.allclose(got[s][2:], [low[0], high[0]], atol=1e-8)


def test_backtests_query(spark):
    months = {}
    for r in table(spark, "lineitem").collect():
        key = r.l_returnflag, r.l_shipdate.year * 12 + r.l_shipdate.month - 1
        months[key] = months.get(key, 0) + r.l_quantity
    for r in catalog.queries()["backtests"](spark, SF).collect():
        series = [months[k] for k in sorted(months) if k[0] == r.l_returnflag]
        model, still = resample.backtest(np.diff(np.log(series)), r.horizon)
        assert r.n == len(model) and math.isclose(r.mae, np.abs(model).mean(), rel_tol=1e-9) and math.isclose(r.mae_still, np.abs(still).mean(), rel_tol=1e-9)
        assert r.win_share == resample.block_win_share(np.abs(still) - np.abs(model))
