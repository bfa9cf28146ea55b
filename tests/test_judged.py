"""Compressed budgets, permutations, conditions, indicators and rules of publication against plain Python."""

import gzip
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline import catalog
from ledgerline.functions.text import squash
from ledgerline.operators import budget, conditions, forecasts, indicators, permutations, resample
from ledgerline.plans import judged

SF = "/root/testdata/sf0.001"


# budgets


def smallest_drop(lines, limit):
    """(kept, bytes) of the longest prefix whose gzip file fits, by compressing each."""
    best = 0, 0
    for k in range(1, len(lines) + 1):
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        size = len(b"".join(c.compress(x) for x in lines[:k]) + c.flush())
        if size <= limit:
            best = k, size
    return best


def test_budget_equals_brute_force(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "a", "a", "b", None]), k, rng.choice([None, "", "same line " * 5, "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 200)))])) for k in range(400)] + [("big", 900, "".join(rng.choice("0123456789abcdef") for _ in range(9000))), ("big", 901, "x")]
    df = spark.createDataFrame(rows, "g string, n int, line string").repartition(6)
    for limit in (10, 300, 1500, 10**6):
        got = {r.g: r for r in budget.within_gzip(df, "g", [F.desc("n")], "line", limit).collect()}
        assert got.keys() == {"a", "b", None, "big"}
        for g, r in got.items():
            lines = [(x or "").encode() + b"\n" for _, _, x in sorted((row for row in rows if row[0] == g), key=lambda row: -row[1])]
            kept, size = smallest_drop(lines, limit)
            assert (r.members, r.kept, r.dropped, r.bytes) == (len(lines), kept, len(lines) - kept, size)
            assert (gzip.decompress(r.file) if kept else r.file) == (b"".join(lines[:kept]) if kept else None)
    assert budget.within_gzip(df.limit(0), "g", [F.desc("n")], "line", 100).count() == 0


# permutations


def mean_ranks(values):
    order = sorted(values)
    first, count = {}, {}
    for k, v in enumerate(order, 1):
        first.setdefault(v, k)
        count[v] = count.get(v, 0) + 1
    return [first[v] + (count[v] - 1) / 2 for v in values]


def test_permutations_equal_a_loop(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), k, float(rng.randint(0, 9)), rng.random()) for k in range(120)] + [("a", 500, None, 1.0), (None, 501, 1.0, 1.0), ("one", 502, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "s string, id int, x double, y double").repartition(5)
    block_of = {(r.id, b): r.b for b in (1, 2) for r in df.select("id", F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(b)).alias("b")).collect()}
    for block_rows in (4096, 40):
        got = {r["round"]: r.rho for r in permutations.rank_permutations(df, "s", "id", "x", "y", 250, 7, block_rows).collect()}
        sums, xx, yy = [0.0] * 251, 0.0, 0.0
        for s in ("a", "b", "one"):
            own = sorted((r for r in rows if r[0] == s and r[2] is not None), key=lambda r: r[1])
            rx, ry = (np.array(mean_ranks([r[c] for r in own])) - (len(own) + 1) / 2 for c in (2, 3))
            xx, yy = xx + rx @ rx, yy + ry @ ry
            n_blocks = -(-len(own) // block_rows)
            for b in range(n_blocks):
                at = [k for k, r in enumerate(own) if (block_of[r[1], n_blocks] if n_blocks > 1 else 0) == b]
                for k in range(251):
                    sums[k] += rx[at] @ (ry[at] if k == 0 else ry[at][permutations.shuffled(7, s, b, k, len(at))])
        assert got.keys() == set(range(251)) and all(math.isclose(got[k], sums[k] / math.sqrt(xx * yy), abs_tol=1e-9) for k in got)


def test_permutation_verdict(spark):
    rows = [(k, v) for k, v in enumerate([0.3, 0.1, -0.3, 0.4, 0.2])]
    (r,) = permutations.judged(spark.createDataFrame(rows, "round int, rho double")).collect()
    assert (r.rho, r.rounds, r.p_two_sided, r.p_greater) == (0.3, 4, 3 / 5, 2 / 5)
    rng = random.Random(1)
    linked = [("s", k, float(k), k + rng.random() * 40) for k in range(200)]
    (r,) = permutations.judged(permutations.rank_permutations(spark.createDataFrame(linked, "s string, id int, x double, y double"), "s", "id", "x", "y", 200, 1)).collect()
    assert r.rho > 0.9 and r.p_two_sided == 1 / 201
    assert permutations.rank_permutations(spark.createDataFrame([], "s string, id int, x double, y double"), "s", "id", "x", "y", 5, 1).where("rho IS NOT NULL").count() == 0


def test_permuted_ranks_query(spark):
    """The registered query against a loop over its own rows."""
    part = spark.read.parquet(f"{SF}/part.parquet")
    line = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("u", F.col("l_extendedprice") / F.col("l_quantity"))
    unit = line.groupBy("l_partkey").agg(F.round(F.median("u"), 6).alias("unit"))
    rows = part.join(unit, part.p_partkey == unit.l_partkey).select("p_brand", "p_partkey", "p_size", "unit").collect()
    sums, xx, yy = np.zeros(401), 0.0, 0.0
    for s in {r.p_brand for r in rows}:
        own = sorted((r for r in rows if r.p_brand == s), key=lambda r: r.p_partkey)
        rx, ry = (np.array(mean_ranks([r[c] for r in own])) - (len(own) + 1) / 2 for c in (2, 3))
        xx, yy = xx + rx @ rx, yy + ry @ ry
        sums += [rx @ (ry if k == 0 else ry[permutations.shuffled(20261103, s, 0, k, len(own))]) for k in range(401)]
    rho = sums / math.sqrt(xx * yy)
    (r,) = catalog.queries()["permuted_ranks"](spark, SF).collect()
    far = (np.abs(rho[1:]) >= abs(rho[0]) - 1e-12).sum()
    assert math.isclose(r.rho, rho[0], abs_tol=1e-8) and r.p_two_sided == (far + 1) / 401
    assert np.allclose([r.low, r.high], np.quantile(rho[1:], [0.025, 0.975]), atol=1e-8)


# conditions


@pytest.mark.parametrize("text, eok, m2, area_class", [
    ("8억", 8.0, None, None), ("3억5천", 3.5, None, None), ("12억 3000", 12.0, None, None), ("강남 7.5억 이하", 7.5, None, None), ("84㎡", None, 84.0, "60-85"), ("84제곱미터", None, 84.0, "60-85"),
    ("59.9m2", None, 59.9, "60"), ("34평", None, 34 * 3.3058, "85-135"), ("60㎡", None, 60.0, "60"), ("135.1㎡", None, 135.1, "135"), ("0억", None, None, None), ("억", None, None, None), ("", None, None, None), (None, None, None, None)])
def test_amounts_and_areas(spark, text, eok, m2, area_class):
    q = squash(F.coalesce(F.col("t"), F.lit("")))
    (r,) = spark.createDataFrame([(text,)], "t string").select(conditions.amount(q).alias("e"), conditions.area(q).alias("a"), conditions.area_class(conditions.area(q)).alias("c")).collect()
    assert r.e == eok and (r.a is None) == (m2 is None) and (m2 is None or math.isclose(r.a, m2)) and r.c == area_class


def test_interpreted_and_found(spark):
    places = spark.createDataFrame([("중구",), ("중랑구",), ("랑구",), ("강남구",), (None,), (" ",)], "place string")
    texts = ["중랑구 8억", "중구", "강남 구 84㎡ 이상 3억5천 미만", "그냥", None, "12억 초과 60m2 이하", "9억", "34평", "20억 이상"]
    df = spark.createDataFrame([(k, x, "mine") for k, x in enumerate(texts)], "id int, text string, other string")
    rows = {r.id: r for r in conditions.interpreted(df, places).collect()}
    plain = {k: [(c.field, c.op, c.number and round(c.number, 4), c.text) for c in r.conditions] for k, r in rows.items()}
    assert plain[0] == [("place", "=", None, "중랑구"), ("band", "=", 8.0, None)] and plain[2] == [("place", "=", None, "강남구"), ("amount", "<", 3.5, None), ("area", ">=", 84.0, None)]
    assert plain[5] == [("amount", ">", 12.0, None), ("area", "<=", 60.0, None)] and plain[7] == [("area_class", "=", None, "85-135")]
    assert [rows[k].state for k in range(9)] == ["read", "exact", "read", "nothing", "nothing", "read", "read", "read", "read"] and all(r.other == "mine" for r in rows.values())
    rng = random.Random(3)
    deals = [(k, rng.choice(["중구", "중랑구", "강남구", None]), rng.choice([None, round(rng.uniform(1, 25), 2)]), rng.choice([None, round(rng.uniform(20, 180), 1)])) for k in range(400)]
    got = conditions.found(conditions.interpreted(df, places), spark.createDataFrame(deals, "deal int, place string, eok double, m2 double"), "id", "place", "eok", "m2").collect()
    ops = {"<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, ">": lambda a, b: a > b}
    klass = lambda m: next(n for b, n in conditions.AREA_CLASSES if b is None or m <= b)

    def meets(deal, c):
        _, place, eok, m2 = deal
        if c.field == "place":
            return place == c.text
        v = m2 if c.field in ("area", "area_class") else eok
        return v is not None and (math.floor(v) == c.number if c.field == "band" else klass(v) == c.text if c.field == "area_class" else ops[c.op](v, c.number))

    want = sorted((k, d[0]) for k, r in rows.items() if r.state == "read" for d in deals if all(meets(d, c) for c in r.conditions))
    assert sorted((r.id, r.deal) for r in got) == want and len({k for k, _ in want}) >= 6


def test_counted_meets_each_question_once(spark, monkeypatch):
    """Copies of questions and of deals are met once; numbers and smallest keys are those of all pairs."""
    texts = ["중구 8억", "84㎡ 이상 3억5천 미만", "12억 초과 60m2 이하", "그냥", "중구  8억", "34평"]
    asked = spark.createDataFrame([(k, texts[k % 6]) for k in range(60)], "id int, text string")
    read = conditions.interpreted(asked, spark.createDataFrame([("중구",)], "place string"))
    rng = random.Random(4)
    kinds = [(rng.choice(["중구", None]), rng.choice([None, float(rng.randint(1, 20))]), rng.choice([None, 50.0, 84.0, 110.0])) for _ in range(30)]
    deals = spark.createDataFrame([(900 - k, *kinds[k % 30]) for k in range(600)], "deal int, place string, eok double, m2 double")
    want = conditions.found(read, deals, "id", "place", "eok", "m2").groupBy("id").agg(F.count("*").alias("n"), F.min("deal").alias("first")).collect()
    made, own = [], conditions.found

    def noted(*args):
        made.append((args[0].count(), args[1].count()))
        return own(*args)

    monkeypatch.setattr(conditions, "found", noted)
    got = conditions.counted(read, deals, "id", "place", "eok", "m2", "deal").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) >= 20
    assert made[0][0] == 4 and made[0][1] == len(set(kinds))


# indicators


def series_of(seed, n, x=None, weight=0.0):
    rng, y, out = random.Random(seed), 0.0, []
    for m in range(n):
        y += rng.gauss(0, 0.01) + (weight * x[m - 3] if x and m >= 3 else 0)
        out.append(y)
    return out


@pytest.fixture(scope="module")
def grid(spark):
    rng = random.Random(9)
    raw = [rng.gauss(0, 0.01) for _ in range(110)]
    prices = {g: series_of(k, 110, raw, 1.0) for k, g in enumerate(("ALL", "a", "b", "c", "d"))}
    x = [sum(raw[max(0, m - 2):m + 1]) for m in range(110)]  # what the next three months will be moved by
    noise = [rng.gauss(0, 1) for _ in range(110)]
    series = [("lead", m, v) for m, v in enumerate(x)] + [("noise", m, v) for m, v in enumerate(noise) if m != 50]
    cands = [indicators.Candidate("lead", "lead", "level", lags=(0, 1), published=(1,)), indicators.Candidate("noise", "noise", "change", 2, (0,)), indicators.Candidate("norm", "noise", "norm", lags=(0,)), indicators.Candidate("yoy", "noise", "yoy", lags=(0,))]
    known = indicators.values(spark.createDataFrame(series, "series string, month int, value double"), cands)
    df = spark.createDataFrame([(g, m, v) for g, y in prices.items() for m, v in enumerate(y)], "region string, m int, y double")
    return prices, x, noise, known, indicators.errors(df, "region", "m", "y", known, [3])


def test_candidate_values(grid):
    _, x, noise, known, _ = grid
    got = {(r.candidate, r.lag, r.month): r.x for r in known.collect()}
    assert all(math.isclose(got["lead", 1, m], x[m + 1]) for m in range(-1, 109)) and ("lead", 0, 110) not in got
    has = lambda *ms: all(0 <= m < 110 and m != 50 for m in ms)
    mean = lambda ms: sum(noise[m] for m in ms) / len(ms)
    want = {}
    for m in range(110):
        if has(m, m - 2):
            want["noise", 0, m] = noise[m] - noise[m - 2]
        if has(*range(m - 26, m + 1)):
            want["norm", 0, m] = mean(range(m - 2, m + 1)) - mean(range(m - 26, m - 2))
        if has(*range(m - 14, m - 11), *range(m - 2, m + 1)):
            want["yoy", 0, m] = mean(range(m - 2, m + 1)) - mean(range(m - 14, m - 11))
    own = {k: v for k, v in got.items() if k[0] != "lead"}
    assert own.keys() == want.keys() and all(math.isclose(own[k], want[k], abs_tol=1e-12) for k in want)


def test_indicator_errors_equal_least_squares(grid):
    prices, x, _, _, errors = grid
    rows = [r for r in errors.where("candidate = 'lead' AND region IN ('a', 'ALL')").collect()]
    assert rows
    feats = lambda y, i: [1.0, y[i] - y[i - 1], y[i - 1] - y[i - 2], (y[i - 2] - y[i - 6]) / 4]
    for r in rows:
        y, lag, i = prices[r.region], r.lag, r.m
        js = [j for j in range(6, i - 2)]
        both = [j for j in js if j + lag < 110]
        fit = lambda a, b: np.linalg.lstsq(np.array(a), np.array(b), rcond=None)[0]
        target = [y[j + 3] - y[j] for j in js]
        base, same = fit([feats(y, j) for j in js], target), fit([feats(y, j) for j in both], [y[j + 3] - y[j] for j in both])
        added = fit([[*feats(y, j), x[j + lag]] for j in both], [y[j + 3] - y[j] for j in both])
        truth = y[i + 3] - y[i]
        want = [(truth - np.dot(f, b)) * 100 for f, b in ((feats(y, i), base), ([*feats(y, i), x[i + lag]], added), (feats(y, i), same))]
        assert np.allclose([r.base, r["with"], r.same], want, atol=1e-7)


def test_indicator_verdicts(spark, grid):
    rules = indicators.Rules(regions=3)
    scored = indicators.scores(grid[4], "region", "m", rules)
    got = {(r.candidate, r.lag): r.verdict for r in indicators.verdicts(scored, "region", "ALL", rules).collect()}
    assert got["lead", 0] == "leads" and got["lead", 1] in ("published", "no") and got["noise", 0] == "no"
    r = scored.where("region = 'ALL' AND candidate = 'lead' AND lag = 0").first()
    own = sorted(grid[4].where("region = 'ALL' AND candidate = 'lead' AND lag = 0").collect(), key=lambda e: e.m)
    e = {c: np.abs([x[c] for x in own]) for c in ("base", "with", "same")}
    win = min(resample.block_win_share(e[c] - e["with"], 1000, 12, 20261001) for c in ("base", "same"))
    assert r.origins == len(own) and r.win == math.floor(win * 100 + 0.5) / 100 and r.passes == (win >= 0.9)
    rows = [("ALL", "p", 1, True, 3, True), ("ALL", "q", 0, False, 3, True), ("a", "q", 0, False, 3, True)]
    few = spark.createDataFrame(rows, "region string, candidate string, lag int, published boolean, h int, passes boolean")
    assert {r.candidate: r.verdict for r in indicators.verdicts(few, "region", "ALL").collect()} == {"p": "published", "q": "main only"}


def test_indicator_queries_agree(spark):
    errors = judged.indicator_errors(spark, SF).collect()
    scores = catalog.queries()["indicator_scores"](spark, SF).collect()
    assert len({(r.region, r.candidate, r.lag, r.h) for r in scores}) == len(scores) > 20
    for r in scores[::7]:
        own = [e for e in errors if (e.region, e.candidate, e.lag, e.h) == (r.region, r.candidate, r.lag, r.h)]
        assert r.origins == len(own) and r["with"] == math.floor(np.mean([abs(e["with"]) for e in own]) * 100 + 0.5) / 100
    names = {c.name for c in judged.CANDIDATES}
    assert {r.candidate for r in catalog.queries()["indicator_verdicts"](spark, SF).collect()} <= names


def test_kill_rules(spark):
    def judge(rows):
        df = spark.createDataFrame(rows, "g string, own double, low double, high double, other double")
        return indicators.kill_rules(df, "g", "own", "low", "high", "other", 2, 0.5, 3).first()

    good = [("a", 1.0, 0.5, 1.5, 1.0), ("b", 2.0, 1.0, 3.0, 2.0), ("c", 3.0, -1.0, 5.0, 3.0)]
    assert judge(good).passes and math.isclose(judge(good).rho, 1.0)
    against = [("a", 1.0, 0.5, 1.5, -1.0), ("b", 2.0, 1.0, 3.0, -0.5), ("c", 3.0, -1.0, 5.0, 3.0)]
    assert judge(against).kill_sign and judge(against).kill and not judge(against).passes
    assert judge([("a", 1.0, 0.5, 1.5, None)]).kill_rho and not judge(good[:2]).passes
    assert forecasts.PIVOT == 1e-12
