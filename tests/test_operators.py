import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import cells, events, guard, lookup, merge, resample, series, titles
from ledgerline.sources import files, slots


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def test_row_diff_pairs_leftovers(spark):
    old = spark.createDataFrame([("a", "k1"), ("a", "k1"), ("b", "k1"), ("c", "k2")], "line string, k string")
    new = spark.createDataFrame([("a", "k1"), ("b2", "k1"), ("d", "k3")], "line string, k string")
    got = rows(merge.row_diff(old, new, "line", ["k"], F.col("line")))
    assert got == [("appeared", "k3", None, "d"), ("changed", "k1", "a", "b2"), ("gone", "k1", "b", None), ("gone", "k2", "c", None)]


def test_overlay_drops_single_copies(spark):
    base = spark.createDataFrame([("a",), ("a",), ("b",)], "line string")
    gone, new = spark.createDataFrame([("a",)], "line string"), spark.createDataFrame([("z",)], "line string")
    assert rows(merge.apply_overlay(base, gone, new, "line")) == [("a",), ("b",), ("z",)]


@pytest.mark.parametrize("seed", range(3))
def test_as_of_and_nearest_against_loops(spark, seed):
    rnd = random.Random(seed)
    left = [(rnd.choice("ab"), rnd.randint(0, 30), i) for i in range(60)]
    right = [(k, x, x * 10 + i) for i, k in enumerate("ab") for x in sorted(rnd.sample(range(30), 8))]
    a, b = spark.createDataFrame(left, "k string, t int, id int"), spark.createDataFrame(right, "k string, t int, v int")
    for strict in (False, True):
        want = sorted((i, max(((x, v) for q, x, v in right if q == k and (x < t if strict else x <= t)), default=(0, None))[1]) for k, t, i in left)
        assert sorted(tuple(r) for r in lookup.as_of(a, b, ["k"], "t", "v", strict).select("id", "v").collect()) == want
    got = {r.id: r.v for r in lookup.nearest_within(a, b.withColumnRenamed("t", "y"), ["k"], "t", "y", 3.0, "v").collect()}
    want = {i: min(((abs(x - t), v) for q, x, v in right if q == k and abs(x - t) < 3), default=(0, None))[1] for k, t, i in left}
    assert got == {i: v for i, v in want.items() if v is not None}


def test_greedy_groups_compare_with_the_first(spark):
    df = spark.createDataFrame([("k", x) for x in (59.1, 59.6, 60.0, 60.1, 60.1, 60.7)], "k string, a double")
    assert {r.a: r.label for r in cells.greedy_groups(df, ["k"], "a", 1.0).collect()} == {59.1: 59.1, 59.6: 59.1, 60.0: 59.1, 60.1: 60.1, 60.7: 60.1}


def test_same_day_events_do_not_see_each_other(spark):
    df = spark.createDataFrame([("c", 0, 5, 1), ("c", 200, 9, 2), ("c", 200, 8, 3), ("c", 260, 10, 4)], "c string, day int, v int, id int")
    prior = {r.id: (r.prior_n, r.prior_max) for r in events.with_prior(df, ["c"], "day", "v").collect()}
    assert prior == {1: (0, None), 2: (1, 5), 3: (1, 5), 4: (3, 9)}
    following = {r.id: r.next_day for r in events.with_next(df, ["c"], "day", "id", "v", 90).collect()}
    assert following == {1: None, 2: 260, 3: 260, 4: None}


def test_repeat_pair_bounds(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 300, 2.0), ("b", 0, 1.0), ("b", 299, 1.0), ("c", 0, 1.0), ("c", 400, 2.001)], "u string, day int, v double")
    assert rows(events.repeat_pairs(df, ["u"], "day", "v"), "u", "day", "next_day") == [("a", 0, 300)]


def test_guard_and_holds(spark):
    v = guard.ingest_verdict(F.col("s"), F.col("r"), F.col("t"))
    df = spark.createDataFrame([(100, 0, 0), (100, 40, 40), (100, 91, 91), (100, 90, 90), (5, 1, 1), (100, 99, 98), (None, 3, 3)], "s int, r int, t int")
    assert [r[0] for r in df.select(v).collect()] == ["empty", "half", "accept", "drop", "accept", "mismatch", "accept"]
    days = spark.createDataFrame([("x", d, "half") for d in (1, 1, 2, 3, 4)] + [("x", 5, "accept"), ("x", 6, "half")], "slot string, day int, verdict string")
    assert rows(guard.holds(days, "slot", "day"), "day", "held", "release") == [(1, 1, False), (2, 2, False), (3, 3, False), (4, 4, True), (6, 1, False)]


def test_series(spark):
    df = spark.createDataFrame([("a", m, m) for m in (1, 2, 4, 5, 6)], "k string, m int, v int")
    assert rows(series.last_run(df, ["k"], "m"), "m") == [(4,), (5,), (6,)]
    assert rows(df.select("m", series.full_sum(F.col("v"), ["k"], "m", 2).alias("s"))) == [(1, None), (2, 3), (4, None), (5, 9), (6, 11)]


def test_kernels_are_seeded_and_cover():
    assert np.array_equal(resample.draws(7, 50, 40).ravel(), (resample.lcg(7, 2000) * 40).astype(int))
    low, high = resample.median_interval(np.arange(101.0))
    assert low < 50 < high and (low, high) == resample.median_interval(np.arange(101.0))
    x = np.random.default_rng(1).normal(size=(50, 3))
    assert np.allclose(resample.least_squares(x, x @ [1, 2, 3]), [1, 2, 3])
    assert resample.least_squares(np.ones((5, 2)), np.ones(5)) is None
    assert resample.block_win_share(np.ones(30)) == 1.0


def test_median_interval_holds_some_rounds_at_a_time():
    values = np.random.default_rng(1).normal(size=60_000)
    tracemalloc.start()
    got = resample.median_interval(values)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    rows = resample.draws(20261001, 400, len(values))
    medians = np.sort([np.median(values[x]) for x in rows])
    assert got == (medians[20], medians[380])
    assert peak < rows.nbytes


def test_titles_greedy_against_loop(spark):
    rnd = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    data = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 4)))) for i in range(60)] + [(60, None)]
    grams = lambda s: {s[i:i + 2] for i in range(len(s) - 1)}
    kept = []
    for i, x in data:
        g = grams((x or "").replace(" ", ""))
        if not any(g and h and 2 * len(g & h) / (len(g) + len(h)) >= 0.75 for _, h in kept):
            kept.append((i, g))
    got = titles.kept_greedily(spark.createDataFrame(data, "id int, t string"), "id", "t")
    assert sorted(r.id for r in got.collect()) == sorted(i for i, _ in kept)


def test_slots_and_digest(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"kind":"sale","district":"11110","yearMonth":"202601","ok":true,"count":1,"totalCount":1,"arrivals":{"abc":"2026-01-05"},"items":[{"jibun":12,"aptNm":"x"}]}')
    s = slots.read_slots(spark, str(tmp_path / "a.json"))
    assert rows(slots.catalogue(s), "district", "complete") == [("11110", True)]
    assert slots.rows(s).first()["item"]["jibun"] == "12"
    df = spark.createDataFrame([("p", 1, "t1"), ("p", 2, "t1"), ("q", 3, "t1")], "k string, v int, observedAt string")
    other = df.orderBy(F.desc("v")).withColumn("observedAt", F.lit("t2")).withColumn("v", F.when(F.col("k") == "q", 4).otherwise(F.col("v")))
    assert rows(slots.changed_partitions(other, df, ["k"])) == [("q",)]
    slots.write_changed(df, str(tmp_path / "out"), ["k"])
    slots.write_changed(other, str(tmp_path / "out"), ["k"], df)
    assert rows(spark.read.parquet(str(tmp_path / "out")), "k", "v") == [("p", 1), ("p", 2), ("q", 4)]


def test_csv_header_and_budget(spark, tmp_path):
    (tmp_path / "x.csv").write_text('﻿name,amount\n"a ""b"", c",3\n')
    df = files.read_csv(spark, str(tmp_path / "x.csv"))
    assert rows(files.with_header(df, {"title": ["name"], "value": ["amount"]})) == [('a "b", c', "3")]
    with pytest.raises(ValueError):
        files.with_header(df, {"title": ["name"]})
    sized = spark.createDataFrame([("a", 5, 10), ("b", 3, 10), ("c", 3, 10), ("d", 1, 10)], "k string, n int, size int")
    assert rows(files.within_budget(sized, "size", "n", "k", 25), "k") == [("a",), ("b",)]
    files.write_ledger(sized, str(tmp_path / "ledger"), "k")
    assert spark.read.text(str(tmp_path / "ledger")).first()[0] == '{"k":"a","n":5,"size":10}'


def test_nearest_within_keeps_equal_rows(spark):
    from ledgerline.operators import lookup

    left = spark.createDataFrame([("k", 1.0), ("k", 1.0), ("k", 9.0), (None, 1.0)], "k string, x double")
    right = spark.createDataFrame([("k", 1.5, 2), ("k", 0.5, 1)], "k string, y double, tie int")
    got = lookup.nearest_within(left, right, ["k"], "x", "y", 2.0, "tie").collect()
    assert [(r.k, r.x, r.tie) for r in got] == [("k", 1.0, 1), ("k", 1.0, 1)]


def test_nearest_within_joins_no_buckets(spark):
    """Many rows of both sides in one bucket: nearest and ties as in a loop, without a join of the bucket's rows."""
    rnd = random.Random(5)
    left = [(rnd.choice(["a", "b", None]), rnd.choice([None, float("nan"), float(rnd.randint(0, 400))]), i) for i in range(300)]
    right = [(rnd.choice(["a", "b", None]), rnd.choice([None, float("nan"), rnd.randint(0, 800) / 2]), rnd.choice([None, i % 50]), i) for i in range(600)]
    a, b = spark.createDataFrame(left, "k string, x double, id int"), spark.createDataFrame(right, "k string, y double, tie int, other int")
    for tolerance in (0.5, 3.0, 1000.0):
        got = lookup.nearest_within(a, b, ["k"], "x", "y", tolerance, "tie")
        assert got.columns == ["k", "x", "id", "y", "tie", "other"] and "Join" not in got._jdf.queryExecution().executedPlan().toString()
        want = {}
        for k, x, i in left:
            near = [(abs(x - y), tie is not None, tie or 0) for q, y, tie, _ in right if k is not None and q == k and x is not None and y is not None and abs(x - y) < tolerance]
            if near:
                want[i] = min(near)
        assert {r.id: (abs(r.x - r.y), r.tie is not None, r.tie or 0) for r in got.collect()} == want
