"""Forecasts, their log in batch and as streams, correlations of all pairs."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import correlate, forecasts
from ledgerline.streaming.frozen_log import FrozenLog

MADE = "region string, origin int, h int, target int, change double, drift double, low double, high double, day date"
D = dt.date


def ar_series(seed, months, phi=0.6):
    rng, r, y, out = random.Random(seed), 0.0, 0.0, []
    for _ in range(months):
        r = 0.002 + phi * r + rng.gauss(0, 0.01)
        y += r
        out.append(y)
    return out


def plain_prediction(logs, t, h, least=24):
    """(model, drift) by numpy's least squares, or None."""
    feats = lambda i: [1.0, logs[i] - logs[i - 1], logs[i - 1] - logs[i - 2], np.mean([logs[i - k] - logs[i - k - 1] for k in range(2, 6)])]
    js = [j for j in range(6, t - h + 1)]
    if t < 6 or len(js) < least:
        return None
    x, y = np.array([feats(j) for j in js]), np.array([logs[j + h] - logs[j] for j in js])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    return float(np.dot(feats(t), beta)), h * float(np.mean(np.diff(logs[:t + 1])))


@pytest.fixture(scope="module")
def judged(spark):
    data = {"a": ar_series(1, 90), "b": ar_series(2, 70), "short": ar_series(3, 12), "flat": [0.0] * 60}
    df = spark.createDataFrame([(k, m, y) for k, v in data.items() for m, y in enumerate(v)], "region string, m int, y double")
    got = forecasts.with_bands(forecasts.predictions(df, ["region"], "m", "y", [3, 6]), ["region"], "m").collect()
    return data, got


def test_predictions_equal_least_squares(judged):
    data, got = judged
    assert {r.region for r in got} == {"a", "b"}  # too short, and no pivot
    want = {(k, t, h): p for k in ("a", "b") for t in range(len(data[k])) for h in (3, 6) if (p := plain_prediction(data[k], t, h))}
    assert {(r.region, r.m, r.h) for r in got} == set(want)
    for r in got:
        model, drift = want[r.region, r.m, r.h]
        assert math.isclose(r.model, model, abs_tol=1e-9) and math.isclose(r.drift, drift, abs_tol=1e-12)


def test_ranges_see_only_what_had_come(judged):
    data, got = judged
    errors = {(r.region, r.h, r.m): r.error for r in got}
    for r in got:
        past = [e for (g, h, m), e in errors.items() if g == r.region and h == r.h and m + h <= r.m and e is not None]
        if not past:
            assert r.low is None and r.high is None
        else:
            assert np.allclose([r.low, r.high], np.quantile(past, [0.1, 0.9]))


def made(spark, rows):
    return spark.createDataFrame([(*r, D(2026, 9, 1)) for r in rows], MADE)


def release(spark, values, day, region="200", first=24318):
    return spark.createDataFrame([(region, first + k, math.log(v), day) for k, v in enumerate(values)], "region string, m int, y double, day date")


#: Origin 202607 as a month index, and the entry that the values below are known for.
ORIGIN = 2026 * 12 + 6
ENTRY = ("200", ORIGIN, 3, ORIGIN + 3, 2.5, 1.5, -0.5, 5.5)


def test_a_score_is_that_of_the_first_release(spark, tmp_path):
    log = FrozenLog(spark, str(tmp_path))
    log.add_forecasts(made(spark, [ENTRY]), "f", 0)
    log.add_forecasts(made(spark, [(*ENTRY[:4], 9.9, 1.5, -0.5, 5.5)]), "f", 1)
    log.add_release(release(spark, [100], D(2026, 10, 7), first=ORIGIN), "i", 0)
    assert log.entries().first().actual is None
    log.add_release(release(spark, [100, 101, 102, 110], D(2026, 12, 15), first=ORIGIN), "i", 1)
    log.add_release(release(spark, [100, 101, 102, 104], D(2027, 1, 20), first=ORIGIN), "i", 2)
    (e,) = log.entries().collect()
    assert (e.change, e.actual, e.scored_on) == (2.5, 9.53, D(2026, 12, 15))
    (r,) = forecasts.record(log.entries(), ["region"]).collect()
    assert (r.made, r.scored, r.pending, r.mae, r.inside, r.won, r.of) == (1, 1, 0, 7.03, 0, 1, 1)


def test_no_forecast_without_a_change(spark, tmp_path):
    log = FrozenLog(spark, str(tmp_path))
    log.add_forecasts(made(spark, [("210", ORIGIN, 3, ORIGIN + 3, None, None, None, None)]), "f", 0)
    assert log.entries().count() == 0


def test_drift_is_filled_once(spark, tmp_path):
    log = FrozenLog(spark, str(tmp_path))
    log.add_forecasts(made(spark, [("200", ORIGIN, 3, ORIGIN + 3, 2.5, None, -0.5, 5.5), (*ENTRY[:2], 6, *ENTRY[3:])]), "f", 0)
    base = lambda v: spark.createDataFrame([("200", ORIGIN, 3, v), ("200", ORIGIN, 6, v), ("999", ORIGIN, 3, v)], "region string, origin int, h int, drift double")
    log.fill_drift(base(0.7), D(2026, 10, 7), "d", 0)
    log.fill_drift(base(0.9), D(2026, 11, 1), "d", 1)
    got = {r.h: (r.drift, r.drift_added_on) for r in log.entries().collect()}
    assert got == {3: (0.7, D(2026, 10, 7)), 6: (1.5, None)}


def snapshot(log):
    return sorted(map(tuple, log.entries().collect()))


def test_replayed_batches_leave_the_log_unchanged(spark, tmp_path):
    rng = random.Random(5)
    index = {(g, m): [100 + rng.random() * 10 for _ in range(3)] for g in ("200", "210") for m in range(ORIGIN, ORIGIN + 8)}
    makes = [made(spark, [(g, ORIGIN + k, h, ORIGIN + k + h, rng.random(), rng.choice([None, 0.5]), -1.0, 1.0) for g in ("200", "210") for h in (3, 6)]) for k in range(4)]
    releases = []
    for k in range(6):  # each build brings a month more and revises the two before
        rows = [(g, m, math.log(index[g, m][min(2, ORIGIN + k + 2 - m)]), D(2026, 10 if k < 3 else 12, 1 + k)) for g in ("200", "210") for m in range(ORIGIN + k, ORIGIN + k + 3)]
        releases.append(spark.createDataFrame(rows, "region string, m int, y double, day date"))
    log = FrozenLog(spark, f"{tmp_path}/log")

    def replay(order):
        for kind, k in order:
            (log.add_forecasts if kind == "f" else log.add_release)((makes if kind == "f" else releases)[k], kind, k)

    steps = [("f", 0), ("i", 0), ("f", 1), ("f", 2), ("i", 1), ("i", 2), ("f", 3), ("i", 3), ("i", 4), ("i", 5)]
    replay(steps)
    once = snapshot(log)
    assert any(r[9] is not None for r in once) and len(once) == 16
    replay([steps[-1], *steps])
    assert snapshot(log) == once
    # the batch twin over everything at once
    points = releases[0]
    for r in releases[1:]:
        points = points.unionByName(r)
    blank = makes[0].limit(0).drop("day")
    for m in makes:
        blank = forecasts.made(blank, m.drop("day"), ["region"])
    blank = blank.withColumns({"drift_added_on": F.lit(None).cast("date"), "actual": F.lit(None).cast("double"), "scored_on": F.lit(None).cast("date")})
    twin = forecasts.frozen(blank, points, ["region"], "m", "day", "y").select(*log.entries().columns)
    assert sorted(map(tuple, twin.collect())) == once
    assert snapshot(log.compacted(f"{tmp_path}/compact")) == once


def test_two_streams_write_one_log(spark, tmp_path):
    """Forecasts and releases as streams of files; the checkpoints are then lost, so that every epoch runs again."""
    log = FrozenLog(spark, f"{tmp_path}/log")
    made(spark, [(g, ORIGIN + k, 3, ORIGIN + k + 3, 1.0, 0.5, -1.0, 1.0) for g in ("200", "210") for k in range(3)]).repartition(2).write.parquet(f"{tmp_path}/made")
    for k in range(3):
        release(spark, [100, 101, 102, 110, 105 + k, 108 + k][:4 + k], D(2026, 12, 1 + k), first=ORIGIN).coalesce(1).write.mode("append").parquet(f"{tmp_path}/index")

    def run(name, schema, add):
        for attempt in range(2):
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
            q = stream.writeStream.foreachBatch(log.sink(add, name)).option("checkpointLocation", f"{tmp_path}/cp-{name}-{attempt}").trigger(availableNow=True).start()
            q.awaitTermination(120)
            assert q.exception() is None
            yield snapshot(log)

    list(run("made", MADE, log.add_forecasts))
    first, second = run("index", "region string, m int, y double, day date", log.add_release)
    assert first == second
    done = {(r[0], r[1]): r[9] for r in second}
    assert done[("200", ORIGIN)] == 9.53 and done[("210", ORIGIN)] is None and sum(v is not None for v in done.values()) == 3


def test_correlations_of_all_pairs(spark):
    rng = random.Random(3)
    rows = [(f"s{k}", m, rng.gauss(k, 1 + k)) for k in range(7) for m in range(40) if rng.random() < 0.7] + [("flat", m, 1.0) for m in range(40)]
    rows += [("odd", 0, None), ("odd", 1, float("nan")), ("s0", 39, float("inf"))]
    df = spark.createDataFrame(rows, "s string, m int, v double").repartition(3)
    at = {}
    for s, m, v in rows:
        if v is not None and math.isfinite(v):
            at.setdefault(s, {})[m] = v
    want = {}
    for a in at:
        for b in at:
            both = sorted(set(at[a]) & set(at[b]))
            if a < b and both:
                x, y = np.array([at[a][m] for m in both]), np.array([at[b][m] for m in both])
                want[a, b] = len(both), (None if x.std() < 1e-9 or y.std() < 1e-9 else float(np.corrcoef(x, y)[0, 1]))
    for block in (2, 256):
        got = {(r.a, r.b): (r.n, r["corr"]) for r in correlate.pair_correlations(df, "s", "m", "v", block).collect()}
        assert got.keys() == want.keys()
        assert all(got[k][0] == n and (got[k][1] is None if c is None else math.isclose(got[k][1], c, abs_tol=1e-9)) for k, (n, c) in want.items())
    assert correlate.pair_correlations(df.limit(0), "s", "m", "v").count() == 0
