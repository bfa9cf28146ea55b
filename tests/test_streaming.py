"""Streams against their batch twins."""

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import guard
from ledgerline.streaming import arrivals


def drained(query_df, mode, name, spark):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


@pytest.fixture
def source(spark, tmp_path):
    def make(df, files=1):
        path = str(tmp_path / "in")
        df.repartition(files).write.parquet(path)
        return spark.readStream.schema(df.schema).parquet(path)

    return make


def test_weeks_settle_after_the_grace(spark, source):
    days = ["2024-01-01", "2024-01-03", "2024-01-08", "2024-01-29"]
    df = spark.createDataFrame([(d, "a", 1.0) for d in days], "d string, k string, v double").select(F.to_timestamp("d").alias("ts"), "k", "v")
    got = drained(arrivals.weekly(source(df), "ts", ["k"], "v", "3 days"), "append", "weeks", spark)
    assert sorted((str(r.week)[:10], r.n) for r in got.collect()) == [("2024-01-01", 2), ("2024-01-08", 1)]


def test_first_arrivals(spark, source):
    df = spark.createDataFrame([("x", "2024-01-01"), ("x", "2024-01-01"), ("y", "2024-01-02")], "id string, d string").select("id", F.to_timestamp("d").alias("ts"))
    got = drained(arrivals.first_arrivals(source(df), ["id"], "ts", "10 days"), "append", "firsts", spark)
    assert sorted(r.id for r in got.collect()) == ["x", "y"]


def test_holds_match_the_batch(spark, source):
    rows = [("s", f"2024-01-0{d}", "accept" if d == 3 else "half") for d in range(1, 9)] + [("t", "2024-01-01", "half"), ("t", "2024-01-01", "half")]
    df = spark.createDataFrame(rows, "slot string, d string, verdict string").select("slot", F.to_date("d").alias("day"), "verdict")
    got = drained(arrivals.holds(source(df)), "append", "holds", spark)
    want = guard.holds(df, "slot", "day")
    key = lambda r: tuple(r)
    assert sorted(map(key, got.select("slot", "day", "held", "release").collect())) == sorted(map(key, want.collect()))
