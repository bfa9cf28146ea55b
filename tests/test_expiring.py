"""State that leaves after its term, against the batch twins."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import events, guard
from ledgerline.streaming import expiring

DAY = dt.timedelta(days=1)
T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def run(spark, tmp_path):
    """Feed batches, one file each, to make(stream); the rows that come out and the checkpoint."""
    expiring.with_state_store(spark)

    def go(batches, schema, make):
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/b{k}")
            (name,) = [n for n in os.listdir(f"{tmp_path}/b{k}") if n.endswith(".parquet")]
            os.makedirs(f"{tmp_path}/in", exist_ok=True)
            os.replace(f"{tmp_path}/b{k}/{name}", f"{tmp_path}/in/{k:03d}.parquet")
            os.utime(f"{tmp_path}/in/{k:03d}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        out, cp = f"{tmp_path}/out", f"{tmp_path}/cp"
        q = make(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
        return spark.read.parquet(out), cp

    yield go
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def keys_in_state(spark, checkpoint, name):
    return {r.key[0] for r in spark.read.format("statestore").option("stateVarName", name).load(checkpoint).collect()}


def test_state_leaves_after_the_term_and_rows_do_not_arrive_again_within_it(spark, run):
    at = lambda k, d: (k, T0 + d * DAY)
    batches = [[at("a", 0), at("b", 0), at("c", 0)], [at("a", 5)], [at("a", 14), at("d", 14)], [at("b", 16), at("e", 20)], [at("e", 21)]]
    got, cp = run(batches, "k string, ts timestamp", lambda s: expiring.first_seen(s, ["k"], "ts", 10 * DAY))
    days = sorted((r.k, (r.ts - T0).days) for r in got.collect())
    # a came back within ten days, twice; b after sixteen; c never did
    assert days == [("a", 0), ("b", 0), ("b", 16), ("c", 0), ("d", 14), ("e", 20)]
    assert keys_in_state(spark, cp, "span") == {"a", "b", "d", "e"}


def test_first_seen_equals_its_batch_twin(spark, run):
    rng = random.Random(4)
    batches = [[(rng.choice(["a", "b", None, "x"]), T0 + (k * 4 + rng.random() * 4) * DAY) for _ in range(rng.randint(1, 5))] for k in range(8)]
    schema = "k string, ts timestamp"
    got, _ = run(batches, schema, lambda s: expiring.first_seen(s, ["k"], "ts", 5 * DAY))
    twin = events.arrivals_after_gap(spark.createDataFrame([r for b in batches for r in b], schema), ["k"], "ts", "5 days")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, twin.collect()))


def test_holds_leave_with_acceptance_and_with_the_term(spark, run):
    at = lambda s, d, v: (s, T0 + d * DAY, v)
    batches = [[at("s", 0, "half"), at("t", 0, "zero"), at("u", 0, "zero")], [at("s", 1, "half"), at("t", 1, "accept")], [at("s", 1, "half"), at("s", 2, "half"), at("s", 3, "half")],
               [at("t", 4, "half")], [at("s", 40, "half"), at("v", 40, "accept")], [at("w", 41, "half")]]
    schema = "slot string, day timestamp, verdict string"
    got, cp = run(batches, schema, lambda s: expiring.expiring_holds(s, term=30 * DAY))
    rows = sorted((r.slot, (r.day - T0).days, r.held, r.release) for r in got.collect())
    assert rows == [("s", 0, 1, False), ("s", 1, 2, False), ("s", 2, 3, False), ("s", 3, 4, True), ("s", 40, 1, False), ("t", 0, 1, False), ("t", 4, 1, False), ("u", 0, 1, False), ("w", 41, 1, False)]
    assert keys_in_state(spark, cp, "held") == {"s", "w"}
    within = [r for b in batches[:4] for r in b]
    twin = guard.holds(spark.createDataFrame(within, schema).select("slot", F.to_date("day").alias("day"), "verdict"), "slot", "day")
    assert sorted((r.slot, (r.day - T0.date()).days, r.held, r.release) for r in twin.collect()) == [r for r in rows if r[1] < 40]
