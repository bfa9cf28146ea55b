"""Repeat sales, chosen periods, lines of months, aliases and payload shapes on small cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import periods, trades
from ledgerline.sources import shape

RAW = "id int, cdealType string, dealingGbn string, dealYear int, dealMonth int, dealDay int, dealAmount string"


def raw(spark, *rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], RAW)


def test_trades_that_count(spark):
    rows = raw(spark, ("", "중개거래", 2024, 5, 3, "275,000"), ("O", "중개거래", 2024, 5, 3, "x"), (None, "중개거래", 2024, 6, 30, " 1,000 "), ("", "직거래", 2024, 5, 3, "1"), ("", None, 2024, 5, 3, "1"), ("", "중개거래", 2024, 7, 1, "1"))
    got = trades.trades(rows, 202405, 202406).collect()
    assert [(r.id, r.ym, str(r.day), r.amount) for r in got] == [(0, 202405, "2024-05-03", 275000), (2, 202406, "2024-06-30", 1000)]
    for bad in (("", "중개거래", 2024, 5, 3, "27x"), ("", "중개거래", 2024, 5, 3, ""), ("", "중개거래", 2024, 5, 3, "0"), ("", "중개거래", 2024, 5, 3, None), ("", "중개거래", 2024, 2, 30, "5")):
        with pytest.raises(Exception, match="no (amount|day)"):
            trades.trades(raw(spark, bad), 202401, 202412).collect()


def test_pairs_and_index(spark):
    deals = spark.createDataFrame([("a", "2024-01-01", 202401, 100.0, 0), ("a", "2024-10-27", 202410, 200.0, 1), ("a", "2024-10-27", 202410, 201.0, 2), ("a", "2025-08-23", 202508, 402.1, 3), ("b", "2024-01-01", 202401, 100.0, 4)], "h string, d string, ym int, v double, k int").withColumn("d", F.to_date("d"))
    got = trades.house_pairs(deals, ["h"], "d", "ym", "v", ["k"], 300, 2.0).orderBy("month_a").collect()
    # 300 days are kept and 299 are not, a factor of exactly 2 is kept and more is not
    assert [(r.month_a, r.month_b, r.gap, r.outlier) for r in got] == [(202401, 202410, 300, False), (202410, 202508, 300, True)]
    index = spark.createDataFrame([("a", 202401, 50.0), ("a", 202410, 60.0)], "h string, m int, v double")
    both = trades.index_changes(spark.createDataFrame(got), index, ["h"], "m", "v")
    assert [r.official and round(r.official, 6) for r in both.orderBy("month_a").collect()] == [round(math.log(1.2), 6), None]
    (r,) = trades.repeat_table(both, ["h"], ["h"], 1, 0.4).collect()
    assert (r.before, r.excluded, r.pairs, r.houses, r.official_pairs, r.official_dropped, r.qualified, r.many_outliers) == (2, 1, 1, 1, 1, 0, True, True)
    assert math.isclose(r.difference, math.log(2) - math.log(1.2))


def test_aliases_chains_and_circles(spark):
    rng = random.Random(3)
    table = {k: rng.randint(0, 60) for k in rng.sample(range(60), 45)}

    def end(k):
        seen = []
        while k in table and table[k] != k and k not in seen:
            seen.append(k)
            k = table[k]
        return min(seen[seen.index(k):]) if k in seen else k

    df = spark.createDataFrame(list(table.items()) + [(None, 1), (2000, None)], "o int, n int")
    got = {r.o: r.n for r in trades.aliases(df, "o", "n").collect()}
    assert got == {k: end(k) for k, v in table.items() if k != v}
    ids = trades.stable_ids(spark.createDataFrame([(k,) for k in [*range(70), None]], "id int"), "id", trades.aliases(df, "o", "n"), "o", "n", "s")
    assert {r.id: r.s for r in ids.collect()} == {None: None} | {k: end(k) for k in range(70)}
    assert trades.aliases(df.limit(0), "o", "n").count() == 0


def test_period_pairs(spark):
    rows = [(1, [10, 11, 12, 22, 23, 24], 24), (2, [1, 2, 4, None, 22, 23, 24], 24), (3, [1, 2, 22, 23, 24], 24), (4, None, 24), (5, [20, 21, 19], 24)]
    df = spark.createDataFrame(rows, "k int, m array<int>, e int").select("k", periods.period_pairs(F.col("m"), F.col("e")).alias("p"))
    got = {r.k: r.p and (r.p.base, r.p.recent, r.p.gap) for r in df.collect()}
    assert got == {1: ([10, 11, 12], [22, 23, 24], 12), 2: ([1, 2, 4], [22, 23, 24], 21), 3: None, 4: None, 5: ([19, 20, 21], [22, 23, 24], 3)}


def test_window_basis(spark):
    df = spark.createDataFrame([("w1", 13, 5, 9), ("w2", 12, 5, 9), ("w3", 25, 4, None), ("w4", None, 9, 9)], "w string, c long, a long, b long")
    got = {r.w: (r.need, r.short, r.basis) for r in periods.window_basis(df, ["w"], "c", 25, {"a": "sale", "b": "rent"}, 5).collect()}
    assert got == {"w1": (13, [], "arrival"), "w2": (13, [], "contract"), "w3": (13, ["sale", "rent"], "contract"), "w4": (13, [], "contract")}


def test_latest_dominance(spark):
    rows = [("g", m, k >= stale) for m, stale in ((1, 1), (2, 0), (3, 5)) for k in range(30)] + [("g", 4, k >= 20) for k in range(30)] + [("one", 1, k > 0) for k in range(10)] + [("none", 1, False)]
    df = spark.createDataFrame(rows, "g string, m int, reg boolean")
    got = {r.g: tuple(r)[1:] for r in periods.latest_dominance(df, ["g"], "m", F.col("reg")).collect()}
    assert got == {"g": (3, 6, 3, 83.3, 1.7), "one": (1, 1, None, None, None)}


def test_month_lines(spark):
    pairs = spark.createDataFrame([("x", 1, 4.0), ("x", 1, 5.0), ("x", 3, None), ("y", 1, 9.0), ("x", 9, 1.0), (None, 2, 3.0)], "g string, m int, r double")
    groups = spark.createDataFrame([("x",), ("y",), ("z",), (None,)], "g string")
    got = {(r.g, r.m): (r.rate, r.pairs, r.partial) for r in periods.month_lines(pairs, "g", "m", "r", groups, 1, 3, 2, 1).collect()}
    assert len(got) == 12 and got["x", 1] == (4.5, 2, False) and got["all", 1] == (5.0, 3, False) and got["y", 1] == (None, 1, False) and got["z", 3] == (None, 0, True) and got["x", 3] == (None, 0, True)


def test_payload_shapes(spark):
    texts = ['{"a":1,"b":"x"}', '{"a":"1","c":null}', '{"b":[1],"z":{"q":1.5}}', "[1,2]", "{bad", None, "{}", "3", '{"a":1.25,"b":true}', '{"a b":1}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, p string")
    agreed = shape.Agreed(("a",), ("b", "c"), {"a": ("number",), "b": ("string",)}, ("c", "d"))
    got = {r.id: r.problems for r in shape.checked(df, "p", agreed).collect()}
    assert got == {0: [], 1: ["type a"], 2: ["missing a", "unknown z", "type b"], 3: ["no object"], 4: ["broken"], 5: ["broken"], 6: ["missing a"], 7: ["no object"], 8: ["type b"], 9: ["missing a", "unknown a b"]}
    seen = {(r.key, r.type): r.rows for r in shape.describe(df, "p").collect()}
    assert seen == {(None, "array"): 1, (None, "broken"): 2, (None, "number"): 1, ("a", "number"): 2, ("a", "string"): 1, ("b", "array"): 1, ("b", "boolean"): 1, ("b", "string"): 1, ("c", "null"): 1, ("z", "object"): 1, ("a b", "number"): 1}
    assert [r.key for r in shape.absent(df, "p", agreed).collect()] == ["d"] and shape.absent(df.limit(0), "p", agreed).count() == 0
    assert {r.id: r.m for r in df.select("id", shape.projected(F.col("p"), agreed).alias("m")).collect()}[2] == {"b": "[1]"}
