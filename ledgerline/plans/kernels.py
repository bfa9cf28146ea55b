"""Resampling intervals, backtests and correlations, by group. Rows only: SQL has no seeded generator or fit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import dates
from ..operators import ranks, resample, titles
from ..session import checkpointed, ship
from .common import t


def _brand_changes(spark: SparkSession, d: str) -> DataFrame:
    """(brand, part, change): log change of a part's median unit price from 1996 to 1997."""
    rows = t(spark, d, "lineitem").select("l_partkey", F.year("l_shipdate").alias("y"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit")).where("y IN (1996, 1997)")
    per = rows.groupBy("l_partkey").agg(F.median(F.when(F.col("y") == 1996, F.col("unit"))).alias("b"), F.median(F.when(F.col("y") == 1997, F.col("unit"))).alias("r")).where("b > 0 AND r > 0")
    return per.join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "l_partkey", F.ln(F.col("r") / F.col("b")).alias("change"))


def _values(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """A row per group: its values as arrays in a fixed order."""
    own = F.array_sort(F.collect_list(F.struct(*order, *[c for c in values if c not in order])))
    return rows.groupBy(*keys).agg(own.alias("__own")).select(*keys, *[F.col(f"__own.{c}").alias(c) for c in values])


@query()
def change_intervals(spark: SparkSession, d: str) -> DataFrame:
    """90 % resampling interval of each brand's median change over 400 rounds. A brand's cells are one task's."""
    groups = _values(_brand_changes(ship(spark), d), ["p_brand"], ["l_partkey"], ["change"])
    middle = F.aggregate(F.slice(F.array_sort("change"), F.floor((F.size("change") + 1) / 2).cast("int"), 2 - F.size("change") % 2), F.lit(0.0), lambda a, x: a + x) / (2 - F.size("change") % 2)
    groups = groups.withColumns({"n": F.size("change").cast("long"), "median": middle})
    return resample.intervals(groups, ["p_brand", "n", "median"], ["change"], resample.median_sims, 400)


@query()
def gap_intervals(spark: SparkSession, d: str) -> DataFrame:
    """For all pairs of brands, a dimension of fixed size: how the money gap between them changed, with 90 % interval of 200 rounds."""
    rows = t(ship(spark), d, "lineitem").select("l_partkey", F.year("l_shipdate").alias("y"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit")).where("y IN (1996, 1997)")
    per = rows.groupBy("l_partkey").agg(F.median(F.when(F.col("y") == 1996, F.col("unit"))).alias("b"), F.median(F.when(F.col("y") == 1997, F.col("unit"))).alias("recent")).where("b > 0 AND recent > 0")
    per = per.withColumn("log", F.ln(F.col("recent") / F.col("b"))).join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    groups = checkpointed(_values(per, ["p_brand"], ["l_partkey"], ["recent", "log"]))
    a, b = (groups.select(F.col("p_brand").alias(x), F.col("recent").alias(f"recent_{x}"), F.col("log").alias(f"log_{x}")) for x in "ab")
    pairs = a.join(b, F.col("a") < F.col("b"))
    found = resample.intervals(pairs, ["a", "b"], ["recent_a", "log_a", "recent_b", "log_b"], resample.gap_sims, 200)
    return found.select("a", "b", F.floor(F.col("low") + 0.5).alias("low"), F.floor(F.col("high") + 0.5).alias("high"))


@query()
def stratified_intervals(spark: SparkSession, d: str) -> DataFrame:
    """How much more often dear lines are returned than cheap ones of the same month, with 90 % interval: 100 rounds that
    draw within months. Rows of a month that are alike in what counts are one class, and tasks draw from the classes' counts:
    a month's rows are never gathered, and only sums of a round leave a task."""
    rows = t(ship(spark), d, "lineitem").select(
        dates.month_index(F.col("l_shipdate")).alias("m"), (F.col("l_returnflag") == "R").cast("double").alias("hit"), (F.col("l_extendedprice") <= 20_000).alias("low"), (F.col("l_extendedprice") > 60_000).alias("high"))
    classes = rows.groupBy("m", "hit", "low", "high").agg(F.count("*").alias("c"))
    months = classes.groupBy("m").agg(F.sum("c").alias("n"), F.array_sort(F.collect_list(F.struct("hit", "low", "high", "c"))).alias("own"))  # eight classes at most
    # a row per month
    w = Window.partitionBy(F.lit(0)).orderBy("m")
    months = months.select("m", (F.sum("n").over(w) - F.col("n")).alias("skip"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"), "own.hit", "own.low", "own.high", "own.c")
    dealt = months.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(99), F.lit(10)))).repartition(spark.sparkContext.defaultParallelism, "m", "first")

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                sums = resample.class_sums(r["first"], r["first"] + 10, np.array(r["c"]), np.array(r["hit"]), np.array(r["low"]), np.array(r["high"]), r["skip"], r["total"])
                out += [(r["first"] + k, *x) for k, x in enumerate(sums.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)] if out else [pa.array([], pa.int64())] + [pa.array([], pa.float64())] * 4, names=["round", "low", "n_low", "high", "n_high"])

    per = dealt.mapInArrow(run, "round long, low double, n_low double, high double, n_high double").groupBy("round").agg((F.sum("high") / F.sum("n_high") - F.sum("low") / F.sum("n_low")).alias("x"))
    low, high = resample.interval("sims", 100)
    return per.agg(F.collect_list("x").alias("sims")).select(F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query()
def cluster_intervals(spark: SparkSession, d: str) -> DataFrame:
    """By brand, the median change of unit price between a part's successive shipments of one supplier: 90 % interval
    over 400 rounds that draw whole parts, and the range over rounds that leave out a tenth of the parts."""
    rows = t(ship(spark), d, "lineitem").where(F.year("l_shipdate") >= 1997).select("l_partkey", "l_suppkey", "l_shipdate", "l_orderkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"))
    before = F.lag("unit").over(Window.partitionBy("l_partkey", "l_suppkey").orderBy("l_shipdate", "l_orderkey", "unit"))
    logs = rows.withColumn("log", F.ln(F.col("unit") / before)).where("log IS NOT NULL").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    parts = logs.groupBy("p_brand", "l_partkey").agg(F.array_sort(F.collect_list("log")).alias("logs"))
    groups = _values(parts.withColumn("size", F.size("logs")), ["p_brand"], ["l_partkey"], ["logs", "size"]).select("p_brand", F.flatten("logs").alias("logs"), "size")
    groups = checkpointed(groups.where(F.size("size") >= 2))
    sims = resample.by_slices(groups, ["p_brand"], ["logs", "size"], resample.cluster_sims, 400, slices=1)
    swings = resample.by_slices(groups, ["p_brand"], ["logs", "size"], lambda a, b, logs, size: np.array([resample.jitter(logs, size)]), 1, slices=1)
    low, high = resample.interval("sims", 400)
    return sims.select("p_brand", F.round(low, 9).alias("low"), F.round(high, 9).alias("high")).join(swings.select("p_brand", F.round(F.col("sims")[0], 9).alias("jitter")), "p_brand")


@query()
def keyed_intervals(spark: SparkSession, d: str) -> DataFrame:
    """By segment, change of the cost of the median balance at two rates, 95 % interval of 300 rounds with the key's own draws. Balances
    are ranked, tasks draw places, and the balances at the middle ones are looked up: no segment is gathered."""
    rows = t(ship(spark), d, "customer").where("c_acctbal > 0").select("c_mktsegment", "c_custkey", "c_acctbal", F.when(F.col("c_custkey") % 2 == 0, "was").otherwise("now").alias("side"))
    ranked = ranks.gapless(rows, ["c_mktsegment", "side"], [F.col("c_acctbal"), F.col("c_custkey")])
    sizes = rows.groupBy("c_mktsegment").agg(F.count_if(F.col("side") == "was").alias("n_was"), F.count_if(F.col("side") == "now").alias("n_now")).where("n_was > 0 AND n_now > 0")
    sims = resample.median_rounds(sizes, "c_mktsegment", ranked, "c_acctbal", 300, lambda name: resample.key_seed(name, 1), ["was", "now"])
    change = F.col("now") * 4.0 / (F.col("was") * 4.2) - 1
    out = sims.groupBy("c_mktsegment").agg(F.percentile(change, F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return out.select("c_mktsegment", F.round(F.col("q")[0], 9).alias("low"), F.round(F.col("q")[1], 9).alias("high"))


@query()
def binomial_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Exact 95 % interval of the share of returned lines of a supplier's first year, the one of its first line."""
    rows = t(ship(spark), d, "lineitem").select("l_suppkey", "l_returnflag", F.year("l_shipdate").alias("y"))
    per = rows.groupBy("l_suppkey", "y").agg(F.count_if(F.col("l_returnflag") == "R").alias("k"), F.count("*").alias("n"))
    own = per.groupBy("l_suppkey").agg(F.min_by(F.struct("k", "n"), "y").alias("x")).select("l_suppkey", "x.k", "x.n")

    def run(batches):
        for batch in batches:
            k, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "n"))
            low, high = resample.binomial_interval(k, n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low), pa.array(high)], names=[*batch.schema.names, "low", "high"])

    return own.mapInArrow(run, "l_suppkey long, k long, n long, low double, high double").select("l_suppkey", "k", "n", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query()
def backtests(spark: SparkSession, d: str) -> DataFrame:
    """Autoregression against no change on monthly series, horizons 3 and 6, with the share of block resamples it wins."""
    m = t(ship(spark), d, "lineitem").groupBy("l_returnflag", dates.month_index(F.col("l_shipdate")).alias("mi")).agg(F.sum("l_quantity").alias("q"))
    w = Window.partitionBy("l_returnflag").orderBy("mi")
    logs = m.withColumn("change", F.ln(F.col("q") / F.lag("q").over(w))).where("change IS NOT NULL")
    wide = logs.withColumn("horizon", F.explode(F.array(F.lit(3), F.lit(6))))

    def kernel(rows):
        model, still = resample.backtest(rows["change"].to_numpy(), int(rows["horizon"].iloc[0]))
        if not len(model):
            return {"n": 0, "mae": None, "mae_still": None, "win_share": None}
        return {"n": len(model), "mae": float(np.abs(model).mean()), "mae_still": float(np.abs(still).mean()), "win_share": resample.block_win_share(np.abs(still) - np.abs(model))}

    return resample.per_group(wide, ["l_returnflag", "horizon"], ["mi"], {"n": "long", "mae": "double", "mae_still": "double", "win_share": "double"}, kernel)


@query("""
WITH x AS (SELECT l_returnflag, l_quantity AS a, l_extendedprice AS b FROM lineitem)
SELECT l_returnflag, round(corr(a, b), 6) AS pearson, count(*)::BIGINT AS n FROM x GROUP BY 1
""")
def correlations(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of quantity and price."""
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("pearson"), F.count("*").alias("n"))


@query(r"""
WITH s AS (SELECT doc_id, split_part(text, chr(10), 1) AS title FROM documents),
x AS (SELECT *, lower(regexp_replace(regexp_replace(title, '\[[^\]]*\]|\([^)]*\)', '', 'g'), '[^\p{L}\p{N}]', '', 'g')) AS f FROM s),
c AS (SELECT min(doc_id) AS doc_id, f FROM x WHERE length(f) >= 2 GROUP BY f),
gr AS (SELECT DISTINCT doc_id, substr(f, i, 2) AS gram FROM (SELECT doc_id, f, unnest(range(1, length(f))) AS i FROM c)),
n AS (SELECT doc_id, count(*) AS n FROM gr GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM gr a JOIN gr b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT b, list(a) AS near FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 2.0 * c / (x.n + y.n) >= 0.75 GROUP BY 1),
o AS (SELECT list({'b': b, 'near': near} ORDER BY b) AS l FROM e),
last AS (SELECT list_reduce(list_prepend({'b': 0::BIGINT, 'near': []::BIGINT[]}, coalesce(l, [])),
  lambda acc, x: {'b': x.b, 'near': CASE WHEN len(list_filter(x.near, lambda i: NOT list_contains(acc.near, i))) > 0 THEN list_append(acc.near, x.b) ELSE acc.near END}).near AS gone FROM o)
SELECT doc_id, title FROM x WHERE coalesce(length(f), 0) < 2 OR doc_id IN (SELECT doc_id FROM c, last WHERE NOT list_contains(gone, c.doc_id))
""")
def titles_kept_greedily(spark: SparkSession, d: str) -> DataFrame:
    """Whole first lines in order, without those that are like an earlier kept one."""
    first = t(spark, d, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"))
    return titles.kept_greedily(first, "doc_id", "title").select("doc_id", "title")
