"""Statistics of cells: change, spread, ratios, chains, groups, bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import dates, numbers, stats
from ..operators import cells, lookup, series
from .common import r, t


def _unit_prices(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_returnflag", "l_linestatus", "l_quantity", "l_shipdate", (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"))


@query("""
WITH c AS (
  SELECT p_brand, l_partkey,
    median(l_extendedprice / l_quantity) FILTER (WHERE year(l_shipdate) = 1996) AS b,
    median(l_extendedprice / l_quantity) FILTER (WHERE year(l_shipdate) = 1997) AS r
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE year(l_shipdate) IN (1996, 1997) GROUP BY 1, 2)
SELECT p_brand, count(*)::BIGINT AS cells, CASE WHEN count(*) >= 3 THEN round(median(ln(r / b)), 6) END AS change
FROM c WHERE b > 0 AND r > 0 GROUP BY 1
""")
def same_cell_change(spark: SparkSession, d: str) -> DataFrame:
    """Median log change of unit prices from 1996 to 1997 over parts that trade in both, by brand."""
    year = F.year("l_shipdate")
    rows = _unit_prices(spark, d).join(t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return cells.same_cell_change(rows, ["l_partkey"], ["p_brand"], year == 1996, year == 1997, "unit", 3).withColumn("change", r(F.col("change"), 6))


@query("""
WITH c AS (
  SELECT l_partkey, count(*) FILTER (WHERE l_returnflag = 'R') AS n_target, count(*) FILTER (WHERE l_returnflag <> 'R') AS n_control,
    median(l_extendedprice / l_quantity) FILTER (WHERE l_returnflag = 'R') AS t,
    median(l_extendedprice / l_quantity) FILTER (WHERE l_returnflag <> 'R') AS c
  FROM lineitem GROUP BY 1)
SELECT l_partkey, n_target::BIGINT AS n_target, n_control::BIGINT AS n_control, round((t / c - 1) * 100, 4) AS ratio
FROM c WHERE n_target > 0 AND n_control >= 3 AND c > 0 AND abs((t / c - 1) * 100) <= 50
""")
def target_against_control(spark: SparkSession, d: str) -> DataFrame:
    """Returned against kept lines of a part: percent by which the medians of unit price differ."""
    back = F.col("l_returnflag") == "R"
    return cells.cell_ratio(_unit_prices(spark, d), ["l_partkey"], back, ~back, "unit", 3, 50.0).withColumn("ratio", r(F.col("ratio")))


@query("""
WITH m AS (
  SELECT l_partkey, year(l_shipdate) * 12 + month(l_shipdate) - 1 AS mi, median(l_extendedprice / l_quantity) AS m FROM lineitem GROUP BY 1, 2),
p AS (SELECT *, lag(m) OVER w AS p, lag(mi) OVER w AS pmi FROM m WINDOW w AS (PARTITION BY l_partkey ORDER BY mi)),
c AS (SELECT mi, count(*) AS pairs, median(ln(m / p)) AS ch FROM p WHERE pmi = mi - 1 AND m > 0 AND p > 0 GROUP BY 1)
SELECT mi::INT AS mi, pairs::BIGINT AS pairs, round(ch, 6) AS change, round(100 * exp(sum(ch) OVER (ORDER BY mi)), 4) AS level FROM c
""")
def chained_index(spark: SparkSession, d: str) -> DataFrame:
    """Median month-on-month change over parts that trade in both months, chained to an index."""
    rows = _unit_prices(spark, d).withColumn("mi", dates.month_index(F.col("l_shipdate")))
    chained = cells.chain_index(cells.chain_changes(rows, ["l_partkey"], "mi", "unit"), "mi")
    return chained.select("mi", "pairs", r(F.col("change"), 6).alias("change"), r(F.col("level")).alias("level"))


@query("""
WITH c AS (SELECT l_partkey, max(l_extendedprice / l_quantity) / min(l_extendedprice / l_quantity) AS x, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 3),
g AS (SELECT p_brand, list_sort(list(x)) AS v, median(x) AS m, count(*) AS n FROM c JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT p_brand, n::BIGINT AS n, CASE WHEN n >= 10 THEN round(m, 6) END AS median,
  CASE WHEN n >= 20 THEN round(v[least(n, floor(n * 0.25)::BIGINT + 1)], 6) END AS q1,
  CASE WHEN n >= 20 THEN round(v[least(n, floor(n * 0.75)::BIGINT + 1)], 6) END AS q3
FROM g
""")
def spread_with_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Median from 10 cells on, quartiles from 20 on, by the rule sorted[floor(n q)]."""
    per = _unit_prices(spark, d).groupBy("l_partkey").agg((F.max("unit") / F.min("unit")).alias("x"), F.count("*").alias("c")).where("c >= 3")
    rows = per.join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    own = rows.groupBy("p_brand").agg(F.count("*").alias("n"), F.median("x").alias("m"))
    n = F.col("n")
    out = own.join(stats.quantile_floor(rows, ["p_brand"], "x", {"a": 0.25, "b": 0.75}), "p_brand")
    return out.select("p_brand", "n", r(stats.suppressed(F.col("m"), n, 10), 6).alias("median"), r(stats.suppressed(F.col("a"), n, 20), 6).alias("q1"), r(stats.suppressed(F.col("b"), n, 20), 6).alias("q3"))


@query("""
SELECT c_mktsegment, count(*)::BIGINT AS n, round(quantile_cont(c_acctbal, 0.25), 4) AS r7, round(quantile_disc(c_acctbal, 0.9), 4) AS disc,
  round(list_sort(list(c_acctbal))[least(count(*), floor(count(*) * 0.95)::BIGINT + 1)], 4) AS lo, floor(median(c_acctbal) + 0.5)::BIGINT AS whole
FROM customer GROUP BY 1
""")
def three_quantile_rules(spark: SparkSession, d: str) -> DataFrame:
    """Interpolated, ceiling-rank and floor-rank quantiles and the rounded median."""
    x, rows = F.col("c_acctbal"), t(spark, d, "customer")
    own = rows.groupBy("c_mktsegment").agg(
        F.count("*").alias("n"), r(stats.quantile_r7(x, 0.25)).alias("r7"), r(stats.quantile_disc("c_acctbal", 0.9)).alias("disc"), stats.median_whole(x).alias("whole"))
    low = stats.quantile_floor(rows, ["c_mktsegment"], "c_acctbal", {"lo": 0.95})
    return own.join(low, "c_mktsegment").select("c_mktsegment", "n", "r7", "disc", r(F.col("lo")).alias("lo"), "whole")


@query("""
WITH RECURSIVE v AS (SELECT DISTINCT p_brand, p_size::DOUBLE AS s FROM part),
c AS (SELECT p_brand, p_size::DOUBLE AS s, count(*) AS n FROM part GROUP BY 1, 2),
f AS (
  SELECT p_brand, min(s) AS first FROM v GROUP BY 1
  UNION ALL
  SELECT f.p_brand, (SELECT min(v.s) FROM v WHERE v.p_brand = f.p_brand AND v.s >= f.first + 3) FROM f
  WHERE (SELECT min(v.s) FROM v WHERE v.p_brand = f.p_brand AND v.s >= f.first + 3) IS NOT NULL),
g AS (SELECT c.*, (SELECT max(first) FROM f WHERE f.p_brand = c.p_brand AND first <= c.s) AS grp FROM c)
SELECT p_brand, s AS size, first_value(s) OVER (PARTITION BY p_brand, grp ORDER BY n DESC, s) AS label FROM g
""")
def greedy_size_groups(spark: SparkSession, d: str) -> DataFrame:
    """Sizes grouped greedily in steps of 3 from each group's first, labelled by the most frequent."""
    rows = t(spark, d, "part").select("p_brand", F.col("p_size").cast("double").alias("size"))
    return cells.greedy_groups(rows, ["p_brand"], "size", 3.0)


@query("""
WITH b AS (SELECT CASE WHEN p_retailprice < 1000 THEN 0 WHEN p_retailprice >= 1800 THEN 1800 ELSE floor(p_retailprice / 100) * 100 END::BIGINT AS band,
  CASE WHEN p_size < 10 THEN 0 WHEN p_size < 25 THEN 1 ELSE 2 END AS size_band, p_brand FROM part)
SELECT band, size_band::INT AS size_band, p_brand, count(*)::BIGINT AS n FROM b GROUP BY CUBE (band, size_band, p_brand)
""")
def count_cube(spark: SparkSession, d: str) -> DataFrame:
    """Counts by price band, size band and brand, with all totals."""
    rows = t(spark, d, "part").select(
        numbers.band_floor(F.col("p_retailprice"), 100, 1000, 1800).alias("band"), numbers.band(F.col("p_size"), [10, 25]).cast("int").alias("size_band"), "p_brand")
    return rows.cube("band", "size_band", "p_brand").agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT l_linestatus, l_returnflag, year(l_shipdate) AS y, count(*) AS n, sum(l_extendedprice) AS v FROM lineitem GROUP BY GROUPING SETS ((l_linestatus), (l_returnflag), (l_linestatus, l_returnflag)), y)
SELECT l_linestatus, l_returnflag, y::INT AS y, n::BIGINT AS n, round(v, 0) AS v FROM s
""")
def segment_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """Counts and sums by status, by flag and by both, for each year."""
    rows = t(spark, d, "lineitem").withColumn("y", F.year("l_shipdate"))
    y, a, b = F.col("y"), F.col("l_linestatus"), F.col("l_returnflag")
    return rows.groupingSets([[y, a], [y, b], [y, a, b]], y, a, b).agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 0).alias("v")).select("l_linestatus", "l_returnflag", "y", "n", "v")


@query("""
WITH m AS (SELECT l_partkey, date_trunc('month', l_shipdate) AS ym, median(l_extendedprice / l_quantity) AS market FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2 HAVING count(*) >= 2),
g AS (SELECT l_partkey, (l_extendedprice / l_quantity) / market - 1 AS gap FROM lineitem JOIN m USING (l_partkey) WHERE l_returnflag = 'R' AND date_trunc('month', l_shipdate) = ym)
SELECT count(*)::BIGINT AS rows, round(median(gap), 6) AS median_gap, count(*) FILTER (WHERE gap <= -0.1)::BIGINT AS below FROM g
""")
def row_to_aggregate_gap(spark: SparkSession, d: str) -> DataFrame:
    """Returned lines against the median of new lines of the same part and month."""
    rows = _unit_prices(spark, d).withColumn("ym", F.date_trunc("month", "l_shipdate"))
    market = rows.where("l_returnflag = 'N'").groupBy("l_partkey", "ym").agg(F.median("unit").alias("market"), F.count("*").alias("n")).where("n >= 2").drop("n")
    gap = rows.where("l_returnflag = 'R'").join(market, ["l_partkey", "ym"]).select((F.col("unit") / F.col("market") - 1).alias("gap"))
    return gap.agg(F.count("*").alias("rows"), r(F.median("gap"), 6).alias("median_gap"), F.count_if(F.col("gap") <= -0.1).alias("below"))


@query("""
WITH m AS (SELECT l_returnflag, l_linestatus, year(l_shipdate) * 12 + month(l_shipdate) - 1 AS mi, l_extendedprice / l_quantity AS u FROM lineitem),
x AS (SELECT l_returnflag, mi, count(*) AS n FROM m GROUP BY 1, 2)
SELECT a.l_returnflag, a.mi::INT AS mi, (SELECT round(quantile_cont(u, 0.5), 6) FROM m WHERE m.l_returnflag = a.l_returnflag AND m.mi BETWEEN a.mi - 5 AND a.mi) AS median6 FROM x a
""")
def rolling_median(spark: SparkSession, d: str) -> DataFrame:
    """Median over the last six months, rows of all of them together, from counts in bins of equal ratio."""
    rows = _unit_prices(spark, d).withColumn("mi", dates.month_index(F.col("l_shipdate")))
    return series.rolling_median(rows, ["l_returnflag"], "mi", "unit", 6).select("l_returnflag", "mi", r(F.col("median"), 6).alias("median6"))


@query("""
WITH b AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER w AS k, sum(n) OVER w AS run, count(*) FILTER (WHERE n < 12) OVER (PARTITION BY p_brand) AS small FROM b WINDOW w AS (PARTITION BY p_brand ORDER BY n, p_type)),
x AS (SELECT *, coalesce(lag(run) OVER (PARTITION BY p_brand ORDER BY n, p_type), 0) AS before FROM w),
y AS (SELECT p_brand, CASE WHEN small > 0 AND (n < 12 OR k <= 2 OR before < 12) THEN 'other' ELSE p_type END AS p_type, n FROM x),
z AS (SELECT p_brand, p_type, sum(n) AS n, count(*) AS members FROM y GROUP BY 1, 2)
SELECT p_brand, p_type, CASE WHEN NOT (p_type = 'other' AND (n < 12 OR members < 2)) THEN n END::BIGINT AS n, members::BIGINT AS members FROM z
""")
def complementary_suppression(spark: SparkSession, d: str) -> DataFrame:
    """Small types of a brand merged into `other` until it can be shown."""
    counts = t(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return cells.merged_small(counts, ["p_brand"], "p_type", "n", 12)


@query("""
WITH x AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2)
SELECT p_brand, p_type AS mode_type, n::BIGINT AS n FROM x QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) = 1
""")
def mode_with_ties(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent type of a brand, ties in the order of names."""
    counts = t(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return lookup.top_k(counts, ["p_brand"], 1, F.desc("n"), F.col("p_type")).select("p_brand", F.col("p_type").alias("mode_type"), "n")


@query("""
WITH c AS (SELECT l_partkey, median(l_extendedprice / l_quantity) AS m FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
s AS (SELECT (l_extendedprice / l_quantity) / m AS x FROM lineitem JOIN c USING (l_partkey) WHERE l_linestatus = 'O')
SELECT CASE WHEN x > 1.02 THEN 'above' WHEN x < 0.98 THEN 'below' ELSE 'equal' END AS standing, count(*)::BIGINT AS n FROM s GROUP BY 1
""")
def standing_against_live(spark: SparkSession, d: str) -> DataFrame:
    """Open lines against the median of finished lines of their part, in classes of two percent."""
    rows = _unit_prices(spark, d)
    live = rows.where("l_linestatus = 'F'").groupBy("l_partkey").agg(F.median("unit").alias("m"))
    x = F.col("unit") / F.col("m")
    named = rows.where("l_linestatus = 'O'").join(live, "l_partkey").select(F.when(x > 1.02, "above").when(x < 0.98, "below").otherwise("equal").alias("standing"))
    return named.groupBy("standing").agg(F.count("*").alias("n"))


@query("""
WITH c AS (SELECT l_partkey, year(l_shipdate) AS y, median(l_extendedprice / l_quantity) AS m FROM lineitem WHERE year(l_shipdate) IN (1996, 1997) GROUP BY 1, 2),
b AS (SELECT l_partkey, max(CASE WHEN y = 1996 THEN floor(m / 100) END) AS was, max(CASE WHEN y = 1997 THEN floor(m / 100) END) AS now FROM c GROUP BY 1)
SELECT now::BIGINT AS now, count(*) FILTER (WHERE was = now)::BIGINT AS stayed, count(*) FILTER (WHERE was < now)::BIGINT AS rose,
  count(*) FILTER (WHERE was > now)::BIGINT AS fell, count(*) FILTER (WHERE was IS NULL)::BIGINT AS came FROM b WHERE now IS NOT NULL GROUP BY 1
""")
def band_flow(spark: SparkSession, d: str) -> DataFrame:
    """Price bands of parts a year apart: who stayed, rose, fell, or had no price before."""
    rows = _unit_prices(spark, d).withColumn("y", F.year("l_shipdate")).where("y IN (1996, 1997)")
    per = rows.groupBy("l_partkey").agg(F.floor(F.median(F.when(F.col("y") == 1996, F.col("unit"))) / 100).alias("was"), F.floor(F.median(F.when(F.col("y") == 1997, F.col("unit"))) / 100).alias("now"))
    return per.where("now IS NOT NULL").groupBy("now").agg(F.count_if(F.col("was") == F.col("now")).alias("stayed"), F.count_if(F.col("was") < F.col("now")).alias("rose"), F.count_if(F.col("was") > F.col("now")).alias("fell"), F.count_if(F.col("was").isNull()).alias("came"))
