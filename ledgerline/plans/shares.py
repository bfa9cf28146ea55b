"""Shares, intervals, stratified rates, pivots, suppression, selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import dates, finance, numbers, stats
from .common import r, t

_Z = 1.6448536269514722


@query(f"""
WITH s AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS x FROM lineitem GROUP BY 1),
w AS (SELECT *, x / n AS p, {_Z} AS z FROM s)
SELECT l_suppkey, x::BIGINT AS x, n::BIGINT AS n,
  round(((p + z*z/(2*n)) - z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) AS low, round(((p + z*z/(2*n)) + z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) AS high FROM w
""")
def wilson_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Share of returned lines by supplier with its 90 % interval."""
    s = t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("x"), F.count("*").alias("n"))
    low, high = stats.wilson(F.col("x"), F.col("n"))
    return s.select("l_suppkey", "x", "n", r(low, 6).alias("low"), r(high, 6).alias("high"))


@query("""
WITH s AS (SELECT p_brand, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS x FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), a AS (SELECT sum(n) AS n2, sum(x) AS x2 FROM s)
SELECT p_brand, round(x / n, 6) AS share, abs(x/n - x2/n2) > 2 * sqrt(x/n*(1-x/n)/n + x2/n2*(1-x2/n2)/n2) AS differs FROM s, a
""")
def differs_from_all(spark: SparkSession, d: str) -> DataFrame:
    """Brands whose share of returned lines differs from that of all by two standard errors."""
    rows = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    s = rows.groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("x"))
    total = s.agg(F.sum("n").alias("n2"), F.sum("x").alias("x2"))
    both = s.join(F.broadcast(total))
    return both.select("p_brand", r(F.col("x") / F.col("n"), 6).alias("share"), stats.differs(F.col("x"), F.col("n"), F.col("x2"), F.col("n2")).alias("differs"))


@query("""
WITH m AS (SELECT date_trunc('month', l_shipdate) AS ym, floor(l_quantity / 10)::INT AS band, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS x FROM lineitem GROUP BY 1, 2),
a AS (SELECT ym, sum(x) / sum(n) AS rate FROM m GROUP BY 1)
SELECT band, sum(n)::BIGINT AS n, round(sum(x - n * rate) / sum(n), 6) AS excess FROM m JOIN a USING (ym) GROUP BY 1
""")
def stratified_excess(spark: SparkSession, d: str) -> DataFrame:
    """Excess share of returned lines by quantity band over the rate of the same month."""
    m = t(spark, d, "lineitem").groupBy(F.date_trunc("month", "l_shipdate").alias("ym"), F.floor(F.col("l_quantity") / 10).cast("int").alias("band")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("x"))
    rate = m.groupBy("ym").agg((F.sum("x") / F.sum("n")).alias("rate"))
    return m.join(rate, "ym").groupBy("band").agg(F.sum("n").alias("n"), r(F.sum(F.col("x") - F.col("n") * F.col("rate")) / F.sum("n"), 6).alias("excess"))


@query("""
WITH m AS (SELECT date_trunc('month', l_shipdate) AS ym, count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'F') AS done FROM lineitem GROUP BY 1)
SELECT ym, n::BIGINT AS n, round(done / n, 6) AS share FROM m WHERE done / n >= 0.3
""")
def mature_months(spark: SparkSession, d: str) -> DataFrame:
    """Months of which enough is finished."""
    m = t(spark, d, "lineitem").groupBy(F.date_trunc("month", "l_shipdate").alias("ym")).agg(F.count("*").alias("n"), stats.share(F.col("l_linestatus") == "F").alias("share"))
    return m.where("share >= 0.3").withColumn("share", r(F.col("share"), 6))


@query("""
SELECT n_name, CASE WHEN count(*) >= 30 THEN round(avg(c_acctbal), 4) END AS mean, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1
""")
def suppressed_means(spark: SparkSession, d: str) -> DataFrame:
    """Means of groups that are large enough, counts of all."""
    rows = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(r(stats.suppressed(F.avg("c_acctbal"), F.count("*"), 30)).alias("mean"), F.count("*").alias("n"))


@query("""
SELECT year(l_shipdate)::INT AS y, count(*) FILTER (WHERE l_returnflag = 'A')::BIGINT AS A, count(*) FILTER (WHERE l_returnflag = 'N')::BIGINT AS N, count(*) FILTER (WHERE l_returnflag = 'R')::BIGINT AS R FROM lineitem GROUP BY 1
""")
def pivot_counts(spark: SparkSession, d: str) -> DataFrame:
    """Lines by year and flag, flags as columns from a fixed list."""
    rows = t(spark, d, "lineitem").withColumn("y", F.year("l_shipdate")).groupBy("y").pivot("l_returnflag", ["A", "N", "R"]).agg(F.count(F.lit(1)))
    return rows.select("y", *[F.coalesce(c, F.lit(0)).alias(c) for c in "ANR"])


@query("""
SELECT year(o_orderdate) || CASE WHEN month(o_orderdate) <= 6 THEN 'H1' ELSE 'H2' END AS half, count(*)::BIGINT AS n FROM orders GROUP BY 1
""")
def half_years(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").groupBy(dates.half_year(F.year("o_orderdate"), F.month("o_orderdate")).alias("half")).agg(F.count("*").alias("n"))


@query("""
SELECT CASE WHEN (l_extendedprice * 1000)::BIGINT * 1000 <= (l_quantity * 1000 * 1450)::BIGINT * 1000 THEN 'low' ELSE 'high' END AS band, count(*)::BIGINT AS n FROM lineitem GROUP BY 1
""")
def integer_bands(spark: SparkSession, d: str) -> DataFrame:
    """Bands by whole numbers, so that no edge drifts."""
    a, b = (F.col("l_extendedprice") * 1000).cast("long"), (F.col("l_quantity") * 1000 * 1450).cast("long")
    price = F.round(F.col("l_extendedprice") * 1000).cast("long")
    return t(spark, d, "lineitem").groupBy(F.when(numbers.at_most(price, F.round(F.col("l_quantity") * 1000 * 1450).cast("long"), 1000), "low").otherwise("high").alias("band")).agg(F.count("*").alias("n"))


@query("""
WITH l AS (SELECT l_returnflag, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS lag FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_returnflag, count(*)::BIGINT AS n, median(lag) AS median, round(avg((lag <= 30)::INT), 6) AS within30, round(avg((lag > 90)::INT), 6) AS over90, quantile_disc(lag, 0.9)::INT AS p90 FROM l WHERE lag > -10 AND lag < 400 GROUP BY 1
""")
def lag_timing(spark: SparkSession, d: str) -> DataFrame:
    """Delays from order to shipping: median, shares, 90th percentile."""
    rows = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_returnflag", F.datediff("l_shipdate", "o_orderdate").alias("lag")).where("lag > -10 AND lag < 400")
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.median("lag").alias("median"), r(stats.share(F.col("lag") <= 30), 6).alias("within30"), r(stats.share(F.col("lag") > 90), 6).alias("over90"), stats.quantile_disc("lag", 0.9).cast("int").alias("p90"))


@query("""
SELECT p_partkey, round(p_retailprice * (0.04 / 12) * pow(1 + 0.04 / 12, 360) / (pow(1 + 0.04 / 12, 360) - 1), 4) AS payment FROM part
""")
def annuities(spark: SparkSession, d: str) -> DataFrame:
    """Monthly payment of a loan of the price at 4 % over 30 years."""
    return t(spark, d, "part").select("p_partkey", r(finance.monthly_payment(F.col("p_retailprice"), F.lit(4.0))).alias("payment"))


@query("""
SELECT p_brand, count(*) FILTER (WHERE p_retailprice BETWEEN 1300 AND 1400)::BIGINT AS below, count(*) FILTER (WHERE p_retailprice > 1400 AND p_retailprice <= 1500)::BIGINT AS above FROM part GROUP BY 1
""")
def boundary_counts(spark: SparkSession, d: str) -> DataFrame:
    """Parts just below and above a price line."""
    x = F.col("p_retailprice")
    return t(spark, d, "part").groupBy("p_brand").agg(F.count_if(x.between(1300, 1400)).alias("below"), F.count_if((x > 1400) & (x <= 1500)).alias("above"))


@query("""
WITH o AS (SELECT CASE WHEN GROUPING(c_mktsegment) = 1 THEN 'all' ELSE c_mktsegment END AS segment, count(*) AS orders, count(*) FILTER (WHERE o_orderstatus = 'P') AS pending FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment))
SELECT segment, orders::BIGINT AS orders, pending::BIGINT AS pending FROM o
""")
def rolled_up_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts by segment and of all."""
    rows = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = rows.rollup("c_mktsegment").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"), F.grouping("c_mktsegment").alias("g"))
    return o.select(F.when(F.col("g") == 1, "all").otherwise(F.col("c_mktsegment")).alias("segment"), "orders", "pending")
