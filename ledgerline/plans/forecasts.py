"""Forecasts of unit prices by region, judged as of the time, and their log; months are order months, arrivals ship months."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import dates
from ..operators import correlate, forecasts
from ..session import checkpointed
from .common import r, t

#: A month is published this many months after it.
LATE = 2
#: Forecasts of origins before this month index lack a drift, as entries from before there was one.
NO_DRIFT_BEFORE = 1998 * 12
#: The month index in which missing drifts were filled.
FILLED_ON = 2001 * 12

_LINES = """l AS (SELECT r_name AS region, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS m, greatest(year(o_orderdate) * 12 + month(o_orderdate) - 1, year(l_shipdate) * 12 + month(l_shipdate) - 1) AS arrived, l_extendedprice AS v, l_quantity AS q
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

_PREDICTED = _LINES + """,
s0 AS (SELECT region, m, ln(sum(v) / sum(q)) AS y FROM l GROUP BY 1, 2),
s1 AS (SELECT *, m - row_number() OVER (PARTITION BY region ORDER BY m) AS run FROM s0),
s AS (SELECT region, m, y FROM s1 QUALIFY run = max(run) OVER (PARTITION BY region)),
c AS (SELECT *, y - lag(y) OVER w AS r FROM s WINDOW w AS (PARTITION BY region ORDER BY m)),
f AS (SELECT *, r AS x1, lag(r, 1) OVER w AS x2, (lag(r, 2) OVER w + lag(r, 3) OVER w + lag(r, 4) OVER w + lag(r, 5) OVER w) / 4 AS x3, avg(r) OVER (w ROWS UNBOUNDED PRECEDING) AS mean FROM c WINDOW w AS (PARTITION BY region ORDER BY m)),
h AS (SELECT f.*, g.h, CASE g.h WHEN 3 THEN lead(y, 3) OVER w ELSE lead(y, 6) OVER w END - y AS z FROM f, (VALUES (3), (6)) g(h) WINDOW w AS (PARTITION BY g.h, region ORDER BY m)),
k AS (SELECT *, (x3 IS NOT NULL AND z IS NOT NULL) AS ok FROM h),
u AS (
  SELECT a.region, a.m, a.h, a.z, a.mean, a.x1, a.x2, a.x3, count(b.m) AS n, sum(b.x1) AS s1, sum(b.x2) AS s2, sum(b.x3) AS s3, sum(b.x1 * b.x1) AS s11, sum(b.x1 * b.x2) AS s12, sum(b.x1 * b.x3) AS s13, sum(b.x2 * b.x2) AS s22, sum(b.x2 * b.x3) AS s23, sum(b.x3 * b.x3) AS s33,
    sum(b.z) AS b0, sum(b.x1 * b.z) AS b1, sum(b.x2 * b.z) AS b2, sum(b.x3 * b.z) AS b3
  FROM k a JOIN k b ON a.region = b.region AND a.h = b.h AND b.m <= a.m - a.h AND b.ok WHERE a.x3 IS NOT NULL GROUP BY ALL HAVING count(b.m) >= 24),
e1 AS (SELECT *, s11 - s1 * s1 / n AS a11, s12 - s1 * s2 / n AS a12, s13 - s1 * s3 / n AS a13, s22 - s2 * s2 / n AS a22, s23 - s2 * s3 / n AS a23, s33 - s3 * s3 / n AS a33, b1 - s1 * b0 / n AS c1, b2 - s2 * b0 / n AS c2, b3 - s3 * b0 / n AS c3 FROM u),
e2 AS (SELECT *, a22 - a12 * a12 / a11 AS e22, a23 - a12 * a13 / a11 AS e23, a33 - a13 * a13 / a11 AS e33, c2 - a12 * c1 / a11 AS d2, c3 - a13 * c1 / a11 AS d3 FROM e1),
e3 AS (SELECT *, (d3 - e23 * d2 / e22) / (e33 - e23 * e23 / e22) AS t3 FROM e2),
e4 AS (SELECT *, (d2 - e23 * t3) / e22 AS t2 FROM e3),
e5 AS (SELECT *, (c1 - a12 * t2 - a13 * t3) / a11 AS t1 FROM e4),
p AS (SELECT region, m, h, (b0 - s1 * t1 - s2 * t2 - s3 * t3) / n + t1 * x1 + t2 * x2 + t3 * x3 AS model, h * mean AS drift, z AS truth FROM e5),
j AS (SELECT a.region, a.m, a.h, a.model, a.drift, a.truth, a.truth - a.model AS error, quantile_cont(b.truth - b.model, 0.1) AS low, quantile_cont(b.truth - b.model, 0.9) AS high
  FROM p a LEFT JOIN p b ON a.region = b.region AND a.h = b.h AND b.m + b.h <= a.m AND b.truth IS NOT NULL GROUP BY ALL)"""

_LOG = _PREDICTED + """,
en AS (SELECT region, m AS origin, h, m + h AS target, floor(model * 10000 + 0.5) / 100 AS change, floor(drift * 10000 + 0.5) / 100 AS drift0, floor((model + low) * 10000 + 0.5) / 100 AS low, floor((model + high) * 10000 + 0.5) / 100 AS high FROM j WHERE low IS NOT NULL),
pt0 AS (SELECT region, m, greatest(m + 2, arrived) AS build, sum(v) AS v, sum(q) AS q FROM l GROUP BY ALL),
pt AS (SELECT region, m, build, ln(sum(v) OVER w / sum(q) OVER w) AS y FROM pt0 WINDOW w AS (PARTITION BY region, m ORDER BY build)),
fi AS (SELECT region, m, min(build) AS since FROM pt GROUP BY ALL),
da AS (SELECT en.*, CASE WHEN a.since IS NOT NULL AND b.since IS NOT NULL THEN greatest(a.since, b.since) END AS scored_on
  FROM en LEFT JOIN fi a ON a.region = en.region AND a.m = origin LEFT JOIN fi b ON b.region = en.region AND b.m = target),
lg AS (SELECT region, origin, h, target, change, drift0 AS drift, low, high, CASE WHEN origin < 23976 THEN 24012 END AS drift_added_on, scored_on,
  floor(((SELECT max_by(y, build) FROM pt WHERE pt.region = da.region AND m = target AND build <= scored_on) - (SELECT max_by(y, build) FROM pt WHERE pt.region = da.region AND m = origin AND build <= scored_on)) * 10000 + 0.5) / 100 AS actual FROM da)"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """(region, m, arrived, v, q) of each line: order month, the later of order and ship month, price and quantity."""
    nation = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    customer = t(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "nation", "region")
    orders = t(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "nation", "region", dates.month_index(F.col("o_orderdate")).alias("m"))
    lines = t(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select("nation", "region", "m", F.greatest("m", dates.month_index(F.col("l_shipdate"))).alias("arrived"), F.col("l_extendedprice").alias("v"), F.col("l_quantity").alias("q"), "l_partkey")


def _series(lines: DataFrame, key: str) -> DataFrame:
    """(key, m, y): the log unit price of each month of the last run without a missing one."""
    from ..operators import series

    monthly = lines.groupBy(key, "m").agg(F.ln(F.sum("v") / F.sum("q")).alias("y"))
    return series.last_run(monthly, [key], "m").select(key, "m", "y")


def _judged(lines: DataFrame, key: str = "region") -> DataFrame:
    return forecasts.with_bands(forecasts.predictions(_series(lines, key), [key], "m", "y", [3, 6]), [key], "m")


def _points(lines: DataFrame) -> DataFrame:
    """(region, m, build, y): what each build says of a month from the second after it on, where it says anything new."""
    from pyspark.sql import Window

    new = lines.groupBy("region", "m", F.greatest(F.col("m") + LATE, "arrived").alias("build")).agg(F.sum("v").alias("v"), F.sum("q").alias("q"))
    w = Window.partitionBy("region", "m").orderBy("build")
    return new.select("region", "m", "build", F.ln(F.sum("v").over(w) / F.sum("q").over(w)).alias("y"))


def _log(lines: DataFrame) -> DataFrame:
    """The log after all builds: forecasts of all origins, drifts filled, scores frozen at the first build that had them."""
    # the log reads both several times: a row per origin, and a row per month and build
    own = checkpointed(forecasts.entries(_judged(lines), ["region"], "m"))
    old = own.withColumn("drift", F.when(F.col("origin") >= NO_DRIFT_BEFORE, F.col("drift")))
    blank = old.withColumns({"drift_added_on": F.lit(None).cast("int"), "actual": F.lit(None).cast("double"), "scored_on": F.lit(None).cast("int")})
    filled = forecasts.drift_filled(blank, own, ["region"], F.lit(FILLED_ON))
    return forecasts.frozen(filled, checkpointed(_points(lines)), ["region"], "m", "build", "y")


@query("WITH " + _PREDICTED + "SELECT region, m::INT AS m, h::INT AS h, round(model, 6) AS model, round(drift, 6) AS drift, round(truth, 6) AS truth, round(low, 6) AS low, round(high, 6) AS high FROM j")
def region_forecasts(spark: SparkSession, d: str) -> DataFrame:
    """Every origin's forecast of a region's unit price three and six months on, with the range of errors known by then."""
    return _judged(_lines(spark, d)).select("region", "m", "h", *[r(F.col(c), 6).alias(c) for c in ("model", "drift", "truth", "low", "high")])


@query("WITH " + _PREDICTED + """,
x AS (SELECT region, h, truth * 100 AS t, model * 100 AS mo, drift * 100 AS dr, abs(truth * 100) >= 0.5 AS moved FROM j WHERE truth IS NOT NULL)
SELECT region, h::INT AS h, count(*)::BIGINT AS origins, floor(avg(abs(t - mo)) * 100 + 0.5) / 100 AS mae_model, floor(avg(abs(t)) * 100 + 0.5) / 100 AS mae_naive, floor(avg(abs(t - dr)) * 100 + 0.5) / 100 AS mae_drift,
  floor(avg(((mo > 0) = (t > 0))::INT) FILTER (WHERE moved) * 10000 + 0.5) / 100 AS hit, floor(avg((t > 0)::INT) FILTER (WHERE moved) * 10000 + 0.5) / 100 AS always_up FROM x GROUP BY 1, 2
""")
def forecast_scorecard(spark: SparkSession, d: str) -> DataFrame:
    """Mean errors of the regression, of no change and of the mean change, and how often the direction was right."""
    return forecasts.scorecard(_judged(_lines(spark, d)), ["region"])


@query("WITH " + _PREDICTED + "SELECT region, h::INT AS h, count(*)::BIGINT AS origins, count(*) FILTER (WHERE error BETWEEN low AND high)::BIGINT AS inside FROM j WHERE truth IS NOT NULL AND low IS NOT NULL GROUP BY 1, 2")
def forecast_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How often a result lay in the range that was known when the forecast was made."""
    return forecasts.coverage(_judged(_lines(spark, d)), ["region"])


@query("WITH " + _LOG + "SELECT region, origin::INT AS origin, h::INT AS h, target::INT AS target, change, drift, low, high, drift_added_on::INT AS drift_added_on, actual, scored_on::INT AS scored_on FROM lg")
def frozen_forecast_log(spark: SparkSession, d: str) -> DataFrame:
    """The forecast log: entries that stay as made, drifts filled once, results as first published."""
    return _log(_lines(spark, d)).select("region", "origin", "h", "target", "change", "drift", "low", "high", "drift_added_on", "actual", "scored_on")


@query("WITH " + _LOG + """SELECT region, h::INT AS h, count(*)::BIGINT AS made, count(actual)::BIGINT AS scored, count(*) FILTER (WHERE actual IS NULL)::BIGINT AS pending, floor(avg(abs(actual - change)) * 100 + 0.5) / 100 AS mae,
  count(*) FILTER (WHERE actual BETWEEN low AND high)::BIGINT AS inside, count(*) FILTER (WHERE abs(actual - change) < abs(actual) AND abs(actual - change) < abs(actual - drift))::BIGINT AS won, count(*) FILTER (WHERE actual IS NOT NULL AND drift IS NOT NULL)::BIGINT AS of FROM lg GROUP BY 1, 2
""")
def forecast_record(spark: SparkSession, d: str) -> DataFrame:
    """The log's scores by region and horizon."""
    return forecasts.record(_log(_lines(spark, d)), ["region", "h"])


@query("WITH " + _PREDICTED.replace("r_name AS region", "n_name AS region") + """,
x AS (SELECT region, m, error AS e FROM j WHERE h = 3 AND error IS NOT NULL)
SELECT a.region AS a, b.region AS b, count(*)::BIGINT AS origins, round(corr(a.e, b.e), 6) AS corr FROM x a JOIN x b ON a.m = b.m AND a.region < b.region GROUP BY 1, 2 HAVING count(*) >= 12
""")
def error_correlations(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of forecast errors of all pairs of nations over the origins that both have, at least twelve."""
    errors = _judged(_lines(spark, d), "nation").where("h = 3 AND error IS NOT NULL")
    pairs = correlate.pair_correlations(errors, "nation", "m", "error")
    return pairs.where("n >= 12").select("a", "b", F.col("n").alias("origins"), r(F.col("corr"), 6).alias("corr"))


@query("WITH " + _LINES.replace("l_quantity AS q", "l_quantity AS q, l_partkey") + """,
cm AS (SELECT region, l_partkey, m, median(v / q) AS md FROM l GROUP BY 1, 2, 3),
ch AS (SELECT b.region, b.m, count(*) AS pairs, median(ln(b.md / a.md)) AS c FROM cm a JOIN cm b ON a.region = b.region AND a.l_partkey = b.l_partkey AND b.m = a.m + 1 GROUP BY 1, 2),
y AS (SELECT region, m, ln(sum(v) / sum(q)) AS y FROM l GROUP BY 1, 2),
o AS (SELECT region, m, (y - lag(y) OVER w) * 100 AS c, lag(m) OVER w AS pm FROM y WINDOW w AS (PARTITION BY region ORDER BY m)),
x AS (SELECT ch.region, floor(ch.c * 10000 + 0.5) / 100 - o.c AS diff FROM ch JOIN o ON ch.region = o.region AND ch.m = o.m AND o.pm = o.m - 1 WHERE pairs >= 3)
SELECT region, count(*)::BIGINT AS overlap, floor(avg(abs(diff)) * 100 + 0.5) / 100 AS mae, floor(avg(diff) * 100 + 0.5) / 100 AS bias FROM x GROUP BY 1
""")
def nowcast_against_index(spark: SparkSession, d: str) -> DataFrame:
    """The month's change by parts that trade in both months against that of the whole index, over the months that both have:
    mean absolute and mean difference, in percent."""
    from pyspark.sql import Window

    from ..functions.numbers import half_up

    lines = _lines(spark, d)
    monthly = lines.groupBy("region", "l_partkey", "m").agg(F.median(F.col("v") / F.col("q")).alias("md"))
    w = Window.partitionBy("region", "l_partkey").orderBy("m")
    pairs = monthly.withColumn("p", F.when(F.col("m") - F.lag("m").over(w) == 1, F.lag("md").over(w))).where("p IS NOT NULL")
    chain = pairs.groupBy("region", "m").agg(F.count("*").alias("pairs"), half_up(F.median(F.ln(F.col("md") / F.col("p"))) * 100, 2).alias("change")).where("pairs >= 3")
    index = lines.groupBy("region", "m").agg(F.ln(F.sum("v") / F.sum("q")).alias("y"))
    by = Window.partitionBy("region").orderBy("m")
    official = index.withColumn("c", F.when(F.col("m") - F.lag("m").over(by) == 1, (F.col("y") - F.lag("y").over(by)) * 100)).where("c IS NOT NULL")
    diff = chain.join(official, ["region", "m"]).withColumn("diff", F.col("change") - F.col("c"))
    return diff.groupBy("region").agg(F.count("*").alias("overlap"), half_up(F.avg(F.abs("diff")), 2).alias("mae"), half_up(F.avg("diff"), 2).alias("bias"))
