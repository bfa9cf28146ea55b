"""Series: frames, runs, differences, calendars, baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import dates
from ..operators import series
from .common import r, t

_MONTHS = "WITH m AS (SELECT l_returnflag AS f, year(l_shipdate) * 12 + month(l_shipdate) - 1 AS mi, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY 1, 2)"


def _months(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("f"), dates.month_index(F.col("l_shipdate")).alias("mi")).agg(F.sum("l_quantity").cast("long").alias("q"))


@query(_MONTHS + """
SELECT f, mi::INT AS mi, CASE WHEN count(*) OVER w = 12 THEN sum(q) OVER w END::BIGINT AS q12 FROM m WINDOW w AS (PARTITION BY f ORDER BY mi RANGE BETWEEN 11 PRECEDING AND CURRENT ROW)
""")
def trailing_full_sum(spark: SparkSession, d: str) -> DataFrame:
    """Sums of twelve months, null if one is missing."""
    return _months(spark, d).select("f", "mi", series.full_sum(F.col("q"), ["f"], "mi", 12).alias("q12"))


@query(_MONTHS + """,
y AS (SELECT f, mi, sum(q) OVER (PARTITION BY f, mi // 12 ORDER BY mi) AS ytd FROM m),
p AS (SELECT *, lag(mi) OVER w AS pm, lag(ytd) OVER w AS py FROM y WINDOW w AS (PARTITION BY f ORDER BY mi))
SELECT f, mi::INT AS mi, CASE WHEN mi % 12 = 0 THEN ytd WHEN pm = mi - 1 THEN ytd - py END::BIGINT AS monthly FROM p
""")
def monthly_from_year_to_date(spark: SparkSession, d: str) -> DataFrame:
    """Monthly values back from year-to-date sums."""
    w = Window.partitionBy("f", F.floor(F.col("mi") / 12)).orderBy("mi")
    ytd = _months(spark, d).withColumn("ytd", F.sum("q").over(w))
    return series.monthly_from_year_to_date(ytd, ["f"], "mi", "ytd", "monthly").select("f", "mi", "monthly")


@query(_MONTHS + """,
k AS (SELECT * FROM m WHERE mi % 17 <> 3), g AS (SELECT *, mi - row_number() OVER (PARTITION BY f ORDER BY mi) AS run FROM k)
SELECT f, mi::INT AS mi, q FROM g QUALIFY run = max(run) OVER (PARTITION BY f)
""")
def last_unbroken_run(spark: SparkSession, d: str) -> DataFrame:
    """The last run without a missing month, of series with holes."""
    return series.last_run(_months(spark, d).where("mi % 17 <> 3"), ["f"], "mi").select("f", "mi", "q")


@query(_MONTHS + """,
p AS (SELECT f, mi, q, lag(q) OVER w AS p1, lag(mi) OVER w AS pm FROM m WINDOW w AS (PARTITION BY f ORDER BY mi))
SELECT f, mi::INT AS mi, round(ln(q / CASE WHEN pm = mi - 1 THEN p1 END), 6) AS log_change FROM p
""")
def log_changes(spark: SparkSession, d: str) -> DataFrame:
    """Log change from the month before; null over a hole."""
    m = _months(spark, d)
    return m.select("f", "mi", r(F.ln(F.col("q") / series.previous(F.col("q"), ["f"], "mi")), 6).alias("log_change"))


@query("""
WITH c AS (SELECT unnest(generate_series(DATE '1996-01-01', DATE '1996-12-31', INTERVAL 1 DAY))::DATE AS day)
SELECT day::TIMESTAMP AS day FROM c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderdate::DATE = day AND o_orderpriority = '1-URGENT')
""")
def missing_days(spark: SparkSession, d: str) -> DataFrame:
    """Days of 1996 without an urgent order."""
    own = t(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.to_date("o_orderdate").alias("day"))
    return series.missing_days(own, "day", "1996-01-01", "1996-12-31").select(F.col("day").cast("timestamp").alias("day"))


@query("""
WITH e AS (SELECT event_type, ts::DATE AS day, count(*) // 5 AS level FROM events GROUP BY 1, 2),
c AS (SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS ch FROM e WINDOW w AS (PARTITION BY event_type ORDER BY day)),
i AS (SELECT *, sum(ch) OVER (PARTITION BY event_type ORDER BY day) AS isl FROM c)
SELECT event_type, level::BIGINT AS level, min(day)::TIMESTAMP AS since, count(*)::BIGINT AS length FROM i GROUP BY event_type, level, isl QUALIFY isl = max(isl) OVER (PARTITION BY event_type)
""")
def holds_since(spark: SparkSession, d: str) -> DataFrame:
    """The latest level of a series, since when it holds and for how many days."""
    e = t(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.floor(F.count("*") / 5).alias("level"))
    return series.last_change(e, ["event_type"], "day", "level").select("event_type", "level", F.col("since").cast("timestamp").alias("since"), "length")


@query("""
WITH e AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, max(day)::TIMESTAMP AS day, max_by(n, day)::BIGINT AS n FROM e WHERE day <= DATE '2024-01-30' - 7 AND day >= DATE '2024-01-30' - 14 GROUP BY 1
""")
def baseline_row(spark: SparkSession, d: str) -> DataFrame:
    """The last row at least a week old and no older than two."""
    e = t(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).where("day BETWEEN date_sub('2024-01-30', 14) AND date_sub('2024-01-30', 7)")
    return e.groupBy("event_type").agg(F.max("day").cast("timestamp").alias("day"), F.max_by("n", "day").alias("n"))


@query(_MONTHS + """
SELECT f, mi::INT AS mi, q, row_number() OVER (PARTITION BY f ORDER BY mi DESC)::INT AS back FROM m QUALIFY back <= 18
""")
def kept_history(spark: SparkSession, d: str) -> DataFrame:
    """The last eighteen months of each series."""
    back = F.row_number().over(Window.partitionBy("f").orderBy(F.desc("mi")))
    return _months(spark, d).withColumn("back", back).where("back <= 18").select("f", "mi", "q", "back")


@query(_MONTHS + """,
p AS (SELECT mi, max(CASE WHEN f = 'R' THEN q END) AS r, max(CASE WHEN f = 'A' THEN q END) AS a FROM m GROUP BY 1),
w AS (SELECT mi, CASE WHEN count(r) OVER x = 12 AND count(a) OVER x = 12 THEN abs(sum(r) OVER x / sum(a) OVER x - 1) END AS d FROM p WINDOW x AS (ORDER BY mi RANGE BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT count(d)::BIGINT AS windows, round(median(d), 6) AS median_gap FROM w
""")
def aligned_window_gap(spark: SparkSession, d: str) -> DataFrame:
    """Median relative gap of two series' twelve-month sums."""
    p = _months(spark, d).groupBy("mi").pivot("f", ["R", "A"]).agg(F.max("q")).withColumn("all", F.lit(1))
    both = p.select((F.abs(series.full_sum(F.col("R"), ["all"], "mi", 12) / series.full_sum(F.col("A"), ["all"], "mi", 12) - 1)).alias("g"))
    return both.agg(F.count("g").alias("windows"), r(F.median("g"), 6).alias("median_gap"))


@query("""
WITH h AS (SELECT date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS lag, count(*) AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
r AS (SELECT lag, sum(c) OVER (ORDER BY lag) AS upto, sum(c) OVER () AS n FROM h)
SELECT min(lag) FILTER (WHERE upto >= ceil(0.5 * n))::INT AS q50, min(lag) FILTER (WHERE upto >= ceil(0.95 * n))::INT AS q95 FROM r
""")
def quantile_of_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of shipping delays from their histogram, one row per distinct delay."""
    rows = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    h = rows.groupBy(F.datediff("l_shipdate", "o_orderdate").alias("lag")).agg(F.count("*").alias("c"))
    run = h.withColumns({"upto": F.sum("c").over(Window.orderBy("lag")), "n": F.sum("c").over(Window.partitionBy())})
    return run.agg(*[F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * q), F.col("lag"))).alias(a) for q, a in ((0.5, "q50"), (0.95, "q95"))])


@query("""
WITH l AS (SELECT date_trunc('month', o_orderdate) AS om, floor(date_diff('day', o_orderdate::DATE, l_shipdate::DATE) / 30)::INT AS delay, l_linestatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT om, delay, count(*)::BIGINT AS n, count(*) FILTER (WHERE l_linestatus = 'F')::BIGINT AS finished FROM l GROUP BY 1, 2
""")
def arrival_triangle(spark: SparkSession, d: str) -> DataFrame:
    """Lines by month of order and months of delay."""
    rows = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    delay = F.floor(F.datediff("l_shipdate", "o_orderdate") / 30).cast("int")
    return rows.groupBy(F.date_trunc("month", "o_orderdate").alias("om"), delay.alias("delay")).agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("finished"))
