"""Prior, next and repeated events; arrivals and settled weeks in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import dates
from ..operators import events, lookup
from .common import day_number, r, t


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", day_number(F.col("o_orderdate")).alias("day"))


_ORDERS = "WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, (o_orderdate::DATE - DATE '1970-01-01')::INT AS day FROM orders)"


@query(_ORDERS + """,
p AS (SELECT *, count(*) OVER w AS n, min(day) OVER w AS first, max(o_totalprice) OVER w AS best FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT CASE WHEN o_totalprice > best THEN 'record' WHEN o_totalprice >= best * 0.98 THEN 'near' ELSE 'below' END AS verdict, count(*)::BIGINT AS n
FROM p WHERE n >= 3 AND day - first >= 180 GROUP BY 1
""")
def record_highs(spark: SparkSession, d: str) -> DataFrame:
    """Orders above all their customer's orders of earlier days, given enough history."""
    return events.record_highs(_orders(spark, d), ["o_custkey"], "day", "o_totalprice").groupBy("verdict").agg(F.count("*").alias("n"))


@query(_ORDERS + """
SELECT a.o_orderkey, min(struct_pack(d := b.day, k := b.o_orderkey, v := b.o_totalprice)).d::INT AS next_day, round(min(struct_pack(d := b.day, k := b.o_orderkey, v := b.o_totalprice)).v, 4) AS next_value
FROM o a LEFT JOIN o b ON a.o_custkey = b.o_custkey AND b.day BETWEEN a.day + 1 AND a.day + 90 GROUP BY 1
""")
def next_within_wait(spark: SparkSession, d: str) -> DataFrame:
    """The first order of the customer 1 to 90 days later."""
    return events.with_next(_orders(spark, d), ["o_custkey"], "day", "o_orderkey", "o_totalprice", 90).select("o_orderkey", "next_day", r(F.col("next_value")).alias("next_value"))


@query(_ORDERS + """,
p AS (SELECT *, lead(day) OVER w AS nd, lead(o_totalprice) OVER w AS nv FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY day, o_totalprice, o_orderkey))
SELECT o_custkey, day, nd::INT AS next_day, round(ln(nv / o_totalprice), 6) AS log_change FROM p
WHERE nd - day BETWEEN 300 AND 730 AND o_totalprice > 0 AND nv > 0 AND abs(ln(nv / o_totalprice)) <= ln(2)
""")
def repeat_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive orders of a customer 300 to 730 days apart that changed by no more than a factor of two."""
    pairs = events.repeat_pairs(_orders(spark, d), ["o_custkey"], "day", "o_totalprice", F.col("o_totalprice"), F.col("o_orderkey"))
    return pairs.withColumn("log_change", r(F.col("log_change"), 6))


@query(_ORDERS + """,
g(n, span) AS (VALUES (1, 90), (1, 180), (3, 90), (3, 180)),
p AS (SELECT *, count(*) OVER w AS c, min(day) OVER w AS first, max(o_totalprice) OVER w AS best FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT g.n::INT AS least_prior, span::INT AS least_span, count(*)::BIGINT AS judged, count(*) FILTER (WHERE o_totalprice > best)::BIGINT AS records FROM p, g WHERE c >= g.n AND day - first >= span GROUP BY 1, 2
""")
def parameter_grid(spark: SparkSession, d: str) -> DataFrame:
    """Records under a fixed grid of parameters; the windows are computed once."""
    grid = spark.createDataFrame([(1, 90), (1, 180), (3, 90), (3, 180)], "least_prior int, least_span int")
    prior = events.with_prior(_orders(spark, d), ["o_custkey"], "day", "o_totalprice")
    rows = prior.join(F.broadcast(grid), (F.col("prior_n") >= F.col("least_prior")) & (F.col("day") - F.col("prior_first") >= F.col("least_span")))
    return rows.groupBy("least_prior", "least_span").agg(F.count("*").alias("judged"), F.count_if(F.col("o_totalprice") > F.col("prior_max")).alias("records"))


@query("""
WITH m AS (SELECT c_nationkey, c_mktsegment, median(c_acctbal) AS v FROM customer GROUP BY 1, 2),
k AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY c_mktsegment, v) - 1) / 2.0 AS rk FROM m WINDOW w AS (PARTITION BY c_mktsegment ORDER BY v))
SELECT c_mktsegment, c_nationkey, rk::DOUBLE AS average_rank FROM k
""")
def average_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Ranks with ties sharing the mean of their places."""
    m = t(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.median("c_acctbal").alias("v"))
    return m.withColumn("average_rank", events.average_rank("v", ["c_mktsegment"]).cast("double")).select("c_mktsegment", "c_nationkey", "average_rank")


@query("""
WITH w AS (SELECT date_trunc('week', ts)::DATE AS week, event_type, count(*) AS n, sum(value) AS v FROM events GROUP BY 1, 2)
SELECT week::TIMESTAMP AS week, event_type, n::BIGINT AS n, round(v, 2) AS v, (week + 7 + 3 <= DATE '2024-01-30') AS settled,
  sum(n) OVER (PARTITION BY event_type ORDER BY week RANGE BETWEEN INTERVAL 21 DAYS PRECEDING AND CURRENT ROW)::BIGINT AS n4
FROM w
""")
def settled_weeks(spark: SparkSession, d: str) -> DataFrame:
    """Monday weeks, settled after three days of grace, with the sum over four calendar weeks."""
    w = t(spark, d, "events").groupBy(dates.week_start(F.col("ts")).alias("week"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    frame = Window.partitionBy("event_type").orderBy(F.unix_date("week")).rangeBetween(-21, 0)
    return w.select(F.col("week").cast("timestamp").alias("week"), "event_type", "n", F.round("v", 2).alias("v"), dates.week_settled(F.col("week"), F.to_date(F.lit("2024-01-30")), 3).alias("settled"), F.sum("n").over(frame).alias("n4"))


@query("""
SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS ym, count(*)::BIGINT AS n, (last_day(date_trunc('month', o_orderdate)) + 31 <= DATE '1997-06-15') AS closed FROM orders GROUP BY 1, 3
""")
def closed_months(spark: SparkSession, d: str) -> DataFrame:
    """Months, closed thirty days after their end."""
    o = t(spark, d, "orders").select(F.date_trunc("month", "o_orderdate").alias("ym"), dates.month_closed(F.col("o_orderdate"), F.to_date(F.lit("1997-06-15"))).alias("closed"))
    return o.groupBy("ym", "closed").agg(F.count("*").alias("n")).select("ym", "n", "closed")


@query("""
WITH f AS (SELECT user_id, event_type, min(ts)::DATE AS day FROM events GROUP BY 1, 2)
SELECT day::TIMESTAMP AS day, event_type, count(*)::BIGINT AS n, date_diff('day', min(day) OVER (PARTITION BY event_type), day)::INT AS since FROM f GROUP BY 1, 2, day
""")
def arrivals(spark: SparkSession, d: str) -> DataFrame:
    """First days of (user, type) pairs, counted by day."""
    first = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.min(F.to_date("ts")).alias("day")).groupBy("day", "event_type").agg(F.count("*").alias("n"))
    since = F.datediff("day", F.min("day").over(Window.partitionBy("event_type")))
    return first.select(F.col("day").cast("timestamp").alias("day"), "event_type", "n", since.alias("since"))


@query("""
WITH e AS (SELECT event_id, user_id, event_type, value, ts, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, round(value - before, 4) AS change FROM e WHERE before IS NOT NULL
""")
def change_since_previous(spark: SparkSession, d: str) -> DataFrame:
    """Change of an event's value from the user's event before."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return t(spark, d, "events").withColumn("before", F.lag("value").over(w)).where("before IS NOT NULL").select("event_id", r(F.col("value") - F.col("before")).alias("change"))


@query("""
WITH k AS (SELECT e.*, count(*) OVER (PARTITION BY user_id, event_type) AS c FROM events e)
SELECT event_type, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users, round(sum(value), 2) AS total, max_by(event_id, ts)::BIGINT AS last_event
FROM k WHERE ts >= TIMESTAMP '2024-01-23' AND ts < TIMESTAMP '2024-01-30' GROUP BY 1
""")
def week_digest(spark: SparkSession, d: str) -> DataFrame:
    """Arrivals in a seven-day window by type."""
    e = t(spark, d, "events").where("ts >= '2024-01-23' AND ts < '2024-01-30'")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("total"), F.max_by("event_id", "ts").alias("last_event"))


@query("""
WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
s AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 1 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e)
SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, s
""")
def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that a day's silence ends."""
    s = t(spark, d, "events").groupBy("user_id", F.session_window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), "n")
