"""Stored partitions and their two time axes: catalogues, fetch plans, windows, changes, stamps, budgets, weeks, lots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text
from ..sources import files, slots
from ..streaming import arrivals
from .common import t

_SLOTS = """SELECT l_returnflag AS district, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS STRING) AS yearMonth, count(*) AS n, max(l_shipdate) AS seen,
  month(l_shipdate) <> 4 AS ok, count(*) + CASE WHEN month(l_shipdate) = 7 THEN 1 ELSE 0 END AS total FROM lineitem WHERE month(l_shipdate) <> 9 GROUP BY l_returnflag, year(l_shipdate), month(l_shipdate)"""


def _slots(spark: SparkSession, d: str) -> DataFrame:
    t(spark, d, "lineitem").createOrReplaceTempView("__slot_lines")
    made = spark.sql(_SLOTS.replace("FROM lineitem", "FROM __slot_lines"))
    return made.select(F.lit("sale").alias("kind"), "district", "yearMonth", "ok", F.col("n").alias("count"), F.col("total").alias("totalCount"), F.col("seen").alias("observedAt"))


@query(f"""WITH s AS ({_SLOTS}) SELECT district, yearMonth AS ym, n::BIGINT AS n, (ok AND n = total) AS complete FROM s
""")
def slot_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """What is stored: rows of each slot, and whether it is sound and complete."""
    return slots.catalogue(_slots(spark, d)).select("district", F.col("yearMonth").alias("ym"), F.col("count").alias("n"), "complete")


@query(f"""WITH s AS ({_SLOTS}), w AS (SELECT DISTINCT l_returnflag AS district, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS STRING) AS yearMonth FROM lineitem),
p AS (SELECT w.district, w.yearMonth AS ym, CASE WHEN s.district IS NULL THEN 'missing' WHEN NOT ok THEN 'broken' WHEN date_diff('day', seen::DATE, DATE '2001-06-30') >= 400 THEN 'stale' ELSE 'frozen' END AS state FROM w LEFT JOIN s ON w.district = s.district AND w.yearMonth = s.yearMonth)
SELECT district, ym, state FROM p WHERE state <> 'frozen' ORDER BY CASE state WHEN 'missing' THEN 0 WHEN 'broken' THEN 1 ELSE 2 END, ym DESC, district DESC LIMIT 60
""")
def fetch_plan(spark: SparkSession, d: str) -> DataFrame:
    """Slots to fetch now: missing, broken, stale ones, the newest first, as many as the quota allows."""
    wanted = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("district"), (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("string").alias("yearMonth")).distinct()
    return slots.plan_fetch(wanted, _slots(spark, d), ["district", "yearMonth"], F.lit("2001-06-30").cast("date"), 400, 60).withColumnRenamed("yearMonth", "ym")


@query("""WITH o AS (SELECT o_orderstatus AS k, o_orderdate::DATE AS c, o_orderdate::DATE + (o_custkey % 40)::INT AS a FROM orders)
SELECT k, count(*) FILTER (WHERE c >= DATE '1997-03-01' AND c < DATE '1997-06-01')::BIGINT AS by_contract, count(*) FILTER (WHERE a >= DATE '1997-03-01' AND a < DATE '1997-06-01')::BIGINT AS by_arrival FROM o GROUP BY 1
""")
def two_time_axes(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a window by the day of the contract and by the day on which they were first seen."""
    day = F.col("o_orderdate").cast("date")
    o = t(spark, d, "orders").select(F.col("o_orderstatus").alias("k"), day.alias("contract_day"), F.date_add(day, (F.col("o_custkey") % 40).cast("int")).alias("first_seen"))
    start, end = F.lit("1997-03-01").cast("date"), F.lit("1997-06-01").cast("date")
    n = lambda basis: slots.in_window(o, start, end, basis).groupBy("k").agg(F.count("*").alias(f"by_{basis}"))
    both = o.select("k").distinct().join(n("contract"), "k", "left").join(n("arrival"), "k", "left")
    return both.select("k", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("by_contract", "by_arrival")])


@query("""SELECT DISTINCT year(l_shipdate)::INT AS y FROM lineitem WHERE l_partkey % 700 = 5 AND year(l_shipdate) IN (1996, 1998)
""")
def changed_years(spark: SparkSession, d: str) -> DataFrame:
    """Partitions whose rows differ from those stored, whatever their order and the time they were observed."""
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.year("l_shipdate").alias("y"), "l_quantity")
    edited = F.when((F.col("l_partkey") % 700 == 5) & F.col("y").isin(1996, 1998), F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    return slots.changed_partitions(rows.withColumn("l_quantity", edited).withColumn("observedAt", F.lit(2)), rows.withColumn("observedAt", F.lit(1)), ["y"])


@query("""SELECT o_custkey, CASE WHEN bool_or(o_orderdate < TIMESTAMP '1997-01-01') THEN min(o_orderdate::DATE) ELSE DATE '1999-01-01' END::VARCHAR AS day FROM orders GROUP BY 1
""")
def first_seen_days(spark: SparkSession, d: str) -> DataFrame:
    """Known keys keep the day on which they were first seen, new ones get today's."""
    o = t(spark, d, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    known = o.groupBy("o_custkey").agg(F.min("day").alias("day")).where("day < '1997-01-01'")
    return slots.stamped(o, known, "o_custkey", F.lit("1999-01-01").cast("date")).withColumn("day", F.col("day").cast("string"))


@query("""WITH r AS (SELECT p_partkey, p_size, sum(length(p_name)) OVER (ORDER BY p_size DESC, p_partkey) AS upto FROM part) SELECT p_partkey FROM r WHERE upto <= 5000
""")
def budgeted_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that fit a budget of bytes, the largest first."""
    return files.within_budget(t(spark, d, "part").select("p_partkey", "p_size", F.char_length("p_name").alias("b")), "b", "p_size", "p_partkey", 5000).select("p_partkey")


@query("""SELECT date_trunc('week', o_orderdate)::DATE::VARCHAR AS week, o_orderstatus, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2
""")
def weekly_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """Counts and sums by Monday week: the operator that runs on a stream, over a table."""
    out = arrivals.weekly(t(spark, d, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp")), "ts", ["o_orderstatus"], "o_totalprice")
    return out.select(F.col("week").cast("date").cast("string").alias("week"), "o_orderstatus", "n", F.round("total", 2).alias("total"))


@query("""SELECT (date_trunc('week', o_orderdate)::DATE + (7 * k)::INT)::VARCHAR AS until, count(*)::BIGINT AS n FROM orders, range(1, 5) r(k) GROUP BY 1
""")
def moving_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames of four weeks that move by one."""
    out = arrivals.moving_weeks(t(spark, d, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp")), "ts", [], "o_totalprice")
    return out.select(F.col("until").cast("date").cast("string").alias("until"), "n")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 6 = 5 THEN NULL WHEN p_size % 3 = 0 THEN (p_partkey + 1)::VARCHAR ELSE (p_partkey + 1) || '-' || (p_size % 3) END AS lot,
  CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS final FROM part
""")
def lots_and_particles(spark: SparkSession, d: str) -> DataFrame:
    """Lot numbers without leading zeros and a sub number of 0; whether a name ends in a consonant, which picks its particle."""
    k, size = F.col("p_partkey"), F.col("p_size")
    raw = F.when(k % 6 == 5, F.concat(F.lit("산 "), k)).otherwise(F.concat(F.lit(" 00"), k + 1, F.lit("-0"), size % 3, F.lit(" ")))
    name = F.when(k % 4 == 0, "강남").when(k % 4 == 1, "종로").otherwise("x1")
    return t(spark, d, "part").select("p_partkey", text.lot_number(raw).alias("lot"), text.final_consonant(name).alias("final"))


@query("""SELECT p_partkey AS id, p_name AS name, p_retailprice AS price FROM part
""")
def resolved_header(spark: SparkSession, d: str) -> DataFrame:
    """Columns found by lists of accepted names; unknown ones are an error."""
    rows = t(spark, d, "part").select("p_partkey", "p_name", F.col("p_retailprice").alias(" p_retailprice"))
    return files.with_header(rows, {"id": ["p_partkey"], "name": ["title", "p_name"], "price": ["p_retailprice"]})
