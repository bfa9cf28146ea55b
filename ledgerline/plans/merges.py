"""Upserts, diffs, overlays, guards, carry-forward on snapshots that the tables' own columns define."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text
from ..operators import guard, merge
from .common import r, t


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


_DAILY = "WITH e AS (SELECT event_type, ts::DATE AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2)"


@query(_DAILY + """,
s AS (SELECT event_type, day, n FROM e WHERE day < DATE '2024-01-20'), f AS (SELECT event_type, day, n + 1 AS n FROM e WHERE day >= DATE '2024-01-15')
SELECT event_type, day::TIMESTAMP AS day, n::BIGINT AS n FROM f UNION ALL SELECT event_type, day::TIMESTAMP, n::BIGINT FROM s WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.event_type = s.event_type AND f.day = s.day)
""")
def upsert_series(spark: SparkSession, d: str) -> DataFrame:
    """A stored series and a fresh one that overlaps it: fresh wins."""
    e = _daily(spark, d).select("event_type", F.col("day").cast("timestamp").alias("day"), "n")
    stored, fresh = e.where("day < '2024-01-20'"), e.where("day >= '2024-01-15'").withColumn("n", F.col("n") + 1)
    return merge.upsert(stored, fresh, ["event_type", "day"])


@query(_DAILY + """,
s AS (SELECT event_type, day, n FROM e WHERE day < DATE '2024-01-20'), f AS (SELECT event_type, day, n + 1 AS n FROM e WHERE day >= DATE '2024-01-15')
SELECT event_type, day::TIMESTAMP AS day, n::BIGINT AS n FROM s UNION ALL SELECT event_type, day::TIMESTAMP, n::BIGINT FROM f WHERE NOT EXISTS (SELECT 1 FROM s WHERE f.event_type = s.event_type AND f.day = s.day)
""")
def insert_only_log(spark: SparkSession, d: str) -> DataFrame:
    """An append-only log: what was written stays."""
    e = _daily(spark, d).select("event_type", F.col("day").cast("timestamp").alias("day"), "n")
    return merge.insert_only(e.where("day < '2024-01-20'"), e.where("day >= '2024-01-15'").withColumn("n", F.col("n") + 1), ["event_type", "day"])


@query("""
WITH s AS (SELECT l_partkey::VARCHAR || '|' || l_suppkey AS k FROM lineitem WHERE l_returnflag IN ('A', 'R')), f AS (SELECT l_partkey::VARCHAR || '|' || l_suppkey AS k FROM lineitem WHERE l_returnflag IN ('R', 'N')),
x AS (SELECT k FROM s EXCEPT ALL SELECT k FROM f)
SELECT k, count(*)::BIGINT AS copies FROM x GROUP BY 1
""")
def multiset_difference(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one snapshot minus those of another, with multiplicity."""
    rows = t(spark, d, "lineitem").select("l_returnflag", F.concat_ws("|", "l_partkey", "l_suppkey").alias("k"))
    left, right = rows.where("l_returnflag IN ('A', 'R')").select("k"), rows.where("l_returnflag IN ('R', 'N')").select("k")
    return left.exceptAll(right).groupBy("k").agg(F.count("*").alias("copies"))


@query("""
WITH b AS (SELECT o_orderkey, o_custkey, o_custkey::VARCHAR || '|' || o_orderkey || '|' || o_orderstatus AS line, o_orderkey % 10 AS m FROM orders),
s AS (SELECT o_custkey, o_orderkey, line FROM b WHERE m <> 0),
f AS (SELECT o_custkey, o_orderkey, CASE WHEN m = 3 THEN line || '*' ELSE line END AS line FROM b WHERE m <> 7),
sl AS (SELECT * FROM s WHERE line NOT IN (SELECT line FROM f)), fl AS (SELECT * FROM f WHERE line NOT IN (SELECT line FROM s)),
a AS (SELECT o_custkey, line AS old, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM sl),
c AS (SELECT o_custkey, line AS new, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM fl)
SELECT CASE WHEN old IS NULL THEN 'appeared' WHEN new IS NULL THEN 'gone' ELSE 'changed' END AS change, o_custkey, old, new FROM a FULL JOIN c USING (o_custkey, n)
""")
def two_stage_row_diff(spark: SparkSession, d: str) -> DataFrame:
    """Two snapshots of orders: equal rows cancel out, leftovers are paired by customer."""
    b = t(spark, d, "orders").select("o_orderkey", "o_custkey", F.concat_ws("|", "o_custkey", "o_orderkey", "o_orderstatus").alias("line"), (F.col("o_orderkey") % 10).alias("m"))
    stored = b.where("m <> 0")
    fetched = b.where("m <> 7").withColumn("line", F.when(F.col("m") == 3, F.concat("line", F.lit("*"))).otherwise(F.col("line")))
    return merge.row_diff(stored, fetched, "line", ["o_custkey"], F.col("o_orderkey")).select("change", "o_custkey", "old", "new")


@query("""
SELECT o_orderstatus, count(*)::BIGINT AS n FROM (SELECT o_orderstatus FROM orders WHERE o_orderkey % 10 <> 7 UNION ALL SELECT 'new' FROM orders WHERE o_orderkey % 10 = 3) GROUP BY 1
""")
def merge_on_read(spark: SparkSession, d: str) -> DataFrame:
    """A base with an overlay of gone and appeared rows."""
    b = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    merged = merge.apply_overlay(b, b.where("o_orderkey % 10 = 7"), b.where("o_orderkey % 10 = 3").withColumn("o_orderstatus", F.lit("new")), "o_orderkey")
    return merged.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query(_DAILY + """,
x AS (SELECT a.event_type, a.day, a.n AS saved, CASE WHEN day(a.day) % 7 = 0 THEN 0 WHEN day(a.day) % 7 = 1 THEN a.n // 3 WHEN day(a.day) % 7 = 2 THEN a.n - 10 ELSE a.n END AS received FROM e a)
SELECT event_type, day::TIMESTAMP AS day, CASE WHEN received = 0 AND saved > 0 THEN 'empty' WHEN day(day) % 7 = 3 THEN 'mismatch'
  WHEN saved >= 20 AND received * 2 < saved THEN 'half' WHEN saved >= 20 AND saved - received >= 10 THEN 'drop' ELSE 'accept' END AS verdict FROM x
""")
def ingest_guard(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on received partitions; every week some days come empty, halved, short or mismatched."""
    k, n = F.day("day") % 7, F.col("n")
    received = F.when(k == 0, 0).when(k == 1, F.floor(n / 3)).when(k == 2, n - 10).otherwise(n)
    total = F.when(k == 3, received + 1).otherwise(received)
    return _daily(spark, d).select("event_type", F.col("day").cast("timestamp").alias("day"), guard.ingest_verdict(n, received, total).alias("verdict"))


@query(_DAILY + """,
v AS (SELECT event_type, day, CASE WHEN day(day) % 6 = 0 THEN 'accept' ELSE 'half' END AS verdict FROM e),
g AS (SELECT *, sum((verdict = 'accept')::INT) OVER (PARTITION BY event_type ORDER BY day) AS run FROM v),
h AS (SELECT event_type, day, row_number() OVER (PARTITION BY event_type, run ORDER BY day) AS held FROM g WHERE verdict <> 'accept')
SELECT event_type, day::TIMESTAMP AS day, held::BIGINT AS held, held > 3 AS release FROM h
""")
def hold_days(spark: SparkSession, d: str) -> DataFrame:
    """Days a partition has been held since its last accepted day; released after three."""
    v = _daily(spark, d).select("event_type", "day", F.when(F.day("day") % 6 == 0, "accept").otherwise("half").alias("verdict"))
    return guard.holds(v, "event_type", "day").withColumn("day", F.col("day").cast("timestamp"))


@query("""
WITH g AS (SELECT n_name FROM nation), f AS (SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 3 <> 0 GROUP BY 1),
p AS (SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 4 <> 1 GROUP BY 1)
SELECT n_name, CASE WHEN f.n IS NOT NULL THEN f.n ELSE p.n END::BIGINT AS n, CASE WHEN f.n IS NULL AND p.n IS NOT NULL THEN '2024-01-01' END AS stale_at
FROM g LEFT JOIN f USING (n_name) LEFT JOIN p USING (n_name)
""")
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """Nations without fresh counts keep the previous ones and say since when."""
    g = t(spark, d, "nation")
    fresh = t(spark, d, "customer").join(g, F.col("c_nationkey") == F.col("n_nationkey")).where("n_nationkey % 3 <> 0").groupBy("n_name").agg(F.count("*").alias("n"))
    before = t(spark, d, "supplier").join(g, F.col("s_nationkey") == F.col("n_nationkey")).where("n_nationkey % 4 <> 1").groupBy("n_name").agg(F.count("*").alias("n"))
    before = before.withColumns({"updated_at": F.lit("2024-01-01"), "stale_at": F.lit(None).cast("string")})
    return merge.carry_forward(g, fresh, before, "n_name", ["n"])


@query("""
WITH a AS (SELECT user_id, ts::DATE AS day, row_number() OVER (PARTITION BY user_id ORDER BY ts::DATE) AS n FROM events WHERE event_type = 'click'),
b AS (SELECT user_id, ts::DATE AS day, row_number() OVER (PARTITION BY user_id ORDER BY ts::DATE) AS n FROM events WHERE event_type = 'view')
SELECT user_id, least(a.day, b.day)::TIMESTAMP AS day FROM a FULL JOIN b USING (user_id, n)
""")
def rank_aligned_merge(spark: SparkSession, d: str) -> DataFrame:
    """First-seen days of two multisets per user, joined by rank, the earlier one kept."""
    e = t(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    return merge.min_by_rank(e.where("event_type = 'view'"), e.where("event_type = 'click'"), "user_id", "day").withColumn("day", F.col("day").cast("timestamp"))


@query("""
SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) = 1
""")
def first_wins(spark: SparkSession, d: str) -> DataFrame:
    """The first order of each customer and status."""
    return merge.first_by(t(spark, d, "orders"), ["o_custkey", "o_orderstatus"], F.col("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "o_orderkey")


@query("""
SELECT o_custkey, substr(sha256(string_agg(o_orderkey::VARCHAR, chr(10) ORDER BY o_orderkey::VARCHAR)), 1, 16) AS digest, count(*)::BIGINT AS n FROM orders GROUP BY 1
""")
def identity_digest(spark: SparkSession, d: str) -> DataFrame:
    """A digest of a customer's set of order ids, whatever their order."""
    ids = F.array_join(F.sort_array(F.collect_list(F.col("o_orderkey").cast("string"))), "\n")
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.substring(F.sha2(ids, 256), 1, 16).alias("digest"), F.count("*").alias("n"))


@query("""
WITH x AS (SELECT l_partkey, l_suppkey, l_returnflag, count(*) AS c FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) >= 2)
SELECT count(*)::BIGINT AS contracts, sum(c)::BIGINT AS rows FROM x
""")
def repeated_contracts(spark: SparkSession, d: str) -> DataFrame:
    """Keys that occur more than once, and their rows."""
    x = t(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey", "l_returnflag").agg(F.count("*").alias("c")).where("c >= 2")
    return x.agg(F.count("*").alias("contracts"), F.sum("c").alias("rows"))
