"""Joins and lookups: inner, semi, anti, full, as-of, nearest, pairwise, containment; top-k and order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import dates, stats
from ..operators import lookup, merge
from .common import r, t


@query("""
SELECT n_name, count(*)::BIGINT AS n, round(sum(l_extendedprice) / sum(l_quantity), 4) AS price
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY 1
""")
def weighted_price_by_nation(spark: SparkSession, d: str) -> DataFrame:
    """Sum over sum, not a mean of means, over a four-way join."""
    lines = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = lines.join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("n"), r(F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"))


@query("""
WITH g AS (SELECT n_regionkey, n_nationkey, avg(c_acctbal) AS m, count(*) AS w FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT r_name, round(sum(m * w) / sum(w), 4) AS mean, sum(w)::BIGINT AS n FROM g JOIN region ON n_regionkey = r_regionkey GROUP BY 1
""")
def count_weighted_roll_up(spark: SparkSession, d: str) -> DataFrame:
    """Regions' mean as count-weighted mean of their nations' means."""
    per = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_nationkey").agg(F.avg("c_acctbal").alias("m"), F.count("*").alias("w"))
    rows = per.join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name").agg(r(stats.weighted_mean(F.col("m"), F.col("w"))).alias("mean"), F.sum("w").alias("n"))


@query("""
SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
""")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    """Orders with a returned line."""
    back = t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t(spark, d, "orders").select("o_orderkey", "o_custkey").join(back, "o_orderkey", "left_semi")


@query("""
SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')
""")
def anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Customers without a pending order."""
    own = t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, d, "customer").select("c_custkey", "c_name").join(own, "c_custkey", "left_anti")


@query("""
WITH a AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'),
s AS (SELECT l.l_partkey, l.l_suppkey, EXISTS (SELECT 1 FROM b WHERE b.l_partkey = a.l_partkey AND b.l_suppkey = a.l_suppkey) AS twin FROM a JOIN a l USING (l_partkey, l_suppkey))
SELECT twin, count(*)::BIGINT AS n FROM s GROUP BY 1
""")
def twin_split(spark: SparkSession, d: str) -> DataFrame:
    """Returned (part, supplier) pairs with and without a twin among the accepted."""
    keys = ["l_partkey", "l_suppkey"]
    rows = t(spark, d, "lineitem")
    with_twin, without = merge.split_by_match(rows.where("l_returnflag = 'R'").select(*keys).distinct(), rows.where("l_returnflag = 'A'"), keys)
    return with_twin.withColumn("twin", F.lit(True)).unionByName(without.withColumn("twin", F.lit(False))).groupBy("twin").agg(F.count("*").alias("n"))


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS day, o_totalprice FROM orders),
i AS (SELECT date_trunc('month', o_orderdate)::DATE AS day, median(o_totalprice) AS level FROM orders GROUP BY 1)
SELECT o_orderkey, round((SELECT level FROM i WHERE i.day < o.day ORDER BY i.day DESC LIMIT 1), 4) AS level FROM o
""")
def as_of_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The latest monthly level that starts before an order's day."""
    own = t(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), "o_totalprice")
    levels = own.groupBy(F.trunc("day", "month").alias("day")).agg(F.median("o_totalprice").alias("level"))
    return lookup.as_of_months(own, levels, "day", "level").select("o_orderkey", r(F.col("level")).alias("level"))


@query("""
WITH s AS (SELECT s_suppkey, s_nationkey AS k, s_acctbal FROM supplier), c AS (SELECT c_custkey, c_nationkey AS k, c_acctbal FROM customer)
SELECT s_suppkey, c_custkey, round(abs(s_acctbal - c_acctbal), 4) AS gap FROM s JOIN c USING (k) WHERE abs(s_acctbal - c_acctbal) < 50
QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(s_acctbal - c_acctbal), c_custkey) = 1
""")
def nearest_within(spark: SparkSession, d: str) -> DataFrame:
    """For each supplier the customer of its nation with the nearest balance, less than 50 away."""
    s = t(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), "s_acctbal")
    c = t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), "c_acctbal")
    found = lookup.nearest_within(s, c, ["k"], "s_acctbal", "c_acctbal", 50.0, "c_custkey")
    return found.select("s_suppkey", "c_custkey", r(F.abs(F.col("s_acctbal") - F.col("c_acctbal"))).alias("gap"))


@query("""
WITH m AS (SELECT c_nationkey AS k, quantile_cont(c_acctbal, 0.25) AS lo, quantile_cont(c_acctbal, 0.75) AS hi FROM customer GROUP BY 1)
SELECT a.k AS a, b.k AS b, (a.hi < b.lo OR b.hi < a.lo) AS disjoint FROM m a JOIN m b ON a.k < b.k
""")
def pairwise_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Whether two nations' quartile intervals are disjoint; the dimension has a fixed size."""
    m = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.percentile("c_acctbal", 0.25).alias("lo"), F.percentile("c_acctbal", 0.75).alias("hi"))
    a, b = (m.select(F.col("k").alias(x), F.col("lo").alias(f"lo_{x}"), F.col("hi").alias(f"hi_{x}")) for x in "ab")
    pairs = a.join(F.broadcast(b), F.col("a") < F.col("b"))
    return pairs.select("a", "b", ((F.col("hi_a") < F.col("lo_b")) | (F.col("hi_b") < F.col("lo_a"))).alias("disjoint"))


@query("""
WITH m AS (SELECT n_name, median(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT n_name, round(v, 4) AS v, rank() OVER (ORDER BY v DESC)::INT AS rank, lag(n_name) OVER w AS previous, lead(n_name) OVER w AS next FROM m WINDOW w AS (ORDER BY v, n_name)
""")
def rank_and_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Competition rank and neighbours in order, over a dimension of fixed size."""
    m = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.median("c_acctbal").alias("v"))
    return lookup.neighbours(m.withColumn("rank", F.rank().over(Window.orderBy(F.desc("v")))), "v", "n_name").select("n_name", r(F.col("v")).alias("v"), "rank", "previous", "next")


@query("""
SELECT o_custkey, o_orderkey, (row_number() OVER w)::INT AS rank FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey) QUALIFY row_number() OVER w <= 3
""")
def top_per_key(spark: SparkSession, d: str) -> DataFrame:
    """The newest, then dearest three orders of a customer."""
    return lookup.top_k(t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), ["o_custkey"], 3, F.desc("o_orderdate"), F.desc("o_totalprice"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "rank")


@query("""
WITH c AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents)
SELECT source, doc_id, n_chars FROM c WHERE k <= 2 ORDER BY n_chars DESC, doc_id LIMIT 24
""")
def capped_per_source(spark: SparkSession, d: str) -> DataFrame:
    """At most two documents of each source, then the first 24."""
    return lookup.capped(t(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", 2, 24, F.desc("n_chars"), F.col("doc_id"))


@query("""
WITH d AS (SELECT o_custkey, o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_custkey, day::TIMESTAMP AS day, n::BIGINT AS n FROM d QUALIFY row_number() OVER (ORDER BY n DESC, day, o_custkey) = 1
""")
def largest_bundle(spark: SparkSession, d: str) -> DataFrame:
    """The customer and day with most orders."""
    n = t(spark, d, "orders").groupBy("o_custkey", F.date_trunc("day", "o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "day", "o_custkey").limit(1)


@query("""
WITH s AS (SELECT l_suppkey, sum(l_extendedprice) AS v, count(*) AS n FROM lineitem GROUP BY 1), a AS (SELECT sum(n) AS all_n FROM s)
SELECT l_suppkey, n::BIGINT AS n FROM s, a WHERE n * 100 >= all_n AND n >= 10
""")
def concentration(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers with at least a hundredth of all lines, in whole numbers."""
    n = t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("all_n"))
    return n.join(F.broadcast(total)).where("n * 100 >= all_n AND n >= 10").select("l_suppkey", "n")


@query("""
WITH x AS (SELECT p_name, count(DISTINCT p_brand) AS b FROM part GROUP BY 1)
SELECT p_partkey, CASE WHEN b > 1 THEN p_name || ' (' || p_brand || ')' ELSE p_name END AS label FROM part JOIN x USING (p_name)
""")
def qualified_names(spark: SparkSession, d: str) -> DataFrame:
    """Part names, with the brand where several brands share the name."""
    p = t(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    shared = p.groupBy("p_name").agg(F.count_distinct("p_brand").alias("b"))
    return p.join(shared, "p_name").select("p_partkey", F.when(F.col("b") > 1, F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).otherwise(F.col("p_name")).alias("label"))


@query("""
WITH m AS (SELECT l_returnflag AS f, date_trunc('month', l_shipdate) AS ym, avg(l_discount) AS v FROM lineitem GROUP BY 1, 2),
b AS (SELECT ym, max(CASE WHEN f = 'R' THEN v END) AS r, max(CASE WHEN f = 'A' THEN v END) AS a FROM m GROUP BY 1)
SELECT max(ym) AS ym, round(max_by(r, ym), 6) AS r, round(max_by(a, ym), 6) AS a FROM b WHERE r IS NOT NULL AND a IS NOT NULL
""")
def latest_month_in_both(spark: SparkSession, d: str) -> DataFrame:
    """The last month in which both series have a value."""
    m = t(spark, d, "lineitem").groupBy(F.date_trunc("month", "l_shipdate").alias("ym")).pivot("l_returnflag", ["R", "A"]).agg(F.avg("l_discount")).where("R IS NOT NULL AND A IS NOT NULL")
    return m.agg(F.max("ym").alias("ym"), r(F.max_by("R", "ym"), 6).alias("r"), r(F.max_by("A", "ym"), 6).alias("a"))


@query("""
WITH p AS (SELECT p_partkey, p_brand, p_size, p_retailprice FROM part)
SELECT a.p_partkey, b.p_partkey AS similar_key, (row_number() OVER w)::INT AS rank FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey AND abs(a.p_size - b.p_size) <= 3
WINDOW w AS (PARTITION BY a.p_partkey ORDER BY abs(a.p_retailprice - b.p_retailprice), b.p_partkey) QUALIFY row_number() OVER w <= 3
""")
def similar_items(spark: SparkSession, d: str) -> DataFrame:
    """The three parts of the same brand and nearly the same size with the nearest price."""
    out = lookup.nearest_k(t(spark, d, "part"), ["p_brand"], "p_size", 3, "p_retailprice", "p_partkey", 3)
    return out.select("p_partkey", F.col("other").alias("similar_key"), "rank")
