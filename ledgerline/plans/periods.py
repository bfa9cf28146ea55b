"""Repeat sales beside an index, chosen windows and periods, lines of months, aliases, shapes of payloads, returning rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import dates
from ..operators import events, periods, trades
from ..sources import shape
from .common import r, t

_MI = "year({0}) * 12 + month({0}) - 1"


_TRADES = """WITH l AS (SELECT s_nationkey AS g, l_partkey AS house, l_orderkey, l_linenumber, year(l_shipdate) * 100 + month(l_shipdate) AS ym, l_shipdate::DATE AS day, round(l_extendedprice / l_quantity)::BIGINT AS amount, l_returnflag AS f, l_linenumber % 5 AS k
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
i AS (SELECT g, ym, avg(amount) AS v FROM l GROUP BY 1, 2),
tr AS (SELECT * FROM l WHERE f <> 'R' AND k <> 0 AND ym BETWEEN 199606 AND 200006 AND amount > 0),
p AS (SELECT g, house, ym AS a, lead(ym) OVER w AS b, lead(day) OVER w - day AS gap, ln(lead(amount) OVER w / amount) AS c FROM tr WINDOW w AS (PARTITION BY g, house ORDER BY day, l_orderkey, l_linenumber)),
q AS (SELECT p.*, abs(c) > ln(2.0) AS outlier, CASE WHEN x.v > 0 AND y.v > 0 THEN ln(y.v / x.v) END AS official
  FROM p LEFT JOIN i x ON p.g = x.g AND a = x.ym AND a % 100 <> 2 LEFT JOIN i y ON p.g = y.g AND b = y.ym AND b % 100 <> 2 WHERE gap >= 90)
"""


@query(_TRADES + """SELECT g, count(*)::BIGINT AS before, count(*) FILTER (WHERE outlier)::BIGINT AS excluded, count(*) FILTER (WHERE NOT outlier)::BIGINT AS pairs, count(DISTINCT CASE WHEN NOT outlier THEN house END)::BIGINT AS houses,
  round(median(CASE WHEN NOT outlier THEN c END), 6) AS change, median(CASE WHEN NOT outlier THEN gap END)::DOUBLE AS gap, round(median(CASE WHEN NOT outlier THEN official END), 6) AS official, count(CASE WHEN NOT outlier THEN official END)::BIGINT AS official_pairs,
  count(*) FILTER (WHERE NOT outlier AND official IS NULL)::BIGINT AS official_dropped, count(*) FILTER (WHERE NOT outlier) >= 20 AS qualified, count(*) FILTER (WHERE outlier) / count(*) > 0.1 AS many_outliers,
  round(median(CASE WHEN NOT outlier THEN c END) - median(CASE WHEN NOT outlier THEN official END), 6) AS difference FROM q GROUP BY 1
""")
def repeat_sales_beside_index(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of consecutive trades of a part with suppliers of one nation: their change, and that of the nation's index between the same
    months, which has no Februaries."""
    supplier = t(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("g"))
    line = t(spark, d, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    amount = F.round(F.col("l_extendedprice") / F.col("l_quantity")).cast("long")
    index = line.groupBy("g", (F.year("l_shipdate") * 100 + F.month("l_shipdate")).alias("ym")).agg(F.avg(amount).alias("v")).where("ym % 100 <> 2")
    raw = line.where(amount > 0).select(
        "g", F.col("l_partkey").alias("house"), "l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", "O").otherwise("").alias("cdealType"),
        F.when(F.col("l_linenumber") % 5 == 0, "직거래").otherwise("중개거래").alias("dealingGbn"), F.year("l_shipdate").alias("dealYear"), F.month("l_shipdate").alias("dealMonth"),
        F.dayofmonth("l_shipdate").alias("dealDay"), F.format_number(amount, 0).alias("dealAmount"))
    own = trades.trades(raw, 199606, 200006)
    pairs = trades.house_pairs(own, ["g", "house"], "day", "ym", "amount", ["l_orderkey", "l_linenumber"], 90, 2.0)
    both = trades.index_changes(pairs, index, ["g"], "ym", "v")
    out = trades.repeat_table(both, ["g"], ["house"], 20, 0.1)
    return out.select("g", "before", "excluded", "pairs", "houses", r(F.col("change"), 6).alias("change"), "gap", r(F.col("official"), 6).alias("official"), "official_pairs", "official_dropped", "qualified", "many_outliers", r(F.col("difference"), 6).alias("difference"))


@query("""
WITH w AS (SELECT date_trunc('week', l_shipdate)::DATE AS week, count(DISTINCT s_nationkey) AS covered, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'N') AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1), g AS (SELECT count(*) AS k FROM nation)
SELECT week::VARCHAR AS week, covered::BIGINT AS covered, ceil(k / 2)::BIGINT AS need, CASE WHEN a < 50 THEN 'A' ELSE '' END || CASE WHEN n < 50 THEN 'N' ELSE '' END || CASE WHEN r < 50 THEN 'R' ELSE '' END AS short,
  CASE WHEN covered >= ceil(k / 2) AND a >= 50 AND n >= 50 AND r >= 50 THEN 'arrival' ELSE 'contract' END AS basis FROM w, g
""")
def window_bases(spark: SparkSession, d: str) -> DataFrame:
    """For every week: may figures be made from what arrived in it, or must they go by contract days?"""
    line = t(spark, d, "lineitem").join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    flag = lambda f: F.count_if(F.col("l_returnflag") == f)
    weeks = line.groupBy(dates.week_start(F.col("l_shipdate")).alias("week")).agg(F.count_distinct("s_nationkey").alias("covered"), flag("A").alias("a"), flag("N").alias("n"), flag("R").alias("r"))
    groups = t(spark, d, "nation").count()
    out = periods.window_basis(weeks, ["week"], "covered", groups, {"a": "A", "n": "N", "r": "R"}, 50)
    return out.select(F.col("week").cast("string").alias("week"), "covered", "need", F.array_join("short", "").alias("short"), "basis")


@query(f"""
WITH m AS (SELECT DISTINCT l_suppkey AS k, {_MI.format('l_shipdate')} AS mi FROM lineitem WHERE (l_suppkey + month(l_shipdate)) % 4 <> 0 AND year(l_shipdate) < 1999), e AS (SELECT k, max(mi) AS e FROM m GROUP BY 1),
h AS (SELECT m.k, e, count(*) FILTER (WHERE mi BETWEEN e - 14 AND e - 12) AS whole, list_sort(list(mi) FILTER (WHERE mi < e - 2))[1:3] AS early FROM m JOIN e ON m.k = e.k GROUP BY 1, 2),
b AS (SELECT k, e, CASE WHEN whole = 3 THEN [e - 14, e - 13, e - 12] WHEN len(early) = 3 THEN early END AS b FROM h)
SELECT k, e::INT AS recent_end, b[1]::INT AS base_start, b[3]::INT AS base_end, (e - 1 - b[2])::INT AS gap FROM b
""")
def compared_periods(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier's last three months and those they are compared with: a year before, or the earliest there are."""
    m = t(spark, d, "lineitem").where("(l_suppkey + month(l_shipdate)) % 4 <> 0 AND year(l_shipdate) < 1999").select(F.col("l_suppkey").alias("k"), dates.month_index(F.col("l_shipdate")).alias("mi"))
    have = m.groupBy("k").agg(F.collect_set("mi").alias("months"), F.max("mi").alias("e"))  # months, not rows
    p = have.withColumn("p", periods.period_pairs(F.col("months"), F.col("e")))
    return p.select("k", F.col("e").alias("recent_end"), F.col("p.base")[0].alias("base_start"), F.col("p.base")[2].alias("base_end"), F.col("p.gap").alias("gap"))


@query(f"""
WITH m AS (SELECT s_nationkey AS g, {_MI.format('l_shipdate')} AS mi, count(*) AS n, count(*) FILTER (WHERE l_discount < 0.085) AS reg FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
x AS (SELECT g, mi, n, n - reg AS st FROM m WHERE reg / n >= 0.8), y AS (SELECT g, count(*) AS months, sum(st) AS stale, sum(n) AS n, max_by(st, mi) AS ls, max_by(n, mi) AS ln, max(mi) AS latest FROM x GROUP BY 1),
z AS (SELECT *, stale > 0 AND ls / nullif(stale, 0) > 0.01 AND n - ln > 0 AS dom FROM y)
SELECT g, months::BIGINT AS months, stale::BIGINT AS stale, CASE WHEN dom THEN latest END::INT AS latest, CASE WHEN dom THEN floor(ls / stale * 1000 + 0.5) / 10 END AS share_of_stale, CASE WHEN dom THEN floor((stale - ls) / (n - ln) * 1000 + 0.5) / 10 END AS share_without FROM z
""")
def latest_month_dominance(spark: SparkSession, d: str) -> DataFrame:
    """Nations whose last mature month holds a large part of what is not registered, and the share without it."""
    line = t(spark, d, "lineitem").join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("g"), dates.month_index(F.col("l_shipdate")).alias("mi"), "l_discount")
    return periods.latest_dominance(line, ["g"], "mi", F.col("l_discount") < 0.085, 0.8, 0.01)


@query(f"""
WITH c AS (SELECT p_brand AS g, l_partkey, {_MI.format('l_shipdate')} AS mi, median(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS a, median(l_extendedprice) FILTER (WHERE l_returnflag <> 'R') AS b
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
x AS (SELECT unnest([g, 'all']) AS g, mi, a / b * 100 AS rate FROM c WHERE a IS NOT NULL AND b IS NOT NULL AND mi BETWEEN 23976 AND 23999), s AS (SELECT g, mi, count(*) AS n, median(rate) AS m FROM x GROUP BY 1, 2),
k AS (SELECT g, mi FROM (SELECT DISTINCT p_brand AS g FROM part UNION SELECT 'all') CROSS JOIN (SELECT unnest(range(23976, 24000)) AS mi))
SELECT k.g, k.mi::INT AS mi, CASE WHEN n >= 3 THEN floor(m * 100 + 0.5) / 100 END AS rate, coalesce(n, 0)::BIGINT AS pairs, k.mi > 23997 AS partial FROM k LEFT JOIN s ON k.g = s.g AND k.mi = s.mi
""")
def conversion_months(spark: SparkSession, d: str) -> DataFrame:
    """Returned against kept prices of parts that have both in a month: a line for every brand and for all, of 24 months, null where pairs
    are few."""
    part = t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("g"))
    back = F.col("l_returnflag") == "R"
    cells = t(spark, d, "lineitem").join(part, "l_partkey").groupBy("g", "l_partkey", dates.month_index(F.col("l_shipdate")).alias("mi")).agg(
        F.median(F.when(back, F.col("l_extendedprice"))).alias("a"), F.median(F.when(~back, F.col("l_extendedprice"))).alias("b"))
    pairs = cells.where("a IS NOT NULL AND b IS NOT NULL").withColumn("rate", F.col("a") / F.col("b") * 100)
    return periods.month_lines(pairs, "g", "mi", "rate", part.select("g"), 1998 * 12, 1999 * 12 + 11, 3)


@query("""
WITH RECURSIVE a AS (SELECT p_partkey AS o, CASE WHEN p_partkey % 7 = 6 THEN p_partkey - 6 ELSE p_partkey + 1 END AS n FROM part WHERE p_partkey % 7 <> 3),
c AS (SELECT o, n, 1 AS k, least(o, n) AS least FROM a UNION ALL SELECT c.o, a.n, k + 1, least(c.least, a.n) FROM c JOIN a ON c.n = a.o WHERE k < 8),
e AS (SELECT o, max_by(n, k) AS n FROM c GROUP BY 1)
SELECT p_partkey, coalesce(e.n, p_partkey)::BIGINT AS stable FROM part LEFT JOIN e ON p_partkey = e.o
""")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    """The id that each part's key stands for, through chains of aliases: 4, 5, 6, 0, 1, 2, 3 in each seven."""
    k = F.col("p_partkey")
    table = t(spark, d, "part").where(k % 7 != 3).select(k.alias("old"), F.when(k % 7 == 6, k - 6).otherwise(k + 1).alias("new"))
    return trades.stable_ids(t(spark, d, "part").select("p_partkey"), "p_partkey", trades.aliases(table, "old", "new"), "old", "new", "stable")


_PAYLOAD = """WITH p AS (SELECT event_id, CASE event_id % 9 WHEN 1 THEN '{"k":"' || event_id || '"}' WHEN 2 THEN '{"k":1,"extra":[1]}' WHEN 3 THEN '[1,2]' WHEN 4 THEN '{"k":' WHEN 5 THEN '{"note":null}' WHEN 6 THEN '{"k":null,"note":"x"}' ELSE props END AS p FROM events)"""
AGREED = shape.Agreed(("k",), ("note",), {"k": ("number",), "note": ("string",)}, ("k", "note", "day"))


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    """Event properties, some of them not as agreed."""
    m = F.col("event_id") % 9
    p = (F.when(m == 1, F.concat(F.lit('{"k":"'), F.col("event_id"), F.lit('"}'))).when(m == 2, '{"k":1,"extra":[1]}').when(m == 3, "[1,2]").when(m == 4, '{"k":').when(m == 5, '{"note":null}')
         .when(m == 6, '{"k":null,"note":"x"}').otherwise(F.col("props")))
    return t(spark, d, "events").select("event_id", p.alias("p"))


@query(_PAYLOAD + """,
v AS (SELECT CASE WHEN json_valid(p) THEN json_type(p) END AS t, p FROM p),
e AS (SELECT unnest(json_keys(p)) AS key, p FROM v WHERE t = 'OBJECT'),
x AS (SELECT key, json_type(p, '$.' || key) AS t FROM e UNION ALL SELECT NULL, coalesce(t, 'broken') FROM v WHERE t IS NULL OR t <> 'OBJECT')
SELECT key, CASE WHEN t IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN 'number' WHEN t = 'VARCHAR' THEN 'string' ELSE lower(t) END AS type, count(*)::BIGINT AS rows FROM x GROUP BY 1, 2""")
def payload_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Keys of event properties with the types that they have, without values."""
    return shape.describe(_payloads(spark, d), "p")


@query(_PAYLOAD + """SELECT event_id, CASE event_id % 9 WHEN 1 THEN 'type k' WHEN 2 THEN 'unknown extra' WHEN 3 THEN 'no object' WHEN 4 THEN 'broken' WHEN 5 THEN 'missing k' ELSE '' END AS problems FROM p""")
def payload_problems(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with each event's properties, by the keys and types that were agreed."""
    return shape.checked(_payloads(spark, d), "p", AGREED).select("event_id", F.array_join("problems", ", ").alias("problems"))


@query("""SELECT l_partkey, l_orderkey, l_linenumber, l_shipdate::DATE::VARCHAR AS day FROM lineitem WINDOW w AS (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) QUALIFY lag(l_shipdate) OVER w IS NULL OR l_shipdate > lag(l_shipdate) OVER w + INTERVAL 183 DAY""")
def arrivals_after_half_a_year(spark: SparkSession, d: str) -> DataFrame:
    """Lines with which a part arrives: its first, and the first after more than 183 days without one."""
    line = t(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_shipdate")
    out = events.arrivals_after_gap(line, ["l_partkey"], "l_shipdate", "183 days")
    return out.select("l_partkey", "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").cast("string").alias("day"))
