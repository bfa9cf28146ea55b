"""Files within a compressed size, permutation tests, texts read as conditions, indicators judged, rules of publication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import dates
from ..operators import budget, conditions, indicators, permutations
from ..session import ship
from .common import r, t
from .forecasts import _lines, _series


@query()
def gzip_budgets(spark: SparkSession, d: str) -> DataFrame:
    """Each brand's parts with their months of sales, the most sold first, as many as a gzip file of 6,000 bytes holds."""
    line = t(ship(spark), d, "lineitem")
    monthly = line.groupBy("l_partkey", dates.month_index(F.col("l_shipdate")).alias("m")).agg(F.count("*").alias("n"), F.round(F.median(F.col("l_extendedprice") / F.col("l_quantity")), 2).alias("v"))
    per = monthly.groupBy("l_partkey").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("m", "v", "n"))).alias("points"))  # a row per month at most
    rows = per.join(t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_name"), "l_partkey")
    rows = rows.withColumn("line", F.to_json(F.struct("l_partkey", "p_name", "points")))
    fit = budget.within_gzip(rows, "p_brand", [F.desc("n"), F.col("l_partkey")], "line", 6000)
    return fit.select("p_brand", "members", "kept", "dropped", "bytes", F.sha2("file", 256).alias("sha256"))


@query()
def permuted_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Whether a part's size goes with its unit price within its brand: rank correlation against 400 permutations."""
    unit = t(ship(spark), d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.round(F.median(F.col("l_extendedprice") / F.col("l_quantity")), 6).alias("unit"))
    rows = t(spark, d, "part").join(unit, "p_partkey")
    out = permutations.judged(permutations.rank_permutations(rows, "p_brand", "p_partkey", "p_size", "unit", 400, 20261103))
    return out.select(r(F.col("rho"), 9).alias("rho"), "rounds", "p_two_sided", "p_greater", r(F.col("low"), 9).alias("low"), r(F.col("high"), 9).alias("high"))


_TEXTS = """WITH y AS (SELECT list(DISTINCT p_type ORDER BY p_type) AS l FROM part),
q AS (SELECT s_suppkey AS k, s_suppkey % 6 AS f, l[s_suppkey % len(l) + 1] AS place, 9 + s_suppkey % 10 AS e, 50 + s_suppkey % 80 AS a, s_suppkey % 9 + 1 AS c, 20 + s_suppkey % 20 AS p FROM supplier, y),
z AS (SELECT k, f, CASE f WHEN 4 THEN 'nothing' WHEN 3 THEN 'exact' ELSE 'read' END AS state, CASE WHEN f IN (0, 2, 3) THEN place END AS place, CASE WHEN f = 0 THEN e END::DOUBLE AS band,
  CASE f WHEN 1 THEN '<=' WHEN 5 THEN '>' END AS amount_op, CASE f WHEN 1 THEN e + c / 10.0 WHEN 5 THEN 12 + k % 5 END::DOUBLE AS amount,
  CASE WHEN f = 1 THEN CASE WHEN p * 3.3058 <= 60 THEN '60' WHEN p * 3.3058 <= 85 THEN '60-85' WHEN p * 3.3058 <= 135 THEN '85-135' ELSE '135' END END AS area_class,
  CASE f WHEN 2 THEN '>=' WHEN 5 THEN '<' END AS area_op, CASE WHEN f IN (2, 5) THEN a END::DOUBLE AS area FROM q)"""


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """(k, text, conditions, place, state): a search text for every supplier, read."""
    k = F.col("s_suppkey")
    types = t(spark, d, "part").agg(F.sort_array(F.collect_set("p_type")).alias("types")).withColumn("one", F.lit(1))  # a handful of words
    place, e, a = F.lower(F.get("types", (k % F.size("types")).cast("int"))), (9 + k % 10).cast("string"), (50 + k % 80).cast("string")
    text = (F.when(k % 6 == 0, F.concat(place, F.lit(" "), e, F.lit("억")))
            .when(k % 6 == 1, F.concat(e, F.lit("억 "), (k % 9 + 1).cast("string"), F.lit("천 이하 "), (20 + k % 20).cast("string"), F.lit("평")))
            .when(k % 6 == 2, F.concat(place, F.lit("  "), a, F.lit("㎡ 이상"))).when(k % 6 == 3, F.concat(F.lit(" "), place))
            .when(k % 6 == 4, F.lit("아무 말")).otherwise(F.concat(a, F.lit(" m2 미만, "), (12 + k % 5).cast("string"), F.lit("억 초과"))))
    places = t(spark, d, "part").select(F.col("p_type").alias("place")).distinct()
    suppliers = t(spark, d, "supplier").withColumn("one", F.lit(1)).join(F.broadcast(types), "one")
    return conditions.interpreted(suppliers.select(k.alias("k"), text.alias("text")), places)


@query(_TEXTS + "SELECT k, state, place, band, amount_op, amount, area_class, area_op, area FROM z")
def texts_as_conditions(spark: SparkSession, d: str) -> DataFrame:
    """Search texts read as conditions: a place, an amount or its band, an area or its class, with comparisons."""
    one = lambda f: F.get(F.filter("conditions", lambda c: c["field"] == f), F.lit(0))
    return _texts(spark, d).select(
        "k", "state", "place", one("band")["number"].alias("band"), one("amount")["op"].alias("amount_op"), one("amount")["number"].alias("amount"),
        one("area_class")["text"].alias("area_class"), one("area")["op"].alias("area_op"), one("area")["number"].alias("area"))


@query(_TEXTS + """,
d AS (SELECT p_partkey, p_type, p_retailprice / 100 AS eok, p_size * 3.0 AS m2 FROM part)
SELECT k, count(*)::BIGINT AS n, min(p_partkey)::BIGINT AS first FROM z JOIN d ON (place IS NULL OR place = p_type) AND (band IS NULL OR floor(eok) = band)
  AND (amount_op IS NULL OR (amount_op = '<=' AND eok <= amount) OR (amount_op = '>' AND eok > amount)) AND (area_op IS NULL OR (area_op = '>=' AND m2 >= area) OR (area_op = '<' AND m2 < area))
  AND (area_class IS NULL OR area_class = CASE WHEN m2 <= 60 THEN '60' WHEN m2 <= 85 THEN '60-85' WHEN m2 <= 135 THEN '85-135' ELSE '135' END)
WHERE state = 'read' GROUP BY k""")
def deals_by_text(spark: SparkSession, d: str) -> DataFrame:
    """Parts that meet each search text: how many, and the first."""
    deals = t(spark, d, "part").select("p_partkey", "p_type", (F.col("p_retailprice") / 100).alias("eok"), (F.col("p_size") * 3.0).alias("m2"))
    return conditions.counted(_texts(spark, d), deals, "k", "p_type", "eok", "m2", "p_partkey")


CANDIDATES = [
    indicators.Candidate("volume against before", "volume", "norm"), indicators.Candidate("volume on the year", "volume", "yoy"), indicators.Candidate("discount level", "discount", "level"),
    indicators.Candidate("discount change", "discount", "change", 12), indicators.Candidate("returns level", "returns", "level", lags=(0,)), indicators.Candidate("price itself", "price", "change", 3, (0, 2), (2,)),
]


def indicator_errors(spark: SparkSession, d: str) -> DataFrame:
    """Errors by origin of every candidate at 3 and 6 months, for each region and all together."""
    lines = _lines(spark, d)
    prices = _series(lines, "region").unionByName(_series(lines.withColumn("region", F.lit("ALL")), "region"))
    monthly = t(spark, d, "lineitem").groupBy(dates.month_index(F.col("l_shipdate")).alias("month")).agg(
        F.ln(F.count("*").cast("double")).alias("volume"), F.avg("l_discount").alias("discount"), F.avg((F.col("l_returnflag") == "R").cast("double")).alias("returns"),
        F.ln(F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"))
    series = monthly.select("month", F.explode(F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).alias("value")) for c in ("volume", "discount", "returns", "price")])).alias("s"))
    known = indicators.values(series.select("s.series", "month", "s.value"), CANDIDATES)
    return indicators.errors(prices, "region", "m", "y", known, [3, 6])


@query()
def indicator_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Which indicators improve the forecast of the whole, and of how many regions; rules as in Rules, of fewer origins."""
    rules = indicators.Rules(least_origins=12)
    scored = indicators.scores(indicator_errors(ship(spark), d), "region", "m", rules)
    return indicators.verdicts(scored, "region", "ALL", rules)


@query()
def indicator_scores(spark: SparkSession, d: str) -> DataFrame:
    """Mean errors with and without each indicator, and the share of resamples that it wins."""
    return indicators.scores(indicator_errors(ship(spark), d), "region", "m", indicators.Rules(least_origins=12))


@query("""
WITH c AS (
  SELECT p_brand, l_partkey, l_linestatus AS s, median(l_extendedprice / l_quantity) FILTER (WHERE year(l_shipdate) = 1996) AS b, median(l_extendedprice / l_quantity) FILTER (WHERE year(l_shipdate) = 1997) AS r
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE year(l_shipdate) IN (1996, 1997) GROUP BY 1, 2, 3),
g AS (SELECT p_brand, s, count(*) AS n, median(ln(r / b)) AS m, stddev_samp(ln(r / b)) AS sd FROM c WHERE b > 0 AND r > 0 GROUP BY 1, 2),
x AS (SELECT a.p_brand, a.m AS own, a.m - 1.96 * a.sd / sqrt(a.n) AS low, a.m + 1.96 * a.sd / sqrt(a.n) AS high, z.m AS other FROM g a LEFT JOIN (SELECT * FROM g WHERE s = 'F') z USING (p_brand) WHERE a.s = 'O'),
k AS (SELECT rank() OVER (ORDER BY own) + (count(*) OVER (PARTITION BY own) - 1) / 2.0 AS i, rank() OVER (ORDER BY other) + (count(*) OVER (PARTITION BY other) - 1) / 2.0 AS j FROM x WHERE own IS NOT NULL AND other IS NOT NULL),
s AS (SELECT count(*) AS groups, count(*) FILTER (WHERE other IS NOT NULL AND (low > 0 OR high < 0) AND sign(own) <> sign(other)) AS against, (SELECT corr(i, j) FROM k) AS rho FROM x WHERE own IS NOT NULL)
SELECT groups::BIGINT AS groups, against::BIGINT AS against, round(rho, 6) AS rho, against >= 3 AS kill_sign, rho IS NULL OR rho < 0.5 AS kill_rho, against >= 3 OR rho IS NULL OR rho < 0.5 AS kill,
  NOT (against >= 3 OR rho IS NULL OR rho < 0.5) AND groups >= 15 AS passes FROM s
""")
def publication_rules(spark: SparkSession, d: str) -> DataFrame:
    """May the change of open lines by brand be shown, with that of finished lines as the other source? Signs and ranks must agree."""
    line = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("unit", F.col("l_extendedprice") / F.col("l_quantity"))
    year = F.year("l_shipdate")
    side = line.where(year.isin(1996, 1997)).groupBy("p_brand", "l_partkey", "l_linestatus").agg(F.median(F.when(year == 1996, F.col("unit"))).alias("b"), F.median(F.when(year == 1997, F.col("unit"))).alias("e"))
    change = side.where("b > 0 AND e > 0").withColumn("c", F.ln(F.col("e") / F.col("b")))
    per = change.groupBy("p_brand", "l_linestatus").agg(F.count("*").alias("n"), F.median("c").alias("m"), F.stddev_samp("c").alias("sd"))
    half = 1.96 * F.col("sd") / F.sqrt("n")
    own = per.where("l_linestatus = 'O'").select("p_brand", F.col("m").alias("own"), (F.col("m") - half).alias("low"), (F.col("m") + half).alias("high"))
    both = own.join(per.where("l_linestatus = 'F'").select("p_brand", F.col("m").alias("other")), "p_brand", "left")
    out = indicators.kill_rules(both, "p_brand", "own", "low", "high", "other", 3, 0.5, 15)
    return out.withColumn("rho", r(F.col("rho"), 6))
