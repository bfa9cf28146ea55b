"""Published tables over contract rows: cells, leases, renewals, conversions, risks, peers, picks, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import contracts, dates, finance, numbers, stats
from ..operators import events, lookup, products, ranks
from .common import r, t
from .contracts import _LIVE, COMMON, RAW, raw_rows


@query(f"""WITH {COMMON}, l AS (SELECT * FROM common WHERE deposit10k > 0)
SELECT district, round(sum(deposit10k) FILTER (WHERE rent10k IS NULL) / sum(sqm) FILTER (WHERE rent10k IS NULL), 6) AS jeonse, round(sum(deposit10k + rent10k * 12 / 0.05) FILTER (WHERE rent10k > 0) / sum(sqm) FILTER (WHERE rent10k > 0), 6) AS converted,
  round(avg(deposit10k) FILTER (WHERE rent10k > 0), 6) AS deposit, round(avg(rent10k), 6) AS rent, count(*) FILTER (WHERE renewal)::BIGINT AS renewals, count(*)::BIGINT AS n FROM l GROUP BY 1
""")
def rent_summary(spark: SparkSession, d: str) -> DataFrame:
    """Leases of a district in one pass: sums over sums, rents converted at 5 %, means, renewals."""
    rows = contracts.rent_rows(raw_rows(spark, d))
    rent, plain = F.col("rent10k"), F.col("rent10k").isNull()
    over = lambda hit, value: F.sum(F.when(hit, value)) / F.sum(F.when(hit, F.col("sqm")))
    return rows.groupBy("district").agg(
        r(over(plain, F.col("deposit10k")), 6).alias("jeonse"), r(over(~plain, F.col("deposit10k") + rent * 12 / 0.05), 6).alias("converted"), r(F.avg(F.when(~plain, F.col("deposit10k"))), 6).alias("deposit"),
        r(F.avg(rent), 6).alias("rent"), F.count_if(F.col("renewal")).alias("renewals"), F.count("*").alias("n"))


@query(f"""WITH {COMMON}, m AS (SELECT *, floor(sqm + 0.5)::INT AS cell FROM common WHERE {_LIVE} AND NOT coalesce(direct, false))
SELECT apt, cell, count(*)::BIGINT AS n, CASE WHEN count(*) >= 5 THEN quantile_cont(amount10k, 0.25) ELSE min(amount10k) END::DOUBLE AS low, CASE WHEN count(*) >= 5 THEN quantile_cont(amount10k, 0.75) ELSE max(amount10k) END::DOUBLE AS high,
  median(amount10k)::DOUBLE AS middle, min(date) AS first_day, max(amount10k)::BIGINT AS top, max(date) FILTER (WHERE amount10k = (SELECT max(amount10k) FROM m x WHERE x.apt = m.apt AND x.cell = m.cell)) AS top_day FROM m GROUP BY 1, 2
""")
def cell_summary(spark: SparkSession, d: str) -> DataFrame:
    """Cells of name and rounded area: quartiles from five deals on, else the ends; the top deal, the latest of equals."""
    rows = contracts.market_rows(raw_rows(spark, d)).withColumn("cell", numbers.half_up(F.col("sqm")).cast("int"))
    return products.cell_summary(rows, ["apt", "cell"], "amount10k", "date")


@query(f"""WITH {COMMON}, m AS (SELECT apt, floor(sqm + 0.5)::INT AS cell, date[1:4] || date[6:7] AS ym, amount10k FROM common WHERE {_LIVE} AND NOT coalesce(direct, false)),
h AS (SELECT apt, cell, ym, median(amount10k) AS v, count(*) AS n FROM m GROUP BY 1, 2, 3)
SELECT apt, count(*)::BIGINT AS points, string_agg(cell || ':' || ym || ':' || n, ',' ORDER BY cell, ym) AS counts, round(sum(v), 1)::DOUBLE AS medians FROM h GROUP BY 1
""")
def cell_history(spark: SparkSession, d: str) -> DataFrame:
    """Median and count of each cell and month, nested by name."""
    rows = contracts.market_rows(raw_rows(spark, d)).withColumns({"cell": numbers.half_up(F.col("sqm")).cast("int"), "ym": F.concat(F.substring("date", 1, 4), F.substring("date", 6, 2))})
    nested = products.nested_history(rows, "apt", ["cell", "ym"], "amount10k")
    points = F.col("history")
    text = F.array_join(F.transform(points, lambda x: F.concat_ws(":", x["cell"], x["ym"], x["n"])), ",")
    return nested.select("apt", F.size(points).cast("long").alias("points"), text.alias("counts"), r(F.aggregate(points, F.lit(0.0), lambda a, x: a + x["median"]), 1).alias("medians"))


@query(f"""WITH {COMMON}, m AS (SELECT district, apt, floor1 >= 4 AS high, amount10k FROM common WHERE {_LIVE} AND NOT coalesce(direct, false) AND floor1 IS NOT NULL),
c AS (SELECT district, apt, median(amount10k) FILTER (WHERE NOT high) / median(amount10k) FILTER (WHERE high) - 1 AS gap, count(*) FILTER (WHERE high) AS a, count(*) FILTER (WHERE NOT high) AS b FROM m GROUP BY 1, 2)
SELECT district, count(*)::BIGINT AS cells, round(avg((gap < 0)::INT), 6) AS cheaper, CASE WHEN count(*) >= 10 THEN round(median(gap) * 100, 6) END AS gap FROM c WHERE a >= 2 AND b >= 2 GROUP BY 1
""")
def floor_tally(spark: SparkSession, d: str) -> DataFrame:
    """How many names sell their low floors for less than their high ones, and the median gap of a district."""
    rows = contracts.market_rows(raw_rows(spark, d)).where("floor IS NOT NULL").withColumn("high", F.col("floor") >= 4)
    middle = lambda hit: F.median(F.when(hit, F.col("amount10k")))
    c = rows.groupBy("district", "apt").agg((middle(~F.col("high")) / middle(F.col("high")) - 1).alias("gap"), F.count_if("high").alias("a"), F.count_if(~F.col("high")).alias("b")).where("a >= 2 AND b >= 2")
    return c.groupBy("district").agg(F.count("*").alias("cells"), r(stats.share(F.col("gap") < 0), 6).alias("cheaper"), r(stats.suppressed(F.median("gap") * 100, F.count("*"), 10), 6).alias("gap"))


@query(f"""WITH raw AS ({RAW}), l AS (SELECT *, l_partkey0 FROM (SELECT raw.*, l_linenumber AS l_partkey0 FROM raw)),
x AS (SELECT district, (coalesce(cancel_type, '') <> '' OR trim(cancel_day) <> '') AS off, CASE WHEN l_orderkey % 5 < 3 THEN (l_orderkey % 97)::INT END AS lag FROM l)
SELECT district, count(*)::BIGINT AS n, round(avg(off::INT), 6) AS cancelled, round(avg((lag IS NOT NULL AND NOT off)::INT), 6) AS registered, round(avg((lag IS NULL AND NOT off)::INT), 6) AS pending,
  CASE WHEN count(lag) FILTER (WHERE NOT off) >= 10 THEN median(lag) FILTER (WHERE NOT off) END::DOUBLE AS lag, quantile_disc(lag, 0.9) FILTER (WHERE NOT off)::INT AS p90 FROM x GROUP BY 1
""")
def registration_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Contracts called off, registered, still open; how long registration takes. Lags are made up from keys."""
    off = contracts.cancelled(F.col("cancel_type"), F.col("cancel_day"))
    rows = raw_rows(spark, d).select("district", off.alias("off"), F.when(F.col("l_orderkey") % 5 < 3, (F.col("l_orderkey") % 97).cast("int")).alias("lag"))
    return products.outcomes(rows, ["district"], F.col("off"), "lag", 10)


@query(f"""WITH raw AS ({RAW}), x AS (SELECT year(l_shipdate) * 12 + month(l_shipdate) - 1 AS mi, (l_orderkey % 97)::INT AS lag, coalesce(cancel_type, '') <> '' AS off FROM raw),
q AS (SELECT list_sort(list(lag))[least(count(*), floor(count(*) * 0.95)::BIGINT + 1)] AS days FROM x WHERE off),
m AS (SELECT mi, count(*) AS n, count(*) FILTER (WHERE off) AS gone FROM x GROUP BY 1)
SELECT mi::INT AS mi, n::BIGINT AS n, gone::BIGINT AS gone, (make_date((mi + 1)::INT // 12, (mi + 1)::INT % 12 + 1, 1) + days <= DATE '2001-01-15') AS settled FROM m, q
""")
def settled_months(spark: SparkSession, d: str) -> DataFrame:
    """Months whose cancellations have come in: 95 % of them come within so many days of the month's end."""
    rows = raw_rows(spark, d).select(dates.month_index(F.col("l_shipdate")).alias("mi"), (F.col("l_orderkey") % 97).cast("int").alias("lag"), contracts.cancelled_by_kind(F.col("cancel_type")).alias("off"))
    days = stats.quantile_floor(rows.where("off"), [], "lag", {"days": 0.95})
    m = rows.groupBy("mi").agg(F.count("*").alias("n"), F.count_if("off").alias("gone"))
    end = F.make_date(F.floor((F.col("mi") + 1) / 12).cast("int"), F.pmod(F.col("mi") + 1, F.lit(12)) + 1, F.lit(1))
    # one row of days
    return m.join(F.broadcast(days)).select("mi", "n", "gone", (F.date_add(end, F.col("days")) <= F.lit("2001-01-15").cast("date")).alias("settled"))


@query(f"""WITH {COMMON}, x AS (SELECT district, "right" = '사용' AS used, prev_deposit <> ' ' AS known, CASE WHEN sqm <= 60 THEN 'small' WHEN sqm <= 85 THEN 'middle' ELSE 'large' END AS band, deposit10k, contract = '신규' AS new FROM common WHERE deposit10k > 0 AND rent10k IS NULL)
SELECT district, band, count(*) FILTER (WHERE known AND used AND NOT new)::BIGINT AS used, count(*) FILTER (WHERE known AND NOT used AND NOT new)::BIGINT AS unused, count(*) FILTER (WHERE new)::BIGINT AS new, CASE WHEN count(*) FILTER (WHERE new) >= 5 THEN median(deposit10k) FILTER (WHERE new) END::DOUBLE AS new_median FROM x GROUP BY 1, 2
""")
def renewal_cells(spark: SparkSession, d: str) -> DataFrame:
    """Jeonse by area band: renewals with and without the right, new contracts and their median from five on."""
    rows = contracts.jeonse_rows(raw_rows(spark, d)).withColumn("band", F.when(F.col("sqm") <= 60, "small").when(F.col("sqm") <= 85, "middle").otherwise("large"))
    used, new, known = contracts.right_used(F.col("right")), contracts.is_new(F.col("contract")), numbers.filled(F.col("prev_deposit"))
    return rows.groupBy("district", "band").agg(
        F.count_if(known & used & ~new).alias("used"), F.count_if(known & ~used & ~new).alias("unused"), F.count_if(new).alias("new"),
        stats.suppressed(F.median(F.when(new, F.col("deposit10k"))), F.count_if(new), 5).alias("new_median"))


@query(f"""WITH {COMMON}, x AS (SELECT district, year(l_shipdate) AS y, rent10k > 0 AS wolse, trim(prev_deposit) <> '' AS was, deposit10k FROM common WHERE deposit10k > 0),
m AS (SELECT district, y, count(*) AS n, avg(coalesce(wolse, false)::INT) AS share, avg(coalesce(wolse, false)::INT) FILTER (WHERE was) AS switched, median(deposit10k) FILTER (WHERE wolse IS NULL) AS jeonse FROM x GROUP BY 1, 2)
SELECT district, y::INT AS y, n::BIGINT AS n, round(share, 6) AS share, round(switched, 6) AS switched, jeonse::DOUBLE AS jeonse, round(share - lag(share) OVER w, 6) AS moved FROM m WINDOW w AS (PARTITION BY district ORDER BY y)
""")
def rent_flow(spark: SparkSession, d: str) -> DataFrame:
    """The share of leases with rent, among those that had a deposit before too, against the year before."""
    wolse = F.col("rent10k").isNotNull()
    rows = contracts.rent_rows(raw_rows(spark, d)).withColumn("y", F.year("l_shipdate"))
    m = rows.groupBy("district", "y").agg(F.count("*").alias("n"), stats.share(wolse).alias("s"), stats.share(F.when(numbers.filled(F.col("prev_deposit")), wolse)).alias("switched"), F.median(F.when(~wolse, F.col("deposit10k"))).alias("jeonse"))
    w = Window.partitionBy("district").orderBy("y")
    return m.select("district", "y", "n", r(F.col("s"), 6).alias("share"), r(F.col("switched"), 6).alias("switched"), "jeonse", r(F.col("s") - F.lag("s").over(w), 6).alias("moved"))


@query(f"""WITH {COMMON}, x AS (SELECT (year(l_shipdate) + 2) * 100 + month(l_shipdate) AS until, rent10k, "right" = '사용' AS used FROM common WHERE deposit10k > 0 AND l_orderkey % 11 > 0)
SELECT until::INT AS until, count(*)::BIGINT AS total, count(*) FILTER (WHERE rent10k IS NULL)::BIGINT AS jeonse, count(rent10k)::BIGINT AS wolse, count(*) FILTER (WHERE used)::BIGINT AS used FROM x GROUP BY 1
""")
def lease_expiry(spark: SparkSession, d: str) -> DataFrame:
    """Leases by the month in which their term, given as text, ends; terms that say nothing are left out. Leases are counted by the text
    first, so that a text is parsed once, not once a row and again wherever the month is used."""
    term = F.when(F.col("l_orderkey") % 11 > 0, F.concat(F.date_format("l_shipdate", "yy.MM"), F.lit("~"), F.date_format(F.add_months("l_shipdate", 24), "yy.MM"))).otherwise(F.lit("~"))
    counts = {"total": F.count("*"), "jeonse": F.count_if(F.col("rent10k").isNull()), "wolse": F.count("rent10k"), "used": F.count_if(contracts.right_used(F.col("right")))}
    texts = contracts.rent_rows(raw_rows(spark, d)).groupBy(term.alias("term"), (F.year("l_shipdate") + 2 < 2000).alias("past")).agg(*[n.alias(c) for c, n in counts.items()])
    end = dates.expiry_month(F.regexp_extract("term", "(~.*)", 1))
    months = contracts.once(contracts.once(texts, {"end": end}), {"until": F.when(F.col("past"), F.col("end") - 10_000).otherwise(F.col("end")).cast("int")})
    return months.where("until IS NOT NULL").groupBy("until").agg(*[F.sum(c).alias(c) for c in counts])


@query(f"""WITH {COMMON}, g AS (SELECT district, m AS mi FROM (SELECT DISTINCT district FROM raw), range(1997 * 12, 1998 * 12) r(m)),
s AS (SELECT district, year(l_shipdate) * 12 + month(l_shipdate) - 1 AS mi, count(*) FILTER (WHERE direct IS NOT NULL) AS n, count(*) FILTER (WHERE direct) AS k FROM common WHERE amount10k > 0 AND coalesce(cancel_type, '') = '' GROUP BY 1, 2)
SELECT district, g.mi::INT AS mi, coalesce(n, 0)::BIGINT AS n, CASE WHEN n >= 3 THEN round(k / n, 6) END AS share FROM g LEFT JOIN s USING (district, mi)
""")
def direct_share(spark: SparkSession, d: str) -> DataFrame:
    """The share of deals without a broker on a grid of months; null below three."""
    raw = raw_rows(spark, d)
    rows = contracts.sale_rows(raw.where(~contracts.cancelled_by_kind(F.col("cancel_type")))).withColumn("mi", dates.month_index(F.col("l_shipdate")))
    grid = raw.select("district").distinct().withColumn("mi", F.explode(F.sequence(F.lit(1997 * 12), F.lit(1998 * 12 - 1))))
    s = rows.groupBy("district", "mi").agg(F.count("direct").alias("n"), stats.share(F.col("direct")).alias("s"))
    return grid.join(s, ["district", "mi"], "left").select("district", "mi", F.coalesce("n", F.lit(0)).cast("long").alias("n"), r(stats.suppressed(F.col("s"), F.col("n"), 3), 6).alias("share"))


_SIDES = f"""WITH {COMMON}, l AS (SELECT apt, CASE WHEN sqm <= 60 THEN 0 WHEN sqm <= 85 THEN 1 ELSE 2 END AS band, district, year(l_shipdate) AS y, deposit10k, rent10k FROM common WHERE deposit10k > 0),
p AS (SELECT district, apt, band, y, median(deposit10k) FILTER (WHERE rent10k IS NULL) AS jeonse, median(deposit10k / 10.0) FILTER (WHERE rent10k > 0) AS deposit, median(rent10k) AS rent FROM l GROUP BY 1, 2, 3, 4),
q AS (SELECT *, rent * 1200 / (jeonse - deposit) AS rate FROM p WHERE jeonse > deposit AND rent > 0)"""


def _sides(spark: SparkSession, d: str) -> DataFrame:
    rows = contracts.rent_rows(raw_rows(spark, d)).withColumns({"band": numbers.band(F.col("sqm"), [60, 85], "right"), "y": F.year("l_shipdate"), "tenth": F.col("deposit10k") / 10})
    return products.conversion_pairs(rows, ["district", "apt", "band", "y"], "deposit10k", "tenth", "rent10k")


@query(_SIDES + """ SELECT district, band::INT AS band, count(*)::BIGINT AS pairs, round(median(rate), 6) AS rate, round(median(jeonse), 4) AS jeonse, round(median(rent), 4) AS rent FROM q GROUP BY 1, 2 HAVING count(*) >= 3
""")
def conversion_rates(spark: SparkSession, d: str) -> DataFrame:
    """The rate at which deposits turn into rent, over names and bands that have both; from three pairs on."""
    per = _sides(spark, d).groupBy("district", "band").agg(F.count("*").alias("pairs"), F.median("rate").alias("rate"), F.median("jeonse").alias("jeonse"), F.median("rent").alias("rent")).where("pairs >= 3")
    return per.select("district", "band", "pairs", *[r(F.col(c), k).alias(c) for c, k in (("rate", 6), ("jeonse", 4), ("rent", 4))])


@query(_SIDES + """, s AS (SELECT y, count(*) AS n, median(jeonse) AS jeonse, median(deposit) AS deposit, median(rent) AS rent FROM q GROUP BY 1),
c AS (SELECT *, CASE y WHEN 1996 THEN 4.0 WHEN 1997 THEN 4.4 ELSE 4.8 END AS loan FROM s),
e AS (SELECT *, rent + deposit * 0.8 * loan / 1200 + deposit * 0.2 * 3.0 * (1 - 0.154) / 1200 AS cost, lag(loan) OVER w AS loan0, lag(rent) OVER w AS rent0, lag(deposit) OVER w AS deposit0 FROM c WINDOW w AS (ORDER BY y)),
f AS (SELECT *, rent0 + deposit0 * 0.8 * loan0 / 1200 + deposit0 * 0.2 * 3.0 * (1 - 0.154) / 1200 AS cost0, rent0 + deposit0 * 0.8 * loan / 1200 + deposit0 * 0.2 * 3.0 * (1 - 0.154) / 1200 AS at_rate FROM e)
SELECT y::INT AS y, n::BIGINT AS n, round(cost, 4) AS cost, round((cost / cost0 - 1) * 100, 4) AS change, round((at_rate / cost0 - 1) * 100, 4) AS by_rate, round((cost / at_rate - 1) * 100, 4) AS by_level FROM f
""")
def monthly_cost_changes(spark: SparkSession, d: str) -> DataFrame:
    """Cost of the median lease year by year, and how much of its change comes from the rate and from the level."""
    s = _sides(spark, d).groupBy("y").agg(F.count("*").alias("n"), F.median("deposit").alias("deposit"), F.median("rent").alias("rent"))
    s = s.withColumn("loan", F.when(F.col("y") == 1996, 4.0).when(F.col("y") == 1997, 4.4).otherwise(4.8))
    return products.cost_changes(s, "y", F.lit(3.0)).select("y", "n", *[r(F.col(c)).alias(c) for c in ("cost", "change", "by_rate", "by_level")])


@query(f"""WITH {COMMON}, j AS (SELECT district, apt, year(l_shipdate) AS y, deposit10k FROM common WHERE deposit10k > 0 AND rent10k IS NULL AND (year(l_shipdate) = 1996 OR (year(l_shipdate) = 1998 AND contract = '신규'))),
c AS (SELECT district, apt, median(deposit10k) FILTER (WHERE y = 1996) AS was, median(deposit10k) FILTER (WHERE y = 1998) AS now FROM j GROUP BY 1, 2)
SELECT district, count(*)::BIGINT AS cells, CASE WHEN count(*) >= 10 THEN count(*) FILTER (WHERE now < was) END::BIGINT AS fell, CASE WHEN count(*) >= 10 THEN round(avg((now < was)::INT) * 100, 6) END AS share,
  CASE WHEN count(*) FILTER (WHERE now < was) >= 10 THEN round(median((now / was - 1) * 100) FILTER (WHERE now < was), 6) END AS percent, CASE WHEN count(*) FILTER (WHERE now < was) >= 10 THEN floor(median(now - was) FILTER (WHERE now < was) + 0.5) END::BIGINT AS amount
FROM c WHERE was IS NOT NULL AND now IS NOT NULL GROUP BY 1
""")
def reverse_jeonse(spark: SparkSession, d: str) -> DataFrame:
    """Cells whose new deposits are below those of two years before; shares and gaps only of ten cells and more."""
    rows = contracts.jeonse_rows(raw_rows(spark, d)).withColumn("y", F.year("l_shipdate"))
    own = rows.where((F.col("y") == 1996) | ((F.col("y") == 1998) & contracts.is_new(F.col("contract"))))
    middle = lambda y: F.median(F.when(F.col("y") == y, F.col("deposit10k")))
    cells = own.groupBy("district", "apt").agg(middle(1996).alias("was"), middle(1998).alias("now")).where("was IS NOT NULL AND now IS NOT NULL")
    return products.fallen(cells, ["district"], 10)


@query(f"""WITH {COMMON}, m AS (SELECT apt, year(l_shipdate) AS y, median(deposit10k) FILTER (WHERE rent10k IS NULL) AS jeonse, median(amount10k) AS price FROM common WHERE deposit10k > 0 GROUP BY 1, 2)
SELECT y::INT AS y, count(*)::BIGINT AS cells, count(*) FILTER (WHERE jeonse / price >= 0.5)::BIGINT AS risky, count(*) FILTER (WHERE jeonse / price >= 0.8)::BIGINT AS very_risky FROM m WHERE jeonse > 0 AND price > 0 GROUP BY ROLLUP (y)
""")
def deposit_risk(spark: SparkSession, d: str) -> DataFrame:
    """Cells by the ratio of deposit to price, by year and of all."""
    raw = raw_rows(spark, d)
    y = F.year("l_shipdate").alias("y")
    deposits = contracts.jeonse_rows(raw).groupBy("apt", y).agg(F.median("deposit10k").alias("jeonse"))
    prices = contracts.rent_rows(raw).groupBy("apt", y).agg(F.median(numbers.money(F.col("amount"), None)).alias("price"))
    return products.ratio_counts(deposits.join(prices, ["apt", "y"]).where("jeonse > 0 AND price > 0"), ["y"], F.col("jeonse") / F.col("price"), {"risky": 0.5, "very_risky": 0.8})


@query("""WITH v AS (SELECT l_orderkey AS project, l_linenumber AS version, l_shipdate AS tm, l_suppkey % 4 AS series, l_returnflag AS district, l_quantity AS units, l_partkey FROM lineitem),
k AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY project ORDER BY tm DESC, version DESC, units DESC, l_partkey) = 1)
SELECT series::BIGINT AS series, district, year(tm)::INT AS y, count(*)::BIGINT AS projects, sum(units)::DOUBLE AS units FROM k GROUP BY 1, 2, 3
""")
def permits_fold(spark: SparkSession, d: str) -> DataFrame:
    """The latest version of each project, then projects and units by series, district and year."""
    v = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", (F.col("l_suppkey") % 4).alias("series"), F.col("l_returnflag").alias("district"), "l_quantity", "l_partkey")
    last = lookup.top_k(v, ["l_orderkey"], 1, F.desc("l_shipdate"), F.desc("l_linenumber"), F.desc("l_quantity"), F.col("l_partkey"))
    return last.groupBy("series", "district", F.year("l_shipdate").alias("y")).agg(F.count("*").alias("projects"), F.sum("l_quantity").alias("units"))


@query("""WITH m AS (SELECT l_suppkey % 20 AS series, year(l_shipdate) * 12 + month(l_shipdate) - 1 AS mi, count(*) AS n FROM lineitem WHERE l_suppkey % 3 > 0 GROUP BY 1, 2)
SELECT series::BIGINT AS series, min(mi)::INT AS first, max(mi)::INT AS last, (max(mi) - min(mi) + 1 - count(*))::BIGINT AS holes, round(count(*) / (max(mi) - min(mi) + 1), 6) AS coverage, quantile_disc(n, 0.5)::BIGINT AS middle FROM m GROUP BY 1
""")
def series_gates(spark: SparkSession, d: str) -> DataFrame:
    """Span, holes and coverage of monthly series: what a series must show before it is used."""
    rows = t(spark, d, "lineitem").where("l_suppkey % 3 > 0").select((F.col("l_suppkey") % 20).alias("series"), dates.month_index(F.col("l_shipdate")).alias("mi"))
    return products.gates(rows, ["series"], "mi")


@query("""WITH c AS (SELECT p_partkey, floor(p_retailprice / 100) AS price_band, CASE WHEN p_size <= 20 THEN 0 ELSE 1 END AS size_band, p_retailprice, p_brand FROM part)
SELECT p_partkey, (count(*) OVER (PARTITION BY price_band, size_band) - 1)::BIGINT AS peers FROM c
""")
def peers(spark: SparkSession, d: str) -> DataFrame:
    """How many other parts share both bands: counted per band, so that no band is gathered."""
    c = t(spark, d, "part").select("p_partkey", F.floor(F.col("p_retailprice") / 100).alias("price_band"), numbers.band(F.col("p_size"), [20], "right").alias("size_band"))
    return c.join(c.groupBy("price_band", "size_band").agg(F.count("*").alias("n")), ["price_band", "size_band"]).select("p_partkey", (F.col("n") - 1).alias("peers"))


@query(f"""WITH {COMMON}, m AS (SELECT apt, CASE WHEN sqm <= 60 THEN 0 WHEN sqm <= 85 THEN 1 ELSE 2 END AS band, date, amount10k, l_orderkey, l_linenumber, sqm, l_shipdate FROM common WHERE {_LIVE} AND NOT coalesce(direct, false)),
c AS (SELECT apt, band, count(*) AS n, median(amount10k) AS middle, max(date) AS last_day, median(sqm) AS area FROM m GROUP BY 1, 2), g AS (SELECT *, (band = 2) AS large FROM c WHERE n >= 3)
SELECT apt, band::INT AS band, n::BIGINT AS n, middle::DOUBLE AS middle, last_day, round(middle - least(middle * 40 / 100, CASE WHEN middle <= 150000 THEN 60000 WHEN middle <= 250000 THEN 40000 ELSE 20000 END), 4) AS own FROM g
""")
def recommendation_rows(spark: SparkSession, d: str) -> DataFrame:
    """Cells with at least three deals: median, last day, and what is left of the price when the loan is taken off."""
    rows = contracts.market_rows(raw_rows(spark, d)).withColumn("band", numbers.band(F.col("sqm"), [60, 85], "right"))
    cells = rows.groupBy("apt", "band").agg(F.count("*").alias("n"), F.median("amount10k").alias("middle"), F.max("date").alias("last_day")).where("n >= 3")
    return cells.select("apt", "band", "n", "middle", "last_day", r(F.col("middle") - finance.loan_limit(F.col("middle"))).alias("own"))


@query("""WITH f AS (SELECT source AS family, doc_id AS member, TIMESTAMP '2024-03-01' - INTERVAL 1 HOUR * (doc_id % 3000) AS tm FROM documents),
m AS (SELECT family, count(*) AS members, min(tm) AS tm, min(member) FILTER (WHERE tm = (SELECT min(tm) FROM f x WHERE x.family = f.family)) AS oldest FROM f GROUP BY 1 HAVING count(*) >= 5)
SELECT family, members::BIGINT AS members, oldest, date_diff('day', tm::DATE, DATE '2024-03-01')::INT AS days, CASE WHEN date_diff('day', tm::DATE, DATE '2024-03-01') > 100 THEN 'late' WHEN date_diff('day', tm::DATE, DATE '2024-03-01') > 50 THEN 'due' ELSE 'fresh' END AS level FROM m
""")
def source_ages(spark: SparkSession, d: str) -> DataFrame:
    """Families of at least five members: the oldest one, its age, how bad that is."""
    rows = t(spark, d, "documents").select(F.col("source").alias("family"), F.col("doc_id").alias("member"), (F.lit("2024-03-01").cast("timestamp") - F.make_interval(hours=(F.col("doc_id") % 3000).cast("int"))).alias("at"))
    return products.ages(rows, "family", "member", "at", F.lit("2024-03-01").cast("date"), 5, {"late": 100, "due": 50})


@query("""WITH a AS (SELECT row_number() OVER () AS id, l_partkey, l_orderkey, l_linenumber, l_shipdate, l_extendedprice AS v FROM lineitem)
SELECT a.l_orderkey, a.l_linenumber, a.v, count(b.v)::BIGINT AS n, count(*) FILTER (WHERE b.v < a.v)::BIGINT AS lower, count(*) FILTER (WHERE b.v = a.v)::BIGINT AS equal FROM a LEFT JOIN a b ON a.l_partkey = b.l_partkey AND b.l_shipdate < a.l_shipdate GROUP BY a.id, a.l_orderkey, a.l_linenumber, a.v
""")
def price_position(spark: SparkSession, d: str) -> DataFrame:
    """Where a price stands among the earlier ones of its part: how many were lower, equal, and all."""
    rows = t(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", F.unix_date(F.col("l_shipdate").cast("date")).alias("day"), F.col("l_extendedprice").alias("v"))
    return events.standing_among_earlier(rows, ["l_partkey"], "day", "v").select("l_orderkey", "l_linenumber", "v", "n", "lower", "equal")


@query("""WITH c AS (SELECT p_brand, p_name, count(*) AS n, median(p_retailprice) AS m, CASE WHEN median(p_size) <= 20 THEN 0 WHEN median(p_size) <= 35 THEN 1 ELSE 2 END AS band FROM part GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY p_brand, band ORDER BY n DESC, m, p_name) AS in_band, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, m, p_name) AS overall FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN in_band <= 4 THEN 0 ELSE 1 END, overall) AS turn FROM k)
SELECT p_brand, p_name, band::INT AS band, n::BIGINT AS n, (row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, m, p_name))::INT AS place FROM f WHERE turn <= 12
""")
def stratified_pick(spark: SparkSession, d: str) -> DataFrame:
    """Twelve names of a brand: up to four of each band first, the rest by count; then in the order of counts."""
    c = t(spark, d, "part").groupBy("p_brand", "p_name").agg(F.count("*").alias("n"), F.median("p_retailprice").alias("m"), numbers.band(F.median("p_size"), [20, 35], "right").alias("band"))
    return products.stratified_pick(c, ["p_brand"], "band", 4, 12, [F.desc("n"), F.col("m"), F.col("p_name")]).select("p_brand", "p_name", "band", "n", "place")


@query("""WITH a AS (SELECT s_suppkey, s_name, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS v, split_part(s_name, '#', 2) AS no FROM supplier)
SELECT s_suppkey, (row_number() OVER (ORDER BY v DESC NULLS LAST, s_name))::INT AS by_value, (row_number() OVER (ORDER BY v ASC NULLS LAST, s_name))::INT AS by_low, (row_number() OVER (ORDER BY (no::BIGINT % 10), no))::INT AS by_number FROM a
""")
def display_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders of display, unknown values last, numbers before text: each by ranges, so that no task sorts all."""
    out = t(spark, d, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("v"), F.substring_index("s_name", "#", -1).alias("no"))
    orders = {"by_value": [F.desc_nulls_last("v"), F.col("s_name")], "by_low": [F.asc_nulls_last("v"), F.col("s_name")], "by_number": [F.col("no").cast("long") % 10, F.col("no")]}
    for name, order in orders.items():
        out = ranks.gapless(out, [], order, name)
    return out.select("s_suppkey", *[F.col(c).cast("int").alias(c) for c in orders])


@query("""WITH x AS (SELECT l_partkey AS cell, l_returnflag AS district, CASE WHEN l_extendedprice < 30000 THEN 'low' ELSE 'high' END AS band, l_shipdate AS tm, l_extendedprice AS v, max(l_extendedprice) OVER (PARTITION BY l_partkey ORDER BY l_shipdate RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS before FROM lineitem)
SELECT coalesce(district, '*') AS district, coalesce(band, '*') AS band, count(*)::BIGINT AS judged, count(*) FILTER (WHERE v > before)::BIGINT AS records FROM x WHERE before IS NOT NULL AND tm >= TIMESTAMP '1998-01-01' GROUP BY GROUPING SETS ((district), (band), ())
""")
def record_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Record prices by district, by band and of all: history is whole, only the judged deals are chosen afterwards."""
    w = Window.partitionBy("l_partkey").orderBy(F.unix_date(F.col("l_shipdate").cast("date"))).rangeBetween(Window.unboundedPreceding, -1)
    x = t(spark, d, "lineitem").select("l_partkey", F.col("l_returnflag").alias("district"), F.when(F.col("l_extendedprice") < 30_000, "low").otherwise("high").alias("band"), "l_shipdate", F.col("l_extendedprice").alias("v"), F.max("l_extendedprice").over(w).alias("before"))
    judged = x.where("before IS NOT NULL AND l_shipdate >= '1998-01-01'")
    sets = judged.groupingSets([["district"], ["band"], []], "district", "band").agg(F.count("*").alias("judged"), F.count_if(F.col("v") > F.col("before")).alias("records"))
    return sets.select(F.coalesce("district", F.lit("*")).alias("district"), F.coalesce("band", F.lit("*")).alias("band"), "judged", "records")


@query("""WITH k AS (SELECT p_name AS seq, p_brand || '/' || p_size AS stable FROM part)
SELECT seq, count(DISTINCT stable)::BIGINT AS ids, min(stable) AS first FROM k GROUP BY 1 HAVING count(DISTINCT stable) >= 2
""")
def alias_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Sequence names that stand for two or more stable ids."""
    k = t(spark, d, "part").select(F.col("p_name").alias("seq"), F.concat_ws("/", "p_brand", "p_size").alias("stable"))
    return k.groupBy("seq").agg(F.count_distinct("stable").alias("ids"), F.min("stable").alias("first")).where("ids >= 2")


@query("""WITH n AS (SELECT year(l_shipdate) * 12 + month(l_shipdate) - 1 AS mi, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1), o AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) - 1 AS mi, avg(o_totalprice) AS v FROM orders WHERE month(o_orderdate) <> 7 GROUP BY 1)
SELECT n.mi::INT AS mi, (o.mi IS NULL) AS pending, round(n.v / o.v, 6) AS ratio FROM n LEFT JOIN o USING (mi)
""")
def nowcast_overlap(spark: SparkSession, d: str) -> DataFrame:
    """A fast series against the official one, by month; months that the official one lacks are pending."""
    n = t(spark, d, "lineitem").groupBy(dates.month_index(F.col("l_shipdate")).alias("mi")).agg(F.avg("l_extendedprice").alias("v"))
    o = t(spark, d, "orders").where(F.month("o_orderdate") != 7).groupBy(dates.month_index(F.col("o_orderdate")).alias("mi")).agg(F.avg("o_totalprice").alias("o"))
    return n.join(o, "mi", "left").select("mi", F.col("o").isNull().alias("pending"), r(F.col("v") / F.col("o"), 6).alias("ratio"))


@query("""WITH a AS (SELECT n_nationkey AS k, n_regionkey AS g, median(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT a.k, b.k AS peer FROM a JOIN a b ON a.k <> b.k QUALIFY row_number() OVER (PARTITION BY a.k ORDER BY abs(a.v - b.v), b.k) = 1
""")
def nearest_peer(spark: SparkSession, d: str) -> DataFrame:
    """The nation with the nearest median balance; a dimension of 25."""
    a = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.median("c_acctbal").alias("v"))
    b = a.select(F.col("k").alias("peer"), F.col("v").alias("w"))
    pairs = a.join(F.broadcast(b), F.col("k") != F.col("peer"))
    return pairs.groupBy("k").agg(F.min_by("peer", F.struct(F.abs(F.col("v") - F.col("w")), "peer")).alias("peer"))


@query("""WITH p AS (SELECT l_orderkey % 3 AS part, l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_linenumber <= 2 UNION ALL SELECT 9, l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 50 = 0)
SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS times, count(DISTINCT part)::BIGINT AS parts FROM p GROUP BY 1, 2 HAVING count(*) > 1
""")
def part_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Keys that stand more than once in parts that are to be merged."""
    rows = t(spark, d, "lineitem").select((F.col("l_orderkey") % 3).alias("part"), "l_orderkey", "l_linenumber")
    extra = rows.where("l_linenumber = 1 AND l_orderkey % 50 = 0").withColumn("part", F.lit(9).cast("long"))
    return products.repeated_keys(rows.where("l_linenumber <= 2").unionByName(extra), ["l_orderkey", "l_linenumber"], "part")


@query("""WITH m AS (SELECT l_returnflag AS k, l_linestatus AS s, year(l_shipdate) AS y, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)
SELECT k, s, y::INT AS y, n::BIGINT AS n FROM m WHERE n > 2
""")
def nested_and_flat(spark: SparkSession, d: str) -> DataFrame:
    """Counts put in maps of maps and taken out again; points of two and fewer are left out."""
    flat = t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("k"), F.col("l_linestatus").alias("s"), F.year("l_shipdate").alias("y")).agg(F.count("*").alias("n"))
    inner = flat.groupBy("k", "s").agg(F.map_from_entries(F.collect_list(F.struct("y", "n"))).alias("m"))
    nested = inner.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("s", "m"))).alias("maps"))
    return nested.select("k", F.explode("maps").alias("s", "m")).select("k", "s", F.explode("m").alias("y", "n")).where("n > 2")


@query("""WITH m AS (SELECT l_returnflag AS g, year(l_shipdate) * 12 + month(l_shipdate) - 1 AS mi, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2),
x AS (SELECT g, mi, abs(v - lag(v) OVER (PARTITION BY g ORDER BY mi)) AS e FROM m),
c AS (SELECT a.g, a.mi, a.e, quantile_cont(b.e, 0.8) AS q, count(b.e) AS known FROM x a JOIN x b ON a.g = b.g AND b.mi <= a.mi - 3 WHERE a.e IS NOT NULL GROUP BY 1, 2, 3)
SELECT g, count(*)::BIGINT AS judged, round(avg((e <= q)::INT), 6) AS covered FROM c WHERE known >= 12 GROUP BY 1
""")
def expanding_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How often an error lay within the 80 % quantile of the errors known three months before: months only, by group."""
    m = t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("g"), dates.month_index(F.col("l_shipdate")).alias("mi")).agg(F.avg("l_extendedprice").alias("v"))
    e = m.withColumn("e", F.abs(F.col("v") - F.lag("v").over(Window.partitionBy("g").orderBy("mi"))))
    w = Window.partitionBy("g").orderBy("mi").rangeBetween(Window.unboundedPreceding, -3)
    c = e.select("g", "e", F.percentile("e", 0.8).over(w).alias("q"), F.count("e").over(w).alias("known")).where("e IS NOT NULL AND known >= 12")
    return c.groupBy("g").agg(F.count("*").alias("judged"), r(stats.share(F.col("e") <= F.col("q")), 6).alias("covered"))


@query("""WITH v AS (SELECT l_partkey, l_extendedprice / l_quantity AS u FROM lineitem), f AS (SELECT l_partkey, median(u) AS front FROM v GROUP BY 1), b AS (SELECT quantile_disc(front, 1 / 3.0) AS lo, quantile_disc(front, 2 / 3.0) AS hi FROM f)
SELECT CASE WHEN front <= lo THEN 1 WHEN front <= hi THEN 2 ELSE 3 END::INT AS third, count(*)::BIGINT AS n, round(max(front), 6) AS most FROM f, b GROUP BY 1
""")
def price_thirds(spark: SparkSession, d: str) -> DataFrame:
    """Parts in thirds of their price, bounds at ceiling ranks."""
    f = t(spark, d, "lineitem").groupBy("l_partkey").agg(F.median(F.col("l_extendedprice") / F.col("l_quantity")).alias("front"))
    bounds = f.agg(stats.quantile_disc("front", 1 / 3).alias("lo"), stats.quantile_disc("front", 2 / 3).alias("hi"))
    # one row of bounds
    third = F.when(F.col("front") <= F.col("lo"), 1).when(F.col("front") <= F.col("hi"), 2).otherwise(3)
    return f.join(F.broadcast(bounds)).groupBy(third.alias("third")).agg(F.count("*").alias("n"), r(F.max("front"), 6).alias("most"))
