"""Raw contract rows: normalisers, predicates, projections, searches, costs. Lines stand for rows of the register."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import contracts, dates, finance, numbers, stats, text
from .common import r, t

#: Text columns as a register delivers them, made from lines; the words are those of functions.contracts.
RAW = """SELECT l_orderkey, l_linenumber, l_returnflag AS district, l_shipdate,
  concat(' ', CASE WHEN l_partkey % 97 = 0 THEN '' ELSE concat('P', CAST(l_partkey % 400 AS STRING)) END, ' ') AS name,
  concat('D', CAST(l_suppkey % 7 AS STRING), ' ') AS dong,
  CASE WHEN l_partkey % 89 = 0 THEN 'n/a' ELSE concat(CAST(CAST(l_quantity AS INT) + 50 AS STRING), '.', CAST(l_linenumber AS STRING), CAST(l_suppkey % 90 + 10 AS STRING)) END AS area,
  CASE WHEN l_partkey % 83 = 0 THEN ' ' ELSE concat(CAST(CAST(floor(l_extendedprice / 1000) AS BIGINT) AS STRING), ',', lpad(CAST(CAST(floor(l_extendedprice) AS BIGINT) % 1000 AS STRING), 3, '0')) END AS amount,
  year(l_shipdate) AS year, month(l_shipdate) AS month, CASE WHEN l_suppkey % 71 = 0 THEN 32 ELSE day(l_shipdate) END AS day,
  CAST(l_linenumber - 2 AS STRING) AS floor, CAST(1890 + l_suppkey % 130 AS STRING) AS built,
  CASE WHEN l_linenumber = 7 THEN 'O' END AS cancel_type, CASE WHEN l_partkey % 50 = 1 THEN '96.01.01' ELSE ' ' END AS cancel_day,
  CASE l_orderkey % 4 WHEN 0 THEN '직거래' WHEN 1 THEN '중개거래' WHEN 2 THEN ' 중개거래' ELSE '' END AS dealing,
  CASE l_suppkey % 4 WHEN 0 THEN '신규' WHEN 1 THEN '갱신' WHEN 2 THEN ' 갱신 ' ELSE '' END AS contract,
  CAST(CAST(floor(l_extendedprice / 2) AS BIGINT) AS STRING) AS deposit,
  CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN '0' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS rent,
  CASE WHEN l_partkey % 2 = 0 THEN '1,000' ELSE ' ' END AS prev_deposit, CASE WHEN l_suppkey % 3 = 0 THEN '사용' ELSE '' END AS right
FROM lineitem"""
#: The SQL of the rows that pass the checks all normalisers share.
COMMON = """raw AS (""" + RAW + """), common AS (SELECT *, trim(name) AS apt, trim(dong) AS dong1, floor(TRY_CAST(area AS DOUBLE) * 100 + 0.5) / 100 AS sqm,
  year || '-' || lpad(month::VARCHAR, 2, '0') || '-' || lpad(day::VARCHAR, 2, '0') AS date, CASE WHEN floor::DOUBLE > 0 THEN floor::DOUBLE END AS floor1, CASE WHEN built::INT > 1900 THEN built::INT END AS built1,
  TRY_CAST(replace(amount, ',', '') AS BIGINT) AS amount10k, CASE WHEN trim(dealing) <> '' THEN trim(dealing) = '직거래' END AS direct,
  deposit::BIGINT AS deposit10k, CASE WHEN TRY_CAST(rent AS BIGINT) > 0 THEN rent::BIGINT END AS rent10k, CASE WHEN trim(contract) <> '' THEN trim(contract) = '갱신' END AS renewal
  FROM raw WHERE trim(name) <> '' AND TRY_CAST(area AS DOUBLE) > 0 AND day <= 31)"""


def raw_rows(spark: SparkSession, d: str) -> DataFrame:
    t(spark, d, "lineitem").createOrReplaceTempView("__contract_lines")
    return spark.sql(RAW.replace("FROM lineitem", "FROM __contract_lines"))


@query(f"""WITH {COMMON}
SELECT l_orderkey, l_linenumber, apt, dong1 AS dong, sqm, date, floor1 AS floor, built1 AS built, amount10k, direct FROM common WHERE amount10k > 0
""")
def sale_rows(spark: SparkSession, d: str) -> DataFrame:
    """Raw sales parsed and checked."""
    return contracts.sale_rows(raw_rows(spark, d)).select("l_orderkey", "l_linenumber", "apt", "dong", "sqm", "date", "floor", "built", "amount10k", "direct")


@query(f"""WITH {COMMON}
SELECT l_orderkey, l_linenumber, apt, sqm, date, deposit10k, rent10k, renewal FROM common WHERE deposit10k > 0
""")
def rent_rows(spark: SparkSession, d: str) -> DataFrame:
    """Raw leases parsed and checked."""
    return contracts.rent_rows(raw_rows(spark, d)).select("l_orderkey", "l_linenumber", "apt", "sqm", "date", "deposit10k", "rent10k", "renewal")


@query(f"""WITH raw AS ({RAW})
SELECT district, count(*) FILTER (WHERE coalesce(cancel_type, '') <> '' OR trim(cancel_day) <> '')::BIGINT AS cancelled, count(*) FILTER (WHERE coalesce(cancel_type, '') <> '')::BIGINT AS cancelled_by_kind,
  count(*) FILTER (WHERE trim(dealing) = '직거래')::BIGINT AS direct, count(*) FILTER (WHERE trim(dealing) = '중개거래')::BIGINT AS brokered, count(*) FILTER (WHERE trim(dealing) = '')::BIGINT AS unknown,
  count(*) FILTER (WHERE trim(contract) = '갱신')::BIGINT AS renewals, count(*) FILTER (WHERE contract = '신규')::BIGINT AS new_contracts,
  count(*) FILTER (WHERE coalesce(TRY_CAST(rent AS BIGINT), 0) = 0)::BIGINT AS pure_jeonse, count(*) FILTER (WHERE TRY_CAST(rent AS BIGINT) > 0)::BIGINT AS pure_wolse,
  count(*) FILTER (WHERE trim(contract) = '갱신' AND trim(prev_deposit) <> '')::BIGINT AS renewal_pairs, count(*) FILTER (WHERE contract = '신규' AND coalesce(TRY_CAST(rent AS BIGINT), 0) = 0)::BIGINT AS new_jeonse,
  count(*) FILTER (WHERE "right" = '사용')::BIGINT AS right_used FROM raw GROUP BY 1
""")
def row_predicates(spark: SparkSession, d: str) -> DataFrame:
    """How many rows each predicate holds for."""
    c = F.col
    kinds = contracts.direct(c("dealing"))
    return raw_rows(spark, d).groupBy("district").agg(
        F.count_if(contracts.cancelled(c("cancel_type"), c("cancel_day"))).alias("cancelled"), F.count_if(contracts.cancelled_by_kind(c("cancel_type"))).alias("cancelled_by_kind"),
        F.count_if(kinds).alias("direct"), F.count_if(contracts.brokered(c("dealing"))).alias("brokered"), F.count_if(kinds.isNull()).alias("unknown"),
        F.count_if(contracts.renewal(c("contract"))).alias("renewals"), F.count_if(contracts.is_new(c("contract"))).alias("new_contracts"),
        F.count_if(contracts.pure_jeonse(c("deposit"), c("rent"))).alias("pure_jeonse"), F.count_if(contracts.pure_wolse(c("rent"))).alias("pure_wolse"),
        F.count_if(contracts.renewal_pair(c("contract"), c("prev_deposit"))).alias("renewal_pairs"), F.count_if(contracts.new_jeonse(c("contract"), c("deposit"), c("rent"))).alias("new_jeonse"),
        F.count_if(contracts.right_used(c("right"))).alias("right_used"))


_LIVE = "coalesce(cancel_type, '') = '' AND amount10k > 0"


@query(f"""WITH {COMMON}
SELECT 'market' AS kind, count(*)::BIGINT AS n, sum(amount10k)::BIGINT AS amount FROM common WHERE {_LIVE} AND NOT coalesce(direct, false)
UNION ALL SELECT 'record', count(*), sum(amount10k)::BIGINT FROM common WHERE {_LIVE} AND trim(dealing) = '중개거래'
UNION ALL SELECT 'nowcast', count(*), sum(amount10k)::BIGINT FROM common WHERE {_LIVE} AND trim(cancel_day) = ''
UNION ALL SELECT 'jeonse', count(*), sum(deposit10k)::BIGINT FROM common WHERE deposit10k > 0 AND rent10k IS NULL
""")
def row_projections(spark: SparkSession, d: str) -> DataFrame:
    """Rows and amounts of the projections that statistics begin with."""
    raw = raw_rows(spark, d)
    kinds = {"market": (contracts.market_rows(raw), "amount10k"), "record": (contracts.record_rows(raw), "amount10k"), "nowcast": (contracts.nowcast_rows(raw), "amount10k"), "jeonse": (contracts.jeonse_rows(raw), "deposit10k")}
    parts = [rows.agg(F.count("*").alias("n"), F.sum(c).alias("amount")).select(F.lit(k).alias("kind"), "n", "amount") for k, (rows, c) in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"""WITH {COMMON}
SELECT district, apt || '|' || floor(sqm + 0.5)::INT AS cell, count(*)::BIGINT AS n, round(median(amount10k / sqm), 6) AS unit, max(built1)::INT AS built FROM common WHERE {_LIVE} AND NOT coalesce(direct, false) GROUP BY 1, 2
""")
def unit_price_cells(spark: SparkSession, d: str) -> DataFrame:
    """Market deals by name and rounded area: median price of a square metre."""
    rows = contracts.change_rows(raw_rows(spark, d)).withColumn("cell", F.concat_ws("|", "apt", numbers.half_up(F.col("sqm")).cast("int")))
    return rows.groupBy("district", "cell").agg(F.count("*").alias("n"), r(F.median("unit"), 6).alias("unit"), F.max("built").alias("built"))


@query(f"""WITH {COMMON}
SELECT l_orderkey, l_linenumber, amount10k, sqm FROM common
WHERE amount10k BETWEEN 20000 AND 60000 AND sqm >= 60 AND built1 >= 1950 AND district = 'R' AND contains(lower(apt), 'p1') AND NOT coalesce(direct, false)
""")
def deal_search(spark: SparkSession, d: str) -> DataFrame:
    """A search with several conditions."""
    found = contracts.search(contracts.sale_rows(raw_rows(spark, d)), district="R", name="p 1", least_price=20_000, most_price=60_000, least_area=60, built_since=1950, without_direct=True, dong=None)
    return found.select("l_orderkey", "l_linenumber", "amount10k", "sqm")


@query(f"""WITH {COMMON},
b AS (SELECT CASE WHEN amount10k < 30000 THEN 0 WHEN amount10k >= 90000 THEN 90000 ELSE floor(amount10k / 10000) * 10000 END AS price_band,
  CASE WHEN sqm <= 60 THEN 0 WHEN sqm <= 85 THEN 1 ELSE 2 END AS area_band, CASE WHEN 2005 - built1 < 10 THEN 0 WHEN 2005 - built1 < 30 THEN 1 WHEN built1 IS NOT NULL THEN 2 END AS age_band FROM common WHERE amount10k > 0)
SELECT price_band::BIGINT AS price_band, area_band::INT AS area_band, age_band::INT AS age_band, count(*)::BIGINT AS n FROM b GROUP BY 1, 2, 3
""")
def deal_bands(spark: SparkSession, d: str) -> DataFrame:
    """Deals by bands of price (of equal width, open ends), area (closed right) and age (closed left)."""
    rows = contracts.sale_rows(raw_rows(spark, d))
    return rows.groupBy(
        numbers.band_floor(F.col("amount10k"), 10_000, 30_000, 90_000).alias("price_band"), numbers.band(F.col("sqm"), [60, 85], "right").alias("area_band"),
        numbers.band(2005 - F.col("built"), [10, 30]).alias("age_band")).agg(F.count("*").alias("n"))


@query(f"""WITH {COMMON},
c AS (SELECT district, apt, count(*) AS n, date_diff('day', max(l_shipdate)::DATE, DATE '2001-06-30') AS age, median(amount10k) AS m FROM common WHERE amount10k > 0 GROUP BY 1, 2)
SELECT district, apt, CASE WHEN n >= 5 AND age <= 90 THEN 'enough' WHEN n >= 3 THEN 'partial' END AS grade,
  array_to_string(list_filter([CASE WHEN n < 5 THEN 'few_deals' END, CASE WHEN age > 90 THEN 'stale_deal' END, CASE WHEN abs(m - 40000) <= 5000 THEN 'reg_line 40000' END], lambda x: x IS NOT NULL), ',') AS flags FROM c
""")
def grades_and_flags(spark: SparkSession, d: str) -> DataFrame:
    """How far a name's deals can be trusted, and what to look at."""
    per = contracts.sale_rows(raw_rows(spark, d)).groupBy("district", "apt").agg(F.count("*").alias("n"), F.datediff(F.lit("2001-06-30").cast("date"), F.max("l_shipdate")).alias("age"), F.median("amount10k").alias("m"))
    flags = contracts.check_flags(F.col("n"), F.col("age"), F.col("m"), lines=(40_000,))
    return per.select("district", "apt", contracts.sample_grade(F.col("n"), F.col("age")).alias("grade"), F.array_join(flags, ",").alias("flags"))


_PRICE = "floor(p_retailprice * p_size * 3)"
_RATE = "CASE WHEN p <= 60000 THEN 1.0 WHEN p > 90000 THEN 3.0 ELSE floor((p / 30000 * 2 - 3) / 100 * 10000 + 0.5) / 10000 * 100 END"


@query(f"""WITH a AS (SELECT p_partkey, {_PRICE} AS p, p_size > 40 AS large FROM part), b AS (SELECT *, ({_RATE})::DOUBLE AS rate, CASE WHEN p <= 150000 THEN 60000 WHEN p <= 250000 THEN 40000 ELSE 20000 END AS cap FROM a),
c AS (SELECT *, p * rate / 100 AS tax, CASE WHEN p < 5000 THEN least(p * 0.6 / 100, 25) WHEN p < 20000 THEN least(p * 0.5 / 100, 80) WHEN p < 90000 THEN p * 0.4 / 100 WHEN p < 120000 THEN p * 0.5 / 100 WHEN p < 150000 THEN p * 0.6 / 100 ELSE p * 0.7 / 100 END::DOUBLE AS broker FROM b),
e AS (SELECT *, tax + p * (floor(rate * 0.1 * 10000 + 0.5) / 10000) / 100 + CASE WHEN large THEN p * 0.2 / 100 ELSE 0 END + broker AS costs FROM c)
SELECT p_partkey, cap::INT AS cap, round(rate, 4) AS rate, round(costs, 6) AS costs, round(p - least(p * 40 / 100, cap) + costs, 6) AS cash,
  round(p - least(p * 70 / 100, cap) + costs - CASE WHEN p <= 120000 THEN least(200, tax) ELSE 0 END, 6) AS cash_first FROM e
""")
def purchase_columns(spark: SparkSession, d: str) -> DataFrame:
    """Loan cap, tax, costs and least own money of a purchase."""
    p, large = F.floor(F.col("p_retailprice") * F.col("p_size") * 3).cast("double"), F.col("p_size") > 40
    return t(spark, d, "part").select(
        "p_partkey", finance.loan_cap(p).alias("cap"), r(finance.acquisition_rate(p)).alias("rate"), r(finance.purchase_costs(p, large), 6).alias("costs"),
        r(finance.least_cash(p, large), 6).alias("cash"), r(finance.least_cash(p, large, first=True), 6).alias("cash_first"))


@query("""WITH a AS (SELECT p_partkey, p_retailprice * 30 AS jeonse, p_retailprice * 10 AS deposit, p_size * 2.0 AS rent, p_size * 500.0 AS cash, 3 + p_size / 25.0 AS loan FROM part)
SELECT p_partkey, round(CASE WHEN jeonse > deposit THEN rent * 1200 / (jeonse - deposit) END, 4) AS rate,
  round(rent + least(greatest(deposit - cash, 0), deposit * 0.8) * loan / 1200 - greatest(cash - deposit, 0) * 3.1 * (1 - 0.154) / 1200, 4) AS cost, round(greatest(0, deposit - cash - deposit * 0.8), 4) AS short,
  round(rent + deposit * 0.8 * loan / 1200 + deposit * 0.2 * 3.1 * (1 - 0.154) / 1200, 4) AS converted,
  CASE WHEN floor((rent * 1200 / (jeonse - deposit) - loan) * 100 + 0.5) / 100 > 0.3 THEN 'jeonse' WHEN floor((rent * 1200 / (jeonse - deposit) - loan) * 100 + 0.5) / 100 < -0.3 THEN 'wolse' ELSE 'even' END AS side,
  round(least(10, loan + 2), 4) AS legal,
  CASE WHEN greatest(0, floor(floor(deposit) - least(cash, floor(deposit)) - floor(deposit) * 0.8 + 0.5)) = 0 THEN
    floor((floor(deposit) - least(cash, floor(deposit))) * 423 / 12000 + 0.5) + floor(rent * 10 + 0.5) + floor(least(cash, floor(deposit)) * 310 * 846 / 12000000 + 0.5) END::BIGINT AS thousands FROM a
""")
def monthly_cost_columns(spark: SparkSession, d: str) -> DataFrame:
    """Conversion rate, monthly costs by both rules, the cheaper side, the legal cap, and an offer in whole thousands."""
    p = t(spark, d, "part")
    price, size = F.col("p_retailprice"), F.col("p_size")
    jeonse, deposit, rent, cash, loan, yearly = price * 30, price * 10, size * 2.0, size * 500.0, 3 + size / 25.0, F.lit(3.1)
    rate = finance.conversion_rate(jeonse, deposit, rent)
    return p.select(
        "p_partkey", r(rate).alias("rate"), r(finance.monthly_cost(deposit, rent, cash, loan, yearly)).alias("cost"), r(finance.short_of(deposit, cash)).alias("short"),
        r(finance.converted_cost(deposit, rent, loan, yearly)).alias("converted"), finance.cheaper_side(rate, loan).alias("side"), r(finance.legal_conversion(loan)).alias("legal"),
        finance.side_thousands(F.floor(deposit), rent, cash, F.lit(423), F.lit(310)).cast("long").alias("thousands"))


@query("""WITH a AS (SELECT o_orderkey, o_orderdate::DATE AS day, (o_orderdate::DATE + (o_custkey % 400)::INT) AS until FROM orders)
SELECT o_orderkey, ((year(day) * 12 + month(day) + 13) // 12 * 100 + (year(day) * 12 + month(day) + 13) % 12 + 1)::INT AS later, (day - 183)::VARCHAR AS since,
  (SELECT count(*) FROM range(1, (until - day) + 1) g(k) WHERE isodow(day + k::INT) <= 5)::BIGINT AS weekdays, (until - day)::BIGINT AS days, strftime(day, '%y') || '.' || month(day) AS label,
  CASE WHEN make_date(year(until), month(day), least(day(day), 28)) <= until THEN make_date(year(until), month(day), least(day(day), 28)) ELSE make_date(year(until) - 1, month(day), least(day(day), 28)) END::VARCHAR AS latest FROM a
""")
def date_columns(spark: SparkSession, d: str) -> DataFrame:
    """Shifted months, windows, weekdays, labels, days written without a year."""
    day = F.col("o_orderdate").cast("date")
    until = F.date_add(day, F.pmod("o_custkey", F.lit(400)).cast("int"))
    short = F.concat(F.month(day), F.lit("/"), F.least(F.day(day), F.lit(28)))
    return t(spark, d, "orders").select(
        "o_orderkey", dates.shift_month(F.year(day) * 100 + F.month(day), 14).alias("later"), dates.window_start(day).cast("string").alias("since"),
        dates.weekdays_between(day, until).alias("weekdays"), dates.day_gap(day, until).alias("days"), dates.month_label(day).alias("label"), dates.full_date(short, until).cast("string").alias("latest"))


@query("""WITH a AS (SELECT event_id, ts, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y%m%d') WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN '20240231' ELSE 'x' END AS loose,
  CASE event_id % 3 WHEN 0 THEN strftime(ts, '%y.%m.%d') WHEN 1 THEN '24.02.30' ELSE '1.2.3' END AS short FROM events)
SELECT event_id, CASE WHEN event_id % 4 < 2 THEN ts::DATE END::VARCHAR AS loose_day, CASE WHEN event_id % 3 = 0 THEN ts::DATE END::VARCHAR AS short_day, (ts + INTERVAL 9 HOUR)::DATE::VARCHAR AS local_day,
  (make_date(year(ts), month(ts), 1) + (day(ts) + 9)::INT)::DATE::VARCHAR AS rolled FROM a
""")
def parsed_days(spark: SparkSession, d: str) -> DataFrame:
    """Days from several spellings, impossible ones null; a day beyond its month rolls on."""
    k = F.col("event_id")
    loose = F.when(k % 4 == 0, F.date_format("ts", "yyyyMMdd")).when(k % 4 == 1, F.date_format("ts", "yyyy-MM-dd")).when(k % 4 == 2, "20240231").otherwise("x")
    short = F.when(k % 3 == 0, F.date_format("ts", "yy.MM.dd")).when(k % 3 == 1, "24.02.30").otherwise("1.2.3")
    return t(spark, d, "events").select(
        "event_id", dates.loose_day(loose).cast("string").alias("loose_day"), numbers.short_date(short).cast("string").alias("short_day"),
        dates.local_day(F.col("ts")).cast("string").alias("local_day"), numbers.rolled_date(F.year("ts"), F.month("ts"), F.day("ts") + 10).cast("string").alias("rolled"))


@query("""WITH a AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS v FROM orders),
b AS (SELECT *, v // 10000 AS big, v % 10000 AS small FROM a)
SELECT o_orderkey, CASE WHEN big > 0 THEN big::VARCHAR || '억' || CASE WHEN small > 0 THEN ' ' ELSE '' END ELSE '' END || CASE WHEN small > 0 OR big = 0 THEN CASE WHEN small >= 1000 THEN (small // 1000)::VARCHAR || ',' || lpad((small % 1000)::VARCHAR, 3, '0') ELSE small::VARCHAR END || '만' ELSE '' END AS shown,
  (v * 10000)::DOUBLE AS read_back, CASE WHEN v % 200 - 100 > 0 THEN '+' ELSE '' END || (v % 200 - 100)::VARCHAR || '.0%' AS signed FROM b
""")
def amounts_shown_and_read(spark: SparkSession, d: str) -> DataFrame:
    """Amounts as Korean text, and read back from it."""
    v = F.floor("o_totalprice").cast("long")
    shown = text.eok_text(v)
    return t(spark, d, "orders").select("o_orderkey", shown.alias("shown"), text.korean_number(shown).alias("read_back"), text.signed_percent((v % 200 - 100).cast("double")).alias("signed"))


@query(r"""WITH s AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(63743), 'g'), chr(63743)), lambda x: trim(x, chr(32))), lambda x: x <> '') AS p FROM documents)
SELECT doc_id, len(p)::BIGINT AS sentences, len(list_filter(p, lambda x: NOT regexp_matches(x, 'Licen[sc]e|http')))::BIGINT AS kept,
  CASE WHEN contains(text, 'the') THEN 1 ELSE 0 END + CASE WHEN contains(text, 'tion') THEN 1 ELSE 0 END AS names FROM s
""")
def sentence_rules(spark: SparkSession, d: str) -> DataFrame:
    """Sentences, those without banned words, and how many of the given names a text has."""
    rows = t(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    parts = text.sentences(F.col("text"))
    return rows.select("doc_id", F.size(parts).cast("long").alias("sentences"), F.size(text.without_words(parts, "Licen[sc]e|http")).cast("long").alias("kept"), F.size(text.found_names(F.col("text"), ["the", "tion"])).alias("names"))


@query("""SELECT l_returnflag, round(corr(x, y), 6) AS spearman FROM (
  SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS x,
    rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2.0 AS y FROM lineitem) GROUP BY 1
""")
def rank_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Spearman's correlation with mean ranks of ties, from counts of values: no group is sorted row by row."""
    return stats.spearman(t(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_discount").select("l_returnflag", r(F.col("spearman"), 6).alias("spearman"))


@query("""WITH a AS (SELECT l_suppkey % 50 AS k, count(*) FILTER (WHERE l_returnflag = 'R')::DOUBLE AS x, count(*)::DOUBLE AS n, count(*) FILTER (WHERE l_returnflag = 'A')::DOUBLE AS y FROM lineitem GROUP BY 1),
w AS (SELECT *, 1.6448536269514722 AS z, x / n AS p1, y / n AS p2 FROM a),
i AS (SELECT *, (p1 + z * z / (2 * n)) / (1 + z * z / n) AS m1, z * sqrt(p1 * (1 - p1) / n + z * z / (4 * n * n)) / (1 + z * z / n) AS h1, (p2 + z * z / (2 * n)) / (1 + z * z / n) AS m2, z * sqrt(p2 * (1 - p2) / n + z * z / (4 * n * n)) / (1 + z * z / n) AS h2 FROM w)
SELECT k::BIGINT AS k, round(p1 - p2 - sqrt((p1 - (m1 - h1)) ** 2 + (m2 + h2 - p2) ** 2), 6) AS low, round(p1 - p2 + sqrt((m1 + h1 - p1) ** 2 + (p2 - (m2 - h2)) ** 2), 6) AS high FROM i
""")
def share_differences(spark: SparkSession, d: str) -> DataFrame:
    """Newcombe's interval of the difference of two shares."""
    a = t(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("k")).agg(F.count_if(F.col("l_returnflag") == "R").alias("x"), F.count_if(F.col("l_returnflag") == "A").alias("y"), F.count("*").alias("n"))
    low, high = stats.newcombe(F.col("x"), F.col("n"), F.col("y"), F.col("n"))
    return a.select("k", r(low, 6).alias("low"), r(high, 6).alias("high"))
