"""A report of eleven products, ranked parts of ranked groups, rules over texts and their hit rates, amounts and numbers in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import dates, text
from ..operators import reports, rules
from .common import t

M = reports.Measure

#: Section, table, row label, order of the lines, and (name, value, rows behind it or null for counts, least rows, digits), as SQL.
_SECTIONS = [
    (1, "lineitem", "strftime(date_trunc('week', l_shipdate), '%Y-%m-%d')", "1", [("lines", "count(*)", None, 0, 0), ("returned %", "avg((l_returnflag = 'R')::INT) * 100", "count(*)", 20, 1)]),
    (2, "lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey", "n_name", "1", [("unit price", "sum(l_extendedprice) / sum(l_quantity)", "count(*)", 30, 2), ("lines", "count(*)", None, 0, 0)]),
    (3, "part", "p_brand || ' / ' || p_type", "1", [("parts", "count(*)", None, 0, 0), ("median price", "median(p_retailprice)", "count(*)", 5, 2)]),
    (4, "lineitem", "l_returnflag || ' / ' || l_linestatus", "1", [("median quantity", "median(l_quantity)", "count(*)", 0, 1), ("largest", "max(l_extendedprice)", "count(*)", 0, 2)]),
    (5, "orders", "strftime(o_orderdate, '%Y-%m')", "1", [("orders", "count(*)", None, 0, 0), ("total", "sum(o_totalprice)", "count(*)", 10, 0)]),
    (6, "orders", "o_orderpriority", "1", [("open %", "avg((o_orderstatus = 'O')::INT) * 100", "count(*)", 0, 2), ("orders", "count(*)", None, 0, 0)]),
    (7, "customer", "c_mktsegment", "1", [("customers", "count(*)", None, 0, 0), ("mean balance", "avg(c_acctbal)", "count(*)", 0, 2)]),
    (8, "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", "r_name", "1", [("in debt %", "avg((c_acctbal < 0)::INT) * 100", "count(*)", 0, 1), ("median balance", "median(c_acctbal)", "count(*)", 0, 2)]),
    (9, "events", "event_type", "1", [("events", "count(*)", None, 0, 0), ("mean value", "avg(value)", "count(value)", 0, 3)]),
    (10, "documents", "coalesce(lang, '-') || ' / ' || coalesce(source, '-')", "1", [("documents", "count(*)", None, 0, 0), ("longest", "max(n_chars)", "count(n_chars)", 5, 0)]),
    (11, "supplier JOIN nation ON s_nationkey = n_nationkey", "n_name", "1", [("suppliers", "count(*)", None, 0, 0), ("best balance", "max(s_acctbal)", "count(*)", 4, 2)]),
]


def _cells_sql() -> str:
    """The cells of all sections, each value behind its threshold, as one UNION ALL."""
    out = []
    for number, table, row, _, measures in _SECTIONS:
        sums = ", ".join(f"({value})::DOUBLE AS v{k}, ({n or value})::BIGINT AS n{k}" for k, (_, value, n, _, _) in enumerate(measures))
        own = f"(SELECT *, row_number() OVER (ORDER BY r) AS line FROM (SELECT {row} AS r, {sums} FROM {table} GROUP BY 1))"
        for k, (name, _, _, least, digits) in enumerate(measures):
            keep = f"n{k} >= {max(reports.MIN_CELL, least)}"
            out.append(f"SELECT {number}::INT AS section, line::INT AS line, r AS row, {k + 1}::INT AS place, '{name}' AS \"column\", CASE WHEN {keep} THEN floor(v{k} * {10 ** digits} + 0.5) / {10 ** digits} END AS value, n{k} AS n FROM {own}")
    return " UNION ALL ".join(out)


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """The sections' cells. Their figures are written in SQL that both engines read, but for dates."""
    for name in ("lineitem", "supplier", "nation", "region", "part", "orders", "customer", "events", "documents"):
        t(spark, d, name).createOrReplaceTempView(f"__report_{name}")
    own = {"strftime(date_trunc('week', l_shipdate), '%Y-%m-%d')": dates.week_start(F.col("l_shipdate")).cast("string"), "strftime(o_orderdate, '%Y-%m')": F.date_format("o_orderdate", "yyyy-MM")}
    sections = []
    for number, table, row, _, measures in _SECTIONS:
        joined = " JOIN ".join(f"__report_{x}" for x in table.split(" JOIN "))
        rows = spark.sql(f"SELECT * FROM {joined}")
        label = own.get(row, F.expr(row))
        columns = [M(name, F.expr(value), n and F.expr(n), least, digits) for name, value, n, least, digits in measures]
        sections.append(reports.section(rows, number, [label], [], columns))
    return reports.report(sections)


@query(_cells_sql())
def monthly_report(spark: SparkSession, d: str) -> DataFrame:
    """Eleven products as one table of labelled cells; those with few rows behind them are blank."""
    return _cells(spark, d).select("section", "line", "row", "place", "column", "value", "n")


@query(f"SELECT section, count(*)::BIGINT AS cells, count(*) FILTER (WHERE value IS NULL)::BIGINT AS blank FROM ({_cells_sql()}) GROUP BY 1")
def report_blanks(spark: SparkSession, d: str) -> DataFrame:
    """How much of each section is suppressed."""
    return reports.blanks(_cells(spark, d))


@query("""WITH g AS (SELECT p_brand, count(*) AS n, min(p_size) AS least, max(p_size) AS most, floor(median(p_size)) AS middle FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 5),
k AS (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_name) AS k FROM part GROUP BY 1, 2)
SELECT row_number() OVER (ORDER BY n DESC, p_brand)::INT AS place, p_brand, n::BIGINT AS n, (SELECT string_agg(p_name, ', ' ORDER BY k.k) FROM k WHERE k.p_brand = g.p_brand AND k.k <= 3) AS names, least, most, middle::BIGINT AS middle FROM g""")
def leading_brands(spark: SparkSession, d: str) -> DataFrame:
    """The five brands with the most parts: their three most frequent names, sizes from to, and the middle one without its fraction."""
    size = F.col("p_size")
    out = reports.top_within_top(t(spark, d, "part"), "p_brand", "p_name", 5, 3, {"least": F.min(size), "most": F.max(size), "middle": F.floor(F.median(size))})
    return out.select("place", "p_brand", "n", F.array_join("parts", ", ").alias("names"), "least", "most", "middle")


@query("""WITH m AS (SELECT l_suppkey, year(l_shipdate) * 12 + month(l_shipdate) - 1 AS mi, CASE WHEN count(*) >= 3 THEN round(avg(l_extendedprice), 6) END AS v FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, max(mi)::INT AS mi, max_by(v, mi) AS v FROM m WHERE v IS NOT NULL AND mi BETWEEN 24014 AND 24018 GROUP BY 1""")
def latest_figures(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier's latest monthly mean that is at most four months old in July 2001; months of fewer than three lines have none."""
    m = t(spark, d, "lineitem").groupBy("l_suppkey", dates.month_index(F.col("l_shipdate")).alias("mi")).agg(F.when(F.count("*") >= 3, F.round(F.avg("l_extendedprice"), 6)).alias("v"))
    return reports.latest_point(m, ["l_suppkey"], "mi", "v", 2001 * 12 + 6, 4)


#: Rules over the documents' words; names and words are such as occur in them.
RULES = [
    rules.Rule("contact", r"@|https?:", without=r"example\.org"), rules.Rule("licence", r"(?i)licen[sc]e|copyright", signal=r"(?i)rights|permission|free", scoped=False),
    rules.Rule("numbers", r"[0-9]{3}", signal=r"[a-z]{4}", title_without=r"[0-9]"), rules.Rule("long words", r"[a-z]{12}", scoped=False),
]
NAMES, WHOLE, OTHER = ["und", "the", "les", "que"], "en", r"%%%|###"

_RULES = """WITH d AS (SELECT doc_id, coalesce(lang, '-') AS lang, text, split_part(text, chr(10), 1) AS title FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, list_filter(['und', 'the', 'les', 'que'], lambda x: contains(text, x)) AS f FROM d),
w AS (SELECT *, CASE WHEN NOT regexp_matches(text, '%%%|###') THEN CASE WHEN len(f) = 1 THEN f[1] WHEN contains(text, 'en') THEN 'en' END END AS sc FROM s),
h AS (SELECT doc_id, lang, title, sc, [CASE WHEN regexp_matches(text, '@|https?:') AND NOT regexp_matches(text, 'example\\.org') AND sc IS NOT NULL THEN 'contact' END,
  CASE WHEN regexp_matches(text, '(?i)licen[sc]e|copyright') AND regexp_matches(text, '(?i)rights|permission|free') THEN 'licence' END,
  CASE WHEN regexp_matches(text, '[0-9]{3}') AND regexp_matches(text, '[a-z]{4}') AND NOT regexp_matches(title, '[0-9]') AND sc IS NOT NULL THEN 'numbers' END,
  CASE WHEN regexp_matches(text, '[a-z]{12}') THEN 'long words' END] AS a FROM w),
r AS (SELECT doc_id, lang, title, sc, list_filter(a, lambda x: x IS NOT NULL)[1:2] AS hits FROM h)"""


def _ruled(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.coalesce("lang", F.lit("-")).alias("lang"), "text", F.substring_index("text", "\n", 1).alias("title"))
    where = rules.scope(F.col("text"), NAMES, WHOLE, OTHER)
    return docs.withColumn("hits", rules.hits(F.col("title"), F.col("text"), RULES, where)).drop("text")


@query(_RULES + """, a AS (SELECT lang AS scope, count(*) AS value FROM documents GROUP BY 1), z AS (SELECT doc_id, unnest(hits) AS rule, sc FROM r)
SELECT doc_id, rule, CASE WHEN rule IN ('contact', 'numbers') THEN sc END AS scope, (length(rule) + length(coalesce(CASE WHEN rule IN ('contact', 'numbers') THEN sc END, '')))::BIGINT AS value FROM z
WHERE NOT (rule = 'numbers' AND sc = 'que')""")
def answers_by_rule(spark: SparkSession, d: str) -> DataFrame:
    """The first two rules that hit each document, with the figure that answers them in their scope; one scope has no figure."""
    found = _ruled(spark, d)
    scopes = F.explode(F.array(*map(F.lit, [*NAMES, WHOLE]))).alias("scope")
    scoped = spark.createDataFrame([(x.name,) for x in RULES if x.scoped], "rule string").select("rule", scopes)
    plain = spark.createDataFrame([(x.name, None) for x in RULES if not x.scoped], "rule string, scope string")
    figures = scoped.unionByName(plain).withColumn("value", (F.char_length("rule") + F.coalesce(F.char_length("scope"), F.lit(0))).cast("long"))
    figures = figures.withColumn("value", F.when(~((F.col("rule") == "numbers") & F.col("scope").eqNullSafe(F.lit("que"))), F.col("value")))
    return rules.answered(found.select("doc_id", "hits"), "hits", figures).select("doc_id", "rule", "scope", "value")


@query(_RULES + "SELECT lang, count(*)::BIGINT AS texts, count(*) FILTER (WHERE len(hits) > 0)::BIGINT AS hit, floor(count(*) FILTER (WHERE len(hits) > 0) / count(*) * 100 + 0.5)::INT AS rate, count(DISTINCT title)::BIGINT AS titles, count(DISTINCT CASE WHEN len(hits) > 0 THEN title END)::BIGINT AS titles_hit FROM r GROUP BY 1")
def rule_hit_rates(spark: SparkSession, d: str) -> DataFrame:
    """How many documents of each language at least one rule hits."""
    return rules.hit_rates(_ruled(spark, d), ["lang"], "hits", "title")


@query(_RULES + ", z AS (SELECT title, unnest(hits) AS rule FROM r) SELECT rule, count(*)::BIGINT AS texts, count(DISTINCT title)::BIGINT AS titles FROM z GROUP BY 1")
def hits_by_rule(spark: SparkSession, d: str) -> DataFrame:
    """How many documents and titles each rule hits."""
    return rules.by_rule(_ruled(spark, d), "hits", "title")


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 9 + 1 AS a, o_orderkey % 90 + 10 AS b, o_orderkey % 5 AS f FROM orders)
SELECT k, CASE f WHEN 0 THEN a || '월에 ' || format('{:,}', a * 1000000000000 + (a * 1000 + b) * 100000000) || '원' WHEN 1 THEN '약 ' || format('{:,}', a * 1000000) || '원, ' || b || '명' WHEN 2 THEN format('{:,}', b * 100000000 + a * 10000000) || '원과 ' || format('{:,}', (a * 10 + 5) * 10000) || '원'
  WHEN 3 THEN b || '년 ' || a || '%만' ELSE format('{:,}', a * 100000000 + b * 1000000) || ' 5000' END AS shown FROM o""")
def amounts_in_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts with amounts in Korean words, the amounts as numbers: 조, 억, 만 with 천, 백, 십; years, shares and bare numbers stay."""
    a, b = (F.col("o_orderkey") % 9 + 1).cast("string"), (F.col("o_orderkey") % 90 + 10).cast("string")
    k = F.col("o_orderkey") % 5
    line = (F.when(k == 0, F.concat(a, F.lit("월에 "), a, F.lit("조 "), a, F.lit("천"), b, F.lit("억원"))).when(k == 1, F.concat(F.lit("약 "), a, F.lit("백만원, "), b, F.lit("명")))
            .when(k == 2, F.concat(b, F.lit("억"), a, F.lit("000만원과 "), a, F.lit("십5만원"))).when(k == 3, F.concat(b, F.lit("년 "), a, F.lit("%만")))
            .otherwise(F.concat(a, F.lit("억 "), b, F.lit("백만 5000"))))
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), text.normalised_amounts(line).alias("shown"))


@query(r"""WITH s AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), b AS (SELECT *, left(text, length(text) // 2) AS h FROM s),
n AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[0-9][0-9,.]*'), lambda x: NOT contains(h, x)) AS l, len(regexp_extract_all(text, '[0-9][0-9,.]*')) AS n FROM b)
SELECT doc_id, n::INT AS numbers, array_to_string(l, ' ') AS unverified FROM n""")
def unverified_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of a document that its first half does not contain."""
    docs = t(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    half = F.expr("left(text, char_length(text) div 2)")
    return docs.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"(\d[\d,.]*)"))).alias("numbers"), F.array_join(text.unverified_numbers(F.col("text"), half), " ").alias("unverified"))


@query("""SELECT p_brand, p_name, p_size, n::BIGINT AS n, middle, (row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, middle, p_name, p_size))::INT AS place FROM (
  SELECT p_brand, p_name, p_size, count(*) AS n, round(median(p_retailprice), 4) AS middle FROM part GROUP BY 1, 2, 3) WHERE middle >= 930 AND middle < 970""")
def candidates_in_band(spark: SparkSession, d: str) -> DataFrame:
    """Cells of a file per brand, as it is stored (maps of maps by name and size), flattened; those whose middle price lies in a band, the most
    traded first, then the cheapest, then by name."""
    cells = t(spark, d, "part").groupBy("p_brand", "p_name", "p_size").agg(F.struct(F.count("*").alias("n"), F.round(F.median("p_retailprice"), 4).alias("middle")).alias("c"))
    by_size = cells.groupBy("p_brand", "p_name").agg(F.map_from_entries(F.collect_list(F.struct("p_size", "c"))).alias("sizes"))  # fifty sizes at most
    files = by_size.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("p_name", "sizes"))).alias("cells"))  # names of a brand, a file's content
    return reports.in_band(files, "p_brand", "cells", ["p_name", "p_size"], 930, 970)


@query("""WITH s AS (SELECT p_brand, p_name, median(l_extendedprice / l_quantity) AS sale, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'F' GROUP BY 1, 2),
r AS (SELECT p_brand, p_name, median(l_extendedprice / l_quantity) AS rent, count(*) AS m FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'O' GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT p_brand, p_name, n::BIGINT AS n, round(sale, 6) AS sale, m::BIGINT AS m, round(rent, 6) AS rent, round(rent / sale * 100, 4) AS ratio FROM s LEFT JOIN r USING (p_brand, p_name)""")
def attached_columns(spark: SparkSession, d: str) -> DataFrame:
    """A table of one kind of deals with the other kind's columns of the same cell beside it, where that has three rows."""
    line = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("unit", F.col("l_extendedprice") / F.col("l_quantity"))
    side = lambda s, v, n: line.where(F.col("l_linestatus") == s).groupBy("p_brand", "p_name").agg(F.median("unit").alias(v), F.count("*").alias(n))
    both = side("F", "sale", "n").join(side("O", "rent", "m").where("m >= 3"), ["p_brand", "p_name"], "left")
    return both.select("p_brand", "p_name", "n", F.round("sale", 6).alias("sale"), "m", F.round("rent", 6).alias("rent"), F.round(F.col("rent") / F.col("sale") * 100, 4).alias("ratio"))
