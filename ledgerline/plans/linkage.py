"""Names in texts, registers paired in tiers, and gapless orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import entities, matching, ranks
from ..session import ship
from .common import t

_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_MENTIONS = f"""WITH RECURSIVE b AS (SELECT item_id, string_split_regex(translate(coalesce(text, ''), {_UPPER}), '[^a-z]+') AS ws FROM benchmark),
n0 AS (SELECT item_id, unnest(ws) AS w, unnest(range(len(ws))) AS k FROM b), n1 AS (SELECT item_id, w FROM n0 WHERE length(w) >= 6 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY length(w) DESC, k) = 1),
n AS (SELECT min(item_id) AS entity, w FROM n1 GROUP BY w),
d AS (SELECT doc_id, translate(coalesce(text, ''), {_UPPER}) AS s FROM documents),
m0 AS (SELECT doc_id, entity, length(w) AS len, unnest(list_filter(range(length(s) - length(w) + 1), lambda i: substring(s, i::BIGINT + 1, length(w)) = w)) AS i FROM d JOIN n ON contains(s, w)),
m AS (SELECT doc_id, i AS start, i + len AS stop, entity, row_number() OVER (PARTITION BY doc_id ORDER BY i, len DESC, entity) AS k FROM m0),
c AS (SELECT doc_id, start, stop, entity, k FROM m WHERE k = 1
  UNION ALL
  SELECT m.doc_id, m.start, m.stop, m.entity, m.k FROM c JOIN m ON m.doc_id = c.doc_id AND m.start >= c.stop WHERE m.k = (SELECT min(z.k) FROM m z WHERE z.doc_id = c.doc_id AND z.start >= c.stop))"""


def _names(spark: SparkSession, d: str) -> DataFrame:
    """(entity, name): the longest word of each benchmark item, of six letters at least."""
    words = F.split(entities.folded(F.col("text")), "[^a-z]+")
    own = t(spark, d, "benchmark").select(F.col("item_id").alias("entity"), F.posexplode(words).alias("k", "name")).where(F.char_length("name") >= 6)
    return own.groupBy("entity").agg(F.min_by("name", F.struct(-F.char_length("name"), "k")).alias("name"))


def _found(spark: SparkSession, d: str) -> DataFrame:
    return entities.mentions(t(ship(spark), d, "documents").select("doc_id", "text"), _names(spark, d))


@query(_MENTIONS + "SELECT doc_id, start::INT AS start, stop::INT AS stop, entity FROM c")
def names_in_texts(spark: SparkSession, d: str) -> DataFrame:
    """Where documents name the benchmark's longest words: the longest names from left to right."""
    return _found(spark, d).select("doc_id", F.explode("mentions").alias("m")).select("doc_id", "m.start", F.col("m.end").alias("stop"), "m.entity")


@query(_MENTIONS + """,
s AS (SELECT doc_id, count(DISTINCT entity) AS n, max(entity) AS one, max(entity % 7 = 0) AS abroad, count(*) AS c FROM c GROUP BY 1)
SELECT documents.doc_id, coalesce(c, 0)::INT AS mentions, CASE WHEN n = 1 AND NOT abroad THEN one END AS about FROM documents LEFT JOIN s ON documents.doc_id = s.doc_id""")
def text_scopes(spark: SparkSession, d: str) -> DataFrame:
    """The one entity that a document is about, if it names no other and none of those out of scope (every seventh)."""
    foreign = t(spark, d, "benchmark").where("item_id % 7 = 0").agg(F.collect_set("item_id").alias("out"))
    # ids of the benchmark's items only; a row that the planner sends as its size allows
    both = _found(spark, d).withColumn("__one", F.lit(1)).join(foreign.withColumn("__one", F.lit(1)), "__one")
    return both.select("doc_id", F.size("mentions").alias("mentions"), entities.scope(F.col("mentions"), F.col("out")).alias("about"))


_TIERS = [
    matching.Tier("lot and name", ("place", "lot", "name")), matching.Tier("lot", ("place", "lot")), matching.Tier("main lot and name", ("place", "main", "name")),
    matching.Tier("name", ("place", "name")), matching.Tier("only name", ("name",), only=True),
]

#: The SQL of one tier: what is left on both sides, paired by rank within equal keys.
_STEP = """,
a{n} AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY l) AS k, count(*) OVER (PARTITION BY {k}) AS c FROM l{p}),
b{n} AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY r) AS k, count(*) OVER (PARTITION BY {k}) AS c FROM r{p}),
p{n} AS (SELECT l, r, '{t}' AS tier FROM a{n} JOIN b{n} USING ({k}, k) WHERE {only}),
l{n} AS (SELECT * FROM l{p} ANTI JOIN p{n} USING (l)), r{n} AS (SELECT * FROM r{p} ANTI JOIN p{n} USING (r))"""
_MATCH = """WITH l0 AS (SELECT p_partkey AS l, p_brand AS place, (p_partkey % 97)::VARCHAR || '-' || p_size AS lot, (p_partkey % 97)::VARCHAR AS main, p_name AS name FROM part WHERE p_partkey % 2 = 0),
r0 AS (SELECT p_partkey AS r, p_brand AS place, ((p_partkey - 1) % 97)::VARCHAR || '-' || p_size AS lot, ((p_partkey - 1) % 97)::VARCHAR AS main, p_name AS name FROM part WHERE p_partkey % 2 = 1)""" + "".join(
    _STEP.format(n=n, p=n - 1, k=", ".join(x.keys), t=x.name, only="a{0}.c = 1 AND b{0}.c = 1".format(n) if x.only else "TRUE") for n, x in enumerate(_TIERS, 1))
_PAIRS = " UNION ALL ".join(f"SELECT * FROM p{n}" for n in range(1, len(_TIERS) + 1))


def _registers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Parts with even and with odd keys as two registers of the same places, lots and names."""
    def side(odd: int, name: str) -> DataFrame:
        main = ((F.col("p_partkey") - odd) % 97).cast("string")
        rows = t(spark, d, "part").where(F.col("p_partkey") % 2 == odd)
        return rows.select(F.col("p_partkey").alias(name), F.col("p_brand").alias("place"), F.concat_ws("-", main, F.col("p_size")).alias("lot"), main.alias("main"), F.col("p_name").alias("name"))

    return side(0, "l"), side(1, "r")


@query(_MATCH + f"SELECT l, r, tier FROM ({_PAIRS})")
def registers_matched(spark: SparkSession, d: str) -> DataFrame:
    """Two registers paired one to one: by lot and name, by lot, by main lot and name, by name in a place, by a name that is unique."""
    return matching.match(*_registers(spark, d), "l", "r", _TIERS)


@query(_MATCH + f""", m AS ({_PAIRS}), x AS (SELECT coalesce(tier, 'none') AS tier, length(name) AS w FROM l0 LEFT JOIN m USING (l))
SELECT tier, count(*)::BIGINT AS rows, round(count(*) / (SELECT count(*) FROM x), 6) AS share, round(sum(w) / (SELECT sum(w) FROM x), 6) AS weight_share FROM x GROUP BY 1""")
def match_rates(spark: SparkSession, d: str) -> DataFrame:
    """How much of a register each tier paired, by rows and by a weight."""
    left, right = _registers(spark, d)
    pairs = matching.match(left, right, "l", "r", _TIERS)
    rates = matching.match_rates(left, pairs, "l", _TIERS, F.char_length("name"))
    return rates.select("tier", "rows", F.round("share", 6).alias("share"), F.round("weight_share", 6).alias("weight_share"))


@query("""SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC NULLS LAST, s_name, s_suppkey)::BIGINT AS place, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC NULLS LAST, s_name, s_suppkey)::BIGINT AS in_nation FROM supplier""")
def places_by_balance(spark: SparkSession, d: str) -> DataFrame:
    """Every supplier's place by balance, over all and within its nation, without a task that sorts all."""
    order = [F.desc_nulls_last("s_acctbal"), F.col("s_name"), F.col("s_suppkey")]
    own = ranks.gapless(t(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), [], order, "place")
    return ranks.gapless(own, ["s_nationkey"], order, "in_nation").select("s_suppkey", "place", "in_nation")


@query()
def seeded_targets(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (part, supplier) targets of all lines in a seeded order."""
    return ranks.seeded_ranks(t(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct(), ["l_partkey", "l_suppkey"], 20261001)
