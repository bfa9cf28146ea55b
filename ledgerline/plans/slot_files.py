"""Lines as slots of (line status, supplier's nation, ship month), written and read by the slot source."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..session import checkpoint_dir, ship
from ..sources import slot_source
from .common import t

_LINES = """WITH l AS (SELECT l_linestatus AS kind, lpad(s_nationkey::VARCHAR, 5, '0') AS district, strftime(l_shipdate, '%Y%m') AS "yearMonth", l_extendedprice AS amount, l_returnflag = 'R' AS gone
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""
#: The day the plan is made on.
NOW = "2001-06-02"


def _stored(spark: SparkSession, d: str) -> str:
    """A folder with the slots of all lines. Returned lines count as cancelled."""
    supplier = t(spark, d, "supplier").select("s_suppkey", F.lpad(F.col("s_nationkey").cast("string"), 5, "0").alias("district"))
    lines = t(spark, d, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    item = F.create_map(
        F.lit("key"), F.concat_ws("-", "l_orderkey", "l_linenumber"), F.lit("amount"), F.col("l_extendedprice").cast("string"),
        F.lit("cdealType"), F.when(F.col("l_returnflag") == "R", "O").otherwise(""))
    rows = lines.select(F.col("l_linestatus").alias("kind"), "district", F.date_format("l_shipdate", "yyyyMM").alias("yearMonth"), item.alias("item"))
    root = f"{checkpoint_dir(ship(spark))}/slots-{uuid.uuid4().hex}"
    slot_source.write_slots(rows, root, "2001-12-01T00:00:00")
    return root


@query(_LINES + """SELECT kind, district, "yearMonth", 'ok' AS state, count(*)::BIGINT AS n, count(*) FILTER (WHERE gone)::BIGINT AS cancelled, round(sum(amount), 2) AS amount FROM l GROUP BY 1, 2, 3""")
def slot_scan(spark: SparkSession, d: str) -> DataFrame:
    """All slots as written and read back: their state, rows, cancelled rows and amounts."""
    root = _stored(spark, d)
    items = slot_source.read_items(spark, root, ("kind", "district", "yearMonth", "item")).groupBy("kind", "district", "yearMonth").agg(F.round(F.sum(F.col("item")["amount"].cast("double")), 2).alias("amount"))
    slots = slot_source.read_catalogue(spark, root, ("kind", "district", "yearMonth", "state", "count", "cancelled")).select("kind", "district", "yearMonth", "state", F.col("count").alias("n"), "cancelled")
    return slots.join(items, ["kind", "district", "yearMonth"])


@query(_LINES + """SELECT district, "yearMonth", count(*)::BIGINT AS n, round(sum(amount), 2) AS amount FROM l WHERE kind = 'O' AND "yearMonth" >= '199907' AND "yearMonth" < '200107' AND NOT gone GROUP BY 1, 2""")
def slot_window_scan(spark: SparkSession, d: str) -> DataFrame:
    """Live rows of a kind in a window of 24 months; only files of that kind and window are opened."""
    items = slot_source.read_items(spark, _stored(spark, d), ("kind", "district", "yearMonth", "item", "cancelled")).where("kind = 'O' AND yearMonth >= '199907' AND yearMonth < '200107' AND NOT cancelled")
    return items.groupBy("district", "yearMonth").agg(F.count("*").alias("n"), F.round(F.sum(F.col("item")["amount"].cast("double")), 2).alias("amount"))


@query(_LINES + f""",
w AS (SELECT strftime(DATE '2001-06-01' - to_months(k::INT), '%Y%m') AS "yearMonth", k < 3 AS again FROM (SELECT unnest(range(24)) AS k)),
p AS (SELECT kind, lpad(n_nationkey::VARCHAR, 5, '0') AS district, "yearMonth", again FROM nation, (SELECT DISTINCT kind FROM l), w),
h AS (SELECT DISTINCT kind, district, "yearMonth", TRUE AS have FROM l)
SELECT kind, district, "yearMonth", CASE WHEN again IS NULL THEN 'expired' WHEN have IS NULL THEN 'missing' WHEN again THEN 'stale' ELSE 'frozen' END AS state FROM p FULL JOIN h USING (kind, district, "yearMonth")
-- as of {NOW}
""")
def slot_fetch_plan(spark: SparkSession, d: str) -> DataFrame:
    """What to do with each slot of 24 months and with what is stored beyond them."""
    stored = slot_source.read_catalogue(spark, _stored(spark, d), ("kind", "district", "yearMonth", "state"))
    nations = t(spark, d, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("district"))
    kinds = t(spark, d, "lineitem").agg(F.collect_set("l_linestatus").alias("k"))  # two kinds
    wanted = nations.join(F.broadcast(kinds), F.lit(True)).select(F.explode("k").alias("kind"), "district")
    return slot_source.plan(stored, wanted, F.lit(NOW).cast("date"), 24)
