"""Partitioned raw records: slot files, catalogue, idempotent writes, windows over two time axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import row_hash

#: One slot file: a partition's metadata, its rows, and the first day each row was seen.
SLOT = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("district", T.StringType()), T.StructField("yearMonth", T.StringType()),
    T.StructField("ok", T.BooleanType()), T.StructField("resultCode", T.LongType()), T.StructField("count", T.LongType()), T.StructField("totalCount", T.LongType()),
    T.StructField("observedAt", T.TimestampType()), T.StructField("previousObservedAt", T.TimestampType()),
    T.StructField("arrivals", T.MapType(T.StringType(), T.StringType())), T.StructField("items", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
])


def read_slots(spark: SparkSession, *paths: str) -> DataFrame:
    """Slot files with an explicit schema; mixed text and number fields come as text. Broken files are null rows."""
    return spark.read.schema(SLOT).option("multiLine", True).option("mode", "PERMISSIVE").json(list(paths))


def catalogue(slots: DataFrame) -> DataFrame:
    """A row per slot: whether it is sound and complete."""
    return slots.select("kind", "district", "yearMonth", "ok", "count", "totalCount", (F.col("ok") & (F.col("count") == F.col("totalCount"))).alias("complete"))


def rows(slots: DataFrame) -> DataFrame:
    """A row per item with its place in the slot."""
    return slots.select("kind", "district", "yearMonth", F.posexplode("items").alias("ord", "item"))


def arrivals(slots: DataFrame) -> DataFrame:
    """(kind, district, yearMonth, row_key, day) of the first-seen stamps."""
    return slots.select("kind", "district", "yearMonth", F.explode("arrivals").alias("row_key", "day")).withColumn("day", F.to_date("day"))


def in_window(df: DataFrame, start: Column, end: Column, basis: str, contract: str = "contract_day", arrival: str = "first_seen") -> DataFrame:
    """Rows whose contract or arrival day lies in [start, end)."""
    day = F.col(contract if basis == "contract" else arrival)
    return df.where((day >= start) & (day < end))


def plan_fetch(wanted: DataFrame, slots: DataFrame, keys: list[str], now: Column, stale_days: int, quota: int) -> DataFrame:
    """(keys, state): slots to fetch now, missing and broken ones first; at most `quota`, the newest months first."""
    have = slots.select(*keys, "ok", "observedAt")
    age = F.datediff(now, F.to_date("observedAt"))
    state = F.when(F.col("ok").isNull(), "missing").when(~F.col("ok"), "broken").when(age >= stale_days, "stale").otherwise("frozen")
    rank = F.when(F.col("state") == "missing", 0).when(F.col("state") == "broken", 1).otherwise(2)
    todo = wanted.join(have, keys, "left").withColumn("state", state).where("state <> 'frozen'")
    return todo.orderBy(rank, *[F.desc(k) for k in reversed(keys)]).limit(quota).select(*keys, "state")


def content_digest(df: DataFrame, keys: list[str], ignore: tuple[str, ...] = ("observedAt",)) -> DataFrame:
    """(keys, digest, n): a digest of a partition's rows that neither order nor the ignored columns change.

    Row hashes are summed, so nothing is gathered: two 64-bit sums and the count stand for the multiset.
    """
    cols = sorted(c for c in df.columns if c not in (*keys, *ignore))
    a, b = F.xxhash64(*cols), F.xxhash64(F.lit(1), *cols)
    mod = F.lit(1 << 31)
    return df.groupBy(*keys).agg(F.concat_ws(":", F.sum(F.pmod(a, mod)), F.sum(F.pmod(b, mod)), F.bit_xor(a)).alias("digest"), F.count("*").alias("n"))


def changed_partitions(df: DataFrame, stored: DataFrame, keys: list[str], ignore: tuple[str, ...] = ("observedAt",)) -> DataFrame:
    """The partition keys whose content differs from what is stored."""
    new, old = content_digest(df, keys, ignore), content_digest(stored, keys, ignore).withColumnRenamed("digest", "old").drop("n")
    return new.join(old, keys, "left").where(~F.col("digest").eqNullSafe(F.col("old"))).select(*keys)


def write_changed(df: DataFrame, path: str, keys: list[str], stored: DataFrame | None = None) -> None:
    """Overwrite only the partitions whose content changed; others keep their files."""
    own = df if stored is None else df.join(changed_partitions(df, stored, keys), keys, "left_semi")
    own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def stamped(fetched: DataFrame, known: DataFrame, key: str, today: Column) -> DataFrame:
    """(key, day): known rows keep their day, others get today's."""
    fresh = fetched.select(key).distinct().join(known.select(key), key, "left_anti").withColumn("day", today)
    return known.select(key, "day").unionByName(fresh)


def line_key(line: Column) -> Column:
    """The key of a row: a hash of its literal line without a trailing comma."""
    return row_hash(F.regexp_replace(line, r",\s*$", ""))
