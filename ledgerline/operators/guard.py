"""Verdicts on a received partition against what is stored, and the days that a hold has lasted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ingest_verdict(saved: Column, received: Column, total: Column, least: int = 20, drop: int = 10) -> Column:
    """accept, or why not: empty, mismatch, half, drop. Small saved partitions may shrink freely."""
    enough = F.coalesce(saved, F.lit(0)) >= least
    return (
        F.when((received == 0) & (F.coalesce(saved, F.lit(0)) > 0), "empty")
        .when(received != total, "mismatch")
        .when(enough & (received * 2 < saved), "half")
        .when(enough & (saved - received >= drop), "drop")
        .otherwise("accept")
    )


def holds(verdicts: DataFrame, slot: str, day: str, verdict: str = "verdict", hold_days: int = 3) -> DataFrame:
    """(slot, day, held, release): distinct days on which a slot was held up to each row since its last accept, and
    whether that exceeds hold_days."""
    from pyspark.sql import Window

    w = Window.partitionBy(slot).orderBy(day)
    runs = verdicts.withColumn("__run", F.sum((F.col(verdict) == "accept").cast("int")).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    days = runs.where(F.col(verdict) != "accept").groupBy(slot, "__run", day).agg(F.count("*").alias("__c"))
    held = F.row_number().over(Window.partitionBy(slot, "__run").orderBy(day)).cast("long")
    return days.withColumn("held", held).withColumn("release", F.col("held") > hold_days).select(slot, day, "held", "release")
