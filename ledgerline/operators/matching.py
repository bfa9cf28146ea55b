"""Record linkage in tiers: rows of two registers are paired by ever looser keys, each row at most once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from . import ranks


@dataclass(frozen=True)
class Tier:
    """Rows alike in `keys` are paired, if no key is null or blank. `only`: only where each side has one row left with these keys."""

    name: str
    keys: tuple[str, ...]
    only: bool = False


def _keyed(df: DataFrame, tier: Tier) -> DataFrame:
    full = F.lit(True)
    for k in tier.keys:
        full = full & F.col(k).isNotNull() & (F.trim(F.col(k).cast("string")) != "")
    return df.where(full)


def _aligned(left: DataFrame, right: DataFrame, tier: Tier) -> DataFrame:
    """(__l, __r) of one tier: the k-th row of a block on the left with the k-th on the right, by id."""
    keys = list(tier.keys)
    a, b = _keyed(left, tier).select("__l", *keys), _keyed(right, tier).select("__r", *keys)
    if tier.only:
        one = lambda df, c: df.groupBy(*keys).agg(F.count("*").alias("__n"), F.min(c).alias(c)).where("__n = 1").drop("__n")
        return one(a, "__l").join(one(b, "__r"), keys).select("__l", "__r")
    a = ranks.gapless(a, keys, [F.col("__l")], "__k")
    b = ranks.gapless(b, keys, [F.col("__r")], "__k")
    return a.join(b, [*keys, "__k"]).select("__l", "__r")


def match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tiers: list[Tier]) -> DataFrame:
    """(left_id, right_id, tier) of the pairs: one-to-one, each pair by the first tier that makes it.

    Both sides have the tiers' key columns and distinct, non-null ids. Within a block of rows alike in a tier's keys the k-th
    left row (by id) goes to the k-th right one, so ties have one answer and a block of any size is two sorts and a join of
    equal ranks, never pairs; rows that a block has too many of go on to the next tier. A tier reads what earlier ones left.
    """
    cols = sorted({k for t in tiers for k in t.keys})
    a = checkpointed(left.select(F.col(left_id).alias("__l"), *cols))
    b = checkpointed(right.select(F.col(right_id).alias("__r"), *cols))
    found: DataFrame | None = None
    for tier in tiers:
        pairs = checkpointed(_aligned(a, b, tier).withColumn("tier", F.lit(tier.name)))
        found = pairs if found is None else found.unionByName(pairs)
        a = checkpointed(a.join(pairs.select("__l"), "__l", "left_anti"))
        b = checkpointed(b.join(pairs.select("__r"), "__r", "left_anti"))
    return found.select(F.col("__l").alias(left_id), F.col("__r").alias(right_id), "tier")


def match_rates(left: DataFrame, pairs: DataFrame, left_id: str, tiers: list[Tier], weight: Column | None = None) -> DataFrame:
    """(tier, rows, share, weight_share): how much of left each tier paired, by rows and by weight; tier `none` for the rest."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = left.select(left_id, w.alias("__w")).join(pairs.select(left_id, "tier"), left_id, "left")
    per = rows.groupBy(F.coalesce("tier", F.lit("none")).alias("tier")).agg(F.count("*").alias("rows"), F.sum("__w").alias("__w"))
    total = rows.agg(F.count("*").alias("__rows"), F.sum("__w").alias("__all"))  # one row
    return per.join(F.broadcast(total), F.lit(True)).select("tier", "rows", (F.col("rows") / F.col("__rows")).alias("share"), F.try_divide("__w", "__all").alias("weight_share"))
