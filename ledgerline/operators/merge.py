"""Upserts, first and latest wins, multiset and row diffs, overlays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in order (dropDuplicates has no order)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """stored with fresh's rows in place of those with the same key; only fresh rows where `where` holds count.

    An anti-join keeps it to one shuffle of each side, and fresh may be broadcast where it is small.
    """
    fresh = fresh if where is None else fresh.where(where)
    return stored.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def insert_only(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """stored and the fresh rows whose key it lacks: what was written stays as it was."""
    return stored.unionByName(fresh.join(stored.select(*keys).distinct(), keys, "left_anti"))


def carry_forward(groups: DataFrame, fresh: DataFrame, previous: DataFrame, key: str, values: list[str], stamp: str = "updated_at") -> DataFrame:
    """A row per group: fresh values or else the previous ones; stale_at says since when they are carried."""
    f = fresh.select(key, *[F.col(v).alias(f"__f_{v}") for v in values], F.lit(True).alias("__fresh"))
    p = previous.select(key, *[F.col(v).alias(f"__p_{v}") for v in values], F.col(stamp).alias("__stamp"), F.col("stale_at").alias("__stale"))
    both = groups.select(key).distinct().join(f, key, "left").join(p, key, "left")
    new = F.coalesce(F.col("__fresh"), F.lit(False))
    own = [F.when(new, F.col(f"__f_{v}")).otherwise(F.col(f"__p_{v}")).alias(v) for v in values]
    return both.select(key, *own, F.when(~new, F.coalesce("__stale", "__stamp")).alias("stale_at"))


def numbered(df: DataFrame, keys: list[str], *order: Column, name: str = "__n") -> DataFrame:
    """df with the row's number among the rows of its key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def row_diff(stored: DataFrame, fetched: DataFrame, row_key: str, pair_keys: list[str], *order: Column) -> DataFrame:
    """(change, pair_keys, old, new): rows that went, came, or changed, as multisets.

    Rows with the same row_key cancel out one by one; what is left is paired by pair_keys in the given order, and
    pairs are `changed`, the rest `gone` or `appeared`.
    """
    def left_over(a: DataFrame, b: DataFrame) -> DataFrame:
        mine = numbered(a, [row_key], *order)
        theirs = b.groupBy(row_key).agg(F.count("*").alias("__theirs"))
        rest = mine.join(theirs, row_key, "left").where(F.col("__n") > F.coalesce("__theirs", F.lit(0))).drop("__n", "__theirs")
        return numbered(rest, pair_keys, *order)

    old = left_over(stored, fetched).select(*pair_keys, "__n", F.col(row_key).alias("old"))
    new = left_over(fetched, stored).select(*pair_keys, "__n", F.col(row_key).alias("new"))
    change = F.when(F.col("old").isNull(), "appeared").when(F.col("new").isNull(), "gone").otherwise("changed")
    return old.join(new, [*pair_keys, "__n"], "full").select(change.alias("change"), *pair_keys, "old", "new")


def apply_overlay(base: DataFrame, gone: DataFrame, appeared: DataFrame, row_key: str) -> DataFrame:
    """base without one copy per row of `gone` (by row_key), and the rows of `appeared`."""
    copies = gone.groupBy(row_key).agg(F.count("*").alias("__gone"))
    mine = numbered(base, [row_key], F.lit(1))
    kept = mine.join(copies, row_key, "left").where(F.col("__n") > F.coalesce("__gone", F.lit(0))).drop("__n", "__gone")
    return kept.unionByName(appeared)


def min_by_rank(seen: DataFrame, stamps: DataFrame, key: str, day: str) -> DataFrame:
    """Two multisets of days per key, joined by rank: the earlier day of each rank stays."""
    a, b = (numbered(x.select(key, day), [key], F.col(day)) for x in (seen, stamps))
    both = a.withColumnRenamed(day, "__a").join(b.withColumnRenamed(day, "__b"), [key, "__n"], "full")
    return both.select(key, F.least("__a", "__b").alias(day))


def split_by_match(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of left that have, and that lack, a row with the same keys in right; null keys are equal."""
    other = right.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"__{k}"]) for k in keys])
    return left.join(other, same, "left_semi"), left.join(other, same, "left_anti")
