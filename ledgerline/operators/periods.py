"""Which window or pair of periods a figure is made from, by what the data have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_up


def window_basis(weeks: DataFrame, keys: list[str], covered: str, groups: Column | int, kinds: dict[str, str], least: int) -> DataFrame:
    """weeks with `need`, `short` (the kinds with fewer than `least` rows, in order) and `basis`: `arrival` if at least half of the groups are covered
    and no kind is short, else `contract`. kinds: names by column of counts; a null count is none."""
    total = groups if isinstance(groups, Column) else F.lit(groups)
    need = F.ceil(total / 2).cast("long")
    short = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit(0)) < least, name) for c, name in kinds.items()]))
    out = weeks.withColumns({"need": need, "short": short})
    return out.withColumn("basis", F.when((F.coalesce(F.col(covered), F.lit(0)) >= F.col("need")) & (F.size("short") == 0), "arrival").otherwise("contract"))


def period_pairs(months: Column, recent_end: Column, size: int = 3) -> Column:
    """struct<base, recent, gap> of month indexes: the `size` months that end with recent_end, and the same a year before if `months` (an
    array) has them all, else its earliest ones before the recent period; null if there are fewer. gap: months between the middles."""
    recent = F.sequence(recent_end - (size - 1), recent_end)
    ago = F.transform(recent, lambda m: m - 12)
    have = F.array_distinct(F.filter(months, lambda m: m.isNotNull()))
    early = F.slice(F.array_sort(F.filter(have, lambda m: m < recent_end - (size - 1))), 1, size)
    whole = F.size(F.array_except(ago, have)) == 0
    mid = size // 2
    base = F.when(whole, ago).when(F.size(early) == size, early)
    return F.when(base.isNotNull(), F.struct(base.alias("base"), recent.alias("recent"), (recent[mid] - base[mid]).alias("gap")))


def latest_dominance(df: DataFrame, keys: list[str], month: str, registered: Column, mature_share: float = 0.8, most: float = 0.5) -> DataFrame:
    """(keys, months, stale, latest, share_of_stale, share_without): over the months of which at least mature_share is registered, the rows that
    are not. If the latest such month holds more than `most` of them and others have rows, their shares with and without it (in percent,
    one digit); else null. Groups without a mature month are left out."""
    per = df.groupBy(*keys, month).agg(F.count("*").alias("n"), F.count_if(registered).alias("reg"))
    mature = per.where(F.col("reg") / F.col("n") >= mature_share).withColumn("stale", F.col("n") - F.col("reg"))
    one = mature.groupBy(*keys).agg(
        F.count("*").alias("months"), F.sum("stale").alias("stale"), F.sum("n").alias("__n"), F.max_by("stale", month).alias("__ls"), F.max_by("n", month).alias("__ln"), F.max(month).alias("__latest"))
    rest = F.col("__n") - F.col("__ln")
    dominated = (F.col("stale") > 0) & (F.col("__ls") / F.nullif(F.col("stale"), F.lit(0)) > most) & (rest > 0)
    return one.select(
        *keys, "months", "stale", F.when(dominated, F.col("__latest")).alias("latest"), F.when(dominated, half_up(F.col("__ls") / F.nullif(F.col("stale"), F.lit(0)) * 100, 1)).alias("share_of_stale"),
        F.when(dominated, half_up((F.col("stale") - F.col("__ls")) / F.nullif(rest, F.lit(0)) * 100, 1)).alias("share_without"))


def month_lines(pairs: DataFrame, group: str, month: str, rate: str, groups: DataFrame, first: int, last: int, least: int, partial: int = 2, all_: str = "all") -> DataFrame:
    """(group, month, rate, pairs, partial) for every group of `groups` and for all_ together, every month from first to last: the median rate where
    there are `least` pairs, the number of pairs (0 for none), and whether the month is one of the last `partial`. No month or group is
    missing."""
    inside = pairs.where(F.col(month).between(first, last))
    each = inside.select(F.explode(F.array(F.col(group), F.lit(all_))).alias(group), month, rate)
    per = each.groupBy(group, month).agg(F.count(rate).alias("pairs"), F.median(rate).alias("__m"))
    names = groups.select(F.col(group).cast("string").alias(group)).where(F.col(group).isNotNull()).distinct()
    grid = names.unionByName(groups.sparkSession.range(1).select(F.lit(all_).alias(group))).select(group, F.explode(F.sequence(F.lit(first), F.lit(last))).alias(month))
    both = grid.join(per, [group, month], "left")
    n = F.coalesce("pairs", F.lit(0).cast("long"))
    return both.select(group, month, F.when(n >= least, half_up(F.col("__m"), 2)).alias("rate"), n.alias("pairs"), (F.col(month) > last - partial).alias("partial"))
