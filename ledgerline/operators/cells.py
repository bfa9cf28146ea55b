"""Same-cell change, chained months, target against control, greedy grouping, merging of small cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same_cell_change(df: DataFrame, cell: list[str], group: list[str], base: Column, recent: Column, value: str, least: int = 1) -> DataFrame:
    """(group, cells, change): median over cells of ln(recent median / base median); null below `least` cells.

    Cells that miss a period drop out. One shuffle by cell and one by group.
    """
    sides = df.where(base | recent).groupBy(*group, *cell).agg(F.median(F.when(base, F.col(value))).alias("b"), F.median(F.when(recent, F.col(value))).alias("r"))
    per = sides.where("b > 0 AND r > 0").groupBy(*group).agg(F.count("*").alias("cells"), F.median(F.ln(F.col("r") / F.col("b"))).alias("__change"))
    return per.withColumn("change", F.when(F.col("cells") >= least, F.col("__change"))).drop("__change")


def cell_ratio(df: DataFrame, cell: list[str], target: Column, control: Column, value: str, least_control: int = 3, most: float | None = None) -> DataFrame:
    """(cell, n_target, n_control, ratio): percent by which the targets' median exceeds the controls'."""
    per = df.groupBy(*cell).agg(F.count_if(target).alias("n_target"), F.count_if(control).alias("n_control"), F.median(F.when(target, F.col(value))).alias("__t"), F.median(F.when(control, F.col(value))).alias("__c"))
    out = per.where((F.col("n_target") > 0) & (F.col("n_control") >= least_control) & (F.col("__c") > 0)).withColumn("ratio", (F.col("__t") / F.col("__c") - 1) * 100).drop("__t", "__c")
    return out if most is None else out.where(F.abs("ratio") <= most)


def chain_changes(df: DataFrame, cell: list[str], index: str, value: str, least: int = 1) -> DataFrame:
    """(index, pairs, change): median over cells of the log change from the month just before."""
    monthly = df.groupBy(*cell, index).agg(F.median(value).alias("m"))
    w = Window.partitionBy(*cell).orderBy(index)
    pairs = monthly.withColumn("p", F.when(F.col(index) - F.lag(index).over(w) == 1, F.lag("m").over(w))).where("p > 0 AND m > 0")
    per = pairs.groupBy(index).agg(F.count("*").alias("pairs"), F.median(F.ln(F.col("m") / F.col("p"))).alias("__c"))
    return per.withColumn("change", F.when(F.col("pairs") >= least, F.col("__c"))).drop("__c")


def chain_index(changes: DataFrame, index: str, start: float = 100.0) -> DataFrame:
    """changes (one row per month) with `level`: start times the product of changes so far."""
    return changes.withColumn("level", F.lit(start) * F.exp(F.sum("change").over(Window.orderBy(index))))


def greedy_groups(df: DataFrame, keys: list[str], value: str, width: float) -> DataFrame:
    """(keys, value, label): values in ascending groups; one opens a group if it lies at least `width` above the
    group's first. The label is the group's most frequent value, ties the smallest.

    Only the distinct values of a key are gathered, folded in order by a built-in aggregate.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    values = counts.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("__v"))
    start = F.array().cast("array<double>")
    firsts = F.aggregate("__v", start, lambda acc, v: F.when((F.size(acc) == 0) | (v - F.element_at(acc, -1) >= width), F.array_append(acc, v.cast("double"))).otherwise(acc))
    groups = values.withColumn("__first", firsts).select(*keys, F.explode("__v").alias(value), "__first")
    named = groups.withColumn("__group", F.array_max(F.filter("__first", lambda f: f <= F.col(value)))).drop("__first")
    full = named.join(counts, [*keys, value])
    label = F.first(value).over(Window.partitionBy(*keys, "__group").orderBy(F.desc("__n"), value))
    return full.withColumn("label", label).select(*keys, value, "label")


def merged_small(df: DataFrame, group: list[str], member: str, size: str, least: int, other: str = "other") -> DataFrame:
    """(group, member, size, members): members below `least` go to `other`, with the next smallest ones as long as
    `other` has one member or too small a size; `other` is suppressed (size null) if it stays too small.

    Members are ranked by size within the group; running sums say which are merged.
    """
    w = Window.partitionBy(*group).orderBy(size, member)
    run = df.withColumns({"__sum": F.sum(size).over(w), "__n": F.row_number().over(w), "__small": F.count_if(F.col(size) < least).over(Window.partitionBy(*group))})
    before = F.coalesce(F.lag("__sum").over(w), F.lit(0))
    pooled = (F.col("__small") > 0) & ((F.col(size) < least) | (F.col("__n") <= 2) | (before < least))
    named = run.withColumn("__name", F.when(pooled, other).otherwise(F.col(member)))
    out = named.groupBy(*group, F.col("__name").alias(member)).agg(F.sum(size).alias(size), F.count("*").alias("members"))
    hide = (F.col(member) == other) & ((F.col(size) < least) | (F.col("members") < 2))
    return out.withColumn(size, F.when(~hide, F.col(size)))
