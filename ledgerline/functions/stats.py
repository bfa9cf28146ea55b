"""Quantile rules, intervals of shares, weighted means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantile_r7(x: Column, q: float) -> Column:
    """Linear interpolation between order statistics."""
    return F.percentile(x, F.lit(q))


def quantile_floor(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """(keys, a column per quantile): sorted[min(n - 1, floor(n * q))] of the values of each group, nulls left out.

    Values are counted first; running counts say which value stands at a place, so no group is gathered.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    own = Window.partitionBy(*keys)
    upto = counts.withColumns({"__n": F.sum("__c").over(own), "__u": F.sum("__c").over(own.orderBy(value))})
    place = {name: F.least(F.col("__n") - 1, F.floor(F.col("__n") * F.lit(q))) for name, q in quantiles.items()}
    return upto.groupBy(*keys).agg(*[F.min(F.when(F.col("__u") > k, F.col(value))).alias(name) for name, k in place.items()])


def quantile_disc(x: str, q: float) -> Column:
    """The smallest value whose share of values at or below it is at least q."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {x})")


def median_whole(x: Column) -> Column:
    """The median, rounded half up."""
    return F.floor(F.median(x) + 0.5)


def weighted_mean(value: Column, weight: Column) -> Column:
    """Sum of value * weight over sum of weights, over rows that have both; null without weight."""
    both = value.isNotNull() & weight.isNotNull()
    total = F.sum(F.when(both, weight))
    return F.when(total > 0, F.sum(F.when(both, value * weight)) / total)


def share(hit: Column) -> Column:
    """count_if(hit) over rows where hit is known; null without any."""
    n = F.count(hit)
    return F.when(n > 0, F.count_if(hit) / n)


def suppressed(value: Column, n: Column, least: int) -> Column:
    """value where n reaches `least`, else null."""
    return F.when(n >= least, value)


def wilson(x: Column, n: Column, z: float = 1.6448536269514722) -> tuple[Column, Column]:
    """The Wilson interval of a share x / n (90 % by default); null for n = 0."""
    n = F.nullif(n, F.lit(0))
    p, zz = x / n, z * z
    mid = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return mid - half, mid + half


def newcombe(x1: Column, n1: Column, x2: Column, n2: Column, z: float = 1.6448536269514722) -> tuple[Column, Column]:
    """Newcombe's interval of the difference of two shares."""
    n1, n2 = F.nullif(n1, F.lit(0)), F.nullif(n2, F.lit(0))
    (l1, u1), (l2, u2) = wilson(x1, n1, z), wilson(x2, n2, z)
    p1, p2 = x1 / n1, x2 / n2
    d = p1 - p2
    return d - F.sqrt((p1 - l1) ** 2 + (u2 - p2) ** 2), d + F.sqrt((u1 - p1) ** 2 + (p2 - l2) ** 2)


def differs(x1: Column, n1: Column, x2: Column, n2: Column, errors: float = 2.0) -> Column:
    """Whether two shares differ by more than so many standard errors."""
    n1, n2 = F.nullif(n1, F.lit(0)), F.nullif(n2, F.lit(0))
    p1, p2 = x1 / n1, x2 / n2
    return F.abs(p1 - p2) > errors * F.sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2)


def percent_change(log_change: Column) -> Column:
    """A log change as a percentage."""
    return F.expm1(log_change) * 100


def mean_ranks(df: DataFrame, keys: list[str], value: str, rank: str) -> DataFrame:
    """(keys, value, rank): the mean rank of each value in its group, from the counts of values."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__c"))
    before = F.sum("__c").over(Window.partitionBy(*keys).orderBy(value)) - F.col("__c")
    return counts.select(*keys, value, (before + (F.col("__c") + 1) / 2).alias(rank))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, spearman): Pearson's correlation of mean ranks over rows that have both values."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.count("*").alias("__n"))
    whole = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = rows.join(mean_ranks(whole, keys, x, "__x"), [*keys, x]).join(mean_ranks(whole, keys, y, "__y"), [*keys, y])
    n, a, b = F.sum("__n"), F.col("__x"), F.col("__y")
    w = F.col("__n")
    top = n * F.sum(w * a * b) - F.sum(w * a) * F.sum(w * b)
    low = F.sqrt(n * F.sum(w * a * a) - F.sum(w * a) * F.sum(w * a)) * F.sqrt(n * F.sum(w * b * b) - F.sum(w * b) * F.sum(w * b))
    return rows.groupBy(*keys).agg(F.when(low > 0, top / low).alias("spearman"))
