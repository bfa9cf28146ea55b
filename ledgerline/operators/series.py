"""Monthly and weekly series: frames over a period index, runs, differences, calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trailing(keys: list[str], index: str, n: int):
    """The frame of the n periods that end with the row's; absent periods leave it smaller."""
    return Window.partitionBy(*keys).orderBy(index).rangeBetween(-(n - 1), 0)


def full_sum(value: Column, keys: list[str], index: str, n: int) -> Column:
    """The sum of the last n periods, null if one is missing."""
    w = trailing(keys, index, n)
    return F.when(F.count(value).over(w) == n, F.sum(value).over(w))


def previous(value: Column, keys: list[str], index: str) -> Column:
    """The value of the period just before; null if that period is missing."""
    w = Window.partitionBy(*keys).orderBy(index)
    return F.when(F.col(index) - F.lag(index).over(w) == 1, F.lag(value).over(w))


def with_runs(df: DataFrame, keys: list[str], index: str, name: str = "run") -> DataFrame:
    """df with a number that is constant over unbroken runs of periods."""
    return df.withColumn(name, F.col(index) - F.row_number().over(Window.partitionBy(*keys).orderBy(index)))


def last_run(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """The last unbroken run of each key."""
    runs = with_runs(df, keys, index, "__run")
    return runs.withColumn("__last", F.max("__run").over(Window.partitionBy(*keys))).where("__run = __last").drop("__run", "__last")


def monthly_from_year_to_date(df: DataFrame, keys: list[str], index: str, value: str, out: str) -> DataFrame:
    """Monthly values of year-to-date sums: January as it is, later months need the month before."""
    return df.withColumn(out, F.when(F.pmod(F.col(index), F.lit(12)) == 0, F.col(value)).otherwise(F.col(value) - previous(F.col(value), keys, index)))


def calendar(first: str, last: str, df: DataFrame) -> DataFrame:
    """(day): every day between two day literals."""
    return df.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("day"))


def missing_days(df: DataFrame, day: str, first: str, last: str) -> DataFrame:
    """The days between first and last that df lacks."""
    return calendar(first, last, df).join(df.select(F.col(day).alias("day")).distinct(), "day", "left_anti")


def last_change(df: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """Per key the latest value, since which period it holds, and how many rows that is."""
    w = Window.partitionBy(*keys).orderBy(index)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    islands = df.withColumn("__island", F.sum(changed).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per = islands.groupBy(*keys, "__island").agg(F.min(index).alias("since"), F.first(value).alias(value), F.count("*").alias("length"))
    return per.groupBy(*keys).agg(F.max_by(F.struct(value, "since", "length"), "__island").alias("__x")).select(*keys, F.col(f"__x.{value}"), "__x.since", "__x.length")


def rolling_median(df: DataFrame, keys: list[str], month: str, value: str, span: int, bins: int = 64) -> DataFrame:
    """(keys, month, median) over all positive values of the last `span` months, for months that have values.

    Values are counted in bins of equal ratio (`bins` to a doubling); only those counts are repeated into the months that
    see them. They say which bin, or two, holds a month's middle; the values of these bins alone are then put in order.
    """
    rows = df.select(*keys, F.col(month).alias("__m"), F.col(value).alias("__v"), F.floor(F.log2(value) * bins).alias("__b"))
    counts = rows.groupBy(*keys, "__m", "__b").agg(F.count("*").alias("__c"))
    seen = counts.select(*keys, "__b", "__c", F.explode(F.sequence(F.col("__m"), F.col("__m") + span - 1)).alias("__at"))
    seen = seen.join(counts.select(*keys, F.col("__m").alias("__at")).distinct(), [*keys, "__at"]).groupBy(*keys, "__at", "__b").agg(F.sum("__c").alias("__c"))
    own = Window.partitionBy(*keys, "__at")
    places = seen.withColumns({"__n": F.sum("__c").over(own), "__before": F.sum("__c").over(own.orderBy("__b")) - F.col("__c")})
    lower, upper = F.floor((F.col("__n") - 1) / 2), F.floor(F.col("__n") / 2)
    within = lambda k: (F.col("__before") <= k) & (k < F.col("__before") + F.col("__c"))
    middle = places.where(within(lower) | within(upper)).select(*keys, "__at", "__b", "__before", lower.alias("__l"), upper.alias("__u"))
    near = middle.withColumn("__m", F.explode(F.sequence(F.col("__at") - span + 1, F.col("__at"))))
    found = rows.join(near, [*keys, "__m", "__b"])
    at = F.row_number().over(Window.partitionBy(*keys, "__at", "__b").orderBy("__v")) - 1 + F.col("__before")
    # one row, or two in the middle of an even number
    return found.withColumn("__k", at).where((F.col("__k") == F.col("__l")) | (F.col("__k") == F.col("__u"))).groupBy(*keys, F.col("__at").alias(month)).agg(F.avg("__v").alias("median"))
