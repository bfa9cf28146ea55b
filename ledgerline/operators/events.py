"""Prior, next and consecutive events of a cell, by day; events of the same day don't see each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: Rows of a table, about, that a task of standing_among_earlier() sorts.
TASK_ROWS = 100_000


def with_prior(df: DataFrame, cell: list[str], day: str, value: str) -> DataFrame:
    """df with prior_n, prior_first, prior_max: count, first day and largest value strictly before the day."""
    w = Window.partitionBy(*cell).orderBy(day).rangeBetween(Window.unboundedPreceding, -1)
    return df.withColumns({"prior_n": F.count("*").over(w), "prior_first": F.min(day).over(w), "prior_max": F.max(value).over(w)})


def record_highs(df: DataFrame, cell: list[str], day: str, value: str, least_prior: int = 3, least_span: int = 180, near: float = 0.98) -> DataFrame:
    """Rows with enough history, marked `record` (above all before) or `near` (at least near * the maximum)."""
    known = with_prior(df, cell, day, value).where((F.col("prior_n") >= least_prior) & (F.col(day) - F.col("prior_first") >= least_span))
    kind = F.when(F.col(value) > F.col("prior_max"), "record").when(F.col(value) >= F.col("prior_max") * near, "near").otherwise("below")
    return known.withColumn("verdict", kind)


def with_next(df: DataFrame, cell: list[str], day: str, order: str, value: str, wait: int) -> DataFrame:
    """df with next_day and next_value: the first event of the cell 1 to `wait` days later, the first in order."""
    w = Window.partitionBy(*cell).orderBy(day).rangeBetween(1, wait)
    following = F.min(F.struct(F.col(day).alias("d"), F.col(order).alias("o"), F.col(value).alias("v"))).over(w)
    return df.withColumn("__next", following).withColumns({"next_day": F.col("__next.d"), "next_value": F.col("__next.v")}).drop("__next")


def repeat_pairs(df: DataFrame, unit: list[str], day: str, value: str, *order: Column, gap: tuple[int, int] = (300, 730), most: float = 0.6931471805599453) -> DataFrame:
    """(unit, day, next_day, log_change): consecutive events of a unit whose gap and log change are in bounds."""
    w = Window.partitionBy(*unit).orderBy(day, *order)
    pairs = df.withColumns({"next_day": F.lead(day).over(w), "next_value": F.lead(value).over(w)})
    pairs = pairs.where((F.col("next_day") - F.col(day)).between(*gap) & (F.col(value) > 0) & (F.col("next_value") > 0))
    return pairs.withColumn("log_change", F.ln(F.col("next_value") / F.col(value))).where(F.abs("log_change") <= most).select(*unit, day, "next_day", "log_change")


def average_rank(value: str, keys: list[str]) -> Column:
    """Rank of a value with ties sharing the mean of their places."""
    ties = F.count("*").over(Window.partitionBy(*keys, value))
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (ties - 1) / 2


def arrivals_after_gap(df: DataFrame, keys: list[str], time: str, term: str) -> DataFrame:
    """The rows with which a key arrives: its first, and the first after an absence of more than `term` (an interval). Of rows with one
    time the first in the order of all columns counts."""
    w = Window.partitionBy(*keys).orderBy(time, *[c for c in df.columns if c not in (*keys, time)])
    before = F.lag(time).over(w)
    return df.withColumn("__before", before).where(F.col("__before").isNull() | (F.col(time) > F.col("__before") + F.expr(f"INTERVAL {term}"))).drop("__before")


def standing_among_earlier(df: DataFrame, cell: list[str], day: str, value: str) -> DataFrame:
    """df with `n`, `lower` and `equal`: of the rows of the cell on strictly earlier days how many there are, have a lower value, the same value.

    No row meets another: values get dense ranks within the cell, and `lower` adds up over the binary digits of the rank: where a row's
    digit is 1, the earlier rows that share the digits above and have 0 there. That is a running count for each digit that ranks
    of the cell need. Rows whose value is null count nowhere and have nulls; equal rows are rows each.
    """
    rows = checkpointed(df.withColumn("__id", F.monotonically_increasing_id()))
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    # dealt by the cell into a number of parts that adaptive execution does not lower: every sort below is within them
    known = rows.where(F.col(value).isNotNull()).select("__id", *cell, day, value).repartition(parts, *cell)
    ranked = known.withColumn("__r", F.dense_rank().over(Window.partitionBy(*cell).orderBy(value)) - 1)
    most = F.max("__r").over(Window.partitionBy(*cell))
    earlier = lambda *more: Window.partitionBy(*cell, *more).orderBy(day).rangeBetween(Window.unboundedPreceding, -1)
    own = ranked.withColumns({"__n": F.count("*").over(earlier()), "__e": F.count("*").over(earlier("__r")), "__most": most})
    digits = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.col("__most"), F.lit(1)).cast("double"))).cast("int"))
    each = own.select("__id", *cell, day, "__r", "__n", "__e", F.explode(digits).alias("__k"))
    bit = F.expr("shiftright(__r, __k) & 1")
    each = each.withColumns({"__bit": bit, "__above": F.expr("shiftright(__r, __k + 1)")})
    below = F.sum(1 - F.col("__bit")).over(earlier("__k", "__above"))
    # every row has a digit at least
    counts = each.withColumn("__below", F.when(F.col("__bit") == 1, below)).groupBy("__id").agg(F.max("__n").alias("__n"), F.max("__e").alias("__e"), F.sum("__below").alias("__lower"))
    out = rows.join(counts, "__id", "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.col("__n").alias("n"), F.when(F.col("__n").isNotNull(), F.coalesce("__lower", F.lit(0)).cast("long")).alias("lower"), F.col("__e").alias("equal"))
