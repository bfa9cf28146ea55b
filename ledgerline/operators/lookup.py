"""As-of, nearest and peer lookups as equi-joins and windows: no nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str, strict: bool = False) -> DataFrame:
    """left with `value`, the right side's latest at or before (strict: before) each row's time.

    Both sides are merged into one ordered run per key and the last value is carried: one shuffle, no range join.
    """
    mine = left.select(*[F.col(c) for c in left.columns], F.lit(None).cast(right.schema[value].dataType).alias(f"__{value}"), F.lit(0 if strict else 1).alias("__side"))
    theirs = right.select(*[(F.col(c) if c in (*keys, time) else F.lit(None).cast(left.schema[c].dataType)).alias(c) for c in left.columns], F.col(value).alias(f"__{value}"), F.lit(1 if strict else 0).alias("__side"))
    own_side = 0 if strict else 1
    w = Window.partitionBy(*keys).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    run = mine.unionByName(theirs).withColumn(value, F.last(f"__{value}", ignorenulls=True).over(w))
    return run.where(F.col("__side") == own_side).drop("__side", f"__{value}")


def as_of_months(left: DataFrame, levels: DataFrame, day: str, value: str) -> DataFrame:
    """left with `value` of the latest month that starts before each row's day.

    levels has a row per month (its first day as `day`, value). Months without one take the last before, so each row
    has one month to look at: a plain join with a table of months.
    """
    span = levels.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    months = span.select(F.explode(F.sequence("lo", F.add_months("hi", 1), F.expr("INTERVAL 1 MONTH"))).alias("__month"))
    known = months.join(levels.select(F.col("day").alias("__month"), value), "__month", "left")
    # a row per month of the whole span
    filled = known.withColumn(value, F.last(value, ignorenulls=True).over(Window.orderBy("__month")))
    return left.withColumn("__month", F.trunc(F.date_sub(day, 1), "month")).join(filled, "__month", "left").drop("__month")


def nearest_within(left: DataFrame, right: DataFrame, keys: list[str], x: str, y: str, tolerance: float, tie: str) -> DataFrame:
    """left with the right row of the same keys whose y is nearest to x and less than tolerance away; ties by `tie`.

    Values are put in buckets of the tolerance's width; each left row looks into three. In a bucket both sides are merged in
    order and the last right row is carried, once up and once down, so no bucket's rows all meet each other. Equal left
    rows are looked up once and come back as often as they are there; rows with a null in the keys or x find nothing.
    """
    own, others = left.columns, [c for c in right.columns if c not in keys]
    spot = [*keys, "__bucket"]
    mine = left.groupBy(*own).agg(F.count("*").alias("__copies")).dropna(subset=[*keys, x])
    probes = mine.select(
        *keys, F.explode(F.array(*[F.floor(F.col(x) / tolerance) + k for k in (-1, 0, 1)])).alias("__bucket"), F.col(x).alias("__at"), F.lit(1).alias("__side"),
        F.struct(*own, "__copies").alias("__mine"))
    # of rows with the same y only the first by `tie` can be found; a null is the first
    theirs = right.dropna(subset=[*keys, y]).withColumn("__bucket", F.floor(F.col(y) / tolerance)).groupBy(*spot, F.col(y).alias("__at")).agg(F.min_by(F.struct(*others), F.struct(tie)).alias("__theirs"))
    run = probes.unionByName(theirs.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    last = lambda order: F.last("__theirs", ignorenulls=True).over(Window.partitionBy(*spot).orderBy(order, "__side").rowsBetween(Window.unboundedPreceding, 0))
    met = run.select("__side", "__mine", last(F.col("__at")).alias("__low"), last(F.desc("__at")).alias("__high")).where("__side = 1")
    found = met.select("__mine", F.explode(F.array("__low", "__high")).alias("__theirs")).select("__mine.*", "__theirs").where(F.abs(F.col(x) - F.col(f"__theirs.{y}")) < tolerance)
    best = found.groupBy(*own, "__copies").agg(F.min_by("__theirs", F.struct(F.abs(F.col(x) - F.col(f"__theirs.{y}")), F.col(f"__theirs.{tie}"))).alias("__theirs"))
    return best.select(*keys, *[c for c in own if c not in keys], "__theirs.*", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("__copy")).drop("__copy")


def neighbours(df: DataFrame, order: str, name: str) -> DataFrame:
    """The previous and next name in the order of a small dimension."""
    w = Window.orderBy(order, name)
    return df.withColumns({"previous": F.lag(name).over(w), "next": F.lead(name).over(w)})


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first k rows of each key; Spark prunes each task to k rows per key before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def capped(df: DataFrame, group: str, per_group: int, total: int, *order: Column) -> DataFrame:
    """At most per_group rows of each group, then the first `total` of all."""
    return top_k(df, [group], per_group, *order, rank="__rank").drop("__rank").orderBy(*order).limit(total)


def nearest_k(df: DataFrame, keys: list[str], near: str, width: int, value: str, item: str, k: int) -> DataFrame:
    """(item, other, rank): for each item the k others of the same keys whose whole number `near` is at most `width` away with the nearest
    value; ties go to the smaller item. Items are distinct; rows with a null find nothing and are found by nothing.

    An item looks into 2 * width + 1 lists (keys, near). In each the k + 1 rows up to its value on either side are carried along the order
    of values as one array: a row per item and list, no bucket's rows all meet each other.
    """
    rows = df.select(*keys, F.col(near).cast("long").alias("__s"), F.col(value).alias("__v"), F.col(item).alias("__i")).dropna()
    lists = [*keys, "__s"]
    up, down = F.col("__v"), F.desc("__v")
    # the nearest on one side stand last: of equal values the smaller items
    last = lambda order: F.collect_list(F.struct("__v", "__i")).over(Window.partitionBy(*lists).orderBy(order, F.desc("__i")).rowsBetween(-k, 0))
    items = rows.select(*lists, "__v", F.lit(None).cast(df.schema[item].dataType).alias("__i"), F.lit(0).alias("__side"), last(up).alias("__low"), last(down).alias("__high"), F.col("__i").alias("__o"))
    none = F.lit(None).cast(items.schema["__low"].dataType)
    probes = rows.select(*keys, F.explode(F.sequence(F.col("__s") - width, F.col("__s") + width)).alias("__s"), "__v", "__i", F.lit(1).alias("__side"), none.alias("__low"), none.alias("__high"), F.col("__i").alias("__o"))
    carried = lambda c, order: F.last(c, ignorenulls=True).over(Window.partitionBy(*lists).orderBy(order, "__side", F.desc("__o")).rowsBetween(Window.unboundedPreceding, 0))
    met = items.unionByName(probes).select("__side", "__i", "__v", carried("__low", up).alias("__low"), carried("__high", down).alias("__high")).where("__side = 1")
    empty = F.array().cast(items.schema["__low"].dataType)
    others = F.filter(F.concat(F.coalesce("__low", empty), F.coalesce("__high", empty)), lambda o: o["__i"] != F.col("__i"))
    first = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, k)
    best = met.select("__i", first(F.transform(others, lambda o: F.struct(F.abs(F.col("__v") - o["__v"]).alias("d"), o["__i"].alias("j")))).alias("__best"))
    best = best.groupBy("__i").agg(first(F.flatten(F.collect_list("__best"))).alias("__best"))  # 2 * width + 1 arrays of k at most
    return best.select(F.col("__i").alias(item), F.posexplode("__best").alias("rank", "o")).select(item, F.col("o.j").alias("other"), (F.col("rank") + 1).alias("rank"))
