"""Operators behind the published tables: summaries, thresholds, conversions, folds, gates, picks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import finance, stats


def cell_summary(rows: DataFrame, cell: list[str], value: str, day: str, least: int = 5) -> DataFrame:
    """(cell, n, low, high, middle, first_day, top, top_day): quartiles from `least` rows on, else the ends."""
    n, top = F.count("*"), F.max(F.struct(value, day))
    low, high = (F.when(n >= least, stats.quantile_r7(F.col(value), q)).otherwise(end(value)).cast("double") for q, end in ((0.25, F.min), (0.75, F.max)))
    out = rows.groupBy(*cell).agg(n.alias("n"), low.alias("low"), high.alias("high"), F.median(value).cast("double").alias("middle"), F.min(day).alias("first_day"), top.alias("__top"))
    return out.select(*cell, "n", "low", "high", "middle", "first_day", F.col("__top")[value].alias("top"), F.col("__top")[day].alias("top_day"))


def nested_history(rows: DataFrame, name: str, cell: list[str], value: str) -> DataFrame:
    """(name, history): for each name its cells' medians and counts in order; a name has few cells and months."""
    flat = rows.groupBy(name, *cell).agg(F.median(value).cast("double").alias("median"), F.count("*").alias("n"))
    return flat.groupBy(name).agg(F.array_sort(F.collect_list(F.struct(*cell, "median", "n"))).alias("history"))


def outcomes(rows: DataFrame, keys: list[str], off: Column, lag: str, least: int) -> DataFrame:
    """(keys, n, cancelled, registered, pending, lag, p90): shares of all rows, times of the registered ones."""
    done = F.when(~off, F.col(lag))
    own = rows.withColumns({"__off": off, "__done": done})
    return own.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(stats.share(F.col("__off")), 6).alias("cancelled"), F.round(stats.share(F.col("__done").isNotNull()), 6).alias("registered"),
        F.round(stats.share(~F.col("__off") & F.col(lag).isNull()), 6).alias("pending"), stats.suppressed(F.median("__done"), F.count("__done"), least).alias("lag"), stats.quantile_disc("__done", 0.9).alias("p90"))


def conversion_pairs(rows: DataFrame, cell: list[str], jeonse: str, deposit: str, rent: str) -> DataFrame:
    """(cell, jeonse, deposit, rent, rate) of cells that have leases with and without rent and a positive rate."""
    plain = F.col(rent).isNull()
    per = rows.groupBy(*cell).agg(F.median(F.when(plain, F.col(jeonse))).alias("jeonse"), F.median(F.when(~plain, F.col(deposit))).alias("deposit"), F.median(rent).alias("rent"))
    return per.withColumn("rate", finance.conversion_rate(F.col("jeonse"), F.col("deposit"), F.col("rent"))).where("rate > 0")


def cost_changes(levels: DataFrame, period: str, deposit_percent: Column) -> DataFrame:
    """levels (period, deposit, rent, loan) with `cost`, its percent change, and the parts of rate and level: the rate's
    is the change at the earlier level, the level's the rest. A row per period."""
    w = Window.orderBy(period)
    before = levels.withColumns({f"__{c}": F.lag(c).over(w) for c in ("deposit", "rent", "loan")})
    cost = lambda d, n, x: finance.converted_cost(F.col(d), F.col(n), F.col(x), deposit_percent)
    out = before.withColumns({"cost": cost("deposit", "rent", "loan"), "__was": cost("__deposit", "__rent", "__loan"), "__at": cost("__deposit", "__rent", "loan")})
    percent = lambda a, b: (F.col(a) / F.col(b) - 1) * 100
    return out.withColumns({"change": percent("cost", "__was"), "by_rate": percent("__at", "__was"), "by_level": percent("cost", "__at")}).drop("__was", "__at", "__deposit", "__rent", "__loan")


def fallen(cells: DataFrame, keys: list[str], least: int) -> DataFrame:
    """(keys, cells, fell, share, percent, amount) of cells (was, now); values of fewer than `least` cells are null."""
    fell, n, k = F.col("now") < F.col("was"), F.count("*"), F.count_if(F.col("now") < F.col("was"))
    return cells.groupBy(*keys).agg(
        n.alias("cells"), stats.suppressed(k, n, least).alias("fell"), F.round(stats.suppressed(k / n * 100, n, least), 6).alias("share"),
        F.round(stats.suppressed(F.median(F.when(fell, (F.col("now") / F.col("was") - 1) * 100)), k, least), 6).alias("percent"),
        stats.suppressed(F.floor(F.median(F.when(fell, F.col("now") - F.col("was"))) + 0.5), k, least).alias("amount"))


def ratio_counts(cells: DataFrame, keys: list[str], ratio: Column, lines: dict[str, float]) -> DataFrame:
    """(keys, cells, a count per line of ratios at or above it), by keys and of all."""
    return cells.withColumn("__x", ratio).rollup(*keys).agg(F.count("*").alias("cells"), *[F.count_if(F.col("__x") >= v).alias(k) for k, v in lines.items()])


def gates(rows: DataFrame, keys: list[str], month: str) -> DataFrame:
    """(keys, first, last, holes, coverage, middle): months from the first to the last, those without rows, the median count."""
    monthly = rows.groupBy(*keys, month).agg(F.count("*").alias("__n"))
    span = F.max(month) - F.min(month) + 1
    return monthly.groupBy(*keys).agg(F.min(month).alias("first"), F.max(month).alias("last"), (span - F.count("*")).cast("long").alias("holes"), F.round(F.count("*") / span, 6).alias("coverage"), stats.quantile_disc("__n", 0.5).alias("middle"))


def ages(rows: DataFrame, family: str, member: str, at: str, today: Column, least: int, lines: dict[str, int]) -> DataFrame:
    """(family, members, oldest, days, level) of families of `least` members; level: the first line that days exceed."""
    out = rows.groupBy(family).agg(F.count("*").alias("members"), F.min(F.struct(at, member)).alias("__o")).where(F.col("members") >= least)
    days = F.datediff(today, F.col("__o")[at].cast("date"))
    level = reduce(lambda x, kv: x.when(days > kv[1], kv[0]), list(lines.items())[1:], F.when(days > list(lines.values())[0], list(lines)[0]))
    return out.select(family, "members", F.col("__o")[member].alias("oldest"), days.alias("days"), level.otherwise("fresh").alias("level"))


def stratified_pick(rows: DataFrame, keys: list[str], band: str, per_band: int, total: int, order: list[Column]) -> DataFrame:
    """`total` rows of each key, up to per_band of each band before any other; `place` in the given order."""
    place = lambda by, *first: F.row_number().over(Window.partitionBy(*keys, *by).orderBy(*first, *order))
    turn = rows.withColumn("__band", place([band]))
    turn = turn.withColumn("__turn", place([], F.when(F.col("__band") <= per_band, 0).otherwise(1))).where(F.col("__turn") <= total)
    return turn.withColumn("place", place([])).drop("__band", "__turn")


def repeated_keys(parts: DataFrame, keys: list[str], part: str) -> DataFrame:
    """(keys, times, parts): keys that stand more than once, and in how many parts."""
    return parts.groupBy(*keys).agg(F.count("*").alias("times"), F.count_distinct(part).alias("parts")).where("times > 1")
