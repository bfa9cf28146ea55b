"""Forecasts of a monthly series from its own past, judged as of the time, and a log of them that never changes what it says.

Regressions are running sums over a window of months, solved in columns, so a forecast for every origin of every series costs
one sort of the months by series. Log entries are keyed by (series, origin, h): the first forecast of a key stays, its baseline is
filled once if it was missing, and its score is frozen at the first release that has both of its months.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from . import merge

#: Months that a forecast looks back.
LAGS = 6
#: Below this a pivot counts as zero, and there is no forecast.
PIVOT = 1e-12
#: Quantiles of past errors that make a forecast's range.
BAND = (0.1, 0.9)


def ols(terms: list[Column], y: Column, over, now: list[Column], least: int) -> Column:
    """What least squares of y on 1 and terms over the window's rows gives for `now`; null with fewer rows than
    `least` or a pivot below PIVOT.

    The normal equations are running sums; elimination runs on columns, in the order of terms. Rows that lack y or a term count
    nowhere.
    """
    full = y.isNotNull()
    for x in terms:
        full = full & x.isNotNull()
    xs = [F.lit(1.0), *terms]
    k = len(xs)
    total = lambda c: F.sum(F.when(full, c)).over(over)
    a = [[total(xs[i] * xs[j]) if j >= i else None for j in range(k)] for i in range(k)]
    b = [total(x * y) for x in xs]
    count = F.count(F.when(full, F.lit(1))).over(over)
    return _solved(a, b, [F.lit(1.0), *now], count >= least)


def _solved(a: list[list[Column]], b: list[Column], now: list[Column], enough: Column) -> Column:
    """now . beta for the symmetric system a beta = b, of which the upper half is read."""
    k = len(b)
    good = enough
    # each step's columns are named within a struct, so that an expression holds earlier steps by name, not by copy
    state = F.struct(*[a[i][j].alias(f"a{i}{j}") for i in range(k) for j in range(i, k)], *[b[i].alias(f"b{i}") for i in range(k)], good.alias("ok"))
    def eliminated(p: int):
        def step(s: Column) -> Column:
            pivot = s[f"a{p}{p}"]
            kept = [s[f"a{i}{j}"].alias(f"a{i}{j}") for i in range(p + 1) for j in range(i, k)] + [s[f"b{i}"].alias(f"b{i}") for i in range(p + 1)]
            new = [(s[f"a{i}{j}"] - F.try_divide(s[f"a{p}{i}"] * s[f"a{p}{j}"], pivot)).alias(f"a{i}{j}") for i in range(p + 1, k) for j in range(i, k)]
            new += [(s[f"b{i}"] - F.try_divide(s[f"a{p}{i}"] * s[f"b{p}"], pivot)).alias(f"b{i}") for i in range(p + 1, k)]
            return F.struct(*kept, *new, (s["ok"] & (F.abs(pivot) >= PIVOT)).alias("ok"))

        return step

    for p in range(k - 1):
        state = F.element_at(F.transform(F.array(state), eliminated(p)), 1)

    def back(s: Column) -> Column:
        beta: dict[int, Column] = {}
        for i in reversed(range(k)):
            rest = s[f"b{i}"]
            for j in range(i + 1, k):
                rest = rest - s[f"a{i}{j}"] * beta[j]
            beta[i] = F.try_divide(rest, s[f"a{i}{i}"])
        out = beta[0] * now[0]
        for i in range(1, k):
            out = out + beta[i] * now[i]
        return F.when(s["ok"] & (F.abs(s[f"a{k - 1}{k - 1}"]) >= PIVOT), out)

    return F.element_at(F.transform(F.array(state), back), 1)


def predictions(series: DataFrame, keys: list[str], month: str, log: str, horizons: list[int], least: int = 24) -> DataFrame:
    """(keys, month, h, model, drift, truth): for each origin month and horizon, the log change that a regression on the last month's
    change, the one before and the mean of the four before that expects, what the mean change so far gives, and what came (null
    if not yet). Trained on what had ended by the origin, on `least` months at least. Series must not miss a month.
    """
    by = Window.partitionBy(*keys).orderBy(month)
    x = series.withColumn("__r", F.col(log) - F.lag(log).over(by))
    x = x.withColumns({"__x1": F.col("__r"), "__x2": F.lag("__r", 1).over(by), "__x3": (F.lag("__r", 2).over(by) + F.lag("__r", 3).over(by) + F.lag("__r", 4).over(by) + F.lag("__r", 5).over(by)) / 4})
    mean = F.avg("__r").over(by.rowsBetween(Window.unboundedPreceding, 0))
    wide = x.withColumns({"__mean": mean} | {f"__y{h}": F.lead(log, h).over(by) - F.col(log) for h in horizons})
    terms = [F.col(f"__x{k}") for k in (1, 2, 3)]
    for h in horizons:
        # a month's result is known h months later
        known = by.rowsBetween(Window.unboundedPreceding, -h)
        wide = wide.withColumn(f"__p{h}", ols(terms, F.col(f"__y{h}"), known, terms, least))
    each = [F.struct(F.lit(h).alias("h"), F.col(f"__p{h}").alias("model"), (F.col("__mean") * h).alias("drift"), F.col(f"__y{h}").alias("truth")) for h in horizons]
    out = wide.where(F.col("__x3").isNotNull()).select(*keys, month, F.explode(F.array(*each)).alias("p"))
    return out.select(*keys, month, "p.h", "p.model", "p.drift", "p.truth").where("model IS NOT NULL")


def with_bands(predicted: DataFrame, keys: list[str], month: str, band: tuple[float, float] = BAND) -> DataFrame:
    """predictions() with error (truth - model) and low, high: quantiles of the errors that had come by the origin, null without any."""
    e = predicted.withColumn("error", F.col("truth") - F.col("model"))
    # an error is known h months after its origin: it is moved there and looked up from all rows up to the month
    by = Window.partitionBy(*keys, "h").orderBy(month).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = e.select(*keys, "h", month, F.lit(None).cast("double").alias("__past"), F.struct("model", "drift", "truth", "error").alias("__row"))
    moved = e.where("error IS NOT NULL").select(*keys, "h", (F.col(month) + F.col("h")).alias(month), F.col("error").alias("__past"), F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"))
    both = rows.unionByName(moved)
    seen = both.withColumn("__q", F.percentile("__past", F.array(F.lit(band[0]), F.lit(band[1]))).over(by)).where("__row IS NOT NULL")
    return seen.select(*keys, month, "h", "__row.*", F.col("__q")[0].alias("low"), F.col("__q")[1].alias("high"))


def scorecard(judged: DataFrame, keys: list[str], move: float = 0.5) -> DataFrame:
    """(keys, h, origins, first, mae_model, mae_naive, mae_drift, hit, always_up) over with_bands() rows whose result came.
    Changes are percentages, halves up to two digits; direction counts where the truth moved by `move` or more."""
    done = judged.where("truth IS NOT NULL")
    pct = lambda c: F.col(c) * 100
    moved = F.abs(pct("truth")) >= move
    share = lambda hit: F.when(F.count_if(moved) > 0, half_up(F.count_if(moved & hit) / F.count_if(moved) * 100, 2))
    return done.groupBy(*keys, "h").agg(
        F.count("*").alias("origins"), half_up(F.avg(F.abs(pct("truth") - pct("model"))), 2).alias("mae_model"), half_up(F.avg(F.abs(pct("truth"))), 2).alias("mae_naive"),
        half_up(F.avg(F.abs(pct("truth") - pct("drift"))), 2).alias("mae_drift"), share((F.col("model") > 0) == (F.col("truth") > 0)).alias("hit"), share(F.col("truth") > 0).alias("always_up"))


def coverage(judged: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, h, origins, inside): how often the error lay in the range that was known at the origin."""
    done = judged.where("truth IS NOT NULL AND low IS NOT NULL")
    return done.groupBy(*keys, "h").agg(F.count("*").alias("origins"), F.count_if(F.col("error").between(F.col("low"), F.col("high"))).alias("inside"))


def entries(judged: DataFrame, keys: list[str], month: str) -> DataFrame:
    """(keys, origin, h, target, change, drift, low, high): forecasts as they go into the log, in percent."""
    pct = lambda c: half_up(c * 100, 2)
    return judged.where("low IS NOT NULL").select(
        *keys, F.col(month).alias("origin"), "h", (F.col(month) + F.col("h")).alias("target"), pct(F.col("model")).alias("change"), pct(F.col("drift")).alias("drift"),
        pct(F.col("model") + F.col("low")).alias("low"), pct(F.col("model") + F.col("high")).alias("high"))


# the log

#: What a log entry is known by, beside its series.
ENTRY = ["origin", "h"]


def made(log: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """log and those fresh entries whose key it lacks; of fresh entries with one key the smallest counts."""
    own = merge.first_by(fresh, [*keys, *ENTRY], *[F.col(c) for c in fresh.columns])
    return merge.insert_only(log, own, [*keys, *ENTRY])


def drift_filled(log: DataFrame, baseline: DataFrame, keys: list[str], today: Column) -> DataFrame:
    """log (with drift, drift_added_on) in which entries without a drift take that of baseline (keys, origin, h, drift), stamped today."""
    new = baseline.select(*keys, *ENTRY, F.col("drift").alias("__drift"))
    both = log.join(new, [*keys, *ENTRY], "left")
    fill = F.col("drift").isNull() & F.col("__drift").isNotNull()
    return both.withColumns({"drift_added_on": F.when(fill, today).otherwise(F.col("drift_added_on")), "drift": F.coalesce("drift", "__drift")}).select(*log.columns)


def frozen(log: DataFrame, points: DataFrame, keys: list[str], month: str, build: str, value: str) -> DataFrame:
    """log (with actual, scored_on) in which entries without a score take that of the first build that has both months.

    points (keys, month, build, value) are index values by the build that brought them, revised ones again; value is a log. What a
    build says of a month is the latest point up to it. Entries with a score keep it whatever points say.
    """
    first = points.groupBy(*keys, month).agg(F.min(build).alias("__since"))
    todo = log.where("actual IS NULL").drop("actual", "scored_on")

    def since(name: str) -> DataFrame:
        return first.select(*keys, F.col(month).alias(name), F.col("__since").alias(f"__since_{name}"))

    dated = todo.join(since("origin"), [*keys, "origin"], "left").join(since("target"), [*keys, "target"], "left")
    on = F.when(F.col("__since_origin").isNotNull() & F.col("__since_target").isNotNull(), F.greatest("__since_origin", "__since_target"))
    dated = dated.withColumn("scored_on", on).drop("__since_origin", "__since_target")

    def as_of(df: DataFrame, name: str) -> DataFrame:
        p = points.select(*keys, F.col(month).alias(name), F.col(build).alias("__build"), F.col(value).alias("__value"))
        met = df.select(*keys, *ENTRY, "target", "scored_on").join(p, [*keys, name]).where(F.col("__build") <= F.col("scored_on"))
        return met.groupBy(*keys, *ENTRY).agg(F.max_by("__value", "__build").alias(f"__{name}"))

    scored = dated.join(as_of(dated, "origin"), [*keys, *ENTRY], "left").join(as_of(dated, "target"), [*keys, *ENTRY], "left")
    scored = scored.withColumn("actual", half_up((F.col("__target") - F.col("__origin")) * 100, 2))
    return log.where("actual IS NOT NULL").unionByName(scored.select(*log.columns))


def record(log: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, made, scored, pending, mae, inside, won, of): the log's scores; won counts entries whose error is below those of no
    change and of the drift, among the `of` that have a drift."""
    miss = F.abs(F.col("actual") - F.col("change"))
    have = F.col("actual").isNotNull()
    both = have & F.col("drift").isNotNull()
    won = both & (miss < F.abs("actual")) & (miss < F.abs(F.col("actual") - F.col("drift")))
    return log.groupBy(*keys).agg(
        F.count("*").alias("made"), F.count_if(have).alias("scored"), F.count_if(~have).alias("pending"), half_up(F.avg(F.when(have, miss)), 2).alias("mae"),
        F.count_if(have & F.col("actual").between(F.col("low"), F.col("high"))).alias("inside"), F.count_if(won).alias("won"), F.count_if(both).alias("of"))
