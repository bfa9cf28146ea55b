"""Whether an indicator improves a forecast: a grid of named candidates, judged by errors as of the time against stated rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from . import resample
from .forecasts import ols


@dataclass(frozen=True)
class Candidate:
    """A predictor made of one monthly series. kind: `level`, `change` over `months`, `norm` (mean of the last three months less that
    of the 24 before) or `yoy` (mean of three months less that of a year earlier). `lags`: months by which its values come
    earlier than the origin's; at `published` ones it only tells the answer early."""

    name: str
    series: str
    kind: str
    months: int = 12
    lags: tuple[int, ...] = (0, 1)
    published: tuple[int, ...] = ()


@dataclass(frozen=True)
class Rules:
    """When a candidate counts as ahead."""

    least_rows: int = 24
    least_origins: int = 36
    win: float = 0.9
    regions: int = 4
    rounds: int = 1000
    block: int = 12
    seed: int = 20261001


def values(series: DataFrame, candidates: Sequence[Candidate]) -> DataFrame:
    """(candidate, lag, month, x) of series (series, month, value): each candidate's value for an origin month, where all months that it
    is made of are there."""
    by = Window.partitionBy("series").orderBy("month")

    def mean(first: int, last: int) -> Column:
        w = by.rangeBetween(-first, -last)
        return F.when(F.count("value").over(w) == first - last + 1, F.avg("value").over(w))

    def ago(k: int) -> Column:
        return F.max("value").over(by.rangeBetween(-k, -k))

    def of(c: Candidate) -> Column:
        return {"level": F.col("value"), "change": F.col("value") - ago(c.months), "norm": mean(2, 0) - mean(26, 3), "yoy": mean(2, 0) - mean(14, 12)}[c.kind]

    kinds = {(c.kind, c.months if c.kind == "change" else 0): c for c in candidates}
    wide = series.withColumns({f"{kind}{months}": of(c) for (kind, months), c in kinds.items()})
    each = F.array(*[
        F.struct(F.lit(c.series).alias("series"), F.lit(c.name).alias("candidate"), F.lit(lag).alias("lag"), F.lit(lag in c.published).alias("published"), F.col(f"{c.kind}{c.months if c.kind == 'change' else 0}").alias("x"))
        for c in candidates for lag in c.lags])
    long = wide.select("series", "month", F.explode(F.filter(each, lambda e: e["series"] == F.col("series"))).alias("e"))
    # an origin sees the value of its month plus the lag
    return long.select("e.candidate", "e.lag", "e.published", (F.col("month") - F.col("e.lag")).alias("month"), "e.x").where("x IS NOT NULL")


def errors(prices: DataFrame, region: str, month: str, log: str, known: DataFrame, horizons: Sequence[int], rules: Rules = Rules()) -> DataFrame:
    """(region, candidate, lag, published, h, month, base, with, same): errors in percent, by origin, of the regression on past prices, of
    the one with the candidate added and of that on past prices fitted to the rows that the candidate has.

    Each origin is fitted on what had ended by it, by running sums within (region, candidate, lag).
    """
    by0 = Window.partitionBy(region).orderBy(month)
    p = prices.withColumn("__r", F.col(log) - F.lag(log).over(by0))
    p = p.withColumns({"__x1": F.col("__r"), "__x2": F.lag("__r", 1).over(by0), "__x3": (F.lag("__r", 2).over(by0) + F.lag("__r", 3).over(by0) + F.lag("__r", 4).over(by0) + F.lag("__r", 5).over(by0)) / 4})
    p = p.withColumns({f"__y{h}": F.lead(log, h).over(by0) - F.col(log) for h in horizons})
    # candidates and lags are a list that somebody wrote down
    grid = F.broadcast(known.select("candidate", "lag", "published").distinct())
    wide = p.withColumn("__one", F.lit(1)).join(grid.withColumn("__one", F.lit(1)), "__one").drop("__one")
    x = known.select("candidate", "lag", F.col("month").alias(month), F.col("x").alias("__x"))
    wide = wide.join(x, ["candidate", "lag", month], "left")
    by = Window.partitionBy(region, "candidate", "lag").orderBy(month)
    past = [F.col(f"__x{k}") for k in (1, 2, 3)]
    extra = F.col("__x")
    # five terms: four rows each at least
    least = max(rules.least_rows, 5 * 4)
    for h in horizons:
        over = by.rowsBetween(Window.unboundedPreceding, -h)
        y = F.col(f"__y{h}")
        own = F.when(extra.isNotNull(), y)
        wide = wide.withColumns({f"__b{h}": ols(past, y, over, past, 1), f"__w{h}": ols([*past, extra], own, over, [*past, extra], least), f"__s{h}": ols(past, own, over, past, least)})
    each = [F.struct(F.lit(h).alias("h"), *[((F.col(f"__y{h}") - F.col(f"__{k}{h}")) * 100).alias(n) for k, n in (("b", "base"), ("w", "with"), ("s", "same"))]) for h in horizons]
    rows = wide.where(extra.isNotNull()).select(region, "candidate", "lag", "published", month, F.explode(F.array(*each)).alias("e"))
    return rows.select(region, "candidate", "lag", "published", "e.h", F.col(month), "e.base", "e.with", "e.same").dropna(subset=["base", "with", "same"])


def scores(found: DataFrame, region: str, month: str, rules: Rules = Rules()) -> DataFrame:
    """(region, candidate, lag, published, h, origins, base, with, gain, win, passes) of errors(), where there are origins enough. win is the
    smaller share of block resamples in which the candidate's error beats that of either other model. A group is a series' months."""
    def kernel(rows):
        e = {c: np.abs(rows[c].to_numpy()) for c in ("base", "with", "same")}
        n = len(rows)
        win = 0.0
        if n >= 2 * rules.block:
            win = min(resample.block_win_share(e[c] - e["with"], rules.rounds, rules.block, rules.seed) for c in ("base", "same"))
        return {"origins": n, "e_base": float(e["base"].mean()), "e_with": float(e["with"].mean()), "win": win}

    keys = [region, "candidate", "lag", "published", "h"]
    per = resample.per_group(found, keys, [month], {"origins": "long", "e_base": "double", "e_with": "double", "win": "double"}, kernel).where(F.col("origins") >= rules.least_origins)
    base, added = half_up(F.col("e_base"), 2), half_up(F.col("e_with"), 2)
    return per.select(*keys, "origins", base.alias("base"), added.alias("with"), half_up(base - added, 2).alias("gain"), half_up(F.col("win"), 2).alias("win"), (F.col("win") >= rules.win).alias("passes"))


def verdicts(scored: DataFrame, region: str, main: str, rules: Rules = Rules()) -> DataFrame:
    """(candidate, lag, verdict): `no` if it passes at no horizon in the main region, `published` if it then only came out earlier, `leads`
    if at such a horizon as many other regions as the rules ask pass too, else `main only`."""
    first = scored.where(F.col(region) == main).select("candidate", "lag", "published", "h", "passes")
    others = scored.where((F.col(region) != main) & F.col("passes")).groupBy("candidate", "lag", "h").agg(F.count("*").alias("wins"))
    both = first.join(others, ["candidate", "lag", "h"], "left")
    won = F.col("passes") & (F.coalesce("wins", F.lit(0)) >= rules.regions)
    per = both.groupBy("candidate", "lag").agg(F.max("published").alias("published"), F.max("passes").alias("passes"), F.max(won).alias("leads"))
    verdict = F.when(~F.col("passes"), "no").when(F.col("published"), "published").when(F.col("leads"), "leads").otherwise("main only")
    return per.select("candidate", "lag", verdict.alias("verdict"))


def kill_rules(checked: DataFrame, group: str, own: str, low: str, high: str, other: str, most_signs: int, least_rho: float, least_groups: int) -> DataFrame:
    """One row (groups, against, rho, kill_sign, kill_rho, kill, passes) on whether a table of groups may be published beside another source: killed
    if `most_signs` groups or more whose interval leaves out zero have the other sign there, or if the rank correlation of the
    two is below least_rho or can't be had; passes if not killed and there are least_groups groups."""
    from ..functions import stats

    rows = checked.where(F.col(own).isNotNull())
    sure = F.col(other).isNotNull() & ((F.col(low) > 0) | (F.col(high) < 0)) & (F.signum(F.col(own)) != F.signum(F.col(other)))
    counts = rows.agg(F.count("*").alias("groups"), F.count_if(sure).alias("against")).withColumn("__g", F.lit(1))
    rho = stats.spearman(rows.withColumn("__g", F.lit(1)), ["__g"], own, other)
    both = counts.join(rho, "__g", "left")
    out = both.select("groups", "against", F.col("spearman").alias("rho"), (F.col("against") >= most_signs).alias("kill_sign"), (F.col("spearman").isNull() | (F.col("spearman") < least_rho)).alias("kill_rho"))
    out = out.withColumn("kill", F.col("kill_sign") | F.col("kill_rho"))
    return out.withColumn("passes", ~F.col("kill") & (F.col("groups") >= least_groups))
