"""Rules that tie articles to figures: keywords, signal words, exclusions and a scope, applied in order, and how often they hit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULE_HITS = "array<struct<rule: string, scope: string>>"


@dataclass(frozen=True)
class Rule:
    """A rule hits a text that `keyword` finds and, where given, `signal` finds and `without` does not; `title_without` must not be found in the
    title. `scoped`: only with a scope, else the scope is not looked at."""

    name: str
    keyword: str
    signal: str = ""
    without: str = ""
    title_without: str = ""
    scoped: bool = True


def scope(text: Column, names: Sequence[str], whole: str, other: str) -> Column:
    """The one of `names` that a text has, `whole` if it has none or several but says whole, null otherwise; null too where `other` is found."""
    found = F.filter(F.array(*[F.when(F.contains(text, F.lit(n)), F.lit(n)) for n in names]), lambda x: x.isNotNull())
    own = F.when(F.size(found) == 1, found[0]).when(F.contains(text, F.lit(whole)), whole)
    return F.when(~text.rlike(other), own)


def hits(title: Column, text: Column, rules: Sequence[Rule], where: Column, most: int = 2) -> Column:
    """The first `most` rules, in order, that hit a text, with the scope `where` (null for rules that need none). Null texts hit nothing."""
    each = []
    for rule in rules:
        ok = F.coalesce(text.rlike(rule.keyword), F.lit(False))
        if rule.signal:
            ok = ok & text.rlike(rule.signal)
        if rule.without:
            ok = ok & ~text.rlike(rule.without)
        if rule.title_without:
            ok = ok & ~F.coalesce(title.rlike(rule.title_without), F.lit(False))
        if rule.scoped:
            ok = ok & where.isNotNull()
        each.append(F.when(ok, F.struct(F.lit(rule.name).alias("rule"), (where if rule.scoped else F.lit(None).cast("string")).alias("scope"))))
    return F.slice(F.array_compact(F.array(*each)), 1, most)


def answered(df: DataFrame, found: str, answers: DataFrame) -> DataFrame:
    """df with one row per hit that answers (rule, scope, value) has a value for, in the rules' order: rule, scope, value. Thin answers are
    left out by being absent or null."""
    flat = df.select("*", F.posexplode(found).alias("__k", "__h")).drop(found)
    flat = flat.withColumns({"rule": F.col("__h.rule"), "scope": F.col("__h.scope")}).drop("__h")
    known = answers.where("value IS NOT NULL").select(F.col("rule").alias("__r"), F.col("scope").alias("__s"), "value")
    return flat.join(known, (F.col("rule") == F.col("__r")) & F.col("scope").eqNullSafe(F.col("__s"))).drop("__r", "__s", "__k")


def hit_rates(df: DataFrame, keys: list[str], found: str, title: str) -> DataFrame:
    """(keys, texts, hit, rate, titles, titles_hit): how many texts, and distinct titles, at least one rule hit; the rate in whole percent."""
    some = F.size(found) > 0
    per = df.groupBy(*keys).agg(
        F.count("*").alias("texts"), F.count_if(some).alias("hit"), F.count_distinct(title).alias("titles"), F.count_distinct(F.when(some, F.col(title))).alias("titles_hit"))
    return per.select(*keys, "texts", "hit", F.floor(F.col("hit") / F.col("texts") * 100 + 0.5).cast("int").alias("rate"), "titles", "titles_hit")


def by_rule(df: DataFrame, found: str, title: str) -> DataFrame:
    """(rule, texts, titles): how many texts and distinct titles each rule hit."""
    flat = df.select(title, F.explode(found).alias("__h"))
    return flat.groupBy(F.col("__h.rule").alias("rule")).agg(F.count("*").alias("texts"), F.count_distinct(title).alias("titles"))
