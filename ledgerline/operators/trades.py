"""Repeat sales: the trades that count, pairs of consecutive trades of a house, and what an official index says of the same pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import money

# Fixed values of the register: the mark of a cancelled row, the word for a brokered deal.
CANCELLED, BROKERED = "O", "중개거래"


def trades(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Raw contract rows as trades: not cancelled, brokered, of contract months first to last (yyyymm): the columns of rows, with
    `ym`, `day` and `amount`. An amount that is no number, or a day that is none, ends the query: a wrong trade would stand in every
    figure after it."""
    ym = F.col("dealYear").cast("int") * 100 + F.col("dealMonth").cast("int")
    kept = rows.where(~F.coalesce(F.col("cdealType") == CANCELLED, F.lit(False)) & (F.col("dealingGbn") == BROKERED)).withColumn("ym", ym).where(F.col("ym").between(first, last))
    amount = money(F.col("dealAmount"), None)
    day = F.try_to_timestamp(F.format_string("%06d%02d", "ym", F.col("dealDay").cast("int")), F.lit("yyyyMMdd")).cast("date")
    bad = lambda what, c: F.raise_error(F.concat(F.lit(f"no {what}: "), F.coalesce(c.cast("string"), F.lit("null"))))
    return kept.withColumns({"amount": F.when(amount > 0, amount).otherwise(bad("amount", F.col("dealAmount"))), "day": F.coalesce(day, bad("day", F.col("dealDay")))})


def house_pairs(deals: DataFrame, house: list[str], day: str, month: str, amount: str, order: list[str], min_gap: int, most: float) -> DataFrame:
    """(house, month_a, month_b, gap, change, outlier) of neighbouring trades of a house at least min_gap days apart; change is the log of the
    later price over the earlier; beyond a factor `most`, either way, it is an outlier. `order` settles trades of one day."""
    w = Window.partitionBy(*house).orderBy(day, *order)
    pairs = deals.withColumns({"__m": F.lead(month).over(w), "__d": F.lead(day).over(w), "__a": F.lead(amount).over(w)})
    out = pairs.select(*house, F.col(month).alias("month_a"), F.col("__m").alias("month_b"), F.datediff("__d", day).alias("gap"), F.ln(F.col("__a") / F.col(amount)).alias("change"))
    return out.where(F.col("gap") >= min_gap).withColumn("outlier", F.abs("change") > F.log(F.lit(float(most))))


def index_changes(pairs: DataFrame, index: DataFrame, keys: list[str], month: str, value: str) -> DataFrame:
    """pairs with `official`, the log change of the index between their months; null where a month is missing or later than the series'."""
    at = lambda name, out: index.select(*keys, F.col(month).alias(name), F.col(value).alias(out))
    both = pairs.join(at("month_a", "__ia"), [*keys, "month_a"], "left").join(at("month_b", "__ib"), [*keys, "month_b"], "left")
    return both.withColumn("official", F.when((F.col("__ia") > 0) & (F.col("__ib") > 0), F.ln(F.col("__ib") / F.col("__ia")))).drop("__ia", "__ib")


def repeat_table(pairs: DataFrame, keys: list[str], house: list[str], least: int, outlier_share: float) -> DataFrame:
    """(keys, before, excluded, pairs, houses, qualified, many_outliers, change, gap, official, official_pairs, official_dropped, difference) of
    index_changes() pairs: medians over pairs that are no outliers, null without any."""
    kept = ~F.col("outlier")
    only = lambda c: F.when(kept, c)
    per = pairs.groupBy(*keys).agg(
        F.count("*").alias("before"), F.count_if("outlier").alias("excluded"), F.count_if(kept).alias("pairs"), F.count_distinct(only(F.struct(*house))).alias("houses"),
        F.median(only(F.col("change"))).alias("change"), F.median(only(F.col("gap"))).alias("gap"), F.median(only(F.col("official"))).alias("official"),
        F.count(only(F.col("official"))).alias("official_pairs"), F.count_if(kept & F.col("official").isNull()).alias("official_dropped"))
    return per.withColumns({"qualified": F.col("pairs") >= least, "many_outliers": F.col("excluded") / F.col("before") > outlier_share, "difference": F.col("change") - F.col("official")})


def stable_ids(df: DataFrame, key: str, aliases: DataFrame, old: str, new: str, name: str) -> DataFrame:
    """df with `name`: what key stands for by a table of aliases() (old, new), itself where it is none."""
    known = aliases.select(F.col(old).alias("__old"), F.col(new).alias("__new"))
    return df.join(known, F.col(key) == F.col("__old"), "left").withColumn(name, F.coalesce("__new", key)).drop("__old", "__new")


def aliases(table: DataFrame, old: str, new: str) -> DataFrame:
    """(old, new) with every old id led to the end of its chain, in rounds that double what a step covers; ids on a circle, and those
    that lead to one, stand for the circle's smallest id. Of several news of one old id the smallest counts."""
    from ..session import checkpointed

    named = table.where(F.col(old).isNotNull() & F.col(new).isNotNull() & (F.col(old) != F.col(new)))
    step = checkpointed(named.groupBy(F.col(old).alias("o")).agg(F.min(F.col(new)).alias("n")).withColumn("least", F.col("n")))
    for _ in range(step.count().bit_length()):
        on = step.select(F.col("o").alias("n"), F.col("n").alias("far"), F.col("least").alias("far_least"))
        step = checkpointed(step.join(on, "n", "left").select("o", F.coalesce("far", "n").alias("n"), F.least("least", F.coalesce("far_least", "least")).alias("least")))
    # every place is now an end, which is no old id, or on a circle, all of which its row has met
    ends = step.select(F.col("o").alias("n"), F.col("least").alias("circle"))
    return step.drop("least").join(ends, "n", "left").select(F.col("o").alias(old), F.coalesce("circle", "n").alias(new))
