"""What a raw contract row is: parsing, predicates and projections over its text columns.

Raw columns: name, dong, area, amount, year, month, day, floor, built, dealing, cancel_type, cancel_day for sales;
deposit, rent, contract, prev_deposit, right for leases. All are text as delivered, blanks and nulls included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import filled, half_up, money

# The words of the register.
DIRECT, BROKERED, NEW, RENEWED, USED = "직거래", "중개거래", "신규", "갱신", "사용"


def cancelled(kind: Column, day: Column) -> Column:
    """Whether a contract was called off: its kind or its day is filled."""
    return filled(kind) | filled(day)


def cancelled_by_kind(kind: Column) -> Column:
    """The narrower rule that looks at the kind only."""
    return filled(kind)


def _named(text: Column, word: str) -> Column:
    return F.when(filled(text), F.trim(text) == word)


def direct(dealing: Column) -> Column:
    """True for deals without a broker, false for others, null where unknown."""
    return _named(dealing, DIRECT)


def brokered(dealing: Column) -> Column:
    """Whether a broker is known to have made the deal; unknown is false."""
    return F.coalesce(_named(dealing, BROKERED), F.lit(False))


def renewal(contract: Column) -> Column:
    """True for renewals, false for other contracts, null where unknown."""
    return _named(contract, RENEWED)


def is_new(contract: Column) -> Column:
    """Whether the text is the word for a new contract, to the letter."""
    return F.coalesce(contract == NEW, F.lit(False))


def digits_or_zero(text: Column) -> Column:
    """A whole number with thousands commas; 0 for anything else."""
    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), ",", ""))
    return F.coalesce(F.when(bare.rlike(r"^-?\d+$"), bare.try_cast("long")), F.lit(0).cast("long"))


def renewal_pair(contract: Column, prev_deposit: Column) -> Column:
    """A renewal whose earlier deposit is known."""
    return F.coalesce(renewal(contract), F.lit(False)) & filled(prev_deposit)


def right_used(right: Column) -> Column:
    return F.coalesce(F.trim(right) == USED, F.lit(False))


def pure_jeonse(deposit: Column, rent: Column) -> Column:
    """A deposit and no rent."""
    return (digits_or_zero(rent) == 0) & (digits_or_zero(deposit) > 0)


def pure_wolse(rent: Column) -> Column:
    return digits_or_zero(rent) > 0


def new_jeonse(contract: Column, deposit: Column, rent: Column) -> Column:
    return is_new(contract) & pure_jeonse(deposit, rent)


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns, each computed once a row: the planner repeats what withColumns() names wherever a filter or a later column
    uses it, up to methods that the JVM no longer compiles."""
    own = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*own, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _double(name: str) -> Column:
    return F.trim(F.col(name).cast("string")).try_cast("double")


def _whole(x: Column, least: int, most: int) -> Column:
    """A whole number from least to most, else null."""
    return F.when((x == F.floor(x)) & x.between(least, most), x.cast("int"))


def _common(raw: DataFrame, more: dict[str, Column]) -> DataFrame:
    """raw with `apt`, `sqm`, `date`, checked `floor` and `built`, and more, without rows that miss a name, an area or a date.
    Days are checked for their range only: the 31st of any month passes."""
    numbers = ("area", "year", "month", "day", "floor", "built")
    read = once(raw, {"apt": F.trim("name"), "dong": F.trim(F.coalesce("dong", F.lit("")))} | {f"__{c}": _double(c) for c in numbers} | more)
    whole = once(read, {
        "sqm": F.when(F.col("__area") > 0, half_up(F.col("__area"), 2)), "floor": F.when(F.col("__floor") > 0, F.col("__floor")), "built": _whole(F.col("__built"), 1901, 1 << 30),
        "__year": _whole(F.col("__year"), 1900, 2999), "__month": _whole(F.col("__month"), 1, 12), "__day": _whole(F.col("__day"), 1, 31)})
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    kept = whole.where(filled(F.col("apt")) & F.col("sqm").isNotNull() & F.col("__year").isNotNull() & F.col("__month").isNotNull() & F.col("__day").isNotNull())
    return kept.withColumn("date", F.concat_ws("-", F.col("__year").cast("string"), two("__month"), two("__day"))).drop(*[f"__{c}" for c in numbers])


def sale_rows(raw: DataFrame) -> DataFrame:
    """Sales with a positive amount: (…, apt, dong, sqm, date, floor, built, amount10k, direct)."""
    return _common(raw, {"amount10k": money(F.col("amount"), None), "direct": direct(F.col("dealing"))}).where(F.col("amount10k") > 0)


def rent_rows(raw: DataFrame) -> DataFrame:
    """Leases with a positive deposit: (…, deposit10k, rent10k or null, renewal)."""
    out = _common(raw, {"deposit10k": money(F.col("deposit"), None), "rent10k": money(F.col("rent"), 0), "renewal": renewal(F.col("contract"))})
    return out.withColumn("rent10k", F.when(F.col("rent10k") > 0, F.col("rent10k"))).where(F.col("deposit10k") > 0)


def market_rows(raw: DataFrame) -> DataFrame:
    """Live sales that are not known to be direct."""
    live = raw.where(~cancelled_by_kind(F.col("cancel_type")))
    return sale_rows(live).where(~F.coalesce("direct", F.lit(False)))


def record_rows(raw: DataFrame) -> DataFrame:
    """Live sales that are known to be brokered: what may set a record."""
    return sale_rows(raw.where(~cancelled_by_kind(F.col("cancel_type")) & brokered(F.col("dealing"))))


def change_rows(raw: DataFrame) -> DataFrame:
    """market_rows with `unit`, the price of a square metre."""
    return market_rows(raw).withColumn("unit", F.col("amount10k") / F.col("sqm"))


def nowcast_rows(raw: DataFrame) -> DataFrame:
    """Live sales, direct ones too, with `unit` and `cell`, name and rounded area."""
    live = sale_rows(raw.where(~cancelled(F.col("cancel_type"), F.col("cancel_day"))))
    return live.withColumns({"unit": F.col("amount10k") / F.col("sqm"), "cell": F.concat_ws("|", "apt", half_up(F.col("sqm")).cast("int"))})


def jeonse_rows(raw: DataFrame) -> DataFrame:
    """Leases without rent."""
    return rent_rows(raw).where(F.col("rent10k").isNull())


def area_between(sqm: Column, least: float = 82.0, most: float = 86.0) -> Column:
    """The band of the usual flat, both ends included."""
    return sqm.between(least, most)


def search(deals: DataFrame, **wanted) -> DataFrame:
    """deals that meet the wanted conditions; None means no condition.

    district, dong: equal; name: part of the name without blanks or case; least_price, most_price, least_area,
    most_area, built_since; without_direct: leaves out deals known to be direct.
    """
    conditions = {
        "district": lambda v: F.col("district") == v, "dong": lambda v: F.col("dong") == v,
        "name": lambda v: F.contains(F.lower(F.regexp_replace("apt", r"\s+", "")), F.lit("".join(v.split()).lower())),
        "least_price": lambda v: F.col("amount10k") >= v, "most_price": lambda v: F.col("amount10k") <= v,
        "least_area": lambda v: F.col("sqm") >= v, "most_area": lambda v: F.col("sqm") <= v,
        "built_since": lambda v: F.col("built") >= v, "without_direct": lambda v: ~F.coalesce("direct", F.lit(False)) if v else F.lit(True),
    }
    for name, value in wanted.items():
        if value is not None:
            deals = deals.where(conditions[name](value))
    return deals


def sample_grade(n: Column, age: Column, least: int = 3, enough: int = 5, recent: int = 90) -> Column:
    """enough or partial by count and days since the last deal; null below `least`."""
    return F.when(n >= least, F.when((n >= enough) & (age <= recent), "enough").otherwise("partial"))


def check_flags(n: Column, age: Column, median: Column, lines: tuple[int, ...] = (150_000, 250_000), margin: int = 5_000) -> Column:
    """What to look at: few_deals, stale_deal, and reg_line where the median is near a line of the loan rules."""
    near = [F.abs(median - x) <= margin for x in lines]
    flags = F.array(F.when(n < 5, "few_deals"), F.when(age > 90, "stale_deal"), *[F.when(c, F.lit(f"reg_line {x}")) for c, x in zip(near, lines)])
    return F.filter(flags, lambda x: x.isNotNull())
