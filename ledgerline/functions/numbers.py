"""Parsing of numbers and dates as text, rounding, bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(c: Column, blank: int | None = 0) -> Column:
    """A whole amount with thousands commas; blank text gives `blank`, other text that is no number null."""
    text = F.trim(F.replace(c.cast("string"), F.lit(","), F.lit("")))
    return F.when(text == "", F.lit(blank).cast("long")).otherwise(text.try_cast("double").cast("long"))


def number_or_zero(c: Column) -> Column:
    """A number; null, blank and bad text are 0."""
    return F.coalesce(F.trim(F.regexp_replace(c.cast("string"), ",", "")).try_cast("double"), F.lit(0.0))


def filled(c: Column) -> Column:
    """Whether a text is neither null nor blank."""
    return F.coalesce(F.trim(c) != "", F.lit(False))


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounding of ties toward plus infinity; Spark's round() goes away from zero."""
    k = 10**digits
    return F.floor(x * k + 0.5) / k


def fixed(x: Column, digits: int) -> Column:
    """Rounding of the decimal value, ties away from zero."""
    return F.round(x, digits)


def short_date(c: Column) -> Column:
    """A date from yy.MM.dd; anything else, or a day that the month lacks, is null."""
    return F.when(c.rlike(r"^\d{2}\.\d{2}\.\d{2}$"), F.try_to_timestamp(F.concat(F.lit("20"), c), F.lit("yyyy.MM.dd")).cast("date"))


def rolled_date(year: Column, month: Column, day: Column) -> Column:
    """A date from three numbers; days beyond the month's end run on into the next."""
    first = F.to_date(F.format_string("%04d-%02d-01", year.cast("int"), month.cast("int")))
    return F.date_add(first, day.cast("int") - 1)


def band(x: Column, edges: list[float], closed: str = "left") -> Column:
    """The number of edges at or below x (closed left: [lo, hi)) or below x (closed right: (lo, hi]); null for null."""
    hits = [(x >= e) if closed == "left" else (x > e) for e in edges]
    return F.when(x.isNotNull(), sum((h.cast("int") for h in hits), F.lit(0)))


def band_floor(x: Column, width: int, least: int, most: int) -> Column:
    """The lower end of x's band of equal width; all below `least` and from `most` on share a band each."""
    return F.when(x < least, F.lit(0)).when(x >= most, F.lit(most)).otherwise(F.floor(x / width) * width).cast("long")


def at_most(a: Column, b: Column, per_mille: int) -> Column:
    """a <= b * per_mille / 1000 in whole numbers."""
    return a * 1000 <= b * per_mille
