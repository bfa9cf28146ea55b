"""Months as numbers, Monday weeks, settled and closed periods, lease terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_index(d: Column) -> Column:
    """year * 12 + month - 1."""
    return F.year(d) * 12 + F.month(d) - 1


def month_of_index(i: Column) -> Column:
    """yyyymm of a month index, as a number."""
    return (F.floor(i / 12) * 100 + F.pmod(i, F.lit(12)) + 1).cast("int")


def shift_month(yyyymm: Column, k: int) -> Column:
    """yyyymm as a number, k months on."""
    return month_of_index(F.floor(yyyymm / 100) * 12 + F.pmod(yyyymm, F.lit(100)) - 1 + k)


def week_start(d: Column) -> Column:
    """The Monday of d's week."""
    return F.date_trunc("week", d).cast("date")


def week_settled(week: Column, now: Column, grace_days: int) -> Column:
    """Whether the week that starts on `week` ended at least grace_days before now."""
    return F.date_add(week, 7 + grace_days) <= now


def month_closed(d: Column, now: Column, grace_days: int = 30) -> Column:
    """Whether grace_days have passed since the end of d's month."""
    return F.date_add(F.last_day(d), 1 + grace_days) <= now


def local_day(ts: Column, zone: str = "Asia/Seoul") -> Column:
    """The calendar day of a UTC timestamp in a zone."""
    return F.from_utc_timestamp(ts, zone).cast("date")


def expiry_month(term: Column) -> Column:
    """yyyymm of the end of a term yy.mm~yy.mm or ~yy.mm; null if it ends before or when it starts, or is no term."""
    # the format of the register's terms, a fixed value
    pattern = r"^\s*(?:(\d{2})\.(\d{2}))?\s*~\s*(\d{2})\.(\d{2})\s*$"
    part = [F.nullif(F.regexp_extract(term, pattern, k), F.lit("")).cast("int") for k in range(1, 5)]
    start, end = part[0] * 100 + part[1], part[2] * 100 + part[3]
    good = part[3].between(1, 12) & (start.isNull() | (start < end))
    return F.when(good, 200000 + end)


def half_year(year: Column, month: Column) -> Column:
    """yyyyH1 or yyyyH2; yyyy? if the month isn't 1 to 12."""
    return F.concat(year.cast("string"), F.when(month.between(1, 6), "H1").when(month.between(7, 12), "H2").otherwise("?"))


def loose_day(c: Column) -> Column:
    """A day from yyyyMMdd or yyyy-MM-dd; null for other text and for days that no month has."""
    bare = F.when(F.trim(c).rlike(r"^(\d{8}|\d{4}-\d{2}-\d{2})$"), F.regexp_replace(F.trim(c), "-", ""))
    return F.try_to_timestamp(bare, F.lit("yyyyMMdd")).cast("date")


def day_gap(start: Column, end: Column) -> Column:
    """Whole days from start to end, halves up."""
    return F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 86_400_000_000 + 0.5).cast("long")


def weekdays_between(start: Column, end: Column) -> Column:
    """Days from Monday to Friday after start up to end; 0 if end is not after start."""
    n = F.greatest(F.datediff(end, start), F.lit(0))
    left = F.filter(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.when(k < n % 7, F.weekday(F.date_add(end, -k.cast("int"))))), lambda w: w < 5)
    return F.floor(n / 7) * 5 + F.size(left)


def window_start(now: Column, days: int = 183) -> Column:
    """The first day of a window that ends now."""
    return F.date_sub(now.cast("date"), days)


def month_label(d: Column) -> Column:
    """yy.M, as on an axis."""
    return F.concat(F.date_format(d, "yy"), F.lit("."), F.month(d))


def full_date(month_day: Column, now: Column) -> Column:
    """The latest day not after now that is written m/d."""
    part = [F.regexp_extract(month_day, r"^\s*(\d{1,2})/(\d{1,2})\s*$", k).try_cast("int") for k in (1, 2)]
    this, last = (F.try_to_timestamp(F.format_string("%04d-%02d-%02d", y, *part), F.lit("yyyy-MM-dd")).cast("date") for y in (F.year(now), F.year(now) - 1))
    return F.when(this <= now.cast("date"), this).otherwise(last)
