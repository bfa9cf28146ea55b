"""Reports: many products as one table of labelled, suppressed cells, ranked parts within ranked groups, and their CSV files."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up

#: Rows below which a cell is blank whatever its table asks.
MIN_CELL = 3
CELL = "section int, line int, row string, place int, column string, value double, n bigint, text string"


@dataclass(frozen=True)
class Measure:
    """A column of a section: what it shows, how many rows stand behind it (none: it is a count itself), from how many on, and digits."""

    name: str
    value: Column
    n: Column | None = None
    least: int = 0
    digits: int = 0


def shown(value: Column, digits: int) -> Column:
    """A number with thousands commas and up to so many digits, without zeros at the end."""
    v = half_up(value, digits)
    whole = F.format_number(v, digits)
    return F.regexp_replace(whole, r"\.?0+$", "") if digits else whole


def section(df: DataFrame, number: int, row: list[Column], order: list[Column], measures: Sequence[Measure]) -> DataFrame:
    """The cells of one product: a line per group of df (by `row`, shown joined by ` / `), in `order` over the groups, a cell per measure. Cells
    without a value, or with fewer rows than MIN_CELL or the measure asks, are blank: value and text null, n as it is. A product's
    groups are a table that a reader can take in; the line numbers need them in one place."""
    names = [f"__r{k}" for k in range(len(row))]
    sums = []
    for k, m in enumerate(measures):
        sums += [m.value.cast("double").alias(f"__v{k}"), (m.value if m.n is None else m.n).cast("long").alias(f"__n{k}")]
    per = df.groupBy(*[c.alias(n) for c, n in zip(row, names)]).agg(*sums, *[o.alias(f"__o{k}") for k, o in enumerate(order)])
    line = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*[F.col(f"__o{k}") for k in range(len(order))], *names))
    per = per.withColumn("__line", line)
    cells = []
    for k, m in enumerate(measures):
        enough = F.col(f"__n{k}") >= max(MIN_CELL, m.least)
        v = F.when(enough, half_up(F.col(f"__v{k}"), m.digits))
        cells.append(F.struct(F.lit(k + 1).alias("place"), F.lit(m.name).alias("column"), v.alias("value"), F.col(f"__n{k}").alias("n"), F.when(enough, shown(F.col(f"__v{k}"), m.digits)).alias("text")))
    label = F.concat_ws(" / ", *[F.coalesce(F.col(n).cast("string"), F.lit("-")) for n in names])
    return per.select(F.lit(number).alias("section"), F.col("__line").alias("line"), label.alias("row"), F.explode(F.array(*cells)).alias("c")).select("section", "line", "row", "c.*")


def report(sections: Sequence[DataFrame]) -> DataFrame:
    """All sections' cells as one table."""
    return reduce(DataFrame.unionByName, sections)


def blanks(cells: DataFrame) -> DataFrame:
    """(section, cells, blank): how much of each section is suppressed."""
    return cells.groupBy("section").agg(F.count("*").alias("cells"), F.count_if(F.col("text").isNull()).alias("blank"))


def csv_lines(cells: DataFrame) -> DataFrame:
    """(section, line, csv): the sections as lines of CSV, line 0 the header; numbers without commas, blanks empty, quotes where needed."""
    quoted = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    plain = F.coalesce(F.regexp_replace("text", ",", ""), F.lit(""))
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", c.alias("c")))), lambda x: x["c"]), ",")  # noqa: E731  a line's cells
    rows = cells.groupBy("section", "line", "row").agg(ordered(plain).alias("__c")).select("section", "line", F.concat_ws(",", quoted(F.col("row")), "__c").alias("csv"))
    heads = cells.select("section", "place", "column").distinct().groupBy("section").agg(ordered(quoted(F.col("column"))).alias("__c"))
    return heads.select("section", F.lit(0).alias("line"), F.concat(F.lit("row,"), F.col("__c")).alias("csv")).unionByName(rows)


def write_csv(cells: DataFrame, root: str) -> None:
    """One CSV file per section under root/section=<n>: a section's lines go to one task, in order."""
    lines = csv_lines(cells).repartition("section").sortWithinPartitions("section", "line")
    lines.select("section", "csv").write.mode("overwrite").partitionBy("section").text(root)


def top_within_top(df: DataFrame, group: str, part: str, groups: int, parts: int, extra: dict[str, Column]) -> DataFrame:
    """(place, group, n, parts, extra...) of the `groups` groups with the most rows, ties by name, and their `parts` most frequent parts in
    order; extra: other figures of a group. Counts are taken per (group, part) first, so only their sums are ranked."""
    per = df.groupBy(group, part).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(group).orderBy(F.desc("__n"), part)
    some = per.withColumn("__k", F.row_number().over(w)).where(F.col(part).isNotNull() & (F.col("__k") <= parts))
    names = some.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", part))), lambda x: x[part]).alias("parts"))
    own = df.groupBy(group).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in extra.items()]).where(F.col(group).isNotNull())
    first = own.orderBy(F.desc("n"), group).limit(groups)
    # as many rows as groups are asked for
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), group))
    return first.withColumn("place", place).join(names, group, "left").select("place", group, "n", "parts", *extra)


def latest_point(df: DataFrame, keys: list[str], month: str, value: str, now: int, oldest: int) -> DataFrame:
    """(keys, month, value) of the latest month index with a value that is at most `oldest` months before now; groups without one are left out."""
    return df.where(F.col(value).isNotNull() & F.col(month).between(now - oldest, now)).groupBy(*keys).agg(F.max(month).alias(month), F.max_by(value, month).alias(value))


def in_band(files: DataFrame, group: str, cells: str, levels: list[str], low: float, high: float, n: str = "n", middle: str = "middle") -> DataFrame:
    """(group, levels..., n, middle, place) of nested maps of cells (struct with n and middle), one level of names after the other: the cells whose
    middle is in [low, high), in each group by falling n, then middle, then names. Empty maps and null cells have no rows."""
    flat = files.select(group, F.col(cells).alias("__m"))
    for k, name in enumerate(levels):
        flat = flat.select(group, *levels[:k], F.explode("__m").alias(name, "__m"))
    rows = flat.select(group, *levels, F.col(f"__m.{n}").alias(n), F.col(f"__m.{middle}").alias(middle)).where((F.col(middle) >= low) & (F.col(middle) < high))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(n), middle, *levels)))
