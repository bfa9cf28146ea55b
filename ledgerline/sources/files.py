"""CSV, XML and JSON-lines readers with header checks; ledgers and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import key_hash


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None, strict: bool = False, encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header; quotes are doubled. strict fails on rows that don't fit, else they come as nulls."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("encoding", encoding).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    if schema is not None:
        reader = reader.schema(schema).option("enforceSchema", False)
    return reader.csv(path)


def with_header(df: DataFrame, aliases: dict[str, list[str]], optional: tuple[str, ...] = ()) -> DataFrame:
    """Columns renamed by lists of accepted names; unknown or missing columns are an error."""
    by_name = {n.strip().lstrip("﻿"): n for n in df.columns}
    chosen = {k: next((by_name[a] for a in [k, *names] if a in by_name), None) for k, names in aliases.items()}
    missing = [k for k, v in chosen.items() if v is None and k not in optional]
    unknown = sorted(set(df.columns) - {v for v in chosen.values() if v})
    if missing or unknown:
        raise ValueError(f"missing columns {missing}, unknown columns {unknown}")
    return df.select(*[F.col(f"`{v}`").alias(k) for k, v in chosen.items() if v])


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: StructType) -> DataFrame:
    """Rows of an XML page."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def unknown_fields(df: DataFrame, allowed: list[str]) -> list[str]:
    return sorted(set(df.columns) - set(allowed))


def write_ledger(df: DataFrame, path: str, *order: str) -> None:
    """Rows as JSON lines in a fixed order of columns and rows, gzip. A ledger is one small file by contract."""
    lines = df.select(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])).alias("value"), *[F.col(c).alias(f"__{c}") for c in order])
    lines.repartition(1).sortWithinPartitions(*[f"__{c}" for c in order]).select("value").write.mode("overwrite").option("compression", "gzip").text(path)


def figures_digest(df: DataFrame, *order: str) -> DataFrame:
    """(digest): 16 hex digits over all rows, in order, of a small table of figures."""
    row = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, row.alias("r")))), lambda x: x["r"]), "\n")
    return df.agg(key_hash(body).alias("digest"))


def within_budget(df: DataFrame, size: str, least: str, key: str, budget: int) -> DataFrame:
    """The rows that fit a budget of `size`, taken from the largest `least` down; ties by key.

    Sizes are summed in blocks of equal `least`, so the window runs over distinct values, not rows.
    """
    from pyspark.sql import Window

    sums = df.groupBy(least).agg(F.sum(size).alias("__s")).withColumn("__upto", F.sum("__s").over(Window.orderBy(F.desc(least))))
    full = df.join(sums.where(F.col("__upto") <= budget).select(least), least, "left_semi")
    edge = sums.where((F.col("__upto") > budget) & (F.col("__upto") - F.col("__s") < budget)).select(least, (F.col("__upto") - F.col("__s")).alias("__before"))
    rest = df.join(F.broadcast(edge), least).withColumn("__run", F.col("__before") + F.sum(size).over(Window.partitionBy(least).orderBy(key)))
    return full.select(*df.columns).unionByName(rest.where(F.col("__run") <= budget).select(*df.columns))
