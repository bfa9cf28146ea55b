"""What the queries share: reading the tables, days as numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day_number(c: Column) -> Column:
    return F.unix_date(c.cast("date"))


def r(c: Column, digits: int = 4) -> Column:
    return F.round(c, digits)
