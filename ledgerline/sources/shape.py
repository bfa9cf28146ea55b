"""What JSON payloads look like, without their values, and which of them are as agreed."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of types as they are reported.
TYPES = ("object", "array", "string", "number", "boolean", "null")


@dataclass(frozen=True)
class Agreed:
    """core: keys that every object has; allowed: other keys; types: the types a key may have beside null; some: keys that at least one
    object has, since the sender leaves out empty ones."""

    core: tuple[str, ...]
    allowed: tuple[str, ...] = ()
    types: dict[str, tuple[str, ...]] = field(default_factory=dict)
    some: tuple[str, ...] = ()


def parsed(payload: Column) -> Column:
    """The payload as a variant; null if it is no JSON."""
    return F.try_parse_json(payload)


def type_name(schema: Column) -> Column:
    """One of TYPES for the type text of a variant."""
    s = F.upper(schema)
    return (F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null")
            .when(s.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "number"))


def _entries(variant: Column) -> Column:
    """(key, type) of the top level of an object as an array of structs; null for anything else."""
    schema = F.schema_of_variant(variant)
    return F.when(schema.startswith("OBJECT"), F.transform(F.map_entries(F.try_variant_get(variant, "$", "map<string,variant>")), lambda e: F.struct(e["key"].alias("key"), type_name(F.schema_of_variant(e["value"])).alias("type"))))


def describe(df: DataFrame, payload: str) -> DataFrame:
    """(key, type, rows): how often each key of the payloads' top level has a value of which type; key null for payloads that are no
    object, with their own type (`broken` for no JSON). No value gets into the result."""
    v = parsed(F.col(payload))
    rows = df.select(F.coalesce(_entries(v), F.array(F.struct(F.lit(None).cast("string").alias("key"), F.coalesce(type_name(F.schema_of_variant(v)), F.lit("broken")).alias("type")))).alias("e"))
    return rows.select(F.explode("e").alias("e")).groupBy("e.key", "e.type").agg(F.count("*").alias("rows"))


def checked(df: DataFrame, payload: str, agreed: Agreed) -> DataFrame:
    """df with `problems`: what is wrong with each payload, in order: `broken`, `no object`, `missing <key>`, `unknown <key>`, `type <key>`."""
    v = parsed(F.col(payload))
    entries = _entries(v)
    keys = F.transform(entries, lambda e: e["key"])
    known = F.array(*[F.lit(k) for k in (*agreed.core, *agreed.allowed)])
    missing = F.transform(F.array_except(F.array(*[F.lit(k) for k in agreed.core]), keys), lambda k: F.concat(F.lit("missing "), k))
    unknown = F.transform(F.array_sort(F.array_except(keys, known)), lambda k: F.concat(F.lit("unknown "), k))
    out = F.array().cast("array<string>")
    for key, types in agreed.types.items():
        wrong = F.exists(entries, _is_wrong(key, types))
        out = F.concat(out, F.when(wrong, F.array(F.lit(f"type {key}"))).otherwise(F.array().cast("array<string>")))
    problems = F.when(v.isNull(), F.array(F.lit("broken"))).when(entries.isNull(), F.array(F.lit("no object"))).otherwise(F.concat(missing, unknown, out))
    return df.withColumn("problems", problems)


def _is_wrong(key: str, types: tuple[str, ...]):
    def test(e: Column) -> Column:
        return (e["key"] == key) & ~e["type"].isin(*types, "null")

    return test


def absent(df: DataFrame, payload: str, agreed: Agreed) -> DataFrame:
    """(key) of those keys of `some` that no payload of a table that is not empty has: their name is probably wrong."""
    entries = _entries(parsed(F.col(payload)))
    wanted = F.array(*[F.lit(k) for k in agreed.some]).cast("array<string>")
    per = df.select(F.coalesce(F.array_intersect(F.transform(entries, lambda e: e["key"]), wanted), F.array().cast("array<string>")).alias("k"), F.lit(1).alias("one"))
    seen = per.select("one", F.explode_outer("k").alias("k")).groupBy("one").agg(F.collect_set("k").alias("seen"))  # of the named keys only
    return seen.select(F.explode(F.array_except(wanted, F.col("seen"))).alias("key"))


def projected(payload: Column, agreed: Agreed) -> Column:
    """The payload's agreed keys as a map of JSON texts, others left out; keys that it lacks are not made."""
    keys = F.array(*[F.lit(k) for k in (*agreed.core, *agreed.allowed)])
    m = F.try_variant_get(parsed(payload), "$", "map<string,variant>")
    return F.transform_values(F.map_filter(m, lambda k, _: F.array_contains(keys, k)), lambda _, v: F.to_json(v))
