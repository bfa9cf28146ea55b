"""Every query with SQL against DuckDB on the smallest tables; the others for rows."""

import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry_points
from ledgerline import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (bool, str)):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T00:00:00", "")
    return round(float(v), 5)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(name, spark, duck):
    got = catalog.queries()[name](spark, SF)
    rows = got.collect()
    if name not in catalog.oracle_sql():
        assert rows
        return
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got.columns, rows) == _rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["p_brand", "cells", "change"]


def test_titles_kept_greedily_takes_whole_lines(spark, duck):
    form = lambda x: re.sub(r"[\W_]", "", re.sub(r"\[[^\]]*\]|\([^)]*\)", "", x)).lower()
    kept = []
    for i, x in duck.sql("SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) FROM documents ORDER BY doc_id").fetchall():
        f = form(x)
        g = {f[k:k + 2] for k in range(len(f) - 1)}
        if not any(g and h and 2 * len(g & h) / (len(g) + len(h)) >= 0.75 for _, _, h in kept):
            kept.append((i, x, g))
    got = catalog.queries()["titles_kept_greedily"](spark, SF).where("title IS NOT NULL").collect()
    assert sorted((r.doc_id, r.title) for r in got) == [(i, x) for i, x, _ in kept]
