"""The registered queries against SQL, brute force and held-out labels on the smallest tables; the pipeline's stages."""

import math

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from ledgerline.llm import queries
from ledgerline.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    assert got.columns == want.columns
    plain = lambda rows: sorted((tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows), key=repr)
    assert plain(got.collect()) == plain(want.fetchall())


def test_all_queries(spark):
    import __spark_entry__ as entry_points

    names = entry_points.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 14)} and "pipeline" in names


@pytest.mark.parametrize("name, label", [("op3_toxicity", "toxic"), ("op7_quality", "quality")])
def test_held_out_accuracy(spark, name, label):
    sf = "/root/testdata/sf0.1"
    got = queries.queries()[name](spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    y = got[label].to_numpy()
    rank = got["score"].rank().to_numpy()
    auc = (rank[y == 1].mean() - rank[y == 0].mean()) / len(y) + 0.5
    assert auc > 0.96
    if label == "toxic":
        hit = (got["predicted"] == 1).to_numpy()
        assert hit[y == 1].sum() >= 80 and hit[y == 0].sum() <= 10  # of 120 and 870
    assert ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, SF), f"test-{name}")
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= kept and len(ids) > 0.8 * len(kept)
        kept = set(ids)
        if name != "byte_bpe":
            assert docs.columns == columns
    row = docs.first()
    assert len(np.frombuffer(row.token_ids, dtype="<u4")) == row.n_tokens


def test_pipeline_drops_what_op3_predicts_toxic(spark):
    sf = "/root/testdata/sf0.1"
    left = corpus_pipeline.drop_toxic(spark, table(spark, sf, "documents"), sf)
    clean = queries.queries()["op3_toxicity"](spark, sf).where("predicted = 0")
    assert {r.doc_id for r in left.select("doc_id").collect()} == {r.doc_id for r in clean.select("doc_id").collect()}
