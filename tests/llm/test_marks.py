"""The bitmap of ids that keeps most rows of near-dedup out of the join with candidates."""

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import near_dedup


@pytest.mark.parametrize("marks", [near_dedup.MARKS, 3])
def test_marked_keeps_all_and_little_else(spark, monkeypatch, marks):
    monkeypatch.setattr(near_dedup, "MARKS", marks)
    rows = spark.range(-5000, 5000).withColumn("text", F.lit("x")).union(spark.sql("SELECT CAST(NULL AS BIGINT), 'n'"))
    got = [r.id for r in near_dedup._marked(rows, spark.range(-5000, 5000, 50)).collect()]
    assert len(got) == len(set(got)) and set(got) >= set(range(-5000, 5000, 50))
    assert marks == 3 or len(got) < 250
    assert near_dedup._marked(rows, spark.range(0)).collect() == []


def test_texts_are_marked_before_their_join(spark, monkeypatch):
    seen, own = [], near_dedup.sets_of
    monkeypatch.setattr(near_dedup, "sets_of", lambda docs, words: seen.append(docs) or own(docs, words))
    docs = spark.createDataFrame([(i, f"only {i} here {i * i}") for i in range(300)] + [(900 + i, "a text of six words twice") for i in range(2)] + [(950 + i, f"w{i % 2} a b c d e f g h i j k l m n o p q r s t u v w x y z") for i in range(4)], "doc_id long, text string")
    got = {r.id: r.component_id for r in near_dedup.near_groups(docs, words=2).collect()}
    assert got[901] == 900 and got[951] in (950, 951) and got[7] == 7
    assert "__marks" in seen[0]._jdf.queryExecution().optimizedPlan().toString()
