"""Queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, decontaminate, exact_topk, kd_shards, line_dedup, merkle, near_dedup, quality, token_files, toxicity, warc, word_bpe, word_runs
from .common import ready

Query = Callable[[SparkSession, str], DataFrame]

_OPERATORS: list[Query] = [
    byte_bpe.op1_byte_bpe,
    near_dedup.op2_near_dedup,
    toxicity.op3_toxicity,
    warc.op4_warc,
    token_files.op5_token_files,
    exact_topk.op6_exact_topk,
    quality.op7_quality,
    line_dedup.op8_line_dedup,
    kd_shards.op9_kd_shards,
    decontaminate.op10_decontaminate,
    word_runs.op11_word_runs,
    word_bpe.op12_word_bpe,
    merkle.op13_merkle_manifest,
]


#: Rows of an Arrow batch where many at once serve: vectors are searched, and distinct words encoded, by the batch.
_BATCH_ROWS = {"op5_token_files": 10_000, "op6_exact_topk": 10_000}


def _shipped(query: Query) -> Query:
    return lambda spark, sf_dir: query(ready(spark, _BATCH_ROWS.get(query.__name__, 1_000)), sf_dir)


def queries() -> dict[str, Query]:
    return {f.__name__: _shipped(f) for f in _OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": warc.ORACLE, "op6_exact_topk": exact_topk.ORACLE, "op8_line_dedup": line_dedup.ORACLE, "op11_word_runs": word_runs.ORACLE, "op13_merkle_manifest": merkle.ORACLE}
