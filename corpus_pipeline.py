"""The corpus pipeline: toxicity, line dedup, near-dedup, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and
reads it again for the next. All stages but the last return the columns of documents; where a stage changes a text it
sets n_chars anew. The last returns the ids of each text that is left.

Cases: null and empty texts pass through every stage and end without tokens; rows with a null id are never copies of
others and lose no line; rows with one id are one document, which goes or stays with all its rows; an empty table gives
an empty table; columns beside those of documents pass through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import byte_bpe, decontaminate, line_dedup, near_dedup, toxicity
from ledgerline.llm.common import kept_only, ready, staged, table
from ledgerline.llm.labelled import fold

#: Documents with a toxicity of at least this go: those that op3_toxicity predicts toxic.
TOXIC = toxicity.THRESHOLD


def _same_columns(new: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, n_chars counted anew where there is one."""
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return new.select(*[f"`{c}`" for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(ready(spark), sf_dir, "labels"), fold("doc_id", 4) != 2)
    scored = toxicity.toxicity(docs, model, score_col="__ll_toxicity", evidence_col=None)
    return scored.where(F.col("__ll_toxicity") < TOXIC).select(*[f"`{c}`" for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _same_columns(line_dedup.line_dedup(docs, counts=("__ll_n", "__ll_gone_n")), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return near_dedup.one_of_each(docs).select(*[f"`{c}`" for c in docs.columns])


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _same_columns(decontaminate.decontaminate(docs, table(ready(spark), sf_dir, "benchmark")), docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, pattern, decoded_col="decoded")
    return out.select("doc_id", "lang", "source", "n_tokens", "token_ids", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_benchmark),
    ("byte_bpe", tokenize),
]

#: No SQL expresses the classifier or the tokenizer; a test holds the rows of run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage's table. A stage's input, and what the stage itself staged, is deleted once its output is written."""
    docs = table(ready(spark), sf_dir, "documents")
    with kept_only(spark) as (made, drop):
        for name, stage in STAGES:
            docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
            drop(but=made[-1:])
    return docs
