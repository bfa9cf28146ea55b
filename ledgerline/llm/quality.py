"""Quality by compression: zstandard dictionaries of good and bad text.

A text is compressed with a dictionary of labelled good text and with one of bad text. The difference of the sizes per
byte of text says which it resembles; a logistic curve fitted on labelled texts that no dictionary has seen turns it
into a probability. Dictionaries and curve come from a bounded sample (labelled.PER_CLASS per class); every text is scored.

Cases: null and empty texts have difference 0 and the score of that; without labelled rows of both classes every
score is the share of good labels (0.5 without labels); other columns pass through, own output columns are replaced.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread, table, utf8
from .labelled import arrow_rows, fold, platt, sample, weights

DICTIONARY_BYTES = 112_640
LEVEL = 3
THRESHOLD = 0.3


@lru_cache(maxsize=4)
def _compressor(dictionary: bytes):
    import zstandard

    # the form without magic number, checksum, dictionary id and content size
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)


def difference(text: bytes, good: bytes, bad: bytes) -> float:
    """How many bytes less the good dictionary needs per byte of text."""
    return (len(_compressor(bad).compress(text)) - len(_compressor(good).compress(text))) / (len(text) + 1)


def _dictionary(texts: list[bytes]) -> bytes:
    import zstandard

    texts = [t for t in texts if t]
    size = min(DICTIONARY_BYTES, sum(map(len, texts)) // 8)
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little text to train on
        return b"\n".join(texts)[-DICTIONARY_BYTES:] or b"\n" * 8


class Model:
    """good, bad: dictionaries; scale, slope, offset: the curve."""

    def __init__(self, rows: list[tuple[bytes, int]], counts: tuple[int, int]):
        share = counts[1] / sum(counts) if sum(counts) else 0.5
        self.good = self.bad = b""
        self.scale, self.slope, self.offset = 1.0, 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        fit, rest = rows[::2], rows[1::2]
        if all({y for _, y in part} == {0, 1} for part in (fit, rest)):
            self.good, self.bad = (_dictionary([t for t, y in fit if y == k]) for k in (1, 0))
            x = np.array([difference(t, self.good, self.bad) for t, _ in rest])
            y = np.array([y for _, y in rest])
            self.scale = float(x.std()) or 1.0
            self.slope, self.offset = platt(x / self.scale, y, weights(y, counts))

    def score(self, text: bytes) -> float:
        x = difference(text, self.good, self.bad) if text and self.good else 0.0
        return float(1 / (1 + np.exp(-np.clip(self.slope * x / self.scale + self.offset, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", **options) -> Model:
    return Model(*sample(docs, labels, label, learn, **options))


def with_scores(docs: DataFrame, model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col; the model is of fixed size and is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.drop(score_col)
    schema = base.withColumn(score_col, F.lit(0.0)).schema

    def run(batches):
        own = shared.value
        for batch, texts in arrow_rows(batches, "__ll_text"):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([own.score(t) for t in texts], pa.float64())], names=[*batch.schema.names, score_col])

    return base.withColumn("__ll_text", utf8(text_col)).mapInArrow(run, schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    out = with_scores(spread(docs), model).drop("text")
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
