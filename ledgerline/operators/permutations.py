"""Permutation tests of rank correlation within strata, from sums over blocks of bounded size."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats

#: Rows of a block, about.
BLOCK_ROWS = 4096
#: Rounds that one task computes of a block at a time.
SLICE = 100


def shuffled(seed: int, stratum: str, block: int, round_: int, n: int) -> np.ndarray:
    """The permutation of a block's rows in a round; the same wherever it is drawn."""
    return np.random.Generator(np.random.PCG64([seed, zlib.crc32(stratum.encode()), block, round_])).permutation(n)


def rank_permutations(df: DataFrame, stratum: str, row_id: str, x: str, y: str, rounds: int, seed: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(round, rho): the within-stratum rank correlation as observed (round 0) and in each round, in which y was permuted.

    x and y are mean ranks within the stratum, less their mean; rho is the sum of their products over the root of the sums of
    squares, over all strata. Rows are permuted within blocks of a stratum: strata of up to block_rows rows are one block,
    larger ones are dealt into more by a seeded hash of row_id, so that no stratum is one task's; permutations within
    blocks are permutations within strata, which keeps the test exact. Blocks times slices of rounds are dealt to tasks, and only
    a sum per block and round comes back. Rows without stratum, id, x or y count nowhere; ids are distinct.
    """
    rows = df.select(F.col(stratum).cast("string").alias("s"), F.col(row_id).alias("i"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    sizes = rows.groupBy("s").agg(F.count("*").alias("n"))
    ranked = rows.join(stats.mean_ranks(rows, ["s"], "x", "rx"), ["s", "x"]).join(stats.mean_ranks(rows, ["s"], "y", "ry"), ["s", "y"]).join(sizes, "s")
    mean = (F.col("n") + 1) / 2
    block = F.pmod(F.xxhash64(F.lit(seed), "i"), F.ceil(F.col("n") / block_rows)).cast("int")
    centred = ranked.select("s", block.alias("b"), "i", (F.col("rx") - mean).alias("rx"), (F.col("ry") - mean).alias("ry"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "rx", "ry")))
    # about block_rows rows each
    blocks = centred.groupBy("s", "b").agg(ordered.alias("v")).select("s", "b", F.col("v.rx").alias("rx"), F.col("v.ry").alias("ry"))
    dealt = blocks.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(rounds), F.lit(SLICE))))
    dealt = dealt.repartition(df.sparkSession.sparkContext.defaultParallelism, "s", "b", "first")

    def run(batches):
        for batch in batches:
            at, sums = [], []
            for s, b, rx, ry, first in zip(*(batch.column(c).to_pylist() for c in ("s", "b", "rx", "ry", "first"))):
                rx, ry = np.array(rx), np.array(ry)
                for k in range(first, min(rounds, first + SLICE - 1) + 1):
                    at.append(k)
                    sums.append(float(rx @ (ry if k == 0 else ry[shuffled(seed, s, b, k, len(ry))])))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums, pa.float64())], names=["round", "xy"])

    per = dealt.mapInArrow(run, "round int, xy double").groupBy("round").agg(F.sum("xy").alias("xy"))
    scale = centred.agg(F.sqrt(F.sum(F.col("rx") * F.col("rx")) * F.sum(F.col("ry") * F.col("ry"))).alias("scale"))  # one row
    return per.join(F.broadcast(scale), F.lit(True)).select("round", F.try_divide("xy", F.when(F.col("scale") > 0, F.col("scale"))).alias("rho"))


def judged(rho: DataFrame) -> DataFrame:
    """(rho, rounds, p_two_sided, p_greater, low, high) of rank_permutations(): shares of rounds at least as far out, the observed one
    counted; low and high are the 2.5 % and 97.5 % quantiles of the rounds."""
    seen = F.max(F.when(F.col("round") == 0, F.col("rho")))
    whole = rho.select("round", "rho", F.lit(1).alias("__g"))
    one = whole.groupBy("__g").agg(seen.alias("rho"))  # one row
    drawn = whole.where("round > 0").select("__g", F.col("rho").alias("r"))
    eps = 1e-12  # sums in another order
    far: Column = F.abs("r") >= F.abs("rho") - eps
    out = drawn.join(F.broadcast(one), "__g").groupBy("__g", "rho").agg(
        F.count("*").alias("rounds"), F.count_if(far).alias("far"), F.count_if(F.col("r") >= F.col("rho") - eps).alias("above"), F.percentile("r", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return out.select("rho", "rounds", ((F.col("far") + 1) / (F.col("rounds") + 1)).alias("p_two_sided"), ((F.col("above") + 1) / (F.col("rounds") + 1)).alias("p_greater"), F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
