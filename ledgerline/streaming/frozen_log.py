"""The forecast log as a table that micro-batches add to and nothing changes.

What is stored is facts, each true once: a forecast made, a drift filled, a score given, an index value as a build brought it. A
writer's epoch has a folder of its own, which a repeated epoch replaces, and adds only facts whose key no other epoch has: so
replays leave the log as it was, and several streams may write beside each other. Should two writers give one key in the
same moment, the earlier day counts, then the writer's name, then the epoch, for every reader alike.

Reading puts the facts together: one shuffle by key. compacted() writes the facts that count as one folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import forecasts

_KEY = "region string, origin int, h int"
#: Kinds of facts with their columns beside the writer and epoch, which are folders.
FACTS = {
    "made": f"{_KEY}, target int, change double, drift double, low double, high double, day date",
    "drift": f"{_KEY}, drift double, day date",
    "score": f"{_KEY}, actual double, day date",
    "index": "region string, m int, y double, day date",
}
_KEYS = {"made": ["region", "origin", "h"], "drift": ["region", "origin", "h"], "score": ["region", "origin", "h"], "index": ["region", "m", "day"]}


class FrozenLog:
    """A log under `root`, a folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def facts(self, kind: str) -> DataFrame:
        """The facts that count, one per key, with writer and epoch."""
        schema = f"{FACTS[kind]}, writer string, epoch long"
        try:
            rows = self.spark.read.schema(schema).parquet(f"{self.root}/{kind}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)
        first = F.row_number().over(Window.partitionBy(*_KEYS[kind]).orderBy("day", "writer", "epoch"))
        return rows.withColumn("__n", first).where("__n = 1").drop("__n")

    def _add(self, kind: str, rows: DataFrame, writer: str, epoch: int) -> None:
        """Write the rows whose key no other epoch has as this writer's epoch."""
        others = self.facts(kind).where(~((F.col("writer") == writer) & (F.col("epoch") == epoch))).select(*_KEYS[kind])
        cols = [c.split()[0] for c in FACTS[kind].split(", ")]
        new = rows.select(*cols).join(others, _KEYS[kind], "left_anti")
        new.write.mode("overwrite").parquet(f"{self.root}/{kind}/writer={writer}/epoch={epoch}")

    def entries(self) -> DataFrame:
        """The log: forecasts as made, drift and the day it was filled if it was, result and the day of it if there is one."""
        key = _KEYS["made"]
        made = self.facts("made").drop("writer", "epoch", "day")
        drift = self.facts("drift").select(*key, F.col("drift").alias("__drift"), F.col("day").alias("__day"))
        score = self.facts("score").select(*key, "actual", F.col("day").alias("scored_on"))
        both = made.join(drift, key, "left").join(score, key, "left")
        own = F.col("drift").isNotNull()
        return both.select(*key, "target", "change", F.coalesce("drift", "__drift").alias("drift"), "low", "high", F.when(~own, F.col("__day")).alias("drift_added_on"), "actual", "scored_on")

    def add_forecasts(self, batch: DataFrame, writer: str, epoch: int) -> None:
        """Forecasts (those of FACTS["made"]): the first of a key counts, without a change it is none."""
        rows = batch.where("change IS NOT NULL")
        first = F.row_number().over(Window.partitionBy(*_KEYS["made"]).orderBy("day", "target", "change", "drift", "low", "high"))
        self._add("made", rows.withColumn("__n", first).where("__n = 1"), writer, epoch)

    def add_release(self, batch: DataFrame, writer: str, epoch: int) -> None:
        """Index values (region, m, y the log value, day of the release): stored, and every entry that now has the values of both
        its months is scored by what the first release with both said."""
        rows = batch.groupBy("region", "m", "day").agg(F.max("y").alias("y"))
        self._add("index", rows, writer, epoch)
        self._score(writer, epoch)

    def score(self, writer: str, epoch: int) -> None:
        """Score what the stored releases allow: for entries that came after their months' values."""
        self._score(writer, epoch)

    def _score(self, writer: str, epoch: int) -> None:
        own = (F.col("writer") == writer) & (F.col("epoch") == epoch)
        known = self.facts("score").where(~own).select(*_KEYS["score"])
        open_ = self.entries().drop("actual", "scored_on").join(known, _KEYS["score"], "left_anti")
        blank = open_.withColumns({"actual": F.lit(None).cast("double"), "scored_on": F.lit(None).cast("date")})
        scored = forecasts.frozen(blank, self.facts("index"), ["region"], "m", "day", "y").where("actual IS NOT NULL")
        self._add("score", scored.withColumn("day", F.col("scored_on")), writer, epoch)

    def fill_drift(self, baseline: DataFrame, day, writer: str, epoch: int) -> None:
        """Drifts (region, origin, h, drift) for entries made without one, stamped with the day; filled once."""
        bare = self.facts("made").where("drift IS NULL").select(*_KEYS["made"])
        rows = baseline.where("drift IS NOT NULL").join(bare, _KEYS["made"], "left_semi").withColumn("day", F.lit(day).cast("date"))
        self._add("drift", rows, writer, epoch)

    def sink(self, add: Callable[[DataFrame, str, int], None], writer: str) -> Callable[[DataFrame, int], None]:
        """add as a function for foreachBatch of the stream that `writer` names."""
        return lambda batch, epoch: add(batch, writer, epoch)

    def compacted(self, root: str) -> "FrozenLog":
        """A log under another root with the facts that count; writers go on there with new names or later epochs."""
        for kind in FACTS:
            rows = self.facts(kind)
            rows.write.partitionBy("writer", "epoch").mode("errorifexists").parquet(f"{root.rstrip('/')}/{kind}")
        return FrozenLog(self.spark, root)
