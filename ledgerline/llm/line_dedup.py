"""Line dedup over levelled sorted runs.

The state is a set of runs in the shared folder. A run is a table sorted by line key: (k1, k2, n_docs, last_doc, fresh).
Documents come in batches of falling id. A batch is reduced to its own keys and merge-anti-joined with the keys that the
runs hold: a key never seen before enters with the largest id that holds it (`fresh`), and as later batches have smaller
ids, that document is the one that keeps the line. For a known key only the number of documents is added. When a level
holds `fanout` runs they are merged into one run of the next level, so a key is rewritten O(log batches) times.

Line keys are 128 bits (two independent xxhash64), so no line text is shuffled. Lines to drop are found by row, a row
being an id and a 128-bit key of its text.

Cases: null and empty texts have one empty line and stay; lines shorter than `min_chars` always stay; a line
that a document repeats counts once for it; rows with the same id count as one document, each loses its own lines, and
equal rows lose the same; rows with a null id count as one document and keep their lines; columns other than id and
text pass through, those named like the two counts excepted; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampType

from .common import scratch, staged

_SPACE = "' \\t\\n\\u000b\\f\\r'"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "k1 long, k2 long, n_docs long, last_doc {kind}, fresh boolean"


def _row(text: Column) -> list[Column]:
    """The key of a row's text."""
    return [F.xxhash64(text).alias("__ll_r1"), F.xxhash64(F.lit(1), text).alias("__ll_r2")]


def long_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40) -> DataFrame:
    """(doc, row key, pos, k1, k2) of each line whose key has at least min_chars code points."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(F.col(id_col).alias("doc"), *_row(text), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    keys = lines.withColumn("line", F.expr(f"btrim(line, {_SPACE})")).where(F.char_length("line") >= min_chars)
    low = F.translate("line", _UPPER, _LOWER)
    return keys.select("doc", "__ll_r1", "__ll_r2", "pos", F.xxhash64(low).alias("k1"), F.xxhash64(F.lit(1), low).alias("k2"))


class LineRuns:
    """Levelled sorted runs of line keys under one folder; kind: the ids' type."""

    def __init__(self, spark: SparkSession, fanout: int = 2, kind: str = "long"):
        self.spark, self.fanout, self.root, self.schema = spark, fanout, scratch(spark, "line-runs"), RUN.format(kind=kind)
        self.levels: list[list[str]] = [[]]
        self._made = 0

    def _write(self, rows: DataFrame, level: int) -> None:
        path = f"{self.root}/level{level}/run{self._made}"
        self._made += 1
        rows.repartition("k1", "k2").sortWithinPartitions("k1", "k2").write.option("compression", "zstd").parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def rows(self) -> DataFrame:
        """The rows of all runs; a key may have one in each."""
        paths = [p for level in self.levels for p in level]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def merged(self, rows: DataFrame | None = None) -> DataFrame:
        """One row per key over all runs."""
        first = F.max(F.when(F.col("fresh"), F.col("last_doc")))
        return (self.rows() if rows is None else rows).groupBy("k1", "k2").agg(F.sum("n_docs").alias("n_docs"), first.alias("last_doc"), F.max("fresh").alias("fresh"))

    def add(self, lines: DataFrame) -> None:
        """Add a batch of long_lines() rows; its documents have smaller ids than those of all earlier batches."""
        own = lines.select("k1", "k2", "doc").distinct().groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("last_doc"))
        if any(self.levels):
            # a key has one fresh row in all runs; the batch's rows without one are those of the anti-join
            held = self.rows().where("fresh").select("k1", "k2", F.lit(True).alias("held")).hint("merge")
            known = F.col("held").isNotNull()
            own = own.join(held, ["k1", "k2"], "left").select("k1", "k2", "n_docs", F.when(~known, F.col("last_doc")).alias("last_doc"), (~known).alias("fresh"))
        else:
            own = own.withColumn("fresh", F.lit(True))
        self._write(own, 0)
        self._compact(0)

    def _compact(self, level: int) -> None:
        if len(self.levels[level]) < self.fanout:
            return
        runs, self.levels[level] = self.levels[level], []
        self._write(self.merged(self.spark.read.schema(self.schema).parquet(*runs)), level + 1)
        self._compact(level + 1)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 2, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with text_col without the repeated lines, and the two `counts`: lines before dropping, lines dropped.

    A line key of at least min_chars code points that min_docs documents hold loses its lines in all of them
    but the one with the largest id. The documents are ingested in `batches` ranges of falling id; the ranges' bounds
    are approximate quantiles of the ids, which changes their sizes only. Ids without quantiles (strings) are one batch.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, (NumericType, DateType, TimestampType)):
        batches = 1
    lines = long_lines(docs, id_col, text_col, min_chars)
    cuts = docs.agg(F.percentile_approx(id_col, [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    cuts = sorted(set(cuts or []))
    # null ids come last, with the smallest
    batch = F.coalesce(sum((F.col("doc") <= F.lit(c)).cast("int") for c in cuts), F.lit(len(cuts))) if cuts else F.lit(0)
    lines = staged(lines.withColumn("batch", batch), "lines", "batch")
    runs = LineRuns(spark, fanout, docs.schema[id_col].dataType.simpleString())
    for b in range(len(cuts) + 1):
        runs.add(lines.where(F.col("batch") == b))
    repeated = runs.merged().where(F.col("n_docs") >= min_docs).select("k1", "k2", "last_doc")
    gone = lines.join(repeated, ["k1", "k2"]).where(F.col("doc") < F.col("last_doc"))
    gone = gone.groupBy(F.col("doc").alias("__ll_doc"), F.col("__ll_r1").alias("__ll_g1"), F.col("__ll_r2").alias("__ll_g2")).agg(F.collect_set("pos").alias("__ll_gone"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    at = F.sequence(F.lit(0), F.size("__ll_lines") - 1)
    kept = F.when(F.col("__ll_gone").isNull(), F.col(text_col)).otherwise(
        F.array_join(F.transform(F.array_except(at, F.col("__ll_gone")), lambda i: F.element_at(F.col("__ll_lines"), i + 1)), "\n"))
    same = (F.col(id_col) == F.col("__ll_doc")) & (F.col("__ll_r1") == F.col("__ll_g1")) & (F.col("__ll_r2") == F.col("__ll_g2"))
    out = docs.select("*", *_row(text)).join(gone, same, "left").withColumn("__ll_lines", F.split(text, "\n"))
    out = out.withColumns({text_col: kept, counts[0]: F.size("__ll_lines").cast("long"), counts[1]: F.coalesce(F.size("__ll_gone"), F.lit(0)).cast("long")})
    return out.drop("__ll_lines", "__ll_gone", "__ll_doc", "__ll_r1", "__ll_r2", "__ll_g1", "__ll_g2")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(p, 1) AS pos, unnest(p) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
k AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (
  SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (
  SELECT k.*, (r.key IS NOT NULL AND k.doc_id < r.last_doc) AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
