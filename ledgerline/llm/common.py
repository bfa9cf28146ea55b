"""What the corpus operators share: scratch tables in the cluster's shared folder, table reading, word splitting."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import checkpoint_dir, ship

#: Bytes that separate the words of decontamination: every ASCII byte but digits and small letters.
_NOT_WORD = bytes(0x20 if not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80) else b for b in range(256))


def ready(spark: SparkSession, batch_rows: int = 1_000) -> SparkSession:
    """spark with the package shipped and Arrow batches of so many rows, which bounds what a Python worker holds of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    return ship(spark)


#: Paths that scratch() gave out within each kept_only() that is open.
_OPEN: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


@contextmanager
def kept_only(spark: SparkSession):
    """Within it scratch tables are noted; drop(but) of what it gives deletes them, those in `but` excepted. For work of several steps
    whose result is written: what a step staged on its way is of no use once the next one's table is there."""
    made: list[str] = []
    _OPEN.append(made)

    def drop(but: list[str]) -> None:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in [p for p in made if p not in but]:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
            made.remove(path)

    try:
        yield made, drop
    finally:
        _OPEN.remove(made)


def staged(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there and executors may be lost."""
    path = scratch(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _release() -> None:
    """Give memory that this process has let go back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def trimmed(run: Callable) -> Callable:
    """run, a function over a task's batches, after which the worker gives back what the task held: workers outlive
    their tasks, and the next stage's have the executor's memory beside them."""
    def wrapped(batches):
        yield from run(batches)
        _release()

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: a table that comes in fewer partitions than there are cores is dealt out anew."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def utf8(col: str):
    """The text's bytes, empty for null, as Arrow binary: no decoding where bytes will do."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def space_words(data: bytes) -> list[bytes]:
    """Words between space and \\t \\n \\v \\f \\r, A-Z lower-cased."""
    return data.lower().split()


def plain_words(data: bytes) -> list[bytes]:
    """Words of digits, letters and all non-ASCII characters, A-Z lower-cased."""
    return data.lower().translate(_NOT_WORD).split()
