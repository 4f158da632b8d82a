"""What several operators share: small text batches, steps written down, distributed numbering."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugework.session import materialise

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
# Rows of one Arrow batch that carries whole texts: a worker holds one batch at a time.
TEXT_BATCH_ROWS = 1000
# Words a worker remembers, in each of two generations.
MEMO_WORDS = 80_000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size, so that long texts don't fill a Python worker."""
    now = int(spark.conf.get(ARROW_ROWS, "10000"))
    if now <= 0 or now > TEXT_BATCH_ROWS:
        spark.conf.set(ARROW_ROWS, str(TEXT_BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def remainder(id_column: str, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % modulus


def numbered(df: DataFrame, group: str, order: list[str], out: str, label: str) -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... within each value of ``group``, in the order of ``order``.

    The rows are range-partitioned on (group, order), so a hot group is cut into many partitions; they are written with
    a number that rises within a partition, and each (group, partition) is then shifted by the rows of the group in
    earlier partitions. The table of shifts has at most groups + partitions rows. Ties get some order, fixed by the write.
    """
    cut = materialise(
        df.repartitionByRange(group, *order)
        .sortWithinPartitions(group, *order)
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__at", F.monotonically_increasing_id()),
        label,
    )
    runs = cut.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__from"))
    earlier = W.partitionBy(group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    shifts = runs.select(
        F.col(group).alias("__group"), F.col("__part").alias("__run"),
        (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__from")).alias("__shift"),
    )
    return (
        cut.join(shifts, cut[group].eqNullSafe(shifts["__group"]) & (cut["__part"] == shifts["__run"]))
        .withColumn(out, (F.col("__at") + F.col("__shift")).cast("long"))
        .drop("__group", "__run", "__shift", "__part", "__at")
    )


class Memo(dict):
    """Results of ``make`` by key. Holds two generations of at most ``limit`` keys; keys in use stay in the newer one."""

    def __init__(self, make: Callable, limit: int = MEMO_WORDS) -> None:
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


_REMEMBERED: list = [None, None]


def remembered(name: object, make: Callable):
    """What a worker keeps from batch to batch for one operator, made where it is not there. It replaces another's: workers
    are used again by whatever runs next, which would have to bear with both.
    """
    if _REMEMBERED[0] != name:
        _REMEMBERED[:] = [None, None]
        give_back()
        _REMEMBERED[:] = [name, make()]
    return _REMEMBERED[1]


def give_back() -> None:
    """Return what is free in this worker to the system: an executor's JVM and its workers share one allowance."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library; elsewhere there is nothing to do
    if trim:
        trim(0)
