"""Batches of files that count only once they are committed, and a screen of the keys that they hold.

A batch is written to folders of its own, named after it. Its last step appends one small file to ``_commits``; readers take
the batches named there and no others, so what a failed or unfinished write has left is never seen, and several tables
written as one batch appear together. One writer at a time.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "batch STRING, rows BIGINT, saved_at TIMESTAMP, fresh BOOLEAN"
# A batch's keys set HASHES bits each of a Bloom filter of BLOOM_BITS, kept as rows (word, bits) for words that are not 0.
BLOOM_BITS, HASHES = 1 << 27, 4


def new_batch() -> str:
    return f"b{uuid.uuid4().hex}"


def folder(path: str, batch: str) -> str:
    return f"{path}/batch={batch}"


def commit(spark: SparkSession, path: str, batch: str, rows: int, fresh: bool = False) -> None:
    """Make a batch visible; with ``fresh``, those before it no longer are."""
    now = datetime.datetime.now(datetime.timezone.utc)
    line = spark.createDataFrame([(batch, rows, now, fresh)], COMMITS).coalesce(1)
    line.write.mode("append").parquet(f"{path}/_commits")


def committed(spark: SparkSession, path: str) -> list[str]:
    """The names of all batches that count, a short text per write, in the order they were committed."""
    try:
        lines = spark.read.schema(COMMITS).parquet(f"{path}/_commits").orderBy("saved_at", "batch").collect()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    since = max((i for i, r in enumerate(lines) if r.fresh), default=0)
    return [r.batch for r in lines[since:]]


def read_batches(spark: SparkSession, path: str, batches: list[str], schema: str, fmt: str = "parquet",
                 options: dict[str, str] | None = None) -> DataFrame:
    """The rows of the named batches, and ``batch``; only their folders are listed."""
    if not batches:
        return spark.createDataFrame([], f"{schema}, batch STRING")
    reader = spark.read.format(fmt).schema(f"{schema}, batch STRING").options(**(options or {}))
    return reader.option("basePath", path).load([folder(path, b) for b in batches])


def _bits(keys: DataFrame) -> DataFrame:
    """Word and bit of each hash of ``key``."""
    each = keys.select("key", F.explode(F.sequence(F.lit(1), F.lit(HASHES))).alias("nth"))
    place = F.pmod(F.xxhash64("nth", "key"), F.lit(BLOOM_BITS)).alias("place")
    return each.select("key", "nth", place).select(
        "key", "nth", F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, CAST(place & 63 AS INT))").alias("bit"))


def save_keys(keys: DataFrame, path: str, batch: str) -> None:
    """Write the filter of a batch's ``key`` column."""
    words = _bits(keys).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    words.write.parquet(folder(f"{path}/_keys", batch))


def screened(keys: DataFrame, path: str, batches: list[str]) -> DataFrame:
    """(key, batch) wherever the filter of a batch may hold the key; a pair that is missing here is in no batch."""
    words = read_batches(keys.sparkSession, f"{path}/_keys", batches, "word BIGINT, bits BIGINT")
    found = _bits(keys).join(words, "word").filter(F.col("bits").bitwiseAND(F.col("bit")) != 0)
    return found.groupBy("key", "batch").agg(F.count_distinct("nth").alias("n")).filter(F.col("n") == HASHES).drop("n")
