"""Session defaults and the two places where a plan is cut on purpose."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"

# Inputs up to SMALL_ROWS rows may use a plan that holds a group in one task;
# tables up to BROADCAST_ROWS rows and BROADCAST_BYTES may be broadcast. Both are checked, rows by counting.
SMALL_ROWS = 1_000_000
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def local_session(app: str = "gaugework", cpus: int | str = 8, **conf: str) -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a local master may fall back to a folder of this machine; on a
    cluster such a folder would be lost with its executor.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    folder = os.path.join(tempfile.gettempdir(), f"gaugework-{os.getpid()}")
    spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where two branches must see the very same rows (positions taken from
    physical partitions) or where a row count decides the plan. A written
    parquet table survives executor loss and keeps column pruning.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` of so many rows may be broadcast: few rows, and few bytes by Spark's own estimate."""
    return rows <= BROADCAST_ROWS and int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= BROADCAST_BYTES


def small_side(df: DataFrame, written: bool = False) -> DataFrame:
    """``df`` written down, and marked for broadcast if its rows, counted, and bytes are few.

    A larger table is left to a shuffle join.
    """
    table = df if written else materialise(df, "side")
    return F.broadcast(table) if is_small(table, table.count()) else table
