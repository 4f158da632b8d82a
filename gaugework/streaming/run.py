"""Reading and draining streams of parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from gaugework.session import fresh_path, materialise
from gaugework.streaming.windows import Closing

NO_MARK = "1970-01-01T00:00:00.000Z"


def read_folder(spark: SparkSession, folder: str, pattern: str = "*.parquet",
                files_per_trigger: int | None = None) -> DataFrame:
    """A stream over the files of a folder; the schema is that of the files present."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def _reached(query: StreamingQuery, spark: SparkSession, path: str) -> str:
    """The watermark that the queries at ``path`` have come to; it is kept there for a call that finds nothing new."""
    marks = [p.eventTime["watermark"] for p in query.recentProgress if "watermark" in p.eventTime]
    spark.createDataFrame([(max(marks, default=NO_MARK),)], "mark string").write.mode("append").parquet(f"{path}/marks")
    return spark.read.schema("mark string").parquet(f"{path}/marks").agg(F.max("mark")).first()[0]


def drain(stream: DataFrame | Closing, label: str = "stream", path: str | None = None) -> DataFrame:
    """Process what is available and return all rows emitted so far as a table.

    Output and progress go below ``path``: called again with the same path, also by a restarted driver, it carries on where
    it stopped. Without one a new folder of the shared folder is used. No row passes through the driver. A result that
    needs a batch plan gets it over all that was emitted so far.
    """
    closing = stream if isinstance(stream, Closing) else None
    rows = closing.stream if closing else stream
    spark = rows.sparkSession
    path = path or fresh_path(spark, label)
    query = (
        rows.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start(f"{path}/rows")
    )
    query.awaitTermination()
    emitted = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    return closing.finish(emitted, _reached(query, spark, path)) if closing else emitted


def follow(closing: Closing, path: str, **trigger: object) -> StreamingQuery:
    """Keep a stream running: the windows that a micro-batch closes are ranked and written to a folder of that batch.

    A batch that is run again after a failure overwrites its folder, so every window appears once below ``path``/rows.
    """
    if not closing.alone:
        raise ValueError("windows that share panes need those of earlier batches; use drain")

    def write(rows: DataFrame, batch: int) -> None:
        closing.finish(materialise(rows, "closed"), None).write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    return (
        closing.stream.writeStream.outputMode("append").foreachBatch(write)
        .option("checkpointLocation", f"{path}/progress").trigger(**(trigger or {"processingTime": "1 minute"})).start()
    )
