"""Result files and the run/result store.

Both are written in batches that readers see once they are committed (``commits``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.schemas import BENCHMARK_RESULTS, BENCHMARK_RUNS, REQUEST_RESULT
from gaugework.sources.commits import commit, committed, folder, new_batch, read_batches, save_keys, screened

FORMATS = ("csv", "json", "parquet")


def _options(fmt: str) -> dict[str, str]:
    """Text formats keep times to the microsecond, as ISO text."""
    if fmt == "parquet":
        return {}
    return {"header": "true", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def save_results(df: DataFrame, path: str, fmt: str = "csv", mode: str = "append") -> None:
    """Write result rows as one batch below ``path``, a folder per run; ``mode`` is "append" or "overwrite".

    Rebalancing on the run keeps the number of files per run small; AQE splits
    a run that holds much of the data over several writers. The rows are
    computed once: the runs and their sizes, written beside them, are read from
    the files. Then the batch is committed.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; use one of {FORMATS}")
    if mode not in ("append", "overwrite"):
        raise ValueError(f"unknown mode {mode!r}; use append or overwrite")
    spark, batch = df.sparkSession, new_batch()
    rows = df.hint("rebalance", F.col("run_id"))
    rows.write.partitionBy("run_id").format(fmt).options(**_options(fmt)).save(folder(path, batch))
    written = spark.read.format(fmt).schema("run_id STRING").options(**_options(fmt)).load(folder(path, batch))
    written.groupBy("run_id").agg(F.count(F.lit(1)).alias("rows")).write.parquet(folder(f"{path}/_runs", batch))
    total = _runs(spark, path, [batch]).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    commit(spark, path, batch, total, fresh=mode == "overwrite")


def _runs(spark: SparkSession, path: str, batches: list[str]) -> DataFrame:
    """run_id, rows and batch of what was saved."""
    return read_batches(spark, f"{path}/_runs", batches, "run_id STRING, rows BIGINT")


def _results(spark: SparkSession, path: str, batches: list[str], fmt: str, schema: str) -> DataFrame:
    return read_batches(spark, path, batches, schema, fmt, _options(fmt)).drop("batch")


def read_results(spark: SparkSession, path: str, fmt: str = "csv",
                 schema: str = REQUEST_RESULT) -> DataFrame:
    """All stored runs; ``run_id`` is the partition column, so filters on it prune folders."""
    return _results(spark, path, committed(spark, path), fmt, schema)


def latest_run(spark: SparkSession, path: str, fmt: str = "csv",
               schema: str = REQUEST_RESULT) -> DataFrame:
    """The run whose id sorts last; an empty table when nothing is stored.

    The small table of runs names it and the batches that hold it, so only
    their folders are listed, and only its own is read. Rows without a run id
    belong to no run.
    """
    runs = _runs(spark, path, committed(spark, path)).filter("run_id IS NOT NULL")
    last = runs.groupBy("run_id").agg(F.collect_set("batch").alias("batches")).orderBy(F.desc("run_id")).limit(1).first()
    if last is None:
        return _results(spark, path, [], fmt, schema)
    return _results(spark, path, sorted(last.batches), fmt, schema).filter(F.col("run_id") == last.run_id)


def latest_file(spark: SparkSession, pattern: str, fmt: str = "csv",
                schema: str = REQUEST_RESULT) -> DataFrame:
    """Of single-file runs matching ``pattern``, the file whose name sorts last."""
    reader = spark.read.format(fmt).schema(schema).options(**_options(fmt))
    # names only: the content of the files is not read for this
    name = spark.read.format("binaryFile").load(pattern).agg(F.max("path")).first()[0]
    return reader.load(name) if name else spark.createDataFrame([], schema)


def check_store(runs: DataFrame, results: DataFrame, path: str | None = None) -> None:
    """Raises ValueError unless ids and names of runs are new and unique and every result has its run.

    With ``path``, what is stored there counts too: an id is looked for only in batches whose key filter may hold it, and a
    match there is then made sure by the stored rows themselves.
    """
    twice = _run_keys(runs).groupBy("key").count().filter("count > 1").select("key")
    _refuse_runs(twice)
    orphans = results.select("run_id").distinct().join(runs.select(F.col("id").alias("run_id")), "run_id", "left_anti")
    batches = committed(runs.sparkSession, path) if path else []
    if batches:
        _refuse_runs(_stored_keys(_run_keys(runs), path, batches))
        wanted = orphans.select(F.concat(F.lit("id "), F.col("run_id").cast("string")).alias("key"), "run_id")
        there = _stored_keys(wanted.select("key"), path, batches)
        orphans = wanted.join(there, "key", "left_anti").select("run_id")
    missing = orphans.limit(1).collect()
    if missing:
        run = missing[0]["run_id"]
        orphan = results.filter(F.col("run_id").eqNullSafe(F.lit(run))).limit(1).collect()
        raise ValueError(f"result {orphan[0]['id']} refers to run {run}, which is not stored")


def _run_keys(runs: DataFrame) -> DataFrame:
    """Ids and names of runs, each marked as what it is."""
    named = F.array(F.concat(F.lit("id "), F.col("id").cast("string")), F.concat(F.lit("name "), F.col("run_id")))
    return runs.select(F.explode(named).alias("key"), *(["batch"] if "batch" in runs.columns else [])).filter("key IS NOT NULL")


def _stored_keys(keys: DataFrame, path: str, batches: list[str]) -> DataFrame:
    """Those of ``keys`` that a stored run has."""
    maybe = screened(keys, path, batches)
    stored = _run_keys(read_batches(keys.sparkSession, f"{path}/benchmark_runs", batches, BENCHMARK_RUNS))
    return stored.join(maybe, ["key", "batch"], "left_semi").select("key").distinct()


def _refuse_runs(keys: DataFrame) -> None:
    again = keys.orderBy("key").limit(1).collect()
    if again:
        kind, value = again[0]["key"].split(" ", 1)
        raise ValueError(f"run {value} is stored twice" if kind == "id" else f"run name {value!r} is stored twice")


def save_store(runs: DataFrame, results: DataFrame, path: str, checked: bool = True) -> None:
    """Append runs and results as one batch, after checking their keys against each other and against the store.

    Both are written first and checked as written; a batch that fails is never committed.
    """
    spark, batch = runs.sparkSession, new_batch()
    runs.write.parquet(folder(f"{path}/benchmark_runs", batch))
    results.write.parquet(folder(f"{path}/benchmark_results", batch))
    new_runs = spark.read.schema(runs.schema).parquet(folder(f"{path}/benchmark_runs", batch))
    new_results = spark.read.schema(results.schema).parquet(folder(f"{path}/benchmark_results", batch))
    if checked:
        check_store(new_runs, new_results, path)
    save_keys(_run_keys(new_runs), path, batch)
    commit(spark, path, batch, new_runs.count() + new_results.count())


def read_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    batches = committed(spark, path)
    return (read_batches(spark, f"{path}/benchmark_runs", batches, BENCHMARK_RUNS).drop("batch"),
            read_batches(spark, f"{path}/benchmark_results", batches, BENCHMARK_RESULTS).drop("batch"))


def results_with_runs(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Each result with the columns of its run.

    A shuffle join on the run key. One run may own a third of the results; AQE
    splits such a partition, and the run side has one row per key.
    """
    parents = runs.select(
        F.col("id").alias("run_id"), F.col("run_id").alias("run_name"),
        "model_name", "workload_type", "batch_size")
    return results.join(parents, "run_id")


def orphan_results(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Results whose run is not stored."""
    return results.join(runs.select(F.col("id").alias("run_id")), "run_id", "left_anti")


def append_results(*parts: DataFrame) -> DataFrame:
    """Union by name; columns a part lacks (error rows do) become NULL."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part, allowMissingColumns=True)
    return first
