"""Batch-size and quantisation experiments, the run grid and its gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugework.functions.scalars import finite, half_even, iso_stamp, safe_div
from gaugework.operators.derive import sla_flag
from gaugework.operators.percentiles import grouped_percentiles, mean_of
from gaugework.operators.picks import first_by
from gaugework.operators.positions import with_position
from gaugework.operators.quality import against_baseline
from gaugework.operators.sizing import memory_estimate
from gaugework.session import materialise

_RANKS = {"p50_latency_ms": ("latency", 0.50), "p95_latency_ms": ("latency", 0.95),
          "p99_latency_ms": ("latency", 0.99)}


def assign_batches(requests: DataFrame, group: list[str], order: str = "request_id", **kwargs) -> DataFrame:
    """Number the requests of a group in order and cut them into batches of ``batch_size``."""
    return with_position(requests, [order], "__pos", group, **kwargs).withColumn(
        "batch_no", F.floor(F.col("__pos") / F.col("batch_size")).cast("long")).drop("__pos")


def amortised_latency(batched: DataFrame, group: list[str]) -> DataFrame:
    """Each request gets its batch's time divided by the batch's requests (the last one may be short).

    The batch takes as long as its slowest request. A window over one batch
    holds at most ``batch_size`` rows.
    """
    batch = W.partitionBy(*group, "batch_no")
    return batched.withColumns({
        "batch_requests": F.count(F.lit(1)).over(batch),
        "batch_ms": F.max("latency_ms").over(batch),
    }).withColumn("amortised_ms", F.col("batch_ms") / F.col("batch_requests"))


def batch_rows(batched: DataFrame, batches: list[str], keys: list[str] = ()) -> DataFrame:
    """One row per batch, and value of ``keys`` in it: ``n`` requests that took ``amortised_ms`` each, tokens, start and end.

    Requests of a batch lie together since they were numbered, so they are combined before the shuffle; what is shuffled
    and written are batches.
    """
    batches, more = list(batches), [k for k in keys if k not in batches]
    start = F.unix_micros("ts") if "ts" in batched.columns else F.lit(None).cast("long")
    rows = batched.groupBy(*batches, "batch_no", *more).agg(
        F.count(F.lit(1)).alias("n"), F.max("latency_ms").alias("batch_ms"), F.sum("output_tokens").alias("output_tokens"),
        F.min(start).alias("run_from"), F.max(start + F.col("latency_ms") * 1000).alias("run_to"))
    whole = F.col("n")
    if more:
        batch = W.partitionBy(*batches, "batch_no")
        rows, whole = rows.withColumn("batch_ms", F.max("batch_ms").over(batch)), F.sum("n").over(batch)
    return rows.withColumn("amortised_ms", F.col("batch_ms") / whole)


def batch_experiment(batched: DataFrame, group: list[str] = ("batch_size",), batches: list[str] | None = None,
                     strategy: str = "static", sla_target_ms: float = 500.0, **kwargs) -> DataFrame:
    """Latency statistics, wall-clock rates and the SLA flag per batch size.

    ``batches`` are the columns within which batches are numbered, those of ``group`` by default. The batches are written
    once, as they are read twice.
    """
    group = list(group)
    timed = materialise(batch_rows(batched, batches or group, group).select(
        *group, F.col("amortised_ms").alias("latency"), "n", "output_tokens", "run_from", "run_to"), "batches")
    got = grouped_percentiles(timed, group, _RANKS, {
        "latency_sum": ("sum", finite("latency") * F.col("n")), "latency_n": _known("latency", "n"),
        "requests": ("sum", F.col("n")), "output_tokens": ("sum", F.col("output_tokens")),
        "run_from": ("min", F.col("run_from")), "run_to": ("max", F.col("run_to"))}, weight="n", **kwargs)
    stats = got.withColumn("duration_seconds", (F.col("run_to") - F.col("run_from")) / 1e6).withColumns({
        "mean_latency_ms": mean_of("latency_sum", "latency_n"),
        "strategy": F.lit(strategy),
        "throughput_req_per_sec": safe_div("requests", "duration_seconds"),
        "throughput_tokens_per_sec": safe_div("output_tokens", "duration_seconds"),
    })
    return sla_flag(stats, sla_target_ms).select(
        *group, "strategy", "mean_latency_ms", *_RANKS, "throughput_req_per_sec",
        "throughput_tokens_per_sec", "meets_sla", "sla_target_ms")


def _known(value: str, weight: str) -> tuple[str, Column]:
    """The rows that have a value, as an extra of the percentiles."""
    return "sum", F.when(finite(value).isNotNull(), F.col(weight))


def sla_passing(experiments: DataFrame) -> DataFrame:
    return experiments.filter("meets_sla")


def optimal_batch(experiments: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Highest token throughput among the batch sizes that meet the SLA; no row when none does."""
    passing = sla_passing(experiments)
    order = [-F.col("throughput_tokens_per_sec"), F.col("batch_size")]
    if keys:
        return first_by(passing, list(keys), order)
    return passing.orderBy(*order).limit(1)


def quantization_performance(requests: DataFrame, keys: list[str] = ("model_name", "quantization"),
                             latency: str = "latency_ms", digits: int = 2, weight: str | None = None,
                             **kwargs) -> DataFrame:
    """Latency statistics and tokens per second of summed latency (at least 0.001 s).

    Where requests were sent in batches, ``requests`` may be ``batch_rows``, ``latency`` their amortised time and ``weight``
    the number of requests.
    """
    keys, times = list(keys), F.lit(1) if weight is None else F.col(weight)
    timed = requests.select(*keys, F.col(latency).alias("latency"), "output_tokens", times.alias("n"))
    got = grouped_percentiles(timed, keys, _RANKS, {
        "latency_sum": ("sum", finite("latency") * F.col("n")), "latency_n": _known("latency", "n"),
        "tokens": ("sum", F.col("output_tokens"))}, weight=weight and "n", **kwargs).withColumns({
            "mean_latency_ms": mean_of("latency_sum", "latency_n"),
            "throughput_tok_s": F.col("tokens") / F.greatest(F.col("latency_sum") / 1000, F.lit(0.001))})
    stats = ["mean_latency_ms", *_RANKS, "throughput_tok_s"]
    return got.select(*keys, *[half_even(F.coalesce(c, F.lit(0.0)), digits).alias(c) for c in stats])


def experiment_records(performance: DataFrame, accuracy: DataFrame, models: DataFrame,
                       levels: DataFrame, runs: DataFrame) -> DataFrame:
    """Performance, accuracy, accuracy delta and estimated memory per model and quantisation.

    ``runs`` has the run's id and its end as ISO text for each model and quantisation.
    """
    keys = ["model_name", "quantization"]
    scored = against_baseline(
        performance.join(accuracy.select(*keys, "task_accuracy"), keys, "left"))
    memory = memory_estimate(
        scored.join(models.select("model_name", "parameters"), "model_name", "left")
        .join(levels.select("quantization", "dtype", "memory_reduction"), "quantization", "left"))
    return memory.join(runs.select(*keys, "run_id", "timestamp"), keys, "left").select(
        "run_id", *keys, "dtype", "mean_latency_ms", *_RANKS, "throughput_tok_s", "task_accuracy",
        "accuracy_delta", F.col("total_memory_gb").alias("est_memory_gb"), "memory_reduction", "timestamp")


def experiment_runs(requests: DataFrame, keys: list[str] = ("model_name", "quantization")) -> DataFrame:
    """The latest run of each experiment and the time of its last request, as ISO text."""
    return requests.groupBy(*keys).agg(F.max("run_id").alias("run_id"), iso_stamp(F.max("ts")).alias("timestamp"))


def coverage_gaps(results: DataFrame, models: DataFrame, workloads: list[str],
                  batch_sizes: list[int]) -> DataFrame:
    """Cells of models x workloads x batch sizes that have no result.

    Workloads and batch sizes are short lists of the experiment plan, so the
    grid is exploded from literals.
    """
    grid = (
        models.select("model_name")
        .withColumn("workload", F.explode(F.array(*[F.lit(w) for w in workloads])))
        .withColumn("batch_size", F.explode(F.array(*[F.lit(b) for b in batch_sizes])))
    )
    done = results.select("model_name", "workload", "batch_size").distinct()
    return grid.join(done, ["model_name", "workload", "batch_size"], "left_anti")


def distinct_outputs(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).distinct()
