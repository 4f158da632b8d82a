"""Grouped and global summaries of the request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions.scalars import finite, half_even, safe_div
from gaugework.operators.cost import cost_projection, with_prices
from gaugework.operators.derive import resource_shares, throughput_projection
from gaugework.operators.percentiles import grouped_percentiles, mean_of, percentile_columns
from gaugework.session import materialise, small_side


def _known(df: DataFrame, keys: list[str]) -> DataFrame:
    """Groups with a missing key are not reported."""
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    return df


def latency_percentiles(df: DataFrame, keys: list[str], percentiles: list[int] = (50, 90, 95, 99),
                        metrics: list[str] = ("ttft_ms", "end_to_end_ms"),
                        extras: dict[str, tuple[str, Column]] | None = None, **kwargs) -> DataFrame:
    """Per group one struct of percentiles for each metric, then the extras; no rows, no result."""
    outputs = {}
    for m in metrics:
        outputs.update(percentile_columns(m, list(percentiles), f"{m}_p"))
    flat = grouped_percentiles(df, keys, outputs, extras, **kwargs)
    return flat.select(*keys, *[
        F.struct(*[F.col(f"{m}_p{p}").alias(f"p{p}") for p in percentiles]).alias(m) for m in metrics],
        *(extras or {}))


def _latency_extras(column: str = "latency_ms") -> dict[str, tuple[str, Column]]:
    """What the mean latency and the token totals of a group need."""
    return {"latency_sum": ("sum", finite(column)), "latency_n": ("count", finite(column)),
            "input_tokens": ("sum", F.col("input_tokens")), "output_tokens": ("sum", F.col("output_tokens"))}


def config_summary(df: DataFrame, keys: list[str] = ("model_name", "workload", "batch_size"),
                   digits: int = 2, **kwargs) -> DataFrame:
    """Mean, median, p95 and p99 latency and token sums per configuration."""
    keys = list(keys)
    got = grouped_percentiles(df, keys, {
        "latency_ms_median": ("latency_ms", 0.5), "latency_ms_p95": ("latency_ms", 0.95),
        "latency_ms_p99": ("latency_ms", 0.99)}, _latency_extras(), **kwargs)
    rounded = ["latency_ms_mean", "latency_ms_median", "latency_ms_p95", "latency_ms_p99"]
    return got.withColumn("latency_ms_mean", mean_of("latency_sum", "latency_n")).select(
        *keys, *[half_even(c, digits).alias(c) for c in rounded],
        F.col("input_tokens").alias("input_tokens_sum"), F.col("output_tokens").alias("output_tokens_sum"))


def config_metrics(requests: DataFrame, models: DataFrame, quality: DataFrame | None = None,
                   keys: list[str] = ("model_name", "workload", "batch_size"), digits: int = 6,
                   **kwargs) -> DataFrame:
    """What selection and frontier need per configuration: p95 latency, cost, throughput, quality.

    Cost is that of the whole group: its summed latency as machine time plus
    its tokens. ``config_id`` is unique and orders ties.
    """
    keys = list(keys)
    got = grouped_percentiles(requests, keys, {"p95_latency_ms": ("latency_ms", 0.95)}, _latency_extras(), **kwargs)
    priced = cost_projection(with_prices(got.withColumns({
        "duration_seconds": F.col("latency_sum") / 1000, "latency_ms": mean_of("latency_sum", "latency_n"),
    }), models))
    if quality is not None:
        priced = priced.join(quality, "model_name", "left")
    return priced.select(
        F.concat_ws("/", *[F.lpad(F.col(k).cast("string"), 3, "0") if k == "batch_size" else F.col(k)
                           for k in keys]).alias("config_id"),
        *keys, "deployment_type",
        F.round("latency_ms", digits).alias("latency_ms"),
        F.round("p95_latency_ms", digits).alias("p95_latency_ms"),
        F.round("cost_per_1m_tok", digits).alias("cost_per_1m_tok"),
        F.round(safe_div("output_tokens", "duration_seconds"), digits).alias("throughput"),
        *(["quality_score"] if quality is not None else []),
    )


def model_report(df: DataFrame, digits: int = 2, **kwargs) -> DataFrame:
    """Mean and p95 latency and token totals per model."""
    got = grouped_percentiles(
        df, ["model_name"], {"latency_ms_p95": ("latency_ms", 0.95)}, _latency_extras(), **kwargs)
    return got.select(
        "model_name", half_even(mean_of("latency_sum", "latency_n"), digits).alias("latency_ms_mean"),
        half_even("latency_ms_p95", digits).alias("latency_ms_p95"),
        "input_tokens", "output_tokens",
        (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"))


def mean_cost_by_model(df: DataFrame, monthly_millions: float = 100.0) -> DataFrame:
    """Mean price per million tokens per model, cheapest first, and its monthly cost."""
    mean = F.avg(finite("cost_per_1m_tok"))
    return (
        _known(df, ["model_name"]).groupBy("model_name")
        .agg(mean.alias("mean_cost_per_1m_tok"))
        .withColumn("monthly_cost", F.col("mean_cost_per_1m_tok") * monthly_millions)
        .orderBy("mean_cost_per_1m_tok", "model_name")
    )


def throughput_by_model(df: DataFrame) -> DataFrame:
    """Output tokens per second of summed latency."""
    sums = _known(df, ["model_name"]).groupBy("model_name").agg(
        F.sum("output_tokens").alias("output_tokens"), F.sum(finite("latency_ms")).alias("latency_ms"))
    return sums.withColumn("tokens_per_sec", safe_div("output_tokens", F.col("latency_ms") / 1000))


def mean_latency_by_batch(df: DataFrame) -> DataFrame:
    keys = ["model_name", "batch_size"]
    return _known(df, keys).groupBy(*keys).agg(F.avg(finite("latency_ms")).alias("latency_ms"))


def average_resources(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean utilisation; memory totals are those of the first sample."""
    first = F.struct("ts", "sample_id") if "sample_id" in df.columns else F.col("ts")
    means = ["gpu_memory_used_mb", "gpu_utilization_percent", "cpu_percent", "ram_used_gb"]
    return df.groupBy(*keys).agg(
        *[F.avg(finite(c)).alias(c) for c in means],
        *[F.min_by(c, first).alias(c) for c in ("gpu_memory_total_mb", "ram_total_gb")])


def _run_extras() -> dict[str, tuple[str, Column]]:
    """What the rates of a run need: its tokens, requests, first start and last answer in microseconds."""
    start = F.unix_micros("ts")
    return {"total_tokens": ("sum", F.col("input_tokens") + F.col("output_tokens")),
            "total_requests": ("count", F.lit(1)), "run_from": ("min", start),
            "run_to": ("max", start + F.col("latency_ms") * 1000)}


def run_throughput(df: DataFrame, keys: list[str] = ("run_id",)) -> DataFrame:
    """Requests, real token totals and wall-clock rates of each run.

    A run lasts from its first request until its last one is answered.
    """
    kinds = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    totals = _known(df, list(keys)).groupBy(*keys).agg(
        *[kinds[kind](value).alias(name) for name, (kind, value) in _run_extras().items()])
    return throughput_projection(_with_duration(totals))


def _with_duration(totals: DataFrame) -> DataFrame:
    return totals.withColumn("duration_seconds", (F.col("run_to") - F.col("run_from")) / 1e6).drop("run_from", "run_to")


def run_cost(df: DataFrame, models: DataFrame, keys: list[str] = ("run_id", "model_name")) -> DataFrame:
    """Token totals and cost per run and model, over the summed request time."""
    totals = _known(df, list(keys)).groupBy(*keys).agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        (F.sum(finite("latency_ms")) / 1000).alias("duration_seconds"))
    return cost_projection(with_prices(totals, models))


def distinct_counts(df: DataFrame, columns: list[str] = ("model_name", "workload"),
                    approximate: bool = False) -> DataFrame:
    """Number of distinct values per column."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(F.count(F.lit(1)).alias("rows"), *[count(F.col(c)).alias(f"distinct_{c}") for c in columns])


def box_summary(df: DataFrame, key: str = "model_name", value: str = "latency_ms", **kwargs) -> DataFrame:
    """Five-number summary per group and the whiskers: the extreme values within 1.5 IQR."""
    five = grouped_percentiles(
        df, [key], {"low": (value, 0.0), "q1": (value, 0.25), "median": (value, 0.5),
                    "q3": (value, 0.75), "high": (value, 1.0)}, **kwargs)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    five = materialise(five, "box")
    fences = small_side(
        five.select(key, (F.col("q1") - reach).alias("__lo"), (F.col("q3") + reach).alias("__hi")), written=True)
    inside = (
        df.select(key, finite(value).alias("__v")).join(fences, key)
        .filter((F.col("__v") >= F.col("__lo")) & (F.col("__v") <= F.col("__hi")))
        .groupBy(key).agg(F.min("__v").alias("lower_whisker"), F.max("__v").alias("upper_whisker"))
    )
    return five.join(inside, key)


def composite_summary(df: DataFrame, resources: DataFrame, keys: list[str] = ("run_id",), **kwargs) -> DataFrame:
    """Per run: latency, throughput and resource structs (with percentages) and the number of samples."""
    keys = list(keys)
    rates = throughput_projection(_with_duration(latency_percentiles(df, keys, extras=_run_extras(), **kwargs)))
    usage = average_resources(resources, keys).withColumns(resource_shares())
    rate_cols = [c for c in rates.columns if c not in [*keys, "ttft_ms", "end_to_end_ms"]]
    usage_cols = [c for c in usage.columns if c not in keys]
    return (
        rates.select(*keys, F.struct("ttft_ms", "end_to_end_ms").alias("latency"),
                     F.struct(*rate_cols).alias("throughput"), F.col("total_requests").alias("num_samples"))
        .join(usage.select(*keys, F.struct(*usage_cols).alias("resources")), keys, "left")
    )


def headline_kpis(df: DataFrame) -> DataFrame:
    """One row: models, mean latency, mean cost when there is one, samples."""
    cost = [F.avg(finite("cost_per_1m_tok")).alias("avg_cost_per_1m_tok")] if "cost_per_1m_tok" in df.columns else []
    return df.agg(
        F.count_distinct("model_name").alias("models_tested"),
        F.avg(finite("latency_ms")).alias("avg_latency_ms"),
        *cost, F.count(F.lit(1)).alias("total_samples"))


def error_rate(df: DataFrame, keys: list[str]) -> DataFrame:
    keys = list(keys)
    return _known(df, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("is_error")).alias("errors"),
        F.avg(F.col("is_error").cast("double")).alias("error_rate"))
