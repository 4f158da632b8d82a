"""Per-row metrics of requests, runs and resource samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions.scalars import (
    array_mean, half_even, iso_stamp, or_zero, run_stamp, safe_div)


def latency_projection(df: DataFrame) -> DataFrame:
    """Seconds to milliseconds: first token, mean gap between tokens, end to end, queue."""
    return df.withColumns({
        "ttft_ms": F.col("ttft_s") * 1000,
        "mean_itl_ms": array_mean("itl_s") * 1000,
        "end_to_end_ms": F.col("e2e_s") * 1000,
        "queue_time_ms": or_zero("queue_s") * 1000,
    })


def throughput_projection(df: DataFrame) -> DataFrame:
    """Rates of a run from total_tokens, total_requests and duration_seconds."""
    return df.withColumns({
        "tokens_per_second": safe_div("total_tokens", "duration_seconds"),
        "requests_per_second": safe_div("total_requests", "duration_seconds"),
        "tokens_per_request": safe_div("total_tokens", "total_requests"),
    })


def resource_shares() -> dict[str, Column]:
    """GPU memory and RAM in percent of their totals."""
    return {"gpu_memory_percent": safe_div("gpu_memory_used_mb", "gpu_memory_total_mb") * 100,
            "ram_percent": safe_div("ram_used_gb", "ram_total_gb") * 100}


def resource_projection(df: DataFrame) -> DataFrame:
    """GPU memory and RAM in percent, and the sample time as ISO text."""
    return df.withColumns({**resource_shares(), "timestamp": iso_stamp("ts")})


def quality_degradation(df: DataFrame) -> DataFrame:
    """Loss against the baseline in percent (positive = worse); NULL without a delta."""
    return df.withColumn("quality_degradation_pct", half_even(-F.col("accuracy_delta") * 100, 2))


def stamp_runs(df: DataFrame) -> DataFrame:
    return df.withColumns({"run_stamp": run_stamp("ts"), "timestamp": iso_stamp("ts")})


def sla_flag(df: DataFrame, target_ms: float = 500.0, column: str = "p95_latency_ms") -> DataFrame:
    return df.withColumns({
        "meets_sla": F.col(column) <= target_ms, "sla_target_ms": F.lit(float(target_ms))})
