"""Windowed metrics over a live request log or resource feed.

Each function takes a streaming (or batch) DataFrame; the watermark bounds the
state, late rows behind it are dropped, and a window is emitted once, when the
watermark has passed its end. Most functions return a DataFrame. Window
percentiles are exact order statistics, which no bounded state can give, so
they take two steps: the stream counts rows per pane, model and value, and a
batch plan ranks the counts of closed panes by buckets (``order_statistics``).
A pane is a window, or for sliding windows the longest stretch that no window
cuts, so a row is counted once however many windows cover it. A hot model
spreads over all tasks in both steps; no task gathers a window's values.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions.buckets import STEPS_PER_OCTAVE
from gaugework.functions.scalars import finite, safe_div
from gaugework.operators.cost import cost_projection, with_prices
from gaugework.operators.order_statistics import bucketed, values_at_ranks, wanted_buckets
from gaugework.operators.percentiles import BUCKET_ROWS
from gaugework.session import is_small, materialise

SESSION_MERGE = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
# Buckets per doubling of the value that windows are first counted by, finer ones only where too many values share one;
# and the length of a block of windows, in windows.
WIDE_STEPS = 4
BLOCK_WINDOWS = 6
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800}


@dataclass
class Closing:
    """A result that needs a batch plan over what a stream has emitted.

    ``finish`` turns the rows of ``stream``, and the time up to which they are complete (None: all), into the result.
    With ``alone``, the rows that a micro-batch emits are enough for the results that it closes.
    """

    stream: DataFrame
    finish: Callable[[DataFrame, object], DataFrame]
    alone: bool

    def then(self, step: Callable[[DataFrame], DataFrame]) -> Closing:
        return Closing(self.stream, lambda rows, until: step(self.finish(rows, until)), self.alone)


def without_repeats(stream: DataFrame, key: str = "request_id", delay: str = "10 minutes",
                    time: str = "ts") -> DataFrame:
    """Drop redelivered rows; keys are remembered until the watermark passes them."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def _bounds(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                     *columns)


def seconds_of(interval: str) -> int:
    """Whole seconds of a text such as "10 minutes"."""
    found = re.fullmatch(r"\s*(\d+)\s+(second|minute|hour|day|week)s?\s*", interval.lower())
    if not found or not int(found[1]):
        raise ValueError(f"not a window size in seconds, minutes, hours, days or weeks: {interval!r}")
    return int(found[1]) * UNITS[found[2]]


def latency_windows(stream: DataFrame, size: str = "1 hour", slide: str | None = None,
                    delay: str = "10 minutes", percentiles: tuple[int, ...] = (50, 95, 99)) -> DataFrame | Closing:
    """Requests, latency percentiles, error rate and rates per model and window.

    Batch input gives a DataFrame with all windows, a stream what ``drain`` or ``follow`` complete. A row is late once the
    pane that it belongs to has closed.
    """
    long, step = seconds_of(size), seconds_of(slide or size)
    if step > long:
        raise ValueError(f"the slide {slide!r} is longer than the window {size!r}")
    pane = math.gcd(long, step)
    counted = (
        stream.withWatermark("ts", delay)
        .groupBy(F.window("ts", f"{pane} seconds"), "model_name", finite("latency_ms").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("is_error").alias("errors"), F.count("is_error").alias("known"),
             F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
        .select(F.unix_seconds("window.start").alias("pane"), "model_name", "value", "n", "errors", "known", "tokens")
    )

    def finish(counts: DataFrame, until: object = None) -> DataFrame:
        return _ranked(counts, long, step, pane, until, percentiles)

    if stream.isStreaming:
        return Closing(counted, finish, pane == long)
    return finish(materialise(counted, "pane-counts"))


def _ranked(counts: DataFrame, long: int, step: int, pane: int, until: object, percentiles: tuple[int, ...]) -> DataFrame:
    """Windows of ``long`` seconds every ``step`` from written counts per pane, model and value.

    A window sees a pane as few wide buckets; only the values of the buckets that hold a rank are looked at one by one.
    """
    keys, outputs = ["start", "model_name"], {f"latency_p{p}_ms": p / 100 for p in percentiles}
    # the windows that cover a pane
    first = (F.ceil((F.col("pane") + (pane - long)) / step) * step).cast("long")
    last = (F.floor(F.col("pane") / step) * step).cast("long")
    if until is not None and pane < long:
        last = F.least(last, F.floor((F.unix_seconds(F.lit(until).cast("timestamp")) - long) / step).cast("long") * step)

    def covering(df: DataFrame, low: Column, high: Column) -> DataFrame:
        starts = F.when(low <= high, F.sequence(low, high, F.lit(step).cast("long")))
        return df.withColumn("start", F.explode(starts))

    additive = ["errors", "known", "tokens"]
    by_pane = counts.groupBy("pane", "model_name").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in additive])
    totals = covering(by_pane, first, last).groupBy(*keys).agg(
        F.sum("n").alias("requests"), F.sum("tokens").alias("tokens"),
        (F.sum("errors") / F.nullif(F.sum("known"), F.lit(0))).alias("error_rate"))

    # Windows that start within a block are counted by the task that has the block, so a pane is sent to two tasks at most
    # and not to one per window. A block has as many rows as it has panes and buckets, however many its requests.
    block = long if pane == long else step * math.ceil(BLOCK_WINDOWS * long / step)
    for steps in (WIDE_STEPS, STEPS_PER_OCTAVE):
        placed = bucketed(counts, "value", steps).filter("__bucket IS NOT NULL")
        panes = placed.groupBy("pane", "model_name", "__bucket").agg(
            F.sum("n").alias("__n"), F.min("value").alias("__low"), F.max("value").alias("__high"), F.count(F.lit(1)).alias("__rows"))
        blocks = panes.withColumn("__block", F.explode(F.sequence(
            F.floor(first / block).cast("long"), F.floor(F.floor(F.col("pane") / step) * step / block).cast("long"))))
        within = covering(blocks.repartition("__block", "model_name"), F.greatest(first, F.col("__block") * block),
                          F.least(last, F.col("__block") * block + (block - step)))
        buckets = within.groupBy("__block", *keys, "__bucket").agg(
            F.min("__low").alias("__low"), F.max("__high").alias("__high"), F.sum("__n").alias("__n"), F.sum("__rows").alias("__rows"))
        hits = materialise(wanted_buckets(buckets, ["__block", *keys], list(outputs.values())), "window-ranks")
        many, largest = hits.agg(F.count(F.lit(1)), F.max("__rows")).first()
        if (largest or 0) <= BUCKET_ROWS:
            break

    wanted = hits.drop("__block", "__n", "__rows").withColumn(
        "__pane", F.explode(F.sequence("start", F.col("start") + (long - pane), F.lit(pane).cast("long")))
    ).withColumnsRenamed({"model_name": "__model", "__bucket": "__b"})
    if is_small(wanted, many * (long // pane)):
        wanted = F.broadcast(wanted)
    values = placed.select("pane", "model_name", "__bucket", "value", "n").join(
        wanted, (F.col("pane") == F.col("__pane")) & (F.col("__bucket") == F.col("__b"))
        & F.col("model_name").eqNullSafe(F.col("__model")))
    values = values.groupBy(*keys, "__bucket", F.col("value").alias("__value")).agg(
        F.sum("n").alias("__n"), *[F.first(c).alias(c) for c in ("__before", "__total", "__low", "__high")])
    ranks = values_at_ranks(values, keys, outputs, largest or 0).withColumnsRenamed({"start": "__start", "model_name": "__model"})
    both = totals.join(ranks, (F.col("start") == F.col("__start")) & F.col("model_name").eqNullSafe(F.col("__model")), "left")
    return both.select(
        F.timestamp_seconds("start").alias("window_start"), F.timestamp_seconds(F.col("start") + long).alias("window_end"),
        "model_name", "requests", *outputs, "error_rate", (F.col("requests") / long).alias("throughput_req_s"),
        (F.col("tokens") / long).alias("tokens_per_second"))


def sliding_p95(stream: DataFrame, size: str = "10 minutes", slide: str = "1 minute",
                delay: str = "10 minutes") -> DataFrame | Closing:
    """p95 latency per model over a sliding window."""
    columns = ["window_start", "window_end", "model_name", "requests", "latency_p95_ms"]
    found = latency_windows(stream, size, slide, delay, (95,))
    return found.then(lambda df: df.select(*columns)) if isinstance(found, Closing) else found.select(*columns)


def resource_windows(stream: DataFrame, size: str = "5 seconds", delay: str = "10 minutes",
                     keys: list[str] = ()) -> DataFrame:
    """Mean utilisation per window; memory totals are those of the first sample."""
    means = ["gpu_memory_used_mb", "gpu_utilization_percent", "cpu_percent", "ram_used_gb"]
    grouped = (
        stream.withWatermark("ts", delay)
        .groupBy(F.window("ts", size), *keys)
        .agg(F.count(F.lit(1)).alias("samples"),
             *[F.avg(c).alias(c) for c in means],
             *[F.min_by(c, F.struct("ts", "sample_id")).alias(c)
               for c in ("gpu_memory_total_mb", "ram_total_gb")])
        .withColumn("gpu_utilization", F.col("gpu_utilization_percent") / 100)
    )
    return _bounds(grouped, *keys, "samples", *means, "gpu_memory_total_mb", "ram_total_gb",
                   "gpu_utilization")


def alerts(windows: DataFrame | Closing, thresholds: DataFrame,
           keys: list[str] = ("model_name",)) -> DataFrame | Closing:
    """Windows whose metrics pass a threshold; ``thresholds`` is a short static table."""
    if isinstance(windows, Closing):
        return windows.then(lambda df: alerts(df, thresholds, keys))
    known = ["latency_p95_ms", "latency_p99_ms", "throughput_req_s", "gpu_utilization", "error_rate"]
    metrics = [m for m in known if m in windows.columns]
    ids = ["window_start", "window_end", *keys]
    long = windows.select(*ids, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics
    ])).alias("m")).select(*ids, "m.metric", "m.value")
    breach = F.when(F.col("alert_above"), F.col("value") > F.col("threshold")).otherwise(
        F.col("value") < F.col("threshold"))
    return long.join(thresholds, "metric").filter(breach).select(
        *ids, "metric", "value", "threshold")


def run_sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes",
                 key: str = "model_name") -> DataFrame:
    """Runs found by silence: a run of a model ends when nothing arrives for ``gap``.

    Sessions are merged within each task before the shuffle, so a hot model sends a row per session and task.
    """
    stream.sparkSession.conf.set(SESSION_MERGE, "true")
    grouped = (
        stream.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", gap), key)
        .agg(F.count(F.lit(1)).alias("requests"),
             F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
    )
    return grouped.select(
        F.col("session_window.start").alias("run_start"), F.col("session_window.end").alias("run_end"),
        key, "requests", "tokens")


def running_cost(stream: DataFrame, models: DataFrame, size: str = "1 day",
                 delay: str = "10 minutes") -> DataFrame:
    """Cost per model and window; prices come from a static table."""
    sums = (
        stream.withWatermark("ts", delay)
        .groupBy(F.window("ts", size), "model_name")
        .agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
             (F.sum("latency_ms") / 1000).alias("duration_seconds"))
    )
    priced = cost_projection(with_prices(sums, models))
    return _bounds(priced, "model_name", "input_tokens", "output_tokens", "api_cost_usd",
                   "infrastructure_cost_usd", "total_cost_usd").withColumn(
        "cost_per_request_token", safe_div("total_cost_usd", F.col("input_tokens") + F.col("output_tokens")))
