"""Queries that run as streams over the event files until everything is read.

A window is emitted when the watermark (latest time minus the delay) has
passed its end, so the SQL leaves out the windows still open.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.plans.ctes import with_tables
from gaugework.plans.projections import r
from gaugework.plans.registry import query
from gaugework.sources import catalog, tables
from gaugework.streaming import windows
from gaugework.streaming.run import drain, read_folder


def _events(spark, sf):
    return read_folder(spark, sf, "events.parquet")


def _requests(spark, sf):
    return tables.shape_requests(_events(spark, sf))


_ALERTS = {name: (limit, above) for name, limit, above in catalog.ALERT_THRESHOLDS}
_GPU = next(t[1:] for t in catalog.ALERT_THRESHOLDS if t[0] == "gpu_utilization")


def stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


_CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"
_HOURLY = f"""
, hourly AS (
  SELECT window_start, model_name, count(*) AS requests,
         quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95,
         quantile_disc(latency_ms, 0.99) AS p99, avg(CAST(is_error AS DOUBLE)) AS error_rate,
         sum(input_tokens + output_tokens) AS tokens
  FROM (SELECT *, date_trunc('hour', ts) AS window_start FROM requests) GROUP BY window_start, model_name
  HAVING window_start + INTERVAL 1 HOUR <= {_CLOSED})
"""


@query(with_tables("requests", _HOURLY + """
SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, model_name, requests,
       p50 AS latency_p50_ms, p95 AS latency_p95_ms, p99 AS latency_p99_ms, round(error_rate, 6) AS error_rate,
       round(requests / 3600, 9) AS throughput_req_s, round(tokens / 3600, 6) AS tokens_per_second FROM hourly"""))
def stream_latency_windows(spark, sf):
    return drain(windows.latency_windows(_requests(spark, sf)), "latency").select(
        stamp("window_start"), "model_name", "requests", "latency_p50_ms", "latency_p95_ms", "latency_p99_ms",
        r("error_rate"), r("throughput_req_s", 9), r("tokens_per_second"))


@query(with_tables("samples", f"""
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS samples,
       round(avg(gpu_memory_used_mb), 6) AS gpu_memory_used_mb,
       round(avg(gpu_utilization_percent), 6) AS gpu_utilization_percent, round(avg(cpu_percent), 6) AS cpu_percent,
       arg_min(gpu_memory_total_mb, (ts, sample_id)) AS gpu_memory_total_mb
FROM (SELECT *, time_bucket(INTERVAL 5 SECOND, ts) AS w FROM samples) GROUP BY w
HAVING w + INTERVAL 5 SECOND <= {_CLOSED}"""))
def stream_resource_windows(spark, sf):
    samples = tables.shape_resources(_events(spark, sf))
    return drain(windows.resource_windows(samples), "resources").select(
        stamp("window_start"), "samples", r("gpu_memory_used_mb"), r("gpu_utilization_percent"),
        r("cpu_percent"), "gpu_memory_total_mb")


_MEASURED = {"latency_p95_ms": "p95", "latency_p99_ms": "p99", "throughput_req_s": "requests / 3600", "error_rate": "error_rate"}
_LONG = " UNION ALL ".join(
    f"SELECT window_start, model_name, '{m}' AS metric, {v} AS value, {_ALERTS[m][0]} AS t, {str(_ALERTS[m][1]).lower()} AS above"
    " FROM hourly" for m, v in _MEASURED.items())


@query(with_tables("requests", _HOURLY + f"""
, long AS ({_LONG})
SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, model_name, metric, round(value, 9) AS value
FROM long WHERE (above AND value > t) OR (NOT above AND value < t)"""))
def stream_alerts(spark, sf):
    breaches = windows.alerts(windows.latency_windows(_requests(spark, sf)), catalog.alert_thresholds(spark))
    return drain(breaches, "alerts").select(stamp("window_start"), "model_name", "metric", r("value", 9))


@query(with_tables("samples", f"""
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, 'gpu_utilization' AS metric,
       round(avg(gpu_utilization_percent) / 100, 9) AS value
FROM (SELECT *, time_bucket(INTERVAL 5 SECOND, ts) AS w FROM samples) GROUP BY w
HAVING w + INTERVAL 5 SECOND <= {_CLOSED} AND avg(gpu_utilization_percent) / 100 {'>' if _GPU[1] else '<'} {_GPU[0]}"""))
def stream_gpu_alerts(spark, sf):
    samples = tables.shape_resources(_events(spark, sf))
    breaches = windows.alerts(windows.resource_windows(samples), catalog.alert_thresholds(spark), keys=[])
    return drain(breaches, "gpu-alerts").select(stamp("window_start"), "metric", r("value", 9))


@query(with_tables("requests", f"""
, marked AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY model_name ORDER BY ts, request_id)
                            + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM requests),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY model_name ORDER BY ts, request_id) AS n FROM marked)
SELECT model_name, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS run_start, count(*) AS requests,
       CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens
FROM numbered GROUP BY model_name, n HAVING max(ts) + INTERVAL 30 MINUTE <= {_CLOSED}"""))
def stream_run_sessions(spark, sf):
    return drain(windows.run_sessions(_requests(spark, sf)), "sessions").select(
        "model_name", stamp("run_start"), "requests", "tokens")


@query(with_tables("requests models", f"""
SELECT strftime(d, '%Y-%m-%d %H:%M:%S') AS window_start, s.model_name, i AS input_tokens, o AS output_tokens,
       round(i / 1e6 * coalesce(price_in, 0) + o / 1e6 * coalesce(price_out, 0)
             + dur / 3600 * coalesce(cost_per_hour, 0), 9) AS total_cost_usd
FROM (SELECT date_trunc('day', ts) AS d, model_name, CAST(sum(input_tokens) AS BIGINT) AS i,
             CAST(sum(output_tokens) AS BIGINT) AS o, sum(latency_ms) / 1000 AS dur
      FROM requests GROUP BY ALL) s
LEFT JOIN models m ON s.model_name = m.model_name
WHERE d + INTERVAL 1 DAY <= {_CLOSED}"""))
def stream_running_cost(spark, sf):
    return drain(windows.running_cost(_requests(spark, sf), catalog.models(spark)), "cost").select(
        stamp("window_start"), "model_name", "input_tokens", "output_tokens", r("total_cost_usd", 9))


@query(with_tables("requests", f"""
, slid AS (SELECT date_trunc('minute', ts) - to_minutes(k) AS w, model_name, latency_ms
           FROM requests, LATERAL (SELECT unnest(range(0, 10)) AS k))
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, model_name, count(*) AS requests,
       quantile_disc(latency_ms, 0.95) AS latency_p95_ms
FROM slid GROUP BY ALL HAVING w + INTERVAL 10 MINUTE <= {_CLOSED}"""))
def stream_sliding_p95(spark, sf):
    return drain(windows.sliding_p95(_requests(spark, sf)), "sliding").select(
        stamp("window_start"), "model_name", "requests", "latency_p95_ms")


@query(with_tables("requests", "SELECT request_id, model_name, latency_ms FROM requests"))
def stream_without_repeats(spark, sf):
    log = _requests(spark, sf)
    twice = log.withColumn("__copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("__copy")
    return drain(windows.without_repeats(twice), "unique").select("request_id", "model_name", "latency_ms")
