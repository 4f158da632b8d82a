"""Queries over aggregates, reports, sinks and the store."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.operators import aggregates, cost, experiments, filters, quality, report
from gaugework.plans.ctes import with_tables
from gaugework.plans.projections import BATCH_KEYS, configs, r
from gaugework.plans.registry import ORACLE_SQL, query
from gaugework.session import fresh_path, materialise
from gaugework.sources import catalog, store, tables


@query(with_tables("requests", """
SELECT model_name, workload, batch_size, round_even(round(sum(latency_ms), 9) / count(latency_ms), 9) AS latency_ms_mean,
       round_even(quantile_cont(latency_ms, 0.5), 9) AS latency_ms_median,
       round_even(quantile_cont(latency_ms, 0.95), 9) AS latency_ms_p95,
       round_even(quantile_cont(latency_ms, 0.99), 9) AS latency_ms_p99,
       CAST(sum(input_tokens) AS BIGINT) AS input_tokens_sum, CAST(sum(output_tokens) AS BIGINT) AS output_tokens_sum
FROM requests GROUP BY ALL"""))
def config_summary(spark, sf):
    return aggregates.config_summary(tables.requests(spark, sf), digits=9)


@query(ORACLE_SQL["config_summary"])
def config_summary_by_counting(spark, sf):
    """The plan for large logs: percentiles by counting, without and with fine buckets alike."""
    return aggregates.config_summary(tables.requests(spark, sf), digits=9, bucket_rows=0)


@query(with_tables("configs", """
SELECT config_id, model_name, workload, batch_size, latency_ms, p95_latency_ms, cost_per_1m_tok, throughput FROM configs"""))
def config_metrics_by_counting(spark, sf):
    """The plan for crowded buckets."""
    return aggregates.config_metrics(tables.requests(spark, sf), catalog.models(spark), bucket_rows=0).select(
        "config_id", "model_name", "workload", "batch_size", "latency_ms", "p95_latency_ms", "cost_per_1m_tok", "throughput")


@query(with_tables("requests", """
SELECT model_name,
""" + ",\n".join(
    f"round(quantile_cont({e}, {p / 100}), 8) AS {m}_p{p}"
    for m, e in (("ttft_ms", "ttft_ms"), ("end_to_end_ms", "e2e_s * 1000")) for p in (50, 90, 95, 99)) + """
FROM requests GROUP BY 1"""))
def latency_percentiles(spark, sf):
    from gaugework.operators.derive import latency_projection

    timed = latency_projection(tables.requests(spark, sf))
    ranks = aggregates.latency_percentiles(timed, ["model_name"])
    return ranks.select("model_name", *[
        F.round(F.col(f"{m}.p{p}"), 8).alias(f"{m}_p{p}")
        for m in ("ttft_ms", "end_to_end_ms") for p in (50, 90, 95, 99)])


@query(with_tables("requests", """
SELECT model_name, round_even(round(sum(latency_ms), 9) / count(latency_ms), 4) AS latency_ms_mean,
       round_even(quantile_cont(latency_ms, 0.95), 4) AS latency_ms_p95,
       CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
       CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens
FROM requests GROUP BY 1"""))
def model_report(spark, sf):
    return aggregates.model_report(tables.requests(spark, sf), digits=4)


def _priced_requests(spark, sf):
    priced = cost.request_cost(tables.requests(spark, sf), catalog.models(spark))
    return priced.withColumn("cost_per_1m_tok", F.round("cost_per_1m_tok", 12))


_PRICED = """
, priced AS (
  SELECT r.*, deployment_type, round((input_tokens / 1e6 * coalesce(price_in, 0)
           + output_tokens / 1e6 * coalesce(price_out, 0) + latency_ms / 1000 / 3600 * coalesce(cost_per_hour, 0))
           / (input_tokens + output_tokens) * 1e6, 12) AS cost_per_1m_tok
  FROM requests r LEFT JOIN models m ON r.model_name = m.model_name)
"""


@query(with_tables("requests models", _PRICED + """
SELECT model_name, round(avg(cost_per_1m_tok), 6) AS mean_cost_per_1m_tok,
       round(avg(cost_per_1m_tok) * 100, 4) AS monthly_cost
FROM priced GROUP BY 1"""))
def mean_cost_by_model(spark, sf):
    return aggregates.mean_cost_by_model(_priced_requests(spark, sf)).select(
        "model_name", r("mean_cost_per_1m_tok"), r("monthly_cost", 4))


@query(with_tables("requests", """
SELECT model_name, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(latency_ms), 4) AS latency_ms,
       round(sum(output_tokens) / (sum(latency_ms) / 1000), 6) AS tokens_per_sec
FROM requests GROUP BY 1"""))
def throughput_by_model(spark, sf):
    return aggregates.throughput_by_model(tables.requests(spark, sf)).select(
        "model_name", "output_tokens", r("latency_ms", 4), r("tokens_per_sec"))


@query(with_tables("requests", """
SELECT model_name, batch_size, round(avg(latency_ms), 6) AS latency_ms FROM requests GROUP BY ALL"""))
def mean_latency_by_batch(spark, sf):
    return aggregates.mean_latency_by_batch(tables.requests(spark, sf)).select(
        "model_name", "batch_size", r("latency_ms"))


@query(with_tables("samples", """
SELECT run_id, round(avg(gpu_memory_used_mb), 6) AS gpu_memory_used_mb,
       round(avg(gpu_utilization_percent), 6) AS gpu_utilization_percent,
       round(avg(cpu_percent), 6) AS cpu_percent, round(avg(ram_used_gb), 6) AS ram_used_gb,
       arg_min(gpu_memory_total_mb, (ts, sample_id)) AS gpu_memory_total_mb,
       arg_min(ram_total_gb, (ts, sample_id)) AS ram_total_gb
FROM samples GROUP BY 1"""))
def average_resources(spark, sf):
    return aggregates.average_resources(tables.resource_samples(spark, sf), ["run_id"]).select(
        "run_id", r("gpu_memory_used_mb"), r("gpu_utilization_percent"), r("cpu_percent"),
        r("ram_used_gb"), "gpu_memory_total_mb", "ram_total_gb")


@query(with_tables("requests", """
SELECT count(*) AS rows, count(DISTINCT model_name) AS distinct_model_name,
       count(DISTINCT workload) AS distinct_workload, count(DISTINCT run_id) AS distinct_run_id FROM requests"""))
def distinct_counts(spark, sf):
    return aggregates.distinct_counts(
        tables.requests(spark, sf), ["model_name", "workload", "run_id"])


@query(with_tables("requests", """
, five AS (SELECT model_name, min(latency_ms) AS low, quantile_cont(latency_ms, 0.25) AS q1,
                  quantile_cont(latency_ms, 0.5) AS median, quantile_cont(latency_ms, 0.75) AS q3,
                  max(latency_ms) AS high FROM requests GROUP BY 1)
SELECT f.model_name, low, round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median,
       round(any_value(q3), 4) AS q3, any_value(high) AS high,
       min(latency_ms) AS lower_whisker, max(latency_ms) AS upper_whisker
FROM five f JOIN requests r ON f.model_name = r.model_name
  AND latency_ms >= q1 - 1.5 * (q3 - q1) AND latency_ms <= q3 + 1.5 * (q3 - q1)
GROUP BY f.model_name, low"""))
def box_summary(spark, sf):
    return aggregates.box_summary(tables.requests(spark, sf)).select(
        "model_name", "low", r("q1", 4), r("median", 4), r("q3", 4), "high", "lower_whisker", "upper_whisker")


@query(with_tables("requests samples", """
, rates AS (SELECT run_id, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens, count(*) AS n,
              (max(epoch_us(ts) + latency_ms * 1000) - min(epoch_us(ts))) / 1e6 AS duration,
              quantile_cont(ttft_ms, 0.5) AS t50, quantile_cont(e2e_s * 1000, 0.99) AS e99
            FROM requests GROUP BY 1),
usage AS (SELECT run_id, avg(gpu_utilization_percent) AS gpu, avg(gpu_memory_used_mb) AS used, avg(ram_used_gb) AS ram,
            arg_min(gpu_memory_total_mb, (ts, sample_id)) AS gpu_mb, arg_min(ram_total_gb, (ts, sample_id)) AS ram_gb
          FROM samples GROUP BY 1)
SELECT run_id, round(t50, 8) AS ttft_p50, round(e99, 8) AS e2e_p99, round(total_tokens / duration, 6)
         AS tokens_per_second, total_tokens, n AS num_samples, round(gpu, 6) AS gpu_utilization_percent,
       round(CASE WHEN gpu_mb > 0 THEN used / gpu_mb ELSE 0 END * 100, 6) AS gpu_memory_percent,
       round(CASE WHEN ram_gb > 0 THEN ram / ram_gb ELSE 0 END * 100, 6) AS ram_percent
FROM rates JOIN usage USING (run_id)"""))
def composite_summary(spark, sf):
    from gaugework.operators.derive import latency_projection

    full = aggregates.composite_summary(
        latency_projection(tables.requests(spark, sf)), tables.resource_samples(spark, sf))
    return full.select(
        "run_id", F.round("latency.ttft_ms.p50", 8).alias("ttft_p50"),
        F.round("latency.end_to_end_ms.p99", 8).alias("e2e_p99"),
        F.round("throughput.tokens_per_second", 6).alias("tokens_per_second"),
        F.col("throughput.total_tokens").alias("total_tokens"), "num_samples",
        *[F.round(f"resources.{c}", 6).alias(c)
          for c in ("gpu_utilization_percent", "gpu_memory_percent", "ram_percent")])


@query(with_tables("requests models", _PRICED + """
SELECT count(DISTINCT model_name) AS models_tested, round(avg(latency_ms), 6) AS avg_latency_ms,
       round(avg(cost_per_1m_tok), 6) AS avg_cost_per_1m_tok, count(*) AS total_samples FROM priced"""))
def headline_kpis(spark, sf):
    return aggregates.headline_kpis(_priced_requests(spark, sf)).select(
        "models_tested", r("avg_latency_ms"), r("avg_cost_per_1m_tok"), "total_samples")


@query(with_tables("requests", """
SELECT model_name, run_id, count(*) AS requests, count(*) FILTER (is_error) AS errors,
       round(avg(CAST(is_error AS DOUBLE)), 6) AS error_rate FROM requests GROUP BY ALL"""))
def error_rate(spark, sf):
    return aggregates.error_rate(tables.requests(spark, sf), ["model_name", "run_id"]).select(
        "model_name", "run_id", "requests", "errors", r("error_rate"))


_EXPERIMENT = """
batched AS (
  SELECT *, (row_number() OVER (PARTITION BY run_id, model_name, workload, batch_size ORDER BY request_id) - 1) // batch_size AS batch_no
  FROM requests),
timed AS (
  SELECT *, max(latency_ms) OVER b / count(*) OVER b AS lat FROM batched
  WINDOW b AS (PARTITION BY run_id, model_name, workload, batch_size, batch_no)),
experiment AS (
  SELECT batch_size, 'static' AS strategy, round(sum(lat), 9) / count(lat) AS mean_latency_ms, quantile_cont(lat, 0.5) AS p50_latency_ms,
         quantile_cont(lat, 0.95) AS p95_latency_ms, quantile_cont(lat, 0.99) AS p99_latency_ms,
         count(*) / dur AS throughput_req_per_sec, sum(output_tokens) / dur AS throughput_tokens_per_sec
  FROM timed JOIN (SELECT batch_size, (max(epoch_us(ts) + latency_ms * 1000) - min(epoch_us(ts))) / 1e6 AS dur
                   FROM requests GROUP BY 1) USING (batch_size)
  GROUP BY batch_size, dur)"""


def _experiment(spark, sf, target=80.0):
    slim = tables.requests(spark, sf).select("request_id", *BATCH_KEYS, "latency_ms", "output_tokens", "ts")
    batched = experiments.assign_batches(slim, BATCH_KEYS)
    return experiments.batch_experiment(batched, batches=BATCH_KEYS, sla_target_ms=target)


_EXPERIMENT_COLUMNS = ["mean_latency_ms", "p50_latency_ms", "p95_latency_ms", "p99_latency_ms",
                       "throughput_req_per_sec", "throughput_tokens_per_sec"]
_EXPERIMENT_SELECT = "batch_size, strategy, " + ", ".join(
    f"round({c}, 9) AS {c}" for c in _EXPERIMENT_COLUMNS) + ", p95_latency_ms <= 80 AS meets_sla, 80.0::DOUBLE AS sla_target_ms"


def _rounded_experiment(df):
    return df.select("batch_size", "strategy", *[r(c, 9) for c in _EXPERIMENT_COLUMNS], "meets_sla", "sla_target_ms")


@query(with_tables("requests", f", {_EXPERIMENT} SELECT {_EXPERIMENT_SELECT} FROM experiment"))
def batch_experiment(spark, sf):
    return _rounded_experiment(_experiment(spark, sf))


@query(with_tables("requests", f""", {_EXPERIMENT}
SELECT {_EXPERIMENT_SELECT} FROM experiment WHERE p95_latency_ms <= 80"""))
def sla_passing_batches(spark, sf):
    return _rounded_experiment(experiments.sla_passing(_experiment(spark, sf)))


@query(with_tables("requests", f""", {_EXPERIMENT}
SELECT {_EXPERIMENT_SELECT} FROM experiment WHERE p95_latency_ms <= 80
ORDER BY throughput_tokens_per_sec DESC, batch_size LIMIT 1"""))
def optimal_batch(spark, sf):
    return _rounded_experiment(experiments.optimal_batch(_experiment(spark, sf)))


# each quantisation of a model is an experiment of its own, sent in batches
QUANT_KEYS = ["quantization", *BATCH_KEYS]
_PERFORMANCE = """
sent AS (
  SELECT *, (row_number() OVER (PARTITION BY quantization, run_id, model_name, workload, batch_size ORDER BY request_id) - 1) // batch_size AS batch_no
  FROM requests),
shared AS (
  SELECT *, max(latency_ms) OVER b / count(*) OVER b AS lat FROM sent
  WINDOW b AS (PARTITION BY quantization, run_id, model_name, workload, batch_size, batch_no)),
performance AS (
  SELECT model_name, quantization, round_even(round(sum(lat), 9) / count(lat), 4) AS mean_latency_ms,
         round_even(quantile_cont(lat, 0.5), 4) AS p50_latency_ms,
         round_even(quantile_cont(lat, 0.95), 4) AS p95_latency_ms,
         round_even(quantile_cont(lat, 0.99), 4) AS p99_latency_ms,
         round_even(sum(output_tokens) / greatest(sum(lat) / 1000, 0.001), 4) AS throughput_tok_s
  FROM shared GROUP BY ALL)"""


def _performance(spark, sf):
    slim = tables.requests(spark, sf).select("request_id", *QUANT_KEYS, "latency_ms", "output_tokens")
    sent = experiments.batch_rows(experiments.assign_batches(slim, QUANT_KEYS), QUANT_KEYS)
    return experiments.quantization_performance(
        materialise(sent.select("model_name", "quantization", "amortised_ms", "n", "output_tokens"), "shared"),
        latency="amortised_ms", digits=4, weight="n")


@query(with_tables("requests", f", {_PERFORMANCE} SELECT * FROM performance"))
def quantization_performance(spark, sf):
    return _performance(spark, sf)


@query(with_tables("requests accuracy models quantizations", f""", {_PERFORMANCE},
scored AS (SELECT p.*, a.task_accuracy FROM performance p LEFT JOIN accuracy a USING (model_name, quantization)),
sized AS (SELECT m.model_name, q.quantization, q.dtype, q.memory_reduction,
                 try_cast(regexp_extract(parameters, '^([0-9]+(?:\\.[0-9]+)?)B$', 1) AS DOUBLE) * 1e9
                   * CASE dtype WHEN 'int8' THEN 1.0::DOUBLE WHEN 'int4' THEN 0.5::DOUBLE ELSE 2.0::DOUBLE END
                   / 1073741824 * 1.2::DOUBLE AS gb
          FROM models m CROSS JOIN quantizations q)
SELECT e.run_id, s.model_name, s.quantization, z.dtype, s.mean_latency_ms, s.p50_latency_ms, s.p95_latency_ms,
       s.p99_latency_ms, s.throughput_tok_s, s.task_accuracy,
       round(CASE WHEN b.model_name IS NOT NULL AND s.quantization <> 'fp16'
             THEN coalesce(s.task_accuracy, 0) - coalesce(b.task_accuracy, 0) END, 6) AS accuracy_delta,
       round_even(gb, 2) AS est_memory_gb, z.memory_reduction, e.timestamp
FROM scored s JOIN (
  SELECT model_name, quantization, max(run_id) AS run_id, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f') AS timestamp
  FROM requests GROUP BY ALL) e ON s.model_name = e.model_name AND s.quantization = e.quantization LEFT JOIN scored b ON s.model_name = b.model_name AND b.quantization = 'fp16'
JOIN sized z ON s.model_name = z.model_name AND s.quantization = z.quantization"""))
def experiment_records(spark, sf):
    performance = _performance(spark, sf)
    scores = quality.task_accuracy(tables.responses(spark, sf), tables.prompt_keywords(spark, sf))
    records = experiments.experiment_records(
        performance, scores, catalog.models(spark), catalog.quantizations(spark),
        experiments.experiment_runs(tables.requests(spark, sf)))
    return records.withColumn("accuracy_delta", F.round("accuracy_delta", 6))


@query(with_tables("requests models", _PRICED + """
, costs AS (SELECT model_name, avg(cost_per_1m_tok) AS c FROM priced GROUP BY 1),
perf AS (SELECT model_name, avg(latency_ms) AS m, quantile_cont(latency_ms, 0.95) AS p,
                CAST(sum(input_tokens + output_tokens) AS DOUBLE) AS t FROM priced GROUP BY 1),
chat AS (SELECT * FROM priced WHERE latency_ms < 200 ORDER BY latency_ms, request_id LIMIT 1)
SELECT 'overview' AS section, 'all' AS key, 'total_samples' AS metric, CAST(count(*) AS DOUBLE) AS value FROM priced
UNION ALL SELECT 'overview', 'all', 'models_tested', CAST(count(DISTINCT model_name) AS DOUBLE) FROM priced
UNION ALL SELECT 'overview', 'all', 'workload_types', CAST(count(DISTINCT workload) AS DOUBLE) FROM priced
UNION ALL (SELECT 'findings', model_name, 'latency_ms', latency_ms FROM priced ORDER BY latency_ms, request_id LIMIT 1)
UNION ALL (SELECT 'findings', model_name, 'cost_per_1m_tok', cost_per_1m_tok FROM priced
           ORDER BY cost_per_1m_tok, request_id LIMIT 1)
UNION ALL (SELECT 'findings', model_name, 'throughput', round(output_tokens / (latency_ms / 1000), 4) FROM priced
           WHERE latency_ms > 0 ORDER BY round(output_tokens / (latency_ms / 1000), 9) DESC, request_id LIMIT 1)
UNION ALL (SELECT 'advice_batch', 'Use ' || model_name, 'cost_per_1m_tok', cost_per_1m_tok FROM priced
           ORDER BY cost_per_1m_tok, request_id LIMIT 1)
UNION ALL SELECT 'performance', model_name, 'latency_ms_mean', round(m, 4) FROM perf
UNION ALL SELECT 'performance', model_name, 'latency_ms_p95', round(p, 4) FROM perf
UNION ALL SELECT 'performance', model_name, 'total_tokens', t FROM perf
UNION ALL SELECT 'cost', model_name, 'mean_cost_per_1m_tok', round(c, 4) FROM costs
UNION ALL SELECT 'cost', model_name, 'monthly_cost', round(c * 100, 4) FROM costs
UNION ALL SELECT 'advice_realtime', 'Use ' || model_name || ' with batch_size=' || batch_size, 'latency_ms', latency_ms
          FROM chat"""))
def report_tables(spark, sf):
    speed = F.when(F.col("latency_ms") > 0, F.round(F.col("output_tokens") / (F.col("latency_ms") / 1000), 9))
    report_rows = report.report_tables(_priced_requests(spark, sf).withColumn("throughput", speed), digits=4)
    rounded = F.when(F.col("metric") == "cost_per_1m_tok", F.col("value")).otherwise(F.round("value", 4))
    return report_rows.withColumn("value", rounded)


# ---- sources, sinks and the store ---------------------------------------------

def _result_rows(spark, sf):
    return tables.requests(spark, sf).select(
        "run_id", "model_name", "backend", "workload", "batch_size", "latency_ms", "input_tokens",
        "output_tokens", F.col("ts").alias("timestamp"))


@query(with_tables("requests", """
SELECT model_name, batch_size, count(*) AS requests, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
       round(sum(latency_ms), 4) AS latency_ms, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_seen
FROM requests WHERE run_id = (SELECT max(run_id) FROM requests) GROUP BY ALL"""))
def latest_run_scan(spark, sf):
    path = fresh_path(spark, "results-csv")
    stamped = _result_rows(spark, sf).withColumn("run_id", F.date_format("timestamp", "yyyy-MM-dd'T00:00:00'"))
    store.save_results(stamped, path, "csv")
    return store.latest_run(spark, path).groupBy("model_name", "batch_size").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("output_tokens").alias("output_tokens"),
        F.round(F.sum("latency_ms"), 4).alias("latency_ms"),
        F.date_format(F.max("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_seen"))


@query(with_tables("requests", """
, f AS (SELECT * FROM (VALUES ('csv'), ('json'), ('parquet')) AS f(format)),
raw AS (SELECT run_id, count(*) AS n, CAST(sum(output_tokens) AS BIGINT) AS t FROM requests GROUP BY 1),
agg AS (SELECT run_id, count(*) AS n, CAST(sum(t) AS BIGINT) AS t FROM
          (SELECT run_id, model_name, CAST(sum(output_tokens) AS BIGINT) AS t FROM requests GROUP BY ALL) GROUP BY 1)
SELECT format, 'raw' AS layer, run_id, n AS rows, t AS output_tokens FROM raw CROSS JOIN f
UNION ALL SELECT format, 'aggregated', run_id, n, t FROM agg CROSS JOIN f"""))
def result_sinks(spark, sf):
    raw = _result_rows(spark, sf)
    summed = raw.groupBy("run_id", "model_name").agg(F.sum("output_tokens").alias("output_tokens"))
    out = None
    for fmt in store.FORMATS:
        for layer, df, schema in (("raw", raw, store.REQUEST_RESULT),
                                  ("aggregated", summed, "model_name STRING, output_tokens BIGINT, run_id STRING")):
            path = fresh_path(spark, f"{layer}-{fmt}")
            store.save_results(df, path, fmt)
            part = store.read_results(spark, path, fmt, schema).groupBy("run_id").agg(
                F.count(F.lit(1)).alias("rows"), F.sum("output_tokens").alias("output_tokens")
            ).select(F.lit(fmt).alias("format"), F.lit(layer).alias("layer"), "run_id", "rows", "output_tokens")
            out = part if out is None else out.unionByName(part)
    return out


def _stored(spark, sf):
    path = fresh_path(spark, "store")
    store.save_store(tables.benchmark_runs(spark, sf), tables.benchmark_results(spark, sf), path)
    return store.read_store(spark, path)


@query(with_tables("runs results", """
SELECT r.run_id, run_name, model_name, workload_type, batch_size, count(*) AS results,
       round(sum(latency_ms), 4) AS latency_ms, round(sum(cost_usd), 9) AS cost_usd
FROM results r JOIN runs ON r.run_id = runs.id GROUP BY ALL"""))
def run_result_store(spark, sf):
    runs, results = _stored(spark, sf)
    # one row per run before the join: a run with a third of all results is summed on the map side
    sums = results.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("results"), F.round(F.sum("latency_ms"), 4).alias("latency_ms"),
        F.round(F.sum("cost_usd"), 9).alias("cost_usd"))
    return store.results_with_runs(sums, runs).select(
        "run_id", "run_name", "model_name", "workload_type", "batch_size", "results", "latency_ms", "cost_usd")


@query(with_tables("runs results", """
SELECT r.run_id, model_name, batch_size, round(latency_ms, 6) AS latency_ms, input_tokens, output_tokens
FROM results r JOIN runs ON r.run_id = runs.id"""))
def results_with_runs(spark, sf):
    joined = store.results_with_runs(tables.benchmark_results(spark, sf), tables.benchmark_runs(spark, sf))
    return joined.select("run_id", "model_name", "batch_size", r("latency_ms"), "input_tokens", "output_tokens")


@query(with_tables("runs results", """
SELECT run_id, round(latency_ms, 6) AS latency_ms, input_tokens, output_tokens FROM results
WHERE run_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')"""))
def orphan_results(spark, sf):
    return store.orphan_results(
        tables.benchmark_results(spark, sf), tables.benchmark_runs(spark, sf, finished=True)).select(
        "run_id", r("latency_ms"), "input_tokens", "output_tokens")


@query(with_tables("requests", """
SELECT request_id, model_name, run_id, latency_ms, NULL AS error FROM requests WHERE NOT is_error
UNION ALL SELECT request_id, model_name, run_id, NULL, 'failed: ' || workload FROM requests WHERE is_error"""))
def ragged_append(spark, sf):
    log = tables.requests(spark, sf)
    good = log.filter("NOT is_error").select("request_id", "model_name", "run_id", "latency_ms")
    bad = log.filter("is_error").select(
        "request_id", "model_name", "run_id", F.concat(F.lit("failed: "), "workload").alias("error"))
    return store.append_results(good, bad)


@query(with_tables("requests results", """
SELECT source, count(*) AS n, round(sum(latency_ms), 2) AS latency_ms FROM (
  SELECT 'log' AS source, latency_ms FROM requests UNION ALL SELECT 'store', latency_ms FROM results) GROUP BY 1"""))
def append_runs(spark, sf):
    log = tables.requests(spark, sf).select(F.lit("log").alias("source"), "latency_ms")
    kept = tables.benchmark_results(spark, sf).select(F.lit("store").alias("source"), "latency_ms")
    return store.append_results(log, kept).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("latency_ms"), 2).alias("latency_ms"))


@query(with_tables("requests", """
SELECT DISTINCT model_name, workload, quantization FROM requests"""))
def distinct_outputs(spark, sf):
    return experiments.distinct_outputs(tables.requests(spark, sf), ["model_name", "workload", "quantization"])


@query(with_tables("runs models", """
SELECT m.model_name, w AS workload, b AS batch_size
FROM models m CROSS JOIN (SELECT unnest(['1-URGENT', '2-HIGH', '6-NEW']) AS w)
CROSS JOIN (SELECT unnest([1, 4, 8, 16, 32, 64]) AS b)
WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.model_name = m.model_name AND r.workload_type = w AND r.batch_size = b)"""))
def coverage_gaps(spark, sf):
    done = tables.benchmark_runs(spark, sf).withColumnRenamed("workload_type", "workload")
    return experiments.coverage_gaps(
        done, catalog.models(spark), ["1-URGENT", "2-HIGH", "6-NEW"], [*catalog.BATCH_SIZES, 64])
