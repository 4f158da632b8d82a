"""Queries over derived columns, cost and sizing."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.operators import aggregates, cost, derive, experiments, quality, select, sizing
from gaugework.plans.ctes import with_tables
from gaugework.plans.registry import ORACLE_SQL, query
from gaugework.sources import catalog, tables


def r(column: str, digits: int = 6):
    return F.round(F.col(column), digits).alias(column)


@query(with_tables("requests", """
SELECT request_id, round(ttft_s * 1000, 6) AS ttft_ms, round(mean_itl_s * 1000, 6) AS mean_itl_ms,
       round(e2e_s * 1000, 6) AS end_to_end_ms, coalesce(queue_s, 0) * 1000 AS queue_time_ms
FROM requests"""))
def latency_projection(spark, sf):
    return derive.latency_projection(tables.requests(spark, sf)).select(
        "request_id", r("ttft_ms"), r("mean_itl_ms"), r("end_to_end_ms"), "queue_time_ms")


_RUN_RATES = """
SELECT run_id, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens, count(*) AS total_requests,
       (max(epoch_us(ts) + latency_ms * 1000) - min(epoch_us(ts))) / 1e6 AS duration
FROM requests GROUP BY run_id"""


@query(with_tables("requests", f"""
SELECT run_id, total_tokens, total_requests, round(duration, 6) AS duration_seconds,
       round(total_tokens / duration, 6) AS tokens_per_second,
       round(total_requests / duration, 9) AS requests_per_second,
       round(total_tokens / total_requests, 6) AS tokens_per_request
FROM ({_RUN_RATES})"""))
def run_throughput(spark, sf):
    return aggregates.run_throughput(tables.requests(spark, sf)).select(
        "run_id", "total_tokens", "total_requests", r("duration_seconds"), r("tokens_per_second"),
        r("requests_per_second", 9), r("tokens_per_request"))


@query(with_tables("samples", """
SELECT sample_id, round(coalesce(gpu_memory_used_mb / nullif(gpu_memory_total_mb, 0), 0) * 100, 9)
         AS gpu_memory_percent,
       round(ram_used_gb / ram_total_gb * 100, 9) AS ram_percent,
       strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp
FROM samples"""))
def resource_percentages(spark, sf):
    return derive.resource_projection(tables.resource_samples(spark, sf)).select(
        "sample_id", r("gpu_memory_percent", 9), r("ram_percent", 9), "timestamp")


@query(with_tables("requests models", """
SELECT request_id, model_name, deployment_type, round(api, 12) AS api_cost_usd,
       round(infra, 12) AS infrastructure_cost_usd, round(api + infra, 12) AS total_cost_usd,
       (api + infra) / (input_tokens + output_tokens) * 1e6 AS cost_per_1m_tok
FROM (SELECT request_id, r.model_name, deployment_type, input_tokens, output_tokens,
             input_tokens / 1e6 * coalesce(price_in, 0) + output_tokens / 1e6 * coalesce(price_out, 0) AS api,
             latency_ms / 1000 / 3600 * coalesce(cost_per_hour, 0) AS infra
      FROM requests r LEFT JOIN models m ON r.model_name = m.model_name)"""))
def request_cost(spark, sf):
    return cost.request_cost(tables.requests(spark, sf), catalog.models(spark)).select(
        "request_id", "model_name", "deployment_type", r("api_cost_usd", 12),
        r("infrastructure_cost_usd", 12), r("total_cost_usd", 12), "cost_per_1m_tok")


@query(with_tables("requests models", """
SELECT run_id, model_name, input_tokens, output_tokens, round(api, 9) AS api_cost_usd,
       round(infra, 9) AS infrastructure_cost_usd, round(api + infra, 9) AS total_cost_usd
FROM (SELECT run_id, r.model_name, r.input_tokens, r.output_tokens,
             input_tokens / 1e6 * coalesce(price_in, 0) + output_tokens / 1e6 * coalesce(price_out, 0) AS api,
             dur / 3600 * coalesce(cost_per_hour, 0) AS infra
      FROM (SELECT run_id, model_name, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
                   CAST(sum(output_tokens) AS BIGINT) AS output_tokens, sum(latency_ms) / 1000 AS dur
            FROM requests GROUP BY ALL) r
      LEFT JOIN models m ON r.model_name = m.model_name)"""))
def run_cost_totals(spark, sf):
    return aggregates.run_cost(tables.requests(spark, sf), catalog.models(spark)).select(
        "run_id", "model_name", "input_tokens", "output_tokens", r("api_cost_usd", 9),
        r("infrastructure_cost_usd", 9), r("total_cost_usd", 9))


_COST_COLUMNS = "infrastructure_cost, api_cost, engineering_cost, power_cost, total_monthly_cost"


@query(with_tables("monthly", f"SELECT cost_model_id, model_name, {_COST_COLUMNS} FROM monthly"))
def monthly_cost(spark, sf):
    return cost.monthly_cost(tables.cost_models(spark, sf)).select(
        "cost_model_id", "model_name", *_COST_COLUMNS.split(", "))


def _model_pairs(costs):
    """Each cost model against the next one by id; an id that occurs more than once makes one pair."""
    return costs.select(F.col("cost_model_id").alias("baseline_id"),
                        (F.col("cost_model_id") + 1).alias("optimized_id")).distinct()


@query(with_tables("monthly", """
SELECT b.cost_model_id AS baseline_id, o.cost_model_id AS optimized_id,
       b.total_monthly_cost AS baseline_monthly, o.total_monthly_cost AS optimized_monthly,
       round_even(b.total_monthly_cost - o.total_monthly_cost, 2) AS monthly_savings,
       round_even((b.total_monthly_cost - o.total_monthly_cost) * 12, 2) AS annual_savings,
       round_even(CASE WHEN b.total_monthly_cost > 0
                  THEN (b.total_monthly_cost - o.total_monthly_cost) / b.total_monthly_cost * 100 ELSE 0 END, 1)
         AS savings_pct,
       b.infrastructure_cost AS baseline_infrastructure, o.infrastructure_cost AS optimized_infrastructure
FROM monthly b JOIN monthly o ON o.cost_model_id = b.cost_model_id + 1"""))
def tco_savings(spark, sf):
    costs = cost.monthly_cost(tables.cost_models(spark, sf))
    return cost.tco_savings(costs, _model_pairs(costs)).select(
        "baseline_id", "optimized_id", "baseline_monthly", "optimized_monthly", "monthly_savings",
        "annual_savings", "savings_pct",
        F.col("baseline_breakdown.infrastructure_cost").alias("baseline_infrastructure"),
        F.col("optimized_breakdown.infrastructure_cost").alias("optimized_infrastructure"))


def configs(spark, sf):
    """Configuration metrics over the whole request log."""
    return aggregates.config_metrics(
        tables.requests(spark, sf), catalog.models(spark), tables.config_quality(spark, sf))


@query(with_tables("configs", """
SELECT config_id, model_name, workload, batch_size, deployment_type, latency_ms, p95_latency_ms,
       cost_per_1m_tok, throughput, quality_score FROM configs"""))
def config_metrics(spark, sf):
    return configs(spark, sf)


@query(with_tables("configs", """
SELECT o.config_id, b.cost_per_1m_tok AS baseline_cost, o.cost_per_1m_tok AS optimized_cost,
       round_even(b.cost_per_1m_tok * 100, 2) AS baseline_monthly_usd,
       round_even(o.cost_per_1m_tok * 100, 2) AS optimized_monthly_usd,
       round_even(b.cost_per_1m_tok * 100 - o.cost_per_1m_tok * 100, 2) AS savings_monthly_usd,
       round_even(CASE WHEN b.cost_per_1m_tok > 0 THEN (b.cost_per_1m_tok * 100 - o.cost_per_1m_tok * 100)
                  / (b.cost_per_1m_tok * 100) * 100 ELSE 0 END, 1) AS savings_pct
FROM configs b JOIN configs o ON b.workload = o.workload AND b.batch_size = o.batch_size
WHERE b.model_name = 'gpt-3.5-turbo' AND o.model_name <> 'gpt-3.5-turbo'"""))
def frontier_savings(spark, sf):
    every = configs(spark, sf).select("config_id", "model_name", "workload", "batch_size", "cost_per_1m_tok")
    base = every.filter("model_name = 'gpt-3.5-turbo'").select(
        "workload", "batch_size", F.col("cost_per_1m_tok").alias("baseline_cost_per_1m_tok"))
    pairs = every.filter("model_name <> 'gpt-3.5-turbo'").withColumnRenamed(
        "cost_per_1m_tok", "optimized_cost_per_1m_tok").join(base, ["workload", "batch_size"])
    return cost.frontier_savings(pairs).select(
        "config_id", F.col("baseline_cost_per_1m_tok").alias("baseline_cost"),
        F.col("optimized_cost_per_1m_tok").alias("optimized_cost"), "baseline_monthly_usd",
        "optimized_monthly_usd", "savings_monthly_usd", "savings_pct")


@query(with_tables("configs", """
SELECT config_id, round(cost_per_1m_tok * 250, 6) AS monthly_cost FROM configs"""))
def volume_cost(spark, sf):
    return cost.volume_cost(configs(spark, sf), F.lit(250.0)).select("config_id", r("monthly_cost"))


@query(with_tables("memory", """
SELECT m.model_id, m.quantization, m.params_billion, m.bytes_per_param, m.param_memory_gb, m.total_memory_gb,
       round(m.total_memory_gb / f.total_memory_gb * 100, 6) AS pct_of_fp16
FROM memory m JOIN memory f ON m.model_id = f.model_id AND f.quantization = 'fp16'"""))
def memory_estimate(spark, sf):
    sizes = tables.model_sizes(spark, sf)
    estimates = sizing.memory_estimate(sizing.at_each_quantization(sizes))
    return sizing.memory_vs_fp16(estimates, "model_id").select(
        "model_id", "quantization", "params_billion", "bytes_per_param", "param_memory_gb",
        "total_memory_gb", r("pct_of_fp16"))


@query(with_tables("memory", """
SELECT model_id, quantization, cache, round_even(gpu_memory_gb * util, 2) AS reserved_gb,
       CASE WHEN total_memory_gb IS NOT NULL
            THEN round_even(greatest(gpu_memory_gb * util - total_memory_gb, 0), 2) END AS kv_cache_gb,
       CASE WHEN total_memory_gb IS NOT NULL THEN
            round(greatest(gpu_memory_gb * util - total_memory_gb, 0) / gpu_memory_gb * 100, 6) END AS kv_cache_pct
FROM memory CROSS JOIN (VALUES ('default', 0.90::DOUBLE), ('optimized', 0.95::DOUBLE),
                               ('conservative', 0.75::DOUBLE)) AS k(cache, util)"""))
def kv_cache_size(spark, sf):
    estimates = sizing.memory_estimate(sizing.at_each_quantization(tables.model_sizes(spark, sf)))
    sized = estimates.withColumnRenamed("total_memory_gb", "model_memory_gb")
    return sizing.kv_cache_estimate(sized, pct_digits=6).select(
        "model_id", "quantization", "cache", "reserved_gb", "kv_cache_gb", "kv_cache_pct")


@query(with_tables("configs", """
SELECT config_id, model_name, batch_size, 'fp16' AS quantization, 'g5.xlarge' AS infrastructure,
       cost_per_1m_tok, 0.9::DOUBLE AS quality_score FROM configs"""))
def optional_defaults(spark, sf):
    from gaugework.functions.scalars import with_defaults

    bare = aggregates.config_metrics(tables.requests(spark, sf), catalog.models(spark))
    return with_defaults(bare, {**select.CONFIG_DEFAULTS, **select.METRIC_DEFAULTS}).select(
        "config_id", "model_name", "batch_size", "quantization", "infrastructure", "cost_per_1m_tok",
        "quality_score")


@query(with_tables("accuracy", """
SELECT v.model_name, v.quantization, v.task_accuracy,
       round(CASE WHEN b.model_name IS NOT NULL AND v.quantization <> 'fp16'
             THEN v.task_accuracy - b.task_accuracy END, 6) AS accuracy_delta,
       round_even(CASE WHEN b.model_name IS NOT NULL AND v.quantization <> 'fp16'
             THEN -(v.task_accuracy - b.task_accuracy) * 100 END, 2) AS quality_degradation_pct
FROM accuracy v LEFT JOIN accuracy b ON v.model_name = b.model_name AND b.quantization = 'fp16'"""))
def quality_degradation(spark, sf):
    scores = quality.task_accuracy(tables.responses(spark, sf), tables.prompt_keywords(spark, sf))
    return derive.quality_degradation(quality.against_baseline(scores)).select(
        "model_name", "quantization", "task_accuracy", r("accuracy_delta"), "quality_degradation_pct")


@query(with_tables("requests", """
SELECT request_id, strftime(ts, '%Y%m%d_%H%M%S') AS run_stamp,
       strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp FROM requests"""))
def run_identifiers(spark, sf):
    return derive.stamp_runs(tables.requests(spark, sf)).select("request_id", "run_stamp", "timestamp")


# requests are sent in batches within a run, model, workload and batch size
BATCH_KEYS = ["run_id", "model_name", "workload", "batch_size"]
_BATCHED = """
batched AS (
  SELECT *, (row_number() OVER (PARTITION BY run_id, model_name, workload, batch_size ORDER BY request_id) - 1) // batch_size AS batch_no
  FROM requests),
timed AS (
  SELECT *, count(*) OVER (PARTITION BY run_id, model_name, workload, batch_size, batch_no) AS batch_requests,
         max(latency_ms) OVER (PARTITION BY run_id, model_name, workload, batch_size, batch_no) AS batch_ms FROM batched)"""


@query(with_tables("requests", "," + _BATCHED + """
SELECT request_id, batch_size, batch_no, batch_requests, round(batch_ms / batch_requests, 9) AS amortised_ms
FROM timed"""))
def batch_assignment(spark, sf):
    slim = tables.requests(spark, sf).select("request_id", *BATCH_KEYS, "latency_ms")
    batched = experiments.assign_batches(slim, BATCH_KEYS)
    return experiments.amortised_latency(batched, BATCH_KEYS).select(
        "request_id", F.col("batch_size").cast("int").alias("batch_size"), "batch_no", "batch_requests",
        r("amortised_ms", 9))


@query(ORACLE_SQL["batch_assignment"])
def batch_assignment_by_ranges(spark, sf):
    """From many input partitions."""
    slim = tables.requests(spark, sf).select("request_id", *BATCH_KEYS, "latency_ms")
    batched = experiments.assign_batches(slim.repartition(13), BATCH_KEYS)
    return experiments.amortised_latency(batched, BATCH_KEYS).select(
        "request_id", F.col("batch_size").cast("int").alias("batch_size"), "batch_no", "batch_requests",
        r("amortised_ms", 9))


@query(with_tables("configs", """
, tops AS (SELECT workload, max(p95_latency_ms) AS p, max(cost_per_1m_tok * 100) AS c FROM configs GROUP BY 1)
SELECT config_id, round(p95_latency_ms / p * 0.6::DOUBLE + cost_per_1m_tok * 100 / c * 0.4::DOUBLE, 6) AS score
FROM configs JOIN tops USING (workload)"""))
def weighted_score(spark, sf):
    priced = cost.volume_cost(configs(spark, sf), F.lit(100.0))
    return select.weighted_score(priced, ["workload"]).select("config_id", r("score"))


@query(r"""
WITH t AS (SELECT * FROM (VALUES
  (0, 'qa', 'Q: {question}' || chr(10) || 'A:', '{question}', 50, 200),
  (1, 'qa', 'Question: {question}' || chr(10) || 'Answer:', '{question}', 50, 200),
  (2, 'summarization', 'Summarize the following article:' || chr(10) || chr(10) || '{article}'
       || chr(10) || chr(10) || 'Summary:', '{article}', 500, 2000),
  (3, 'code_generation', '# Python function' || chr(10) || '{description}' || chr(10) || chr(10)
       || 'def solution():', '{description}', 100, 500)) AS t(template_id, workload, template, hole, lo, hi)),
d AS (SELECT doc_id, text, len(regexp_extract_all(text, '\S+')) AS n_tokens FROM documents)
SELECT doc_id, workload, template_id, n_tokens, length(replace(template, hole, text)) AS prompt_chars,
       md5(replace(template, hole, text)) AS prompt_md5
FROM d JOIN t ON n_tokens BETWEEN lo AND hi""")
def prompt_building(spark, sf):
    docs = tables.read(spark, sf, "documents").select("doc_id", "text")
    return quality.build_prompts(docs).select(
        "doc_id", "workload", "template_id", F.col("n_tokens").cast("long").alias("n_tokens"),
        F.length("prompt").cast("long").alias("prompt_chars"),
        F.md5("prompt").alias("prompt_md5"))


@query(with_tables("cost_models", """
SELECT cost_model_id, scenario, discount, round(gpu_hourly_rate * (1 - discount), 10) AS scenario_rate
FROM cost_models CROSS JOIN (VALUES ('on_demand', 0.0::DOUBLE), ('spot', 0.7::DOUBLE), ('reserved', 0.4::DOUBLE))
  AS s(scenario, discount)"""))
def cost_scenarios(spark, sf):
    return cost.cost_scenarios(tables.cost_models(spark, sf)).select(
        "cost_model_id", "scenario", "discount", r("scenario_rate", 10))


@query(with_tables("cost_models monthly models", """
SELECT cost_model_id, a.model_name AS api_model,
       round(total_monthly_cost / ((price_in + price_out) / 2), 6) AS break_even_millions
FROM (SELECT m.cost_model_id, total_monthly_cost FROM monthly m JOIN cost_models c USING (cost_model_id)
      WHERE NOT api) s
CROSS JOIN (SELECT * FROM models WHERE deployment_type = 'api') a"""))
def break_even_volume(spark, sf):
    own = cost.monthly_cost(tables.cost_models(spark, sf)).filter("deployment_type = 'self_hosted'")
    # the API price list is two rows of the fixed catalog, so it is exploded from literals
    apis = F.array(*[
        F.struct(F.lit(m[0]).alias("api_model"), F.lit((m[5] + m[6]) / 2).alias("api_price"))
        for m in catalog.MODELS if m[5] is not None])
    pairs = own.withColumn("__a", F.explode(apis)).select("cost_model_id", "total_monthly_cost", "__a.*")
    return cost.break_even(pairs, "total_monthly_cost", "api_price").select(
        "cost_model_id", "api_model", r("break_even_millions"))


@query(with_tables("requests", f"""
SELECT run_id, round(rate, 6) AS requests_per_second,
       CASE WHEN rate < 10 THEN 'light' WHEN rate < 50 THEN 'medium' ELSE 'heavy' END AS tier,
       CASE WHEN rate < 10 THEN 'g5.xlarge' WHEN rate < 50 THEN 'g5.2xlarge' ELSE 'p4d.24xlarge' END AS instance,
       CASE WHEN rate < 10 THEN 1.01::DOUBLE WHEN rate < 50 THEN 1.52::DOUBLE ELSE 32.77::DOUBLE END AS usd_per_hour
FROM (SELECT run_id, total_requests / duration AS rate FROM ({_RUN_RATES}))"""))
def load_tier(spark, sf):
    rates = aggregates.run_throughput(tables.requests(spark, sf)).withColumn(
        "requests_per_second", F.col("total_requests") / F.col("duration_seconds"))
    return sizing.load_tier(rates).select(
        "run_id", r("requests_per_second"), "tier", "instance", "usd_per_hour")
