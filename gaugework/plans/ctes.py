"""The logical tables as common table expressions, for the comparison SQL."""

from __future__ import annotations

from gaugework.sources.catalog import BATCH_SIZES, MODEL_NAMES, MODEL_PRESETS, MODELS, QUANTIZATIONS


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


def sql_value(v) -> str:
    if v is None:
        return "NULL"
    return f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)"


def sql_rows(rows) -> str:
    return ", ".join("(" + ", ".join(sql_value(v) for v in row) + ")" for row in rows)


NAMES = sql_list(MODEL_NAMES)
QUANTS = sql_list([q[0] for q in QUANTIZATIONS])
SIZES = sql_list(BATCH_SIZES)

_CTES = {
    "requests": f"""
        SELECT event_id AS request_id, user_id, ts, strftime(ts, '%Y%m%d') AS run_id,
               {NAMES}[user_id % 6 + 1] AS model_name,
               {sql_list([m[1] for m in MODELS])}[user_id % 6 + 1] AS backend,
               {QUANTS}[event_id % 3 + 1] AS quantization,
               event_type AS workload, {SIZES}[event_id % 5 + 1] AS batch_size,
               event_type = 'error' AS is_error, value AS latency_ms,
               value * 0.25 AS ttft_ms, value / 1000 * 0.25 AS ttft_s, value / 1000 AS e2e_s,
               CASE WHEN k % 3 = 0 THEN 0.0
                    ELSE (value / 1000 * 0.5 + value / 1000 * 0.125) / 2 END AS mean_itl_s,
               CASE WHEN event_id % 4 <> 0 THEN k / 1000.0 END AS queue_s,
               event_id % 200 + 1 AS input_tokens, k + 1 AS output_tokens
        FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""",
    "models": f"""
        SELECT *, CASE WHEN backend LIKE '%api%' THEN 'api' ELSE 'self_hosted' END AS deployment_type
        FROM (VALUES {sql_rows(MODELS)})
          AS m(model_name, backend, parameters, quantization, cost_per_hour, price_in, price_out)""",
    "presets": "SELECT * FROM (VALUES " + sql_rows(
        [(p, n) for p, names in MODEL_PRESETS.items() for n in names]) + ") AS p(preset, model_name)",
    "quantizations": f"""
        SELECT * FROM (VALUES {sql_rows(QUANTIZATIONS)})
          AS q(quantization, label, dtype, memory_reduction, expected_quality_loss)""",
    "samples": """
        SELECT event_id AS sample_id, strftime(ts, '%Y%m%d') AS run_id, k * 240.0 AS gpu_memory_used_mb,
               CASE WHEN user_id % 7 = 0 THEN 0.0::DOUBLE ELSE 24000.0::DOUBLE END AS gpu_memory_total_mb,
               CAST(k AS DOUBLE) AS gpu_utilization_percent, CAST(100 - k AS DOUBLE) AS cpu_percent,
               least(value / 10, 64.0) AS ram_used_gb, 64.0::DOUBLE AS ram_total_gb, ts
        FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""",
    "runs": f"""
        SELECT o_orderkey AS id, 'run-' || o_orderkey AS run_name, {NAMES}[o_custkey % 6 + 1] AS model_name,
               o_orderpriority AS workload_type, {SIZES}[o_orderkey % 5 + 1] AS batch_size
        FROM orders""",
    "results": """
        SELECT l_orderkey AS run_id, l_extendedprice / 100 AS latency_ms, l_partkey % 500 + 1 AS input_tokens,
               CAST(l_quantity AS BIGINT) AS output_tokens, l_extendedprice * l_tax / 1000 AS cost_usd
        FROM lineitem""",
    "reqs": """
        SELECT c_custkey AS req_id,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'real_time_chat' WHEN 'BUILDING' THEN 'interactive_app'
                    WHEN 'FURNITURE' THEN 'batch_processing' WHEN 'HOUSEHOLD' THEN 'high_throughput'
                    ELSE 'other' END AS workload_type,
               CAST(c_custkey % 40 * 10 + 50 AS DOUBLE) AS max_latency_p95_ms,
               greatest(c_acctbal, 0.0) AS monthly_budget_usd,
               CAST(c_custkey % 97 + 1 AS DOUBLE) AS monthly_tokens_millions,
               CAST(0.80 AS DOUBLE) + (c_custkey % 13) / 100 AS min_quality_score,
               c_nationkey % 2 = 0 AS prefer_self_hosted
        FROM customer""",
    "cost_models": """
        SELECT s_suppkey AS cost_model_id, s_name AS model_name, api,
               CASE WHEN api THEN 0.0 ELSE abs(s_acctbal) / 4000 END AS gpu_hourly_rate,
               CASE WHEN s_suppkey % 2 = 0 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END AS gpu_utilization,
               CASE WHEN api THEN CAST(0.5 AS DOUBLE) ELSE 0 END AS price_in,
               CASE WHEN api THEN CAST(1.5 AS DOUBLE) ELSE 0 END AS price_out,
               CASE WHEN api THEN 0.0 ELSE CAST(500 AS DOUBLE) END AS engineering,
               CASE WHEN api THEN 0.0 ELSE CAST(s_suppkey % 10 * 20 AS DOUBLE) END AS power,
               CAST(s_nationkey + 1 AS DOUBLE) AS input_millions,
               CAST(s_nationkey * 2 + 1 AS DOUBLE) AS output_millions
        FROM (SELECT *, s_suppkey % 3 = 0 AS api FROM supplier)""",
    "monthly": """
        SELECT cost_model_id, model_name,
               round_even(gpu_hourly_rate * gpu_utilization * 730, 2) AS infrastructure_cost,
               round_even(input_millions * price_in + output_millions * price_out, 2) AS api_cost,
               round_even(engineering, 2) AS engineering_cost, round_even(power, 2) AS power_cost,
               round_even(gpu_hourly_rate * gpu_utilization * 730
                          + (input_millions * price_in + output_millions * price_out)
                          + engineering + power, 2) AS total_monthly_cost
        FROM cost_models""",
    "sizes": f"""
        SELECT p_partkey AS model_id, p_name AS model_name,
               CASE WHEN p_type = 'PROMO' THEN 'Undisclosed' ELSE p_size || 'B' END AS parameters,
               CASE WHEN p_partkey % 5 = 0 THEN 'INT2' ELSE upper({QUANTS}[p_partkey % 3 + 1]) END AS quantization,
               CASE WHEN p_retailprice >= 950 THEN CAST(80 AS DOUBLE) ELSE CAST(24 AS DOUBLE) END AS gpu_memory_gb,
               CASE WHEN p_type = 'PROMO' THEN NULL ELSE CAST(p_size AS DOUBLE) END AS params_billion
        FROM part""",
    "memory": """
        SELECT model_id, model_name, gpu_memory_gb, params_billion, q.quantization, q.dtype,
               bytes_per_param,
               round_even(params_billion * 1e9 * bytes_per_param / 1073741824, 2) AS param_memory_gb,
               round_even(params_billion * 1e9 * bytes_per_param / 1073741824 * 1.2::DOUBLE, 2) AS total_memory_gb
        FROM sizes CROSS JOIN (
            SELECT quantization, dtype, CASE dtype WHEN 'float16' THEN 2.0::DOUBLE WHEN 'int8' THEN 1.0::DOUBLE
                   WHEN 'int4' THEN 0.5::DOUBLE ELSE 2.0::DOUBLE END AS bytes_per_param FROM quantizations) q""",
    "responses": f"""
        SELECT u.conv_id || '-' || u.turn AS pair_id, u.conv_id, u.turn,
               {NAMES}[u.conv_id % 6 + 1] AS model_name,
               {QUANTS}[(u.conv_id // 6 + u.turn // 2) % 3 + 1] AS quantization,
               u.text AS prompt, a.text AS text
        FROM conversations u JOIN conversations a
          ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'""",
    "keywords": r"""
        SELECT DISTINCT text AS prompt, list_slice(w, greatest(len(w) - 3, 1), len(w)) AS keywords
        FROM (SELECT text, string_split_regex(lower(trim(text)), '\s+') AS w
              FROM conversations WHERE role = 'user')""",
    "graded": """
        SELECT pair_id, model_name, quantization, bool_or(contains(lower(text), kw)) AS is_correct
        FROM (SELECT r.*, unnest(k.keywords) AS kw FROM responses r JOIN keywords k ON r.prompt = k.prompt)
        GROUP BY ALL""",
    "accuracy": """
        SELECT model_name, quantization, round_even(avg(CAST(is_correct AS DOUBLE)), 4) AS task_accuracy,
               count(*) FILTER (is_correct) AS num_correct, count(*) AS num_samples
        FROM graded GROUP BY ALL""",
    "quality": f"""
        SELECT {NAMES}[CAST(substr(source, 4) AS INTEGER) % 6 + 1] AS model_name,
               round(avg(quality), 6) AS quality_score
        FROM documents JOIN labels USING (doc_id) GROUP BY 1""",
    "configs": """
        SELECT g.model_name || '/' || workload || '/' || lpad(CAST(batch_size AS VARCHAR), 3, '0') AS config_id,
               g.model_name, workload, batch_size, deployment_type,
               round(latency_ms, 6) AS latency_ms, round(p95, 6) AS p95_latency_ms,
               round((input_tokens / 1e6 * coalesce(price_in, 0) + output_tokens / 1e6 * coalesce(price_out, 0)
                      + dur / 3600 * coalesce(cost_per_hour, 0)) / (input_tokens + output_tokens) * 1e6, 6)
                 AS cost_per_1m_tok,
               round(output_tokens / nullif(dur, 0), 6) AS throughput, quality_score
        FROM (SELECT model_name, workload, batch_size, round(sum(latency_ms), 9) / count(latency_ms) AS latency_ms,
                     quantile_cont(latency_ms, 0.95) AS p95, sum(latency_ms) / 1000 AS dur,
                     sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens
              FROM requests GROUP BY ALL) g
        JOIN models m ON g.model_name = m.model_name
        LEFT JOIN quality q ON g.model_name = q.model_name""",
}
_NEEDS = {
    "monthly": ["cost_models"], "memory": ["sizes", "quantizations"],
    "graded": ["responses", "keywords"], "accuracy": ["graded"],
    "configs": ["requests", "models", "quality"],
}


def with_tables(names: str, body: str) -> str:
    """``body`` preceded by the named tables (space separated) and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({_CTES[n]})" for n in order) + "\n" + body.strip()
