"""Queries over filters, joins, selection and frontiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.operators import cost, filters, quality, select
from gaugework.operators.skyline import pareto_anti_frontier, pareto_frontier
from gaugework.plans.ctes import with_tables
from gaugework.plans.projections import configs, r
from gaugework.plans.registry import ORACLE_SQL, query
from gaugework.plans.summaries import _PRICED, _priced_requests
from gaugework.session import materialise
from gaugework.sources import catalog, tables

# ---- filters ------------------------------------------------------------------


@query(with_tables("configs", """
SELECT config_id, p95_latency_ms, cost_per_1m_tok, quality_score FROM configs
WHERE p95_latency_ms <= 140 AND quality_score >= 0.85 AND cost_per_1m_tok * 100 <= 12"""))
def constraint_filters(spark, sf):
    fast = filters.within_latency(configs(spark, sf), 140.0)
    good = filters.within_quality(fast, 0.85)
    priced = cost.volume_cost(good, F.lit(100.0))
    return filters.within_budget(priced, 12.0).select(
        "config_id", "p95_latency_ms", "cost_per_1m_tok", "quality_score")


@query(with_tables("requests", """
SELECT request_id, latency_ms FROM requests WHERE latency_ms <= 20"""))
def latency_filter(spark, sf):
    return filters.within_latency(tables.requests(spark, sf), 20.0, "latency_ms").select(
        "request_id", "latency_ms")


@query(with_tables("requests models", _PRICED + """
, own AS (SELECT DISTINCT run_id, workload FROM priced
          WHERE deployment_type = 'self_hosted')
SELECT p.request_id, p.run_id, p.workload, p.model_name, p.deployment_type
FROM priced p LEFT JOIN own o ON p.run_id = o.run_id AND p.workload = o.workload
WHERE o.run_id IS NULL OR p.deployment_type = 'self_hosted'"""))
def prefer_self_hosted(spark, sf):
    return filters.prefer_self_hosted(_priced_requests(spark, sf), ["run_id", "workload"]).select(
        "request_id", "run_id", "workload", "model_name", "deployment_type")


@query(with_tables("requests", """
SELECT request_id, model_name, workload FROM requests
WHERE model_name IN ('phi-3-mini', 'llama-2-7b') AND workload IN ('click', 'purchase')"""))
def membership_filter(spark, sf):
    return filters.members(tables.requests(spark, sf), ["phi-3-mini", "llama-2-7b"], ["click", "purchase"]).select(
        "request_id", "model_name", "workload")


@query(with_tables("requests presets", """
SELECT request_id, model_name FROM requests
WHERE model_name IN (SELECT model_name FROM presets WHERE preset = 'cost_optimized')"""))
def preset_filter(spark, sf):
    return filters.in_preset(tables.requests(spark, sf), catalog.model_presets(spark), "cost_optimized").select(
        "request_id", "model_name")


@query(with_tables("requests", """
SELECT request_id, model_name, backend FROM requests WHERE contains(coalesce(backend, ''), 'api')"""))
def api_backend_filter(spark, sf):
    return filters.api_backends(tables.requests(spark, sf)).select("request_id", "model_name", "backend")


_CHAT = """
SELECT advice, latency_ms FROM (SELECT 1) LEFT JOIN (
  SELECT 'Use ' || model_name || ' with batch_size=' || batch_size AS advice, latency_ms FROM requests
  WHERE latency_ms < {limit} ORDER BY latency_ms, request_id LIMIT 1) ON true"""


@query(with_tables("requests", _CHAT.format(limit=200)))
def realtime_chat_pick(spark, sf):
    return filters.realtime_pick(tables.requests(spark, sf)).select("advice", "latency_ms")


@query(with_tables("requests", """
SELECT 'No models meet <-1ms latency requirement' AS advice, CAST(NULL AS DOUBLE) AS latency_ms
WHERE NOT EXISTS (SELECT 1 FROM requests WHERE latency_ms < -1)"""))
def realtime_chat_no_match(spark, sf):
    return filters.realtime_pick(tables.requests(spark, sf), -1.0).select("advice", "latency_ms")


@query(r"""
SELECT regexp_extract(url, '/([a-z][a-z])/', 1) AS lang, page_id, url FROM pages WHERE contains(url, '?')""")
def question_prompts(spark, sf):
    pages = tables.read(spark, sf, "pages").select(
        F.regexp_extract("url", "/([a-z][a-z])/", 1).alias("lang"), "page_id", "url")
    return filters.question_prompts(pages, ["lang"], "page_id", prompt="url")


@query(with_tables("sizes quantizations", """
SELECT model_id, quantization FROM sizes
WHERE lower(quantization) NOT IN (SELECT quantization FROM quantizations)"""))
def unknown_names(spark, sf):
    return filters.unknown_names(
        tables.model_sizes(spark, sf), "quantization", catalog.quantizations(spark), "quantization").select(
        "model_id", "quantization")


@query(with_tables("sizes quantizations", """
SELECT model_id, s.quantization, q.dtype, q.memory_reduction FROM sizes s
LEFT JOIN quantizations q ON lower(s.quantization) = q.quantization"""))
def resolved_names(spark, sf):
    return filters.resolve_names(
        tables.model_sizes(spark, sf), "quantization", catalog.quantizations(spark), "quantization",
        strict=False).select("model_id", "quantization", "dtype", "memory_reduction")


# ---- best rows ----------------------------------------------------------------

@query(with_tables("requests models", _PRICED + """
(SELECT 'fastest' AS finding, model_name, request_id, latency_ms, cost_per_1m_tok FROM priced
 ORDER BY latency_ms, request_id LIMIT 1)
UNION ALL (SELECT 'cheapest', model_name, request_id, latency_ms, cost_per_1m_tok FROM priced
 ORDER BY cost_per_1m_tok, request_id LIMIT 1)
UNION ALL (SELECT 'most_output', model_name, request_id, latency_ms, cost_per_1m_tok FROM priced
 ORDER BY output_tokens DESC, request_id LIMIT 1)"""))
def best_rows(spark, sf):
    rows = _priced_requests(spark, sf).select(
        "model_name", "request_id", "latency_ms", "cost_per_1m_tok", "output_tokens")
    return select.best_rows(rows, {
        "fastest": ("latency_ms", False), "cheapest": ("cost_per_1m_tok", False),
        "most_output": ("output_tokens", True)}, "request_id").drop("output_tokens")


@query(with_tables("requests", """
SELECT model_name, workload, request_id, latency_ms FROM requests
QUALIFY row_number() OVER (PARTITION BY model_name, workload ORDER BY latency_ms, request_id) = 1"""))
def best_row_per_group(spark, sf):
    rows = tables.requests(spark, sf).select("model_name", "workload", "request_id", "latency_ms")
    return select.best_row(rows, "latency_ms", "request_id", keys=["model_name", "workload"])


@query(with_tables("requests", """
SELECT model_name, round(avg(latency_ms), 6) AS mean_latency_ms FROM requests GROUP BY 1
ORDER BY avg(latency_ms), model_name LIMIT 1"""))
def fastest_model(spark, sf):
    return select.fastest_model(tables.requests(spark, sf)).select("model_name", r("mean_latency_ms"))


# ---- constrained selection ------------------------------------------------------

_SELECTION = """
, cross_all AS (
  SELECT r.*, c.*, c.cost_per_1m_tok * r.monthly_tokens_millions AS monthly,
         p95_latency_ms <= max_latency_p95_ms AS ok1,
         p95_latency_ms <= max_latency_p95_ms AND quality_score >= min_quality_score AS ok2,
         p95_latency_ms <= max_latency_p95_ms AND quality_score >= min_quality_score
           AND c.cost_per_1m_tok * r.monthly_tokens_millions <= monthly_budget_usd AS ok3
  FROM reqs r CROSS JOIN configs c),
funnel AS (
  SELECT req_id, any_value(workload_type) AS workload_type, count(*) AS n_configs,
         count(*) FILTER (ok1) AS n_latency, count(*) FILTER (ok2) AS n_quality, count(*) FILTER (ok3) AS n_budget,
         any_value(prefer_self_hosted) AND count(*) FILTER (ok3 AND deployment_type = 'self_hosted') > 0 AS own
  FROM cross_all GROUP BY req_id),
kept AS (
  SELECT x.*, f.own, max(p95_latency_ms) OVER w AS top_p95, max(monthly) OVER w AS top_cost
  FROM cross_all x JOIN funnel f USING (req_id)
  WHERE ok3 AND (NOT f.own OR deployment_type = 'self_hosted') WINDOW w AS (PARTITION BY req_id)),
scored AS (
  SELECT *, CASE workload_type WHEN 'real_time_chat' THEN p95_latency_ms
                 WHEN 'interactive_app' THEN
                   CASE WHEN top_p95 > 0 THEN p95_latency_ms / top_p95 ELSE 0 END * 0.6::DOUBLE
                   + CASE WHEN top_cost > 0 THEN monthly / top_cost ELSE 0 END * 0.4::DOUBLE
                 WHEN 'high_throughput' THEN -throughput ELSE monthly END AS objective FROM kept),
best AS (
  SELECT * FROM scored WHERE objective IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY req_id ORDER BY objective, config_id) = 1)
"""


def _recommendations(spark, sf):
    return select.select_configs(configs(spark, sf), tables.requirements(spark, sf))


@query(with_tables("reqs configs", _SELECTION + """
SELECT f.req_id, f.workload_type, f.n_latency, f.n_quality, f.n_budget, b.config_id,
       coalesce(b.model_name, 'No match') AS model_name,
       CASE WHEN b.req_id IS NULL THEN 'N/A' ELSE 'fp16' END AS quantization,
       coalesce(b.batch_size, 0) AS batch_size,
       CASE WHEN b.req_id IS NULL THEN 'N/A' ELSE 'g5.xlarge' END AS infrastructure,
       coalesce(round_even(b.monthly, 2), 0) AS estimated_cost_monthly,
       round(b.objective, 6) AS objective, b.req_id IS NOT NULL AS meets_requirements
FROM funnel f LEFT JOIN best b USING (req_id)"""))
def constrained_selection(spark, sf):
    return _recommendations(spark, sf).select(
        "req_id", "workload_type", "n_latency", "n_quality", "n_budget", "config_id", "model_name",
        "quantization", "batch_size", "infrastructure", "estimated_cost_monthly", r("objective"),
        "meets_requirements")


@query(with_tables("reqs configs", _SELECTION + """
SELECT f.req_id, CASE WHEN n_latency = 0 THEN '{latency}' WHEN n_quality = 0 THEN '{quality}' ELSE '{budget}' END AS reason,
       '{hint}' AS hint
FROM funnel f LEFT JOIN best b USING (req_id) WHERE b.req_id IS NULL""".format(**catalog.NO_MATCH)))
def no_match_reasons(spark, sf):
    return _recommendations(spark, sf).filter("NOT meets_requirements").select(
        "req_id", F.col("reasoning")[0].alias("reason"), F.col("reasoning")[1].alias("hint"))


@query(with_tables("reqs configs", _SELECTION + """
SELECT f.req_id, concat_ws(' | ',
  printf('""" + catalog.REASONS["latency"] + """', format('{:.1f}', r.max_latency_p95_ms), n_latency, n_configs),
  printf('""" + catalog.REASONS["quality"] + """', CAST(CAST(round(r.min_quality_score * 100) AS INTEGER) AS VARCHAR), n_quality),
  printf('""" + catalog.REASONS["budget"] + """', format('{:,}', CAST(round_even(r.monthly_budget_usd, 0) AS BIGINT)), n_budget),
  CASE WHEN f.own THEN '""" + catalog.REASONS["self_hosted"] + """' END,
  CASE r.workload_type """ + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in catalog.GOALS.items()) + f"""
    ELSE '{catalog.REASONS["default"]}' END) AS reasoning
FROM funnel f JOIN best b USING (req_id) JOIN reqs r USING (req_id)"""))
def reasoning_lists(spark, sf):
    return _recommendations(spark, sf).filter("meets_requirements").select(
        "req_id", F.array_join("reasoning", " | ").alias("reasoning"))


@query(with_tables("reqs configs", _SELECTION + """
SELECT req_id, n_configs, n_latency, n_quality, n_budget FROM funnel"""))
def constraint_funnel(spark, sf):
    return select.constraint_funnel(configs(spark, sf), tables.requirements(spark, sf)).select(
        "req_id", F.col("n_configs").cast("long").alias("n_configs"), "n_latency", "n_quality", "n_budget")


@query(with_tables("reqs", """
SELECT req_id, CASE WHEN monthly_tokens_millions < 10 THEN 'api'
  WHEN max_latency_p95_ms < 200 THEN 'small_model_gpu'
  WHEN monthly_budget_usd < 5000 THEN 'llama-2-7b int8' ELSE 'llama-2-13b or mistral-7b' END AS strategy FROM reqs"""))
def deployment_strategy(spark, sf):
    return select.deployment_strategy(tables.requirements(spark, sf)).select("req_id", "strategy")


# ---- frontiers ------------------------------------------------------------------

def _flag_sql(table: str, x: str, y: str) -> str:
    """Two minimised expressions: flagged unless some row is as good in both and better in one."""
    return f"""
, v AS (SELECT DISTINCT {x} AS x, {y} AS y FROM {table}),
low AS (SELECT x, min(y) AS y FROM v GROUP BY x),
front AS (SELECT x, y FROM (SELECT x, y, min(y) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b
                            FROM low) WHERE b IS NULL OR y < b)
"""


_GOOD = ", good AS (SELECT * FROM configs WHERE quality_score >= 0.85)"


def _flagged_configs(spark, sf):
    return pareto_frontier(materialise(configs(spark, sf), "configs"), ["p95_latency_ms", "cost_per_1m_tok"])


@query(with_tables("configs", _GOOD + _flag_sql("good", "p95_latency_ms", "cost_per_1m_tok") + """
SELECT config_id, p95_latency_ms, cost_per_1m_tok, f.x IS NOT NULL AS is_pareto_optimal
FROM good g LEFT JOIN front f ON g.p95_latency_ms = f.x AND g.cost_per_1m_tok = f.y"""))
def pareto_configs(spark, sf):
    return _flagged_configs(spark, sf).select(
        "config_id", "p95_latency_ms", "cost_per_1m_tok", "is_pareto_optimal")


@query(with_tables("configs", _GOOD + _flag_sql("good", "-p95_latency_ms", "-cost_per_1m_tok") + """
SELECT config_id, f.x IS NOT NULL AS is_anti_frontier
FROM good g LEFT JOIN front f ON -g.p95_latency_ms = f.x AND -g.cost_per_1m_tok = f.y"""))
def pareto_anti_configs(spark, sf):
    return pareto_anti_frontier(
        materialise(configs(spark, sf), "configs"), ["p95_latency_ms", "cost_per_1m_tok"],
        flag="is_anti_frontier").select("config_id", "is_anti_frontier")


@query("WITH one AS (SELECT 1)" + _flag_sql("lineitem", "l_extendedprice", "-l_quantity") + """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity FROM lineitem
JOIN front ON l_extendedprice = x AND -l_quantity = y""")
def pareto_lines(spark, sf):
    lines = tables.read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    return select.frontier_only(
        pareto_frontier(lines, ["l_extendedprice", "l_quantity"], [True, False])).drop("is_pareto_optimal")


@query("""
WITH p AS (SELECT l_partkey, round(avg(l_extendedprice), 8) AS price, round(avg(l_discount), 8) AS discount
           FROM lineitem GROUP BY 1)""" + _flag_sql("p", "price", "-discount") + """
SELECT l_partkey, price, discount FROM p JOIN front ON price = x AND -discount = y""")
def pareto_parts(spark, sf):
    parts = tables.read(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.round(F.avg("l_extendedprice"), 8).alias("price"), F.round(F.avg("l_discount"), 8).alias("discount"))
    return select.frontier_only(
        pareto_frontier(parts, ["price", "discount"], [True, False])).drop("is_pareto_optimal")


@query("""
WITH p AS (SELECT l_partkey, round(avg(l_extendedprice), 8) AS price, round(avg(l_quantity), 8) AS quantity
           FROM lineitem GROUP BY 1)""" + _flag_sql("p", "price", "-quantity") + """
SELECT l_partkey, price, quantity FROM p JOIN front ON price = x AND -quantity = y""")
def pareto_parts_by_buckets(spark, sf):
    """The plan for large tables: running minima over coarse and fine buckets."""
    parts = tables.read(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.round(F.avg("l_extendedprice"), 8).alias("price"), F.round(F.avg("l_quantity"), 8).alias("quantity"))
    return select.frontier_only(
        pareto_frontier(parts, ["price", "quantity"], [True, False], small_rows=0)).drop("is_pareto_optimal")


@query("""
WITH v AS (SELECT l_quantity AS q, l_discount AS d, l_tax AS t, min(l_extendedprice) AS p FROM lineitem GROUP BY ALL),
front AS (SELECT * FROM v a WHERE NOT EXISTS (
  SELECT 1 FROM v b WHERE b.p <= a.p AND b.q >= a.q AND b.d >= a.d AND b.t <= a.t
    AND (b.p < a.p OR b.q > a.q OR b.d > a.d OR b.t < a.t)))
SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_discount, l_tax FROM lineitem
JOIN front ON l_quantity = q AND l_discount = d AND l_tax = t AND l_extendedprice = p""")
def pareto_lines_four_objectives(spark, sf):
    lines = tables.read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    flagged = pareto_frontier(lines, ["l_extendedprice", "l_quantity", "l_discount", "l_tax"],
                              [True, False, False, True])
    return select.frontier_only(flagged).drop("is_pareto_optimal")


_THREE = """
WITH points AS (
  SELECT l_partkey AS config_id, CAST(l_partkey AS VARCHAR) AS model_name,
         round(avg(l_extendedprice), 8) AS latency_ms, round(1 - avg(l_discount), 8) AS cost_per_1m_tok,
         round(avg(l_quantity), 8) AS throughput FROM lineitem GROUP BY 1),
front3 AS (SELECT * FROM points a WHERE NOT EXISTS (
  SELECT 1 FROM points b WHERE b.latency_ms <= a.latency_ms AND b.cost_per_1m_tok <= a.cost_per_1m_tok
    AND b.throughput >= a.throughput AND (b.latency_ms < a.latency_ms OR b.cost_per_1m_tok < a.cost_per_1m_tok
    OR b.throughput > a.throughput)))
"""


def _three_way(spark, sf, **kwargs):
    """One point per part; price and quantity pull against each other, so the frontier is not tiny."""
    points = tables.read(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.round(F.avg("l_extendedprice"), 8).alias("latency_ms"),
        F.round(1 - F.avg("l_discount"), 8).alias("cost_per_1m_tok"),
        F.round(F.avg("l_quantity"), 8).alias("throughput"),
    ).select(F.col("l_partkey").alias("config_id"), F.col("l_partkey").cast("string").alias("model_name"),
             "latency_ms", "cost_per_1m_tok", "throughput")
    return pareto_frontier(
        materialise(points, "points"), ["latency_ms", "cost_per_1m_tok", "throughput"], [True, True, False],
        **kwargs)


@query(_THREE + "SELECT config_id, latency_ms, cost_per_1m_tok, throughput FROM front3")
def frontier_by_slabs(spark, sf):
    """The plan for large frontiers: slabs along each objective and the grid of occupied cells."""
    return select.frontier_only(_three_way(spark, sf, slab_rows=20)).select(
        "config_id", "latency_ms", "cost_per_1m_tok", "throughput")


@query(_THREE + """
SELECT model_name, 'unknown' AS quantization, 1 AS batch_size, latency_ms, cost_per_1m_tok, throughput,
       0.0::DOUBLE AS quality_score, config_id IN (SELECT config_id FROM front3) AS is_pareto_optimal FROM points""")
def frontier_export(spark, sf):
    return select.frontier_export(_three_way(spark, sf))


@query(_THREE + """
SELECT config_id, row_number() OVER (ORDER BY latency_ms, config_id) - 1 AS latency_rank,
       row_number() OVER (ORDER BY cost_per_1m_tok, config_id) - 1 AS cost_rank,
       row_number() OVER (ORDER BY throughput DESC, config_id) - 1 AS throughput_rank FROM front3""")
def positional_ranks(spark, sf):
    return select.positional_ranks(select.frontier_only(_three_way(spark, sf))).select(
        "config_id", "latency_rank", "cost_rank", "throughput_rank")


@query(_THREE + """
, ranks AS (SELECT config_id, (row_number() OVER (ORDER BY latency_ms, config_id)
       + row_number() OVER (ORDER BY cost_per_1m_tok, config_id)
       + row_number() OVER (ORDER BY throughput DESC, config_id)) AS s FROM front3)
(SELECT 'cost' AS priority, config_id FROM front3 ORDER BY cost_per_1m_tok, config_id LIMIT 1)
UNION ALL (SELECT 'latency', config_id FROM front3 ORDER BY latency_ms, config_id LIMIT 1)
UNION ALL (SELECT 'throughput', config_id FROM front3 ORDER BY throughput DESC, config_id LIMIT 1)
UNION ALL (SELECT 'balanced', config_id FROM ranks ORDER BY s, config_id LIMIT 1)""")
def priority_picks(spark, sf):
    flagged = materialise(_three_way(spark, sf), "flagged")
    out = None
    for priority in ("cost", "latency", "throughput", "balanced"):
        pick = select.recommend_by_priority(flagged, priority).select(
            F.lit(priority).alias("priority"), "config_id")
        out = pick if out is None else out.unionByName(pick)
    return out


@query(with_tables("configs", _GOOD + _flag_sql("good", "p95_latency_ms", "cost_per_1m_tok") + """
SELECT config_id, cost_per_1m_tok, p95_latency_ms FROM good JOIN front
ON p95_latency_ms = x AND cost_per_1m_tok = y ORDER BY cost_per_1m_tok, config_id"""))
def frontier_line(spark, sf):
    return select.frontier_line(_flagged_configs(spark, sf))


@query(with_tables("configs", _GOOD + _flag_sql("good", "p95_latency_ms", "cost_per_1m_tok") + """
SELECT config_id FROM good WHERE NOT EXISTS (SELECT 1 FROM front
  WHERE p95_latency_ms = x AND cost_per_1m_tok = y)"""))
def dominated_configs(spark, sf):
    return select.dominated_only(_flagged_configs(spark, sf)).select("config_id")


# ---- quality --------------------------------------------------------------------

@query(with_tables("accuracy", "SELECT * FROM accuracy"))
def task_accuracy(spark, sf):
    return quality.task_accuracy(tables.responses(spark, sf), tables.prompt_keywords(spark, sf))


@query(with_tables("graded", "SELECT pair_id, is_correct FROM graded"))
def graded_responses(spark, sf):
    return quality.graded(tables.responses(spark, sf), tables.prompt_keywords(spark, sf)).select(
        "pair_id", "is_correct")


def _text_pairs(spark, sf):
    answers = tables.responses(spark, sf)
    return answers.drop("prompt"), answers.select("pair_id", F.col("prompt").alias("reference"))


_LCS = r"""
, tok AS (SELECT *, len(g) AS n, len(r) AS m FROM (
    SELECT pair_id, model_name, quantization, regexp_extract_all(lower(text), '[a-z0-9]+') AS g,
           regexp_extract_all(lower(prompt), '[a-z0-9]+') AS r FROM responses)),
steps(pair_id, i, j, v) AS (
  SELECT pair_id, 0, unnest(range(0, m + 1)), 0 FROM tok
  UNION ALL
  SELECT pair_id, i + 1, j, max(t) OVER (PARTITION BY pair_id ORDER BY j)
  FROM (SELECT s.pair_id, s.i, s.j, CASE WHEN s.j > 0 AND tok.g[s.i + 1] = tok.r[s.j]
               THEN lag(s.v) OVER (PARTITION BY s.pair_id ORDER BY s.j) + 1 ELSE s.v END AS t
        FROM steps s JOIN tok ON s.pair_id = tok.pair_id WHERE s.i < tok.n)),
scored AS (
  SELECT model_name, quantization, l / nullif(n, 0) AS p, l / nullif(m, 0) AS r
  FROM tok JOIN (SELECT pair_id, max(v) AS l FROM steps GROUP BY 1) USING (pair_id))
SELECT model_name, quantization, round_even(avg(coalesce(2 * p * r / nullif(p + r, 0), 0)), 4) AS rouge_l_score,
       count(*) AS num_samples FROM scored GROUP BY ALL
"""


@query(with_tables("responses", _LCS).replace("WITH", "WITH RECURSIVE", 1))
def rouge_l(spark, sf):
    generated, references = _text_pairs(spark, sf)
    return quality.rouge_l(generated, references)


# the name under which the form without stems was known before it became the only one
query(ORACLE_SQL["rouge_l"], "rouge_l_unstemmed")(rouge_l)


@query(with_tables("requests", """
, o AS (SELECT model_name, user_id || '/' || run_id || '/' || batch_size AS prompt, workload AS output
        FROM requests),
p AS (SELECT model_name, prompt, count(DISTINCT output) = 1 AS alike FROM o GROUP BY ALL HAVING count(*) >= 2)
SELECT model_name, round_even(avg(CAST(alike AS DOUBLE)), 4) AS consistency_score,
       count(*) FILTER (alike) AS num_consistent, count(*) AS num_samples FROM p GROUP BY 1"""))
def consistency(spark, sf):
    return quality.consistency(tables.requests(spark, sf).select(
        "model_name", F.concat_ws("/", "user_id", "run_id", "batch_size").alias("prompt"),
        F.col("workload").alias("text")))


@query(r"""
WITH o AS (SELECT lang, split_part(text, '.', 1) AS prompt, trim(text, chr(32)) AS output FROM documents),
p AS (SELECT lang, prompt, count(DISTINCT output) = 1 AS alike FROM o GROUP BY ALL HAVING count(*) >= 2)
SELECT lang, round_even(avg(CAST(alike AS DOUBLE)), 4) AS consistency_score,
       count(*) FILTER (alike) AS num_consistent, count(*) AS num_samples FROM p GROUP BY 1""")
def text_consistency(spark, sf):
    outputs = tables.read(spark, sf, "documents").select(
        "lang", F.split_part("text", F.lit("."), F.lit(1)).alias("prompt"), "text")
    return quality.consistency(outputs, ["lang"])


# ---- scalar functions -------------------------------------------------------------

@query("""
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, upper(event_type) AS kind,
       greatest(value - 50, 0) AS over_50, contains(event_type, 'u') AS has_u,
       regexp_replace(event_type, 'e+$', '') AS stripped, format('{:08d}', event_id) AS label,
       strftime(ts, '%H:%M:%S') AS clock
FROM events""")
def scalar_functions(spark, sf):
    return tables.read(spark, sf, "events").select(
        "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.upper("event_type").alias("kind"),
        F.greatest(F.col("value") - 50, F.lit(0.0)).alias("over_50"),
        F.contains("event_type", F.lit("u")).alias("has_u"),
        F.regexp_replace("event_type", "e+$", "").alias("stripped"),
        F.format_string("%08d", "event_id").alias("label"),
        F.date_format("ts", "HH:mm:ss").alias("clock"))
