import random

import pytest
from pyspark.sql import functions as F

from gaugework.operators import filters
from gaugework.operators.select import (
    best_row, constraint_funnel, deployment_strategy, select_configs, weighted_score)

CONFIG = ("config_id string, model_name string, deployment_type string, p95_latency_ms double, "
          "cost_per_1m_tok double, throughput double, quality_score double")
REQ = ("req_id int, workload_type string, max_latency_p95_ms double, monthly_budget_usd double, "
       "monthly_tokens_millions double, min_quality_score double, prefer_self_hosted boolean")
KINDS = ["real_time_chat", "interactive_app", "batch_processing", "high_throughput", "other"]


def choose(configs, req, with_quality=True):
    """Restates the rules row by row: (config_id or None, counts, first failed limit)."""
    _, kind, latency, budget, tokens, quality, own = req
    fast = [c for c in configs if c[3] <= latency]
    good = [c for c in fast if not with_quality or c[6] >= quality]
    paid = [c for c in good if c[4] * tokens <= budget]
    counts = (len(fast), len(good), len(paid))
    if not paid:
        return None, counts, counts.index(0)
    left = [c for c in paid if c[2] == "self_hosted"] if own else paid
    left = left or paid
    top_l, top_c = max(c[3] for c in left), max(c[4] * tokens for c in left)
    key = {
        "real_time_chat": lambda c: c[3],
        "interactive_app": lambda c: c[3] / top_l * 0.6 + c[4] * tokens / top_c * 0.4,
        "high_throughput": lambda c: -c[5],
    }.get(kind, lambda c: c[4] * tokens)
    return min(left, key=lambda c: (key(c), c[0]))[0], counts, None


def tables(seed):
    rng = random.Random(seed)
    configs = [(f"c{i:03d}", f"m{i % 4}", rng.choice(["api", "self_hosted"]), float(rng.randint(5, 60)) * 10,
                float(rng.randint(1, 20)) / 4, float(rng.randint(1, 9)) * 10, rng.randint(75, 95) / 100)
               for i in range(60)]
    reqs = [(i, KINDS[i % 5], float(rng.randint(0, 60)) * 10, float(rng.randint(0, 300)),
             float(rng.randint(1, 100)), rng.randint(80, 97) / 100, rng.random() < 0.5) for i in range(80)]
    return configs, reqs


@pytest.mark.parametrize("chunk_rows", [1000, 7])
@pytest.mark.parametrize("with_quality", [True, False])
def test_equal_to_rules(spark, chunk_rows, with_quality):
    configs, reqs = tables(5)
    cdf = spark.createDataFrame(configs, CONFIG)
    if not with_quality:
        cdf = cdf.drop("quality_score")
    rdf = spark.createDataFrame(reqs, REQ)
    got = {r["req_id"]: r for r in select_configs(cdf, rdf, chunk_rows).collect()}
    funnel = {r["req_id"]: r for r in constraint_funnel(cdf, rdf, chunk_rows).collect()}
    reasons = ["No configs meet latency SLA", "No configs meet quality threshold", "No configs meet budget constraint"]
    assert len(got) == len(reqs)
    for req in reqs:
        best, counts, failed = choose(configs, req, with_quality)
        row = got[req[0]]
        assert row["config_id"] == best
        assert (row["n_latency"], row["n_quality"], row["n_budget"]) == counts
        assert (funnel[req[0]]["n_latency"], funnel[req[0]]["n_quality"], funnel[req[0]]["n_budget"]) == counts
        assert row["meets_requirements"] == (best is not None)
        if best is None:
            assert row["model_name"] == "No match" and row["batch_size"] == 0
            assert row["reasoning"] == [reasons[failed], "Consider relaxing constraints"]


def test_repeated_and_missing_requirements(spark):
    configs, reqs = tables(6)
    rows = [reqs[3], reqs[3], (500, "other", None, 1e9, 1.0, 0.0, False), (501, None, 1e9, 1e9, 1.0, 0.0, None)]
    answers = [sorted(map(str, select_configs(spark.createDataFrame(configs, CONFIG), spark.createDataFrame(rows, REQ),
                                              chunk_rows).collect())) for chunk_rows in (1000, 7)]
    assert answers[0] == answers[1] and len(answers[0]) == 4


def test_many_pairs(spark):
    rng = random.Random(8)
    configs = [(f"c{i:05d}", "m", rng.choice(["api", "self_hosted"]), rng.random() * 600, rng.random() * 5,
                rng.random() * 90, 0.7 + rng.random() * 0.3) for i in range(3000)]
    reqs = [(i, KINDS[i % 5], rng.random() * 600, rng.random() * 300, rng.random() * 100, 0.75 + rng.random() * 0.2,
             rng.random() < 0.5) for i in range(100)]
    got = {r["req_id"]: r for r in select_configs(
        spark.createDataFrame(configs, CONFIG), spark.createDataFrame(reqs, REQ)).collect()}
    for req in reqs:
        best, counts, _ = choose(configs, req)
        assert got[req[0]]["config_id"] == best
        assert tuple(got[req[0]][c] for c in ("n_latency", "n_quality", "n_budget")) == counts


def test_reasoning_and_defaults(spark):
    cdf = spark.createDataFrame([("c", "m", "self_hosted", 100.0, 2.0, 5.0, 0.9)], CONFIG)
    rdf = spark.createDataFrame([(1, "interactive_app", 500.0, 10000.0, 100.0, 0.85, True)], REQ)
    row = select_configs(cdf, rdf).first()
    assert (row["quantization"], row["batch_size"], row["infrastructure"]) == ("fp16", 8, "g5.xlarge")
    assert row["estimated_cost_monthly"] == 200.0
    assert row["reasoning"] == [
        "Filtered to p95 latency ≤ 500.0ms (1/1 configs)", "Filtered to quality ≥ 85% (1 configs)",
        "Filtered to monthly cost ≤ $10,000 (1 configs)", "Preferring self-hosted deployments",
        "Balancing latency (60%) and cost (40%)"]


def test_no_configs_at_all(spark):
    cdf = spark.createDataFrame([], CONFIG)
    rdf = spark.createDataFrame([(1, "other", 500.0, 10.0, 1.0, 0.8, False)], REQ)
    assert select_configs(cdf, rdf).first()["reasoning"][0] == "No configs meet latency SLA"


def test_prefer_self_hosted(spark):
    rows = [(1, "api", True), (1, "self_hosted", True), (2, "api", True), (3, "api", False), (3, "self_hosted", False)]
    df = spark.createDataFrame(rows, "s int, deployment_type string, want boolean")
    got = sorted((r["s"], r["deployment_type"]) for r in filters.prefer_self_hosted(df, ["s"], "want").collect())
    assert got == [(1, "self_hosted"), (2, "api"), (3, "api"), (3, "self_hosted")]
    assert filters.prefer_self_hosted(df, ["s"]).filter("s = 3").count() == 1


def test_weighted_score_of_zeros(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 0.0)], "s int, p95_latency_ms double, monthly_cost double")
    assert [r["score"] for r in weighted_score(df, ["s"]).collect()] == [0.0, 0.0]


def test_limits_are_inclusive_but_chat_is_strict(spark):
    df = spark.createDataFrame([(1, "m", 8, 200.0), (2, "n", 4, 199.0)],
                               "request_id int, model_name string, batch_size int, latency_ms double")
    assert filters.within_latency(df, 200.0, "latency_ms").count() == 2
    assert filters.realtime_pick(df).first()["advice"] == "Use n with batch_size=4"
    assert filters.realtime_pick(df, 100.0).first()["advice"] == "No models meet <100ms latency requirement"


def test_names(spark):
    known = spark.createDataFrame([("fp16", 2.0)], "quantization string, bytes double")
    df = spark.createDataFrame([(1, "FP16"), (2, "int3")], "id int, quantization string")
    assert [r["id"] for r in filters.unknown_names(df, "quantization", known, "quantization").collect()] == [2]
    loose = {r["id"]: r["bytes"] for r in filters.resolve_names(
        df, "quantization", known, "quantization", strict=False).collect()}
    assert loose == {1: 2.0, 2: None}
    with pytest.raises(Exception, match="int3"):
        filters.resolve_names(df, "quantization", known, "quantization").collect()


def test_question_prompts(spark):
    df = spark.range(100).selectExpr("id", "id % 2 as m", "if(id % 3 = 0, 'why?', 'so.') as prompt")
    got = filters.question_prompts(df, ["m"], "id", 5)
    assert sorted(r["id"] for r in got.collect()) == [0, 3, 6, 9, 12, 15, 18, 21, 24, 27]
    assert filters.question_prompts(df, ["m"], "id").count() == 34


def test_nan_quality_does_not_pass(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 0.9), (3, None)], "id int, quality_score double")
    assert [r["id"] for r in filters.within_quality(df, 0.5).collect()] == [2]


def test_strategy_rules(spark):
    rows = [(1, "x", 500.0, 9000.0, 5.0, 0.8, False), (2, "x", 100.0, 9000.0, 50.0, 0.8, False),
            (3, "x", 500.0, 100.0, 50.0, 0.8, False), (4, "x", 500.0, 9000.0, 50.0, 0.8, False)]
    got = [r["strategy"] for r in deployment_strategy(spark.createDataFrame(rows, REQ)).orderBy("req_id").collect()]
    assert got == ["api", "small_model_gpu", "llama-2-7b int8", "llama-2-13b or mistral-7b"]


def test_best_row_per_group(spark):
    df = spark.range(30).withColumn("g", F.col("id") % 3).withColumn("v", F.col("id") % 5)
    assert {(r["g"], r["id"]) for r in best_row(df, "v", "id", keys=["g"]).collect()} == {(0, 0), (1, 10), (2, 5)}
