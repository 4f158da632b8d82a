"""Known values of the projections, prices, sizes and experiments."""

import pytest
from pyspark.sql import functions as F

from gaugework.functions.scalars import array_mean, half_even, parameters_billion, with_defaults
from gaugework.operators import aggregates, cost, derive, experiments, quality, sizing
from gaugework.sources import catalog


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_latency_projection(spark):
    df = spark.sql("select 0.05D ttft_s, array(0.01D, 0.03D) itl_s, 0.5D e2e_s, cast(null as double) queue_s "
                   "union all select 0.1D, array(), 0.2D, 0.004D")
    rows = derive.latency_projection(df).orderBy("ttft_s").collect()
    assert rows[0]["ttft_ms"] == 50.0 and rows[0]["mean_itl_ms"] == pytest.approx(20.0)
    assert rows[0]["queue_time_ms"] == 0.0 and rows[1]["mean_itl_ms"] == 0.0 and rows[1]["queue_time_ms"] == 4.0


def test_throughput_and_resources(spark):
    row = one(derive.throughput_projection(spark.sql(
        "select 1000L total_tokens, 10L total_requests, 10.0D duration_seconds")))
    assert (row["tokens_per_second"], row["requests_per_second"], row["tokens_per_request"]) == (100.0, 1.0, 100.0)
    row = one(derive.throughput_projection(spark.sql(
        "select 1000L total_tokens, 0L total_requests, 0.0D duration_seconds")))
    assert (row["tokens_per_second"], row["tokens_per_request"]) == (0.0, 0.0)
    row = one(derive.resource_projection(spark.sql(
        "select 12000D gpu_memory_used_mb, 24000D gpu_memory_total_mb, 8D ram_used_gb, 16D ram_total_gb, "
        "timestamp'2024-01-02 03:04:05.678' ts")))
    assert (row["gpu_memory_percent"], row["ram_percent"]) == (50.0, 50.0)
    assert row["timestamp"] == "2024-01-02T03:04:05.678000"


def test_cost(spark):
    base = "select 1000000L input_tokens, 500000L output_tokens, 3600.0D duration_seconds, 1.0D cost_per_hour, " \
           "0.5D cost_per_1m_tokens_input, 1.5D cost_per_1m_tokens_output"
    row = one(cost.cost_projection(spark.sql(base)))
    assert (row["api_cost_usd"], row["infrastructure_cost_usd"], row["total_cost_usd"]) == (1.25, 1.0, 2.25)
    row = one(cost.cost_projection(spark.sql(
        "select 500000L input_tokens, 500000L output_tokens, 3600.0D duration_seconds, 1.0D cost_per_hour, "
        "cast(null as double) cost_per_1m_tokens_input, cast(null as double) cost_per_1m_tokens_output")))
    assert row["cost_per_1m_tok"] == 1.0
    row = one(cost.cost_projection(spark.sql(base).withColumns(
        {"input_tokens": F.lit(0), "output_tokens": F.lit(0)})))
    assert row["cost_per_1m_tok"] == 0.0


def test_monthly_cost_and_savings(spark):
    schema = ("cost_model_id int, model_name string, gpu_hourly_rate double, gpu_utilization double, "
              "cost_per_1m_input_tokens double, cost_per_1m_output_tokens double, engineering_monthly double, "
              "power_monthly double, input_millions double, output_millions double")
    models = spark.createDataFrame([
        (1, "api", 0.0, 1.0, 0.5, 1.5, 0.0, 0.0, 600.0, 400.0), (2, "own", 1.006, 0.5, 0.0, 0.0, 100.0, 10.0, 600.0, 400.0),
        (3, "free", 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 600.0, 400.0)], schema)
    costs = cost.monthly_cost(models)
    totals = {r["cost_model_id"]: r["total_monthly_cost"] for r in costs.collect()}
    assert totals == {1: 900.0, 2: pytest.approx(477.19), 3: 0.0}
    pairs = spark.createDataFrame([(1, 2), (3, 1)], "baseline_id int, optimized_id int")
    got = {r["baseline_id"]: r for r in cost.tco_savings(costs, pairs).collect()}
    assert got[1]["monthly_savings"] == pytest.approx(422.81) and got[1]["savings_pct"] == 47.0
    assert got[1]["annual_savings"] == pytest.approx(5073.72)
    assert got[1]["baseline_breakdown"]["api_cost"] == 900.0
    assert got[3]["savings_pct"] == 0.0


def test_savings_of_repeated_ids(spark, tmp_path):
    """An id with several cost models: each of them against each of the next id, once, as in the SQL."""
    from gaugework.plans.all import ORACLE_SQL, QUERIES
    from tests.agreement import compare, connect

    rows = [(0, "a", 2, 4703.96), (1, "b", 8, 1264.03), (1, "b", 8, 1264.03), (1, "c", 9, 264.03), (2, "d", 17, 6633.93),
            (2, "d", 17, 6633.93), (3, "e", 10, 1773.36)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").toPandas().to_parquet(
        str(tmp_path / "supplier.parquet"))
    found, problems = compare(spark, connect(str(tmp_path)), QUERIES["tco_savings"], ORACLE_SQL["tco_savings"], str(tmp_path))
    assert found == 3 + 3 * 2 + 2 and not problems


def test_rounding_keeps_the_sign(spark):
    values = [-0.047, 0.047, -0.05, 0.0, -0.0, -12.25, 12.25, -3.07]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i")
    assert [repr(r["x"]) for r in df.select(half_even("v", 1).alias("x")).collect()] == [
        "-0.0", "0.0", "-0.0", "0.0", "-0.0", "-12.2", "12.2", "-3.1"]


def test_frontier_savings_break_even_scenarios(spark):
    pairs = spark.createDataFrame([(2.0, 0.5), (0.0, 1.0)], "baseline_cost_per_1m_tok double, optimized_cost_per_1m_tok double")
    rows = cost.frontier_savings(pairs).orderBy("optimized_cost_per_1m_tok").collect()
    assert (rows[0]["savings_monthly_usd"], rows[0]["savings_pct"]) == (150.0, 75.0)
    assert rows[1]["savings_pct"] == 0.0 and rows[1]["payback_period_months"] == 0
    be = cost.break_even(spark.sql("select 730D fixed, 1.0D price union all select 730D, 0.0D"), "fixed", "price")
    assert [r["break_even_millions"] for r in be.orderBy("price").collect()] == [None, 730.0]
    rates = {r["scenario"]: r["scenario_rate"] for r in cost.cost_scenarios(
        spark.sql("select 10.0D gpu_hourly_rate")).collect()}
    assert rates == {"on_demand": 10.0, "spot": pytest.approx(3.0), "reserved": 6.0}


def test_memory(spark):
    models = spark.createDataFrame(
        [("a", "7B"), ("b", "3.8B"), ("c", "~175B (estimated)"), ("d", "Undisclosed")],
        "model_name string, parameters string")
    est = sizing.memory_vs_fp16(sizing.memory_estimate(sizing.at_each_quantization(models)))
    got = {(r["model_name"], r["quantization"]): r for r in est.collect()}
    assert got["a", "fp16"]["total_memory_gb"] == 15.65
    assert got["a", "int4"]["total_memory_gb"] < got["a", "int8"]["total_memory_gb"] < 15.65
    assert got["a", "int8"]["pct_of_fp16"] == pytest.approx(50.0, abs=0.1)
    assert got["b", "fp16"]["params_billion"] == 3.8
    assert got["c", "fp16"]["total_memory_gb"] is None and got["d", "int8"]["pct_of_fp16"] is None
    odd = sizing.memory_estimate(spark.sql("select '7B' parameters, 'int2' dtype"))
    assert one(odd)["bytes_per_param"] == 2.0


def test_kv_cache_and_tiers(spark):
    df = spark.sql("select 24D gpu_memory_gb, 14D model_memory_gb union all select 24D, 40D")
    got = {(r["model_memory_gb"], r["cache"]): r for r in sizing.kv_cache_estimate(df).collect()}
    assert got[14.0, "default"]["kv_cache_gb"] == 7.6 and got[14.0, "default"]["reserved_gb"] == 21.6
    assert got[40.0, "optimized"]["kv_cache_gb"] == 0.0
    tiers = sizing.load_tier(spark.sql("select explode(array(0D, 9.9D, 10D, 50D)) requests_per_second"))
    assert [r["tier"] for r in tiers.orderBy("requests_per_second").collect()] == ["light", "light", "medium", "heavy"]


def test_scalars(spark):
    row = spark.sql("select 0.125D a, 0.135D b, array() e, '13B' p").select(
        half_even("a", 2).alias("a"), array_mean(F.col("e").cast("array<double>")).alias("e"),
        parameters_billion("p").alias("p")).first()
    assert (row["a"], row["e"], row["p"]) == (0.12, 0.0, 13.0)
    kept = with_defaults(spark.sql("select cast(null as double) as q"), {"q": 0.9, "t": 50.0}).first()
    assert kept["q"] is None and kept["t"] == 50.0


def test_batches(spark):
    df = spark.range(10).selectExpr(
        "id as request_id", "4 as batch_size", "cast(10 + id as double) as latency_ms", "5L as output_tokens",
        "timestamp_seconds(id) as ts")
    for parts in (1, 5):
        batched = experiments.assign_batches(df.repartition(parts), ["batch_size"])
        timed = experiments.amortised_latency(batched, ["batch_size"]).orderBy("request_id").collect()
        assert [r["batch_no"] for r in timed] == [0] * 4 + [1] * 4 + [2] * 2
        assert timed[0]["amortised_ms"] == 13 / 4 and timed[9]["amortised_ms"] == 19 / 2
        row = one(experiments.batch_experiment(batched, sla_target_ms=5.0))
        assert row["throughput_tokens_per_sec"] == pytest.approx(50 / 9.019) and row["meets_sla"] is False


def test_batch_rows_equal_amortised_requests(spark):
    """Also by a column that varies within a batch, and where a batch's requests have no latency."""
    df = spark.range(200).selectExpr(
        "id as request_id", "id % 3 as run", "if(id % 2 = 0, 4, 8) as batch_size", "id % 5 as q",
        "if(id between 40 and 90, null, cast(id * 7 % 31 as double)) as latency_ms", "id as output_tokens", "timestamp_seconds(id) as ts")
    batched = experiments.assign_batches(df, ["run", "batch_size"])
    timed = experiments.amortised_latency(batched, ["run", "batch_size"])
    for keys in (["batch_size"], ["q"], ["run", "q"]):
        rows = experiments.batch_rows(batched, ["run", "batch_size"], keys)
        got = rows.groupBy(*keys).agg(F.sum("n"), F.sum(F.col("n") * F.col("amortised_ms")), F.sum("output_tokens")).collect()
        want = timed.groupBy(*keys).agg(F.count(F.lit(1)), F.sum("amortised_ms"), F.sum("output_tokens")).collect()
        assert len(got) == len(want)
        for g, w in zip(sorted(map(tuple, got)), sorted(map(tuple, want))):
            assert g == pytest.approx(w)


def test_optimal_batch(spark):
    schema = "batch_size int, throughput_tokens_per_sec double, meets_sla boolean"
    df = spark.createDataFrame([(4, 500.0, True), (16, 1200.0, True), (32, 9000.0, False)], schema)
    assert experiments.optimal_batch(df).first()["batch_size"] == 16
    assert experiments.optimal_batch(df.filter("NOT meets_sla")).count() == 0
    assert experiments.optimal_batch(spark.createDataFrame([], schema)).count() == 0


def test_quantization_floor_and_records(spark):
    rows = [("m", "fp16", 0.0, 7), ("m", "int8", 500.0, 10), ("n", "int8", 250.0, 10)]
    df = spark.createDataFrame(rows, "model_name string, quantization string, latency_ms double, output_tokens long")
    perf = experiments.quantization_performance(df)
    got = {(r["model_name"], r["quantization"]): r["throughput_tok_s"] for r in perf.collect()}
    assert got == {("m", "fp16"): 7000.0, ("m", "int8"): 20.0, ("n", "int8"): 40.0}
    acc = spark.createDataFrame([("m", "fp16", 0.9), ("m", "int8", 0.88), ("n", "int8", 0.5)],
                                "model_name string, quantization string, task_accuracy double")
    models = spark.createDataFrame([("m", "7B"), ("n", "Undisclosed")], "model_name string, parameters string")
    log = spark.sql("""SELECT 'm' AS model_name, 'int8' AS quantization, run_id, timestamp(t) AS ts FROM VALUES
                    ('r1', '2024-01-01 00:00:00'), ('r2', '2024-01-02 03:04:05') AS v(run_id, t)""")
    runs = experiments.experiment_runs(log)
    rec = {(r["model_name"], r["quantization"]): r for r in experiments.experiment_records(
        perf, acc, models, catalog.quantizations(spark), runs).collect()}
    assert (rec["m", "int8"]["run_id"], rec["m", "int8"]["timestamp"]) == ("r2", "2024-01-02T03:04:05.000000")
    assert rec["m", "fp16"]["run_id"] is None
    assert rec["m", "int8"]["accuracy_delta"] == pytest.approx(-0.02)
    assert rec["m", "fp16"]["accuracy_delta"] is None and rec["n", "int8"]["accuracy_delta"] is None
    assert rec["m", "fp16"]["est_memory_gb"] == 15.65 and rec["n", "int8"]["est_memory_gb"] is None


def test_degradation(spark):
    schema = "model_name string, quantization string, task_accuracy double, rouge_l_score double"
    df = spark.createDataFrame([("m", "fp16", 0.90, 0.70), ("m", "int8", 0.88, 0.68), ("m", "int4", None, 0.6)], schema)
    got = {r["quantization"]: r for r in derive.quality_degradation(quality.against_baseline(df)).collect()}
    assert got["int8"]["accuracy_delta"] == pytest.approx(-0.02)
    assert got["int8"]["rouge_delta"] == pytest.approx(-0.02)
    assert got["int8"]["quality_degradation_pct"] == 2.0
    assert got["int4"]["accuracy_delta"] == pytest.approx(-0.9)
    assert got["fp16"]["quality_degradation_pct"] is None


def test_average_resources_first_totals(spark):
    df = spark.sql("""select * from values
        (1, 'r', 10D, 100D, 50D, 20D, 4D, 8D, timestamp'2024-01-01 00:00:05'),
        (2, 'r', 30D, 200D, 70D, 40D, 6D, 9D, timestamp'2024-01-01 00:00:01')
        as t(sample_id, run_id, gpu_memory_used_mb, gpu_memory_total_mb, gpu_utilization_percent, cpu_percent,
             ram_used_gb, ram_total_gb, ts)""")
    row = one(aggregates.average_resources(df, ["run_id"]))
    assert (row["gpu_memory_used_mb"], row["gpu_memory_total_mb"], row["ram_total_gb"]) == (20.0, 200.0, 9.0)


def test_coverage_gaps(spark):
    models = spark.createDataFrame([("m",), ("n",)], "model_name string")
    done = spark.createDataFrame([("m", "qa", 1), ("m", "qa", 4), ("n", "qa", 1)],
                                 "model_name string, workload string, batch_size int")
    gaps = experiments.coverage_gaps(done, models, ["qa"], [1, 4]).collect()
    assert [tuple(r) for r in gaps] == [("n", "qa", 4)]
