from gaugework.operators.report import report_tables

SCHEMA = ("request_id int, model_name string, workload string, batch_size int, latency_ms double, "
          "input_tokens long, output_tokens long")
ROWS = [(1, "a", "qa", 4, 300.0, 10, 20), (2, "b", "qa", 8, 250.0, 1, 2), (3, "b", "chat", 8, 250.0, 1, 2),
        (4, None, "chat", 1, 900.0, 5, 5)]


def as_dict(df):
    return {(r["section"], r["key"], r["metric"]): r["value"] for r in df.collect()}


def test_without_cost(spark):
    got = as_dict(report_tables(spark.createDataFrame(ROWS, SCHEMA)))
    assert got["overview", "all", "total_samples"] == 4.0
    assert got["overview", "all", "models_tested"] == 2.0
    assert got["findings", "b", "latency_ms"] == 250.0
    assert got["performance", "b", "total_tokens"] == 6.0
    assert ("advice_realtime", "No models meet <200ms latency requirement", "latency_ms") in got
    assert not any(section == "cost" or key is None for section, key, _ in got)


def test_with_cost_and_throughput(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).selectExpr(
        "*", "latency_ms / 100 as cost_per_1m_tok", "cast(request_id as double) as throughput")
    got = as_dict(report_tables(df, limit_ms=260.0))
    assert got["cost", "a", "mean_cost_per_1m_tok"] == 3.0 and got["cost", "a", "monthly_cost"] == 300.0
    assert got["findings", "b", "cost_per_1m_tok"] == 2.5
    assert got["findings", None, "throughput"] == 4.0
    assert got["advice_realtime", "Use b with batch_size=8", "latency_ms"] == 250.0
    assert got["advice_batch", "Use b", "cost_per_1m_tok"] == 2.5


def test_empty(spark):
    got = as_dict(report_tables(spark.createDataFrame([], SCHEMA)))
    assert got["overview", "all", "total_samples"] == 0.0
