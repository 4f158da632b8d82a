import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.operators.aggregates import box_summary, config_summary, latency_percentiles
from gaugework.operators.percentiles import grouped_percentiles

# without and with fine buckets
PLANS = [dict(), dict(bucket_rows=0)]
OUT = {"p0": ("v", 0.0), "p50": ("v", 0.5), "p95": ("v", 0.95), "p99": ("v", 0.99), "p100": ("v", 1.0)}


def groups(seed):
    rng = np.random.default_rng(seed)
    return {
        "one": [3.5],
        "two": [1.0, 2.0],
        "skewed": list(np.round(rng.lognormal(3, 1, 3000), 2)),
        "crowded": list(100 + rng.random(500) * 1e-9),
        "signs": list(rng.normal(0, 1, 400) * 10.0 ** rng.integers(-200, 200, 400)) + [0.0, -0.0],
        "equal": [7.25] * 100,
    }


@pytest.mark.parametrize("plan", PLANS)
def test_equal_to_linear_interpolation(spark, plan):
    data = groups(1)
    df = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs], "g string, v double")
    got = {r["g"]: r for r in grouped_percentiles(df, ["g"], OUT, **plan).collect()}
    assert set(got) == set(data)
    for g, vs in data.items():
        for name, (_, p) in OUT.items():
            assert got[g][name] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=1e-300)


@pytest.mark.parametrize("plan", PLANS)
def test_missing_values_and_keys(spark, plan):
    rows = [("a", 1.0, None), ("a", float("nan"), 4.0), ("a", 3.0, 6.0), (None, 9.0, 9.0), ("b", None, 5.0)]
    df = spark.createDataFrame(rows, "g string, v double, w double")
    got = {r["g"]: (r["x"], r["y"]) for r in grouped_percentiles(
        df, ["g"], {"x": ("v", 0.5), "y": ("w", 0.5)}, **plan).collect()}
    assert got == {"a": (2.0, 5.0), "b": (None, 5.0)}


@pytest.mark.parametrize("plan", PLANS)
def test_groups_without_values_and_extras(spark, plan):
    rows = [("a", 1.5, 2), ("a", 2.5, 3), ("b", None, 4), ("b", float("nan"), 5), ("c", 0.0, 6)]
    df = spark.createDataFrame(rows, "g string, v double, w long")
    got = grouped_percentiles(df, ["g"], {"m": ("v", 0.5)}, {
        "s": ("sum", F.col("w")), "n": ("count", F.lit(1)), "lo": ("min", F.col("w")), "hi": ("max", F.col("w")),
        "k": ("count", F.when(~F.isnan("v"), F.col("v")))}, **plan)
    assert got.columns == ["g", "m", "s", "n", "lo", "hi", "k"]
    assert sorted(map(tuple, got.collect())) == [
        ("a", 2.0, 5, 2, 2, 3, 2), ("b", None, 9, 2, 4, 5, 0), ("c", 0.0, 6, 1, 6, 6, 1)]


@pytest.mark.parametrize("plan", PLANS)
def test_no_keys(spark, plan):
    df = spark.range(1001).selectExpr("cast(id as double) as v")
    row = grouped_percentiles(df, [], {"m": ("v", 0.5), "q": ("v", 0.333)}, **plan).first()
    assert row["m"] == 500.0 and row["q"] == pytest.approx(333.0)


def test_latency_golden(spark):
    df = spark.range(100).selectExpr(
        "'run' as run_id", "50.0D + id as ttft_ms", "100.0D + id as end_to_end_ms")
    row = latency_percentiles(df, ["run_id"]).first()
    assert row["ttft_ms"]["p50"] == pytest.approx(99.5)
    assert row["ttft_ms"]["p95"] == pytest.approx(144.05)
    assert row["ttft_ms"]["p99"] == pytest.approx(148.01)
    assert row["end_to_end_ms"].asDict().keys() == {"p50", "p90", "p95", "p99"}
    assert latency_percentiles(df.filter("false"), ["run_id"]).count() == 0


def test_config_summary_drops_missing_keys(spark):
    rows = [("m", "qa", 1, 10.0, 5, 6), ("m", "qa", 1, 20.0, 5, 6), (None, "qa", 1, 99.0, 1, 1)]
    df = spark.createDataFrame(
        rows, "model_name string, workload string, batch_size int, latency_ms double, "
        "input_tokens long, output_tokens long")
    out = config_summary(df).collect()
    assert len(out) == 1
    assert out[0]["latency_ms_mean"] == 15.0 and out[0]["latency_ms_p95"] == 19.5
    assert out[0]["input_tokens_sum"] == 10 and out[0]["output_tokens_sum"] == 12


def test_box_whiskers(spark):
    df = spark.createDataFrame([("m", float(v)) for v in [1, 2, 3, 4, 5, 100]], "model_name string, latency_ms double")
    row = box_summary(df).first()
    assert (row["low"], row["high"], row["lower_whisker"], row["upper_whisker"]) == (1.0, 100.0, 1.0, 5.0)


@pytest.mark.parametrize("bucket_rows", [5_000_000, 3])
def test_weights_equal_repeated_rows(spark, bucket_rows):
    import random

    rng = random.Random(11)
    rows = [(rng.choice("ab"), rng.choice([1.0, 2.5, rng.uniform(0, 50), None]), rng.uniform(-3, 3), rng.randint(1, 6)) for _ in range(200)]
    df = spark.createDataFrame(rows, "g string, v double, u double, w int")
    outputs = {"p0": ("v", 0.0), "p50": ("v", 0.5), "p95": ("v", 0.95), "u90": ("u", 0.9)}
    repeated = df.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("w"))))

    def found(df, **kwargs):
        return sorted(tuple(r) for r in grouped_percentiles(df, ["g"], outputs, bucket_rows=bucket_rows, **kwargs).collect())

    assert found(df, weight="w") == found(repeated)
