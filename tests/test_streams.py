"""Streams against batch results, with late rows, repeats and several micro-batches."""

import datetime

import pytest
from pyspark.sql import functions as F

from gaugework.sources import catalog
from gaugework.streaming import windows
from gaugework.operators.order_statistics import bucketed, values_at_ranks, wanted_buckets
from gaugework.streaming.run import drain, follow, read_folder

START = datetime.datetime(2024, 1, 1)
SCHEMA = ("request_id long, ts timestamp, model_name string, latency_ms double, is_error boolean, "
          "input_tokens long, output_tokens long")


def row(i, minutes, latency=10.0, model="llama-2-7b"):
    return (i, START + datetime.timedelta(minutes=minutes), model, latency, i % 10 == 0, 3, 4)


def write(spark, path, *batches):
    """One file per batch, with rising modification times, so that they arrive in order."""
    import os
    import time

    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))
        for f in path.glob("*.parquet"):
            if f.name not in write.seen:
                write.seen.add(f.name)
                os.utime(f, (time.time() - 1000 + n, time.time() - 1000 + n))
    return read_folder(spark, str(path), files_per_trigger=1)


write.seen = set()


def test_windows_equal_batch(spark, tmp_path):
    rows = [row(i, i * 1.7, float(i % 50)) for i in range(400)]
    stream = write(spark, tmp_path / "in", rows[:150], rows[150:300], rows[300:])
    got = drain(windows.latency_windows(stream)).collect()
    batch = windows.latency_windows(spark.createDataFrame(rows, SCHEMA))
    closed = max(r[1] for r in rows) - datetime.timedelta(minutes=10)
    want = batch.filter(F.col("window_end") <= F.lit(closed)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 11


def test_late_rows_are_dropped(spark, tmp_path):
    stream = write(
        spark, tmp_path / "in",
        [row(1, 5), row(2, 30)],
        [row(3, 200)],
        [row(6, 210)],          # late rows are judged by the watermark of the batch before
        [row(4, 10)],
        [row(5, 500)])
    got = {(r["window_start"].hour, r["requests"]) for r in drain(windows.latency_windows(stream)).collect()}
    assert got == {(0, 2), (3, 2)}


def test_repeats_are_dropped(spark, tmp_path):
    stream = write(spark, tmp_path / "in", [row(1, 0), row(2, 1), row(1, 0)], [row(2, 1), row(3, 2)])
    got = drain(windows.without_repeats(stream)).collect()
    assert sorted(r["request_id"] for r in got) == [1, 2, 3]


def test_sessions_split_at_gaps(spark, tmp_path):
    minutes = [0, 10, 35, 100, 120, 400]
    stream = write(spark, tmp_path / "in", [row(i, m) for i, m in enumerate(minutes)])
    got = sorted((r["run_start"].hour * 60 + r["run_start"].minute, r["requests"])
                 for r in drain(windows.run_sessions(stream)).collect())
    assert got == [(0, 3), (100, 2)]


def test_alerts(spark):
    df = spark.createDataFrame(
        [row(1, 0, 700.0), row(2, 1, 700.0), row(3, 2, 10.0, "phi-3-mini")], SCHEMA)
    found = windows.alerts(windows.latency_windows(df), catalog.alert_thresholds(spark)).collect()
    got = {(r["model_name"], r["metric"]) for r in found}
    assert got == {("llama-2-7b", "latency_p95_ms"), ("llama-2-7b", "throughput_req_s"),
                   ("phi-3-mini", "throughput_req_s")}


def test_gpu_alert(spark):
    rows = [(i, START + datetime.timedelta(seconds=i), 100.0, 200.0, 95.0 if i < 5 else 20.0, 1.0, 1.0, 2.0) for i in range(10)]
    df = spark.createDataFrame(rows, "sample_id long, ts timestamp, gpu_memory_used_mb double, gpu_memory_total_mb double, "
                               "gpu_utilization_percent double, cpu_percent double, ram_used_gb double, ram_total_gb double")
    found = windows.alerts(windows.resource_windows(df), catalog.alert_thresholds(spark), keys=[]).collect()
    assert [(r["window_start"], r["metric"], r["value"]) for r in found] == [(START, "gpu_utilization", 0.95)]


def test_exact_percentiles_of_many_values(spark, tmp_path):
    """More different values in one window than any sketch would keep."""
    n = 30_000
    df = spark.range(n).selectExpr("id", "timestamp_micros(1704067200000000 + id) ts", "'m' model_name",
                                   "(id * 7919 % 30011) * 0.001D latency_ms", "false is_error", "1L input_tokens", "1L output_tokens")
    values = sorted(i * 7919 % 30011 * 0.001 for i in range(n))
    last = spark.createDataFrame([(n, START + datetime.timedelta(hours=3), "m", 1.0, False, 1, 1)], df.schema)
    df.unionByName(last).coalesce(1).write.parquet(str(tmp_path / "in"))
    path = str(tmp_path / "out")
    got = drain(windows.latency_windows(read_folder(spark, str(tmp_path / "in"))), path=path).collect()
    assert len(got) == 1 and got[0]["requests"] == n
    for p in (50, 95, 99):
        assert got[0][f"latency_p{p}_ms"] == values[-(-p * n // 100) - 1]
    # a second call carries on after what is done already
    again = drain(windows.latency_windows(read_folder(spark, str(tmp_path / "in"))), path=path)
    assert again.count() == 1


def test_running_cost_and_sliding(spark, tmp_path):
    rows = [row(i, i * 20) for i in range(100)]
    stream = write(spark, tmp_path / "in", rows)
    cost = drain(windows.running_cost(stream, catalog.models(spark))).collect()
    assert len(cost) == 1 and cost[0]["input_tokens"] == 72 * 3
    assert cost[0]["total_cost_usd"] == pytest.approx(72 * 0.01 / 3600 * 1.006)
    slid = drain(windows.sliding_p95(write(spark, tmp_path / "in2", [row(1, 0, 5.0), row(2, 3, 9.0), row(3, 60)])))
    assert slid.filter("latency_p95_ms = 9.0").count() == 10


def test_busy_model_with_millions_of_values(spark):
    """Two million values in one window: ranks come from buckets, and no aggregate gathers values."""
    n = 2_000_000
    df = spark.range(n).selectExpr("id", "timestamp_micros(1704067200000000 + id) ts", "'m' model_name",
                                   "cast(id * 7919 % 2000003 as double) / 8 latency_ms", "id % 10 = 0 is_error",
                                   "1L input_tokens", "1L output_tokens")
    found = windows.latency_windows(df)
    plan = found._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "collect_set" not in plan
    values = sorted(i * 7919 % 2000003 / 8 for i in range(n))
    row = found.collect()
    assert len(row) == 1 and row[0]["requests"] == n and row[0]["error_rate"] == 0.1
    assert [row[0][f"latency_p{p}_ms"] for p in (50, 95, 99)] == [values[-(-p * n // 100) - 1] for p in (50, 95, 99)]


def test_ranks_of_crowded_values(spark):
    """A bucket that is too large for a task is cut again, with the same result."""
    import random

    rng = random.Random(5)
    rows = [(g, 100 + rng.random() * 0.001 if rng.random() < 0.9 else rng.uniform(-5, 500)) for g in (None, "a", "b") for _ in range(700)]
    rows += [("c", None), ("d", -0.0), ("d", 0.0), ("d", 7.0)]
    counts = bucketed(spark.createDataFrame(rows, "g string, v double").groupBy("g", "v").agg(F.count(F.lit(1)).alias("__n")), "v")
    buckets = counts.groupBy("g", "__bucket").agg(F.sum("__n").alias("__n"), F.min("v").alias("__low"), F.max("v").alias("__high"))
    outputs = {"low": 0.01, "mid": 0.5, "high": 0.999, "top": 1.0}
    hits = wanted_buckets(buckets, ["g"], list(outputs.values())).withColumnRenamed("g", "k").drop("__n")
    values = counts.join(hits, ["__bucket"]).filter(F.col("g").eqNullSafe(F.col("k"))).withColumnRenamed("v", "__value").drop("k")
    want = {}
    for g in (None, "a", "b", "d"):
        own = sorted(v for h, v in rows if h == g and v is not None)
        want[g] = tuple(own[max(1, -(-round(f * 1000) * len(own) // 1000)) - 1] for f in outputs.values())
    for largest in (1, 10 ** 9):
        got = {r["g"]: tuple(r[o] for o in outputs) for r in values_at_ranks(values, ["g"], outputs, largest, 10).collect()}
        assert got == want


@pytest.mark.parametrize("size,slide", [("10 minutes", "1 minute"), ("6 minutes", "4 minutes"), ("5 minutes", "2 minutes"), ("1 hour", None)])
def test_windows_from_panes(spark, tmp_path, size, slide):
    """Windows of all overlaps equal those that the rows themselves are copied into."""
    rows = [row(i, (i * 37 % 101) * 0.9, float(i * 7 % 23), ["a", "b", None][i % 3]) for i in range(160)]
    df = spark.createDataFrame(rows, SCHEMA)
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    want = df.groupBy(window.alias("w"), "model_name").agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("latency_ms")).alias("v"), F.avg(F.col("is_error").cast("double")).alias("e"))
    want = {(r["w"]["start"], r["w"]["end"], r["model_name"]): (r["n"], r["v"][-(-95 * r["n"] // 100) - 1], r["e"]) for r in want.collect()}

    def found(df):
        return {(r["window_start"], r["window_end"], r["model_name"]): (r["requests"], r["latency_p95_ms"], r["error_rate"]) for r in df.collect()}

    assert found(windows.latency_windows(df, size, slide)) == want
    ordered = sorted(rows, key=lambda r: r[1])
    stream = write(spark, tmp_path / "in", ordered[:90], ordered[90:])
    path = str(tmp_path / "out")
    closed = ordered[-1][1] - datetime.timedelta(minutes=10)
    done = {k: v for k, v in want.items() if k[1] <= closed}
    assert found(drain(windows.latency_windows(stream, size, slide), path=path)) == done
    # a call that finds nothing new knows how far the one before has come
    again = read_folder(spark, str(tmp_path / "in"), files_per_trigger=1)
    assert found(drain(windows.latency_windows(again, size, slide), path=path)) == done


@pytest.mark.parametrize("most", [windows.BUCKET_ROWS, 3])
def test_sliding_windows_write_no_copies(spark, monkeypatch, most):
    """Ten windows cover a row, yet what is written grows with the windows and not with ten times the rows."""
    rows = [row(i, (i * 37 % 2003) * 0.06, 1.0 + (i * 7919 % 3001) * 0.25) for i in range(2000)]
    written, keep = {}, windows.materialise

    def counted(df, label="step"):
        written[label] = (table := keep(df, label)).count()
        return table

    monkeypatch.setattr(windows, "materialise", counted)
    monkeypatch.setattr(windows, "BUCKET_ROWS", most)
    got = {r["window_start"]: (r["requests"], r["latency_p95_ms"])
           for r in windows.sliding_p95(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {}
    for start in (START + datetime.timedelta(minutes=m) for m in range(-10, 130)):
        own = sorted(r[3] for r in rows if start <= r[1] < start + datetime.timedelta(minutes=10))
        if own:
            want[start] = (len(own), own[-(-95 * len(own) // 100) - 1])
    assert got == want and len(got) > 100
    assert written.pop("pane-counts") == len(rows) and sum(written.values()) <= len(want)


def test_following_a_stream(spark, tmp_path):
    rows = [row(i, i * 1.7, float(i % 50)) for i in range(400)]
    stream = write(spark, tmp_path / "in", rows[:150], rows[150:300], rows[300:])
    path = str(tmp_path / "out")
    follow(windows.latency_windows(stream), path, availableNow=True).awaitTermination()
    got = spark.read.parquet(f"{path}/rows").drop("batch").collect()
    closed = max(r[1] for r in rows) - datetime.timedelta(minutes=10)
    want = windows.latency_windows(spark.createDataFrame(rows, SCHEMA)).filter(F.col("window_end") <= F.lit(closed)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 11
    with pytest.raises(ValueError, match="drain"):
        follow(windows.sliding_p95(stream), path)


@pytest.mark.parametrize("text", ["soon", "0 minutes", "-1 hours", "3 months"])
def test_window_sizes(text):
    with pytest.raises(ValueError, match="window size"):
        windows.seconds_of(text)


def test_windows_with_gaps_are_refused(spark):
    with pytest.raises(ValueError, match="slide"):
        windows.latency_windows(spark.createDataFrame([row(1, 0)], SCHEMA), "1 minute", "2 minutes")
