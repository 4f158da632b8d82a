import pytest
from pyspark.sql import functions as F

from gaugework.schemas import BENCHMARK_RESULTS, BENCHMARK_RUNS, REQUEST_RESULT
from gaugework.sources import catalog, commits, store


def results(spark, run, n):
    return spark.range(n).selectExpr(
        f"'{run}' as run_id", "'m' as model_name", "'vllm' as backend", "'qa' as workload", "1 as batch_size",
        "id * 0.5D as latency_ms", "id as input_tokens", "id as output_tokens",
        "timestamp_micros(1700000000123456 + id) as timestamp")


@pytest.mark.parametrize("fmt", store.FORMATS)
def test_round_trip_and_latest(spark, tmp_path, fmt):
    path = str(tmp_path / fmt)
    store.save_results(results(spark, "20240101_000000", 5), path, fmt)
    store.save_results(results(spark, "20240201_000000", 3), path, fmt)
    assert store.read_results(spark, path, fmt).count() == 8
    latest = store.latest_run(spark, path, fmt)
    assert latest.count() == 3 and latest.select("run_id").distinct().first()[0] == "20240201_000000"
    want = sorted(map(tuple, results(spark, "20240201_000000", 3).select(latest.columns).collect()))
    assert sorted(map(tuple, latest.collect())) == want
    assert "PartitionFilters: [isnotnull(run_id" in latest._jdf.queryExecution().toString()


@pytest.mark.parametrize("fmt", store.FORMATS)
def test_latest_of_odd_ids(spark, tmp_path, fmt):
    """ISO stamps are escaped in folder names, and a missing id is no run."""
    path = str(tmp_path / fmt)
    none = results(spark, "x", 2).selectExpr("cast(null as string) as run_id", "* except (run_id)")
    for rows in (results(spark, "2024-01-02T09:00:00", 4), results(spark, "2024-01-02T10:00:00", 3), none):
        store.save_results(rows, path, fmt)
    assert {r["run_id"] for r in store.latest_run(spark, path, fmt).collect()} == {"2024-01-02T10:00:00"}
    assert store.latest_run(spark, path, fmt).count() == 3 and store.read_results(spark, path, fmt).count() == 9


def test_nothing_stored(spark, tmp_path):
    empty = tmp_path / "none"
    empty.mkdir()
    assert store.latest_run(spark, str(empty)).count() == 0


def test_latest_file(spark, tmp_path):
    for run, n in (("20240101_000000", 4), ("20240301_000000", 2)):
        folder = tmp_path / f"benchmark_results_{run}.csv"
        results(spark, run, n).coalesce(1).write.option("header", True).option(
            "timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(str(folder))
    newest = store.latest_file(spark, str(tmp_path / "benchmark_results_20240301*.csv"), schema=REQUEST_RESULT)
    assert newest.count() == 2


def test_unknown_format(spark, tmp_path):
    with pytest.raises(ValueError):
        store.save_results(results(spark, "r", 1), str(tmp_path / "x"), "xlsx")


def test_store_and_orphans(spark, tmp_path):
    runs = spark.createDataFrame([(1, "r1", "m", "qa", 4, 10, None)], BENCHMARK_RUNS)
    rows = [(10, 1, 5.0, 1.0, 1, 1, 0.0, 0.0, 0.0, None), (11, 2, 6.0, 1.0, 1, 1, 0.0, 0.0, 0.0, None)]
    found = spark.createDataFrame(rows, BENCHMARK_RESULTS)
    with pytest.raises(ValueError, match="result 11 refers to run 2"):
        store.save_store(runs, found, str(tmp_path / "s"))
    with pytest.raises(ValueError, match="run 1 is stored twice"):
        store.save_store(runs.union(runs), found.filter("run_id = 1"), str(tmp_path / "s"))
    store.save_store(runs, found, str(tmp_path / "s"), checked=False)
    runs, found = store.read_store(spark, str(tmp_path / "s"))
    assert [r["id"] for r in store.orphan_results(found, runs).collect()] == [11]
    assert [(r["id"], r["model_name"]) for r in store.results_with_runs(found, runs).collect()] == [(10, "m")]


def test_ragged_append(spark):
    good = spark.sql("select 'r' run_id, 1.0D p95")
    bad = spark.sql("select 's' run_id, 'out of memory' error")
    rows = {r["run_id"]: (r["p95"], r["error"]) for r in store.append_results(good, bad).collect()}
    assert rows == {"r": (1.0, None), "s": (None, "out of memory")}


def test_catalog(spark):
    types = {r["model_name"]: r["deployment_type"] for r in catalog.models(spark).collect()}
    assert len(types) == 6 and sorted(types.values()) == ["api"] * 2 + ["self_hosted"] * 4
    presets = catalog.model_presets(spark).groupBy("preset").count().collect()
    assert {r["preset"]: r["count"] for r in presets} == {
        "quick_test": 2, "cost_optimized": 3, "quality_focused": 2, "full_suite": 6}
    assert catalog.kv_caches(spark).count() == 3 and catalog.quantizations(spark).count() == 3


def run_rows(spark, *ids):
    return spark.createDataFrame([(i, f"r{i}", "m", "qa", 4, 10, None) for i in ids], BENCHMARK_RUNS)


def result_rows(spark, *pairs):
    return spark.createDataFrame([(i, run, 5.0, 1.0, 1, 1, 0.0, 0.0, 0.0, None) for i, run in pairs], BENCHMARK_RESULTS)


def test_second_append_is_checked_against_the_first(spark, tmp_path):
    path = str(tmp_path / "s")
    store.save_store(run_rows(spark, *range(50)), result_rows(spark, (1, 3), (2, 49)), path)
    with pytest.raises(ValueError, match="run 7 is stored twice"):
        store.save_store(run_rows(spark, 100, 7), result_rows(spark, (3, 100)), path)
    again = run_rows(spark, 101).withColumn("run_id", F.lit("r8"))
    with pytest.raises(ValueError, match="run name 'r8' is stored twice"):
        store.save_store(again, result_rows(spark, (3, 101)), path)
    with pytest.raises(ValueError, match="result 4 refers to run 100"):
        store.save_store(run_rows(spark, 102), result_rows(spark, (3, 5), (4, 100)), path)
    with pytest.raises(ValueError, match="result 9 refers to run None"):
        store.save_store(run_rows(spark), result_rows(spark, (3, 5), (9, None)), path)
    # later results of stored runs, with and without new runs
    store.save_store(run_rows(spark, 103), result_rows(spark, (3, 5), (4, 103)), path)
    store.save_store(run_rows(spark), result_rows(spark, (5, 103), (6, 0)), path)
    runs, found = store.read_store(spark, path)
    assert sorted(r.id for r in runs.collect()) == [*range(50), 103]
    assert sorted((r.id, r.run_id) for r in found.collect()) == [(1, 3), (2, 49), (3, 5), (4, 103), (5, 103), (6, 0)]
    assert store.orphan_results(found, runs).count() == 0


def test_key_filter_has_no_misses(spark, tmp_path):
    path = str(tmp_path)
    keys = spark.range(5000).selectExpr("concat('id ', id) key")
    commits.save_keys(keys.filter("key < 'id 3'"), path, "b1")
    commits.save_keys(keys.filter("key >= 'id 3'"), path, "b2")
    more = keys.unionByName(spark.range(5000).selectExpr("concat('new ', id) key"))
    found = {(r.key, r.batch) for r in commits.screened(more, path, ["b1", "b2"]).collect()}
    assert {(r.key, "b1" if r.key < "id 3" else "b2") for r in keys.collect()} <= found
    assert len(found) < 5100 and commits.screened(keys, path, []).count() == 0


@pytest.mark.parametrize("fmt", store.FORMATS)
def test_unfinished_write_is_invisible(spark, tmp_path, fmt, monkeypatch):
    path = str(tmp_path / "r")
    store.save_results(results(spark, "20240101", 5), path, fmt)

    def stop(*_, **__):
        raise RuntimeError("lost")

    monkeypatch.setattr(store, "commit", stop)
    with pytest.raises(RuntimeError):
        store.save_results(results(spark, "20240301", 4), path, fmt)
    with pytest.raises(RuntimeError):
        store.save_store(run_rows(spark, 1), result_rows(spark, (1, 1)), str(tmp_path / "s"))
    monkeypatch.undo()
    assert store.read_results(spark, path, fmt).count() == 5
    assert {r.run_id for r in store.latest_run(spark, path, fmt).collect()} == {"20240101"}
    store.save_store(run_rows(spark, 1), result_rows(spark, (1, 1)), str(tmp_path / "s"))
    assert [t.count() for t in store.read_store(spark, str(tmp_path / "s"))] == [1, 1]


def test_overwrite_and_modes(spark, tmp_path):
    path = str(tmp_path / "r")
    for run, mode in (("20240301", "append"), ("20240101", "overwrite"), ("20240102", "append"), ("20240102", "append")):
        store.save_results(results(spark, run, 3), path, "parquet", mode)
    assert store.read_results(spark, path, "parquet").count() == 9
    assert store.latest_run(spark, path, "parquet").count() == 6
    with pytest.raises(ValueError, match="mode"):
        store.save_results(results(spark, "x", 1), path, mode="ignore")


def test_rows_are_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = results(spark, "20240101", 40)
    store.save_results(df.mapInArrow(count, df.schema), str(tmp_path / "r"), "json")
    assert seen.value == 40 and store.read_results(spark, str(tmp_path / "r"), "json").count() == 40


def test_empty_results(spark, tmp_path):
    path = str(tmp_path / "r")
    store.save_results(results(spark, "x", 0), path)
    assert store.read_results(spark, path).count() == 0 and store.latest_run(spark, path).count() == 0
