import numpy as np
import pytest

from gaugework.operators.select import frontier_export, recommend_by_priority
from gaugework.operators import skyline
from gaugework.operators.skyline import _by_slabs, _keep_undominated, pareto_anti_frontier, pareto_frontier


def dominates(a, b):
    return all(x <= y for x, y in zip(a, b)) and any(x < y for x, y in zip(a, b))


def cloud(seed, n, k, rounded):
    rng = np.random.default_rng(seed)
    x = rng.random((n, k))
    x = x / x.sum(axis=1, keepdims=True) * 10 * (1 + 0.1 * rng.random((n, 1)))
    if rounded:
        x = np.round(x)
    return [tuple(float(v) for v in row) for row in np.concatenate([x, x[:15]])]


def frame(spark, points):
    k = len(points[0])
    return spark.createDataFrame(
        [(i, *p) for i, p in enumerate(points)], "id int, " + ", ".join(f"v{j} double" for j in range(k)))


@pytest.mark.parametrize("k", [1, 2, 3, 4])
@pytest.mark.parametrize("rounded", [False, True])
@pytest.mark.parametrize("plan", [dict(), dict(small_rows=10, slab_rows=30)])
def test_equal_to_brute_force(spark, k, rounded, plan):
    points = cloud(k, 150, k, rounded)
    want = {i for i, p in enumerate(points) if not any(dominates(q, p) for q in points)}
    got = pareto_frontier(frame(spark, points), [f"v{j}" for j in range(k)], **plan)
    assert got.count() == len(points)
    assert {r["id"] for r in got.filter("is_pareto_optimal").collect()} == want


@pytest.mark.parametrize("k, max_cells", [(4, 81), (3, 1)])
def test_slabs_are_cut_again(spark, k, max_cells):
    """With a tiny grid a slab is cut several times, and no group is larger than asked for."""
    points = sorted(set(cloud(20 + k, 100, k, k == 4)))
    dims = [f"v{j}" for j in range(k)]
    df = spark.createDataFrame(points, ", ".join(f"{d} double" for d in dims))
    want = {p for p in points if not any(dominates(q, p) for q in points)}
    assert {tuple(r) for r in _by_slabs(df, dims, 30, max_cells).collect()} == want


def test_maximised_objective_and_anti_frontier(spark):
    points = cloud(9, 120, 2, True)
    df = frame(spark, points)
    signed = [(a, -b) for a, b in points]
    want = {i for i, p in enumerate(signed) if not any(dominates(q, p) for q in signed)}
    got = pareto_frontier(df, ["v0", "v1"], [True, False]).filter("is_pareto_optimal").collect()
    assert {r["id"] for r in got} == want
    nobody = {i for i, p in enumerate(points) if not any(dominates(p, q) for q in points)}
    anti = pareto_anti_frontier(df, ["v0", "v1"]).filter("is_pareto_optimal").collect()
    assert {r["id"] for r in anti} == nobody


def test_threshold_missing_values_and_empty(spark):
    rows = [(1, 1.0, 1.0, 0.5), (2, 2.0, 2.0, 0.9), (3, None, 0.0, 0.9), (4, 3.0, 3.0, 0.9)]
    df = spark.createDataFrame(rows, "id int, latency_ms double, cost_per_1m_tok double, quality_score double")
    got = {r["id"]: r["is_pareto_optimal"] for r in pareto_frontier(df).collect()}
    assert got == {2: True, 3: False, 4: False}
    assert pareto_frontier(df.filter("false")).count() == 0


POINTS = [("a", 10.0, 5.0, 100.0), ("b", 20.0, 1.0, 50.0), ("c", 15.0, 3.0, 300.0), ("d", 30.0, 9.0, 10.0)]


def test_priorities(spark):
    df = spark.createDataFrame(POINTS, "config_id string, latency_ms double, cost_per_1m_tok double, throughput double")
    flagged = pareto_frontier(df, ["latency_ms", "cost_per_1m_tok"])
    pick = {p: recommend_by_priority(flagged, p).first()["config_id"]
            for p in ("cost", "latency", "throughput", "balanced")}
    assert pick == {"cost": "b", "latency": "a", "throughput": "c", "balanced": "c"}
    with pytest.raises(ValueError):
        recommend_by_priority(flagged, "beauty")
    assert recommend_by_priority(flagged.filter("config_id = 'd'"), "cost").count() == 0


def test_export_flattens_config(spark):
    df = spark.sql("select 'm' as model_name, named_struct('quantization','int8','batch_size',4) as config, "
                   "1.0D as latency_ms, 2.0D as cost_per_1m_tok, true as is_pareto_optimal")
    row = frontier_export(df).first()
    assert (row["quantization"], row["batch_size"], row["throughput"]) == ("int8", 4, 0.0)


@pytest.mark.parametrize("k", [1, 2, 4, 5, 6, 7, 8])
@pytest.mark.parametrize("rounded", [False, True])
def test_kernel_equals_brute_force(k, rounded, monkeypatch):
    """Tiny blocks, so that every kind of split happens; rounded vectors tie in many places."""
    monkeypatch.setattr(skyline, "PAIRS_AT_ONCE", 6)
    monkeypatch.setattr(skyline, "BLOCK_POINTS", 3)
    for seed in range(4):
        points = np.array(cloud(seed, 160, k, rounded))
        if rounded:
            points[:, 0] = np.round(points[:, 0] / 4)
        kept = _keep_undominated(points)
        distinct = {tuple(p) for p in points}
        want = {p for p in distinct if not any(dominates(q, p) for q in distinct)}
        assert {tuple(points[i]) for i in kept} == want and len(kept) == len(want)


def test_kernel_grows_little_faster_than_its_vectors():
    import time

    def seconds(n):
        points = np.array(cloud(3, n, 4, False))
        start = time.process_time()
        assert len(_keep_undominated(points)) > n / 3
        return time.process_time() - start

    seconds(2_000)
    assert seconds(32_000) < 10 * max(seconds(8_000), 0.05)


def test_infinite_objectives():
    points = np.array([[1.0, np.inf, 0, 1], [1, 2, 0, 1], [-np.inf, np.inf, 5, 5], [0, 0, np.inf, -np.inf]] * 30)
    assert sorted(_keep_undominated(points).tolist()) == [1, 2, 3]
