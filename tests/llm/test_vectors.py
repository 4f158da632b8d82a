"""Zone maps and whitening against brute force."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.llm import qd_whitening as qd
from gaugework.llm import zone_maps as zones
from gaugework.llm.queries import ORACLE_SQL, QUERIES
from gaugework.llm.vectors import quantised
from tests.agreement import compare, connect

SCHEMA = "vec_id long, embedding array<double>, label int, cluster int, distance string, component int"
NAN, INF = float("nan"), float("inf")


def vectors(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 0, 7, "x", 9) for i, v in rows], SCHEMA).repartition(parts)


def clouds(seed, n, dims=64, groups=5, spread=0.1):
    rng = np.random.default_rng(seed)
    middles = rng.uniform(-0.5, 0.5, (groups, dims))
    return [(i, (middles[rng.integers(groups)] + spread * rng.standard_normal(dims)).tolist()) for i in range(n)]


def odd_vectors(dims=64):
    """Nulls, other lengths, entries that are no numbers, repeated ids and rows, a missing id."""
    same = [0.25] * dims
    return [(900, None), (901, []), (902, [0.5] * (dims - 1)), (903, [NAN] + [0.5] * (dims - 1)), (904, [INF] + [0.5] * (dims - 1)),
            (905, [None] + [0.5] * (dims - 1)), (906, same), (906, same), (906, [-0.01] * dims), (None, same), (907, [0.5] * (dims + 1))]


def kept_of(rows, dims):
    good = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    return [(i, [math.floor(64 * x) for x in v]) for i, v in good]


def lloyd(rows, clusters=16, rounds=3, dims=64):
    kept = kept_of(rows, dims)
    mark = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    packed = lambda v: np.array(v, "<i8").tobytes()
    middles = [v for _, v in sorted(kept, key=lambda r: (mark(r[0]), packed(r[1])))[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(middles))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for c in range(len(middles)):
            own = [v for (_, v), k in zip(kept, of) if k == c]
            if own:
                middles[c] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *reversed(near(v))) for i, v in kept]
    own = {c: sum(d for _, k, d in found if k == c) for _, c, _ in found}
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in middles]
    return [(i, c, d, own[c], sum(own.values()), digest[c]) for i, c, d in found]


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (5, 2)])
def test_hilbert_curve_steps_to_neighbours(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = [k.tobytes() for k in zones.hilbert_keys(cells, bits)]
    assert len(set(keys)) == len(cells)
    path = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_candidates_keep_every_nearest_centroid():
    rng = np.random.default_rng(3)
    dropped = 0
    for _ in range(200):
        rows = rng.integers(-6, 7, (30, 4)) + rng.integers(-20, 21, 4)
        middles = rng.integers(-25, 26, (12, 4))
        middles[5] = middles[2]  # a tie everywhere
        left = zones.candidates(rows.min(axis=0), rows.max(axis=0), middles)
        every = ((rows[:, None] - middles) ** 2).sum(axis=2).argmin(axis=1)
        assert set(every) <= set(left)
        assert (zones.nearest(rows, middles, left)[0] == every).all()
        dropped += 12 - len(left)
    assert dropped > 1200


def test_nearest_in_whole_numbers():
    rows, middles = np.array([[2 ** 24, 0], [1, 3]]), np.array([[2 ** 24 + 1, 1], [2 ** 24, 1], [0, 3]])
    assert [x.tolist() for x in zones.nearest(rows, middles, np.arange(3))] == [[1, 2], [1, 1]]


@pytest.mark.parametrize("block_rows", [1, 7, 512])
def test_clusters(spark, block_rows):
    rows = clouds(1, 150) + odd_vectors() + [(2000 + i, [0.125] * 64) for i in range(60)]
    got = zones.with_inertia(*zones.cluster_vectors(vectors(spark, rows), block_rows=block_rows))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(lloyd(rows), key=str)


def test_few_and_no_vectors(spark):
    rows = clouds(2, 5)
    got = zones.with_inertia(*zones.cluster_vectors(vectors(spark, rows)))
    assert sorted(map(tuple, got.collect())) == sorted(lloyd(rows))
    assert zones.with_inertia(*zones.cluster_vectors(vectors(spark, odd_vectors()[:3]))).count() == 0


def test_clusters_too_large_to_be_exact(spark):
    with pytest.raises(Exception, match="64 bits"):
        zones.cluster_vectors(vectors(spark, [(1, [1e9] * 64), (2, [0.0] * 64)]))


def test_copies_are_cut(spark):
    """One vector with very many copies does not end in one partition."""
    rows = [(i, [0.5] * 8) for i in range(3000)]
    found = quantised(vectors(spark, rows), 8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    blocks = zones.hilbert_blocks(found, 8, block_rows=5000)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(blocks.select(F.size("ids")).toPandas().iloc[:, 0]) < 2000


def test_clusters_equal_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert not compare(spark, connect(sf), QUERIES["op11_zone_maps"], ORACLE_SQL["op11_zone_maps"], sf)[1]


# ---- whitening -------------------------------------------------------------------

def plain(rows, dims, k=32):
    kept = kept_of(rows, dims)
    x = np.array([v for _, v in kept], float) + 1_000_000
    mid = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(mid, full_matrices=False)
    return kept, mid, s[:k] ** 2 / len(x), vt[:k], (mid ** 2).sum() / len(x)


def held_to(spark, rows, dims, k=32, parts=3):
    out = qd.whiten(vectors(spark, rows, parts)).orderBy("component").toPandas()
    kept, mid, e, vt, trace = plain(rows, dims, k)
    k = min(k, len(e), dims)
    assert len(out) == len(kept) * k and set(out.n) == {len(kept)}
    assert out.identity_error.nunique() == 1 and out.identity_error[0] < 1e-9
    sums = [sum(c) for c in zip(*(v for _, v in kept))]
    deviation = lambda v: sum((len(kept) * a - s) ** 2 for a, s in zip(v, sums))
    for component, part in out.groupby("component"):
        want = (mid @ vt[component - 1]) / math.sqrt(e[component - 1])
        assert sorted(part.deviation) == sorted(deviation(v) for _, v in kept)
        assert part.explained.iloc[0] == pytest.approx(e[component - 1] / trace, rel=1e-10)
        by_id = {i: w for (i, _), w in zip(kept, want)}
        got = part[part.vec_id.notna()]
        sign = np.sign(sum(by_id[i] * w for i, w in zip(got.vec_id, got.whitened)))
        if len(by_id) == len(kept):
            assert np.abs(sign * got.whitened - [by_id[i] for i in got.vec_id]).max() < 1e-7


def test_whitening(spark):
    held_to(spark, clouds(4, 400, spread=0.2), 64)


def test_whitening_of_odd_rows(spark):
    held_to(spark, clouds(5, 200, spread=0.2) + odd_vectors()[:6], 64, parts=5)
    rows = clouds(6, 100, spread=0.2) + odd_vectors()
    out = qd.whiten(vectors(spark, rows)).toPandas()
    assert len(out) == 32 * len(kept_of(rows, 64)) and out.identity_error[0] < 1e-9


def test_whitening_of_narrow_vectors(spark):
    held_to(spark, clouds(7, 300, dims=5, spread=0.3), 5, 5)


def test_directions_without_spread_have_no_component(spark):
    rng = random.Random(1)
    rows = [(i, [a := rng.random(), 0.5, a, rng.random() * 40]) for i in range(200)]
    out = qd.whiten(vectors(spark, rows)).toPandas()
    assert sorted(set(out.component)) == [1, 2] and out.identity_error[0] < 1e-9
    for rows in ([(i, [0.5] * 8) for i in range(9)], [(1, [0.1, 0.2])], odd_vectors()[:2], []):
        assert qd.whiten(vectors(spark, rows)).count() == 0


def test_many_tasks_fold_level_by_level(spark):
    rows = clouds(8, 200, dims=6, spread=0.3)
    found = quantised(vectors(spark, rows, 40), 6).repartition(40)
    n, sums = qd.column_sums(found, 6)
    r = qd.triangle(found, n, sums)
    states = qd.folded(found.select("vector"), lambda batches: str(sum(b.num_rows for b in batches)).encode() or None,
                       lambda a, b: str(int(a) + int(b)).encode(), 8, fan_in=3)
    _, mid, _, _, _ = plain(rows, 6)
    assert states == b"200" and np.allclose(r.T @ r, mid.T @ mid)


def test_deviation_that_does_not_fit():
    model = qd.Whitening(10 ** 9, np.array([0, 0], object), np.eye(2), np.ones(2), 2.0)
    assert model.deviations(np.array([[1, 2], [10, 0]])) == [5 * 10 ** 18, None]


def shapes():
    rng = np.random.default_rng(9)
    yield rng.standard_normal((300, 40)) * np.logspace(0, -9, 40)
    yield np.linalg.qr(rng.standard_normal((200, 30)))[0]  # all singular values equal
    yield np.concatenate([x := rng.standard_normal((100, 6)), x], axis=1)
    yield np.concatenate([rng.standard_normal((50, 4)), np.zeros((50, 2))], axis=1)
    u, v = (np.linalg.qr(rng.standard_normal((60, 20)))[0] for _ in range(2))
    yield u * np.r_[[5.0] * 5, [3, 3 + 1e-12, 3 - 1e-12], np.linspace(2, 1, 12)] @ v[:20]
    yield np.array([[3.0]])


@pytest.mark.parametrize("x", list(shapes()), ids=["graded", "equal", "repeated", "constant", "close", "single"])
def test_values_and_vectors_of_a_matrix(x):
    d = x.shape[1]
    r = np.linalg.qr(x, mode="r")
    a, b, p = qd.bidiagonal(np.concatenate([r, np.zeros((d - len(r), d))]))
    values, z = qd.right_vectors(a, b, d)
    w, s = p @ z, np.linalg.svd(x, compute_uv=False)
    assert np.abs(np.sqrt(values) - s).max() < 1e-13 * s[0]
    assert np.abs(w.T @ w - np.eye(d)).max() < 1e-11
    assert np.abs(x.T @ (x @ w) - w * values).max() < 1e-12 * s[0] ** 2


def test_small_singular_values_to_the_last_digits():
    """Known: the product of the singular values of a bidiagonal matrix is that of its diagonal, however small."""
    a = np.logspace(0, -12, 20)
    got = qd.dqds((a ** 2).tolist(), ((0.3 * a[:-1]) ** 2).tolist())
    assert sum(map(math.log, got)) == pytest.approx(2 * sum(map(math.log, a)), rel=1e-14)
    assert min(got) == pytest.approx(float(np.linalg.svd(np.diag(a) + np.diag(0.3 * a[:-1], 1))[1][-1]) ** 2, rel=1e-9)
