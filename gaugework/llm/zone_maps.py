"""Centroid clustering over blocks of vectors in Hilbert order, each with a box that rules centroids out.

1. Vectors become whole numbers (``vectors.py``). Smallest and largest value per dimension set a grid of ``BITS`` bits a
   dimension, and the place of a vector's cell on the Hilbert curve through that grid is its sort key. Rows are
   range-partitioned on (key, hash of the id), so that one vector with very many copies is cut as well, sorted, and
   packed into blocks of ``BLOCK_ROWS`` vectors with the smallest and largest value per dimension: the zone map.
2. In each round a block asks which centroids can be nearest to any vector of its box. A centroid goes if its least
   distance to the box is more than another's largest, or if a third one, the nearest to the box's middle, is nearer to
   every corner of it. Only the candidates left are compared with the block's vectors, exactly.
3. Sums per centroid and dimension are added up within tasks, then by centroid, as decimals. The driver sees the
   centroids alone: their number times the dimensions.

The result doesn't depend on the blocks, as bounds are exact and ties count as not ruled out.

Defined cases: vectors with another number of components, null, or with a null or non-finite entry are left out; ties in
distance go to the smaller number; rows that repeat an id are vectors of their own, and among equal hashes the vector
itself decides which one is a first centroid; a null id hashes as an empty text; with fewer vectors than centroids, there
are as many centroids as vectors; an empty table gives no rows; other columns are not read. Where scaled components are so
large that a squared distance may not fit into 64 bits (about 2^26 with 64 of them), an error says so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm.common import table
from gaugework.llm.registry import query
from gaugework.llm.vectors import SCALE, binaries, quantised, rows_of
from gaugework.session import materialise

DIMS, CLUSTERS, ROUNDS = 64, 16, 3
SEED_PREFIX = "1:"
BITS = 6
BLOCK_ROWS = 512
# Centroid values that may go through the driver to every task.
MAX_CENTROID_VALUES = 4_000_000

BLOCKS = "ids array<long>, vectors binary, low binary, high binary"
SUMS = "cluster int, dim int, total long, n long"
ASSIGNED = "vec_id long, cluster int, distance long"


def extremes(vectors: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Smallest and largest value per dimension; None without rows."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            if batch.num_rows:
                rows = rows_of(batch.column(0), dims)
                low = rows.min(axis=0) if low is None else np.minimum(low, rows.min(axis=0))
                high = rows.max(axis=0) if high is None else np.maximum(high, rows.max(axis=0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(low), pa.array(high)],
                                             names=["dim", "low", "high"])

    found = (vectors.select("vector").mapInArrow(fold, "dim int, low long, high long")
             .groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("dim").collect())
    if not found:
        return None
    low, high = np.array([r.low for r in found]), np.array([r.high for r in found])
    if 16 * dims * max(-int(low.min()), int(high.max())) ** 2 >= 2 ** 63:
        raise ArithmeticError("squared distances may not fit into 64 bits")
    return low, high


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve, as rows of bytes that sort like the places; ``cells`` are below 2**bits.

    Skilling's transform ("Programming the Hilbert curve", 2004), all rows at once: axes are turned into the transposed
    index, whose bits are then dealt out from the highest of the first axis to the lowest of the last one.
    """
    x = cells.T.astype(np.uint32).copy()
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(len(x)):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & (q - 1)).astype(np.uint32)
            x[0] ^= np.where(flip, q - 1, swap).astype(np.uint32)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[-1] & q, q - 1, 0).astype(np.uint32)
        q >>= 1
    x ^= turn
    planes = [(x >> b & 1).T for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes, axis=1).astype(np.uint8), axis=1)


def hilbert_blocks(vectors: DataFrame, dims: int, bits: int = BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of vectors that are near each other, with their boxes; ``vectors`` is what ``quantised`` gave."""
    found = extremes(vectors, dims)
    low, high = found if found else (np.zeros(dims, np.int64), np.ones(dims, np.int64))
    step = np.maximum((high - low) // (1 << bits) + 1, 1)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = (rows_of(batch.column(1), dims) - low) // step
            keys = hilbert_keys(cells, bits) if batch.num_rows else np.zeros((0, 1), np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([k.tobytes() for k in keys], pa.binary())],
                                             names=["vec_id", "vector", "place"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = [], np.zeros((0, dims), np.int64)
        for batch in batches:
            ids += batch.column(0).to_pylist()
            rows = np.concatenate([rows, rows_of(batch.column(1), dims)])
            while len(ids) >= block_rows:
                yield block(ids[:block_rows], rows[:block_rows])
                ids, rows = ids[block_rows:], rows[block_rows:]
        if ids:
            yield block(ids, rows)

    def block(ids: list, rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(pa.int64())), pa.array([np.ascontiguousarray(rows, "<i8").tobytes()]),
             binaries(rows.min(axis=0)[None]), binaries(rows.max(axis=0)[None])],
            names=[f.split()[0] for f in BLOCKS.split(", ")])

    keyed = vectors.mapInArrow(key, "vec_id long, vector binary, place binary")
    spread = F.xxhash64("vec_id", "vector")
    ordered = keyed.repartitionByRange("place", spread).sortWithinPartitions("place", spread)
    return materialise(ordered.select("vec_id", "vector").mapInArrow(pack, BLOCKS), "zones")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroids that can be nearest to a whole-number point of the box, ascending.

    For the centroid m nearest to the box's middle, d(x, m) - d(x, c) is linear in x, so its largest value over the
    box is at a corner and c can be left out exactly when m wins there.
    """
    c = centroids
    least = (np.maximum(np.maximum(low - c, c - high), 0) ** 2).sum(axis=1)
    most = (np.maximum(np.abs(c - low), np.abs(c - high)) ** 2).sum(axis=1)
    left = np.flatnonzero(least <= most.min())
    middle = ((2 * c[left] - low - high) ** 2).sum(axis=1)
    m = left[int(middle.argmin())]
    slope = 2 * (c[left] - c[m])
    lead = (c[m] ** 2).sum() - (c[left] ** 2).sum(axis=1) + np.maximum(slope * low, slope * high).sum(axis=1)
    return left[(lead > 0) | (lead == 0) & (left <= m)]


def nearest(rows: np.ndarray, centroids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the nearest centroid of ``among`` (ties: the smallest number) and its squared distance, exactly."""
    some = centroids[among]
    largest = max(int(np.abs(rows).max()), int(np.abs(some).max()), 1)
    if 16 * rows.shape[1] * largest ** 2 < 2 ** 53:  # every product and sum is then a whole number that a double holds
        a, b = rows.astype(float), some.astype(float)
        squares = (a ** 2).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b ** 2).sum(axis=1)
        distances = squares.astype(np.int64)
    else:
        distances = np.stack([((rows - c) ** 2).sum(axis=1) for c in some], axis=1)
    best = distances.argmin(axis=1)
    return among[best], distances[np.arange(len(rows)), best]


def opened(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, vectors and the box's corners of each block."""
    for i in range(batch.num_rows):
        ids, vectors, low, high = (batch.column(k)[i] for k in range(4))
        yield (ids.values, np.frombuffer(vectors.as_py(), "<i8").reshape(-1, dims),
               np.frombuffer(low.as_py(), "<i8"), np.frombuffer(high.as_py(), "<i8"))


def cluster_sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's vectors per centroid and their sums per dimension."""
    k, dims = centroids.shape
    totals, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
    for batch in batches:
        for _, rows, low, high in opened(batch, dims):
            cluster, _ = nearest(rows, centroids, candidates(low, high, centroids))
            for c in np.unique(cluster):
                own = rows[cluster == c]
                totals[c] += own.sum(axis=0)
                counts[c] += len(own)
    full = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(full, dims), pa.int32()), pa.array(np.tile(np.arange(dims), len(full)), pa.int32()),
         pa.array(totals[full].ravel()), pa.array(np.repeat(counts[full], dims))],
        names=["cluster", "dim", "total", "n"])


def assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, rows, low, high in opened(batch, centroids.shape[1]):
            cluster, distance = nearest(rows, centroids, candidates(low, high, centroids))
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(distance)],
                                             names=["vec_id", "cluster", "distance"])


def first_centroids(vectors: DataFrame, clusters: int, dims: int) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in that order."""
    mark = F.sha2(F.concat(F.lit(SEED_PREFIX), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    found = vectors.select(mark.alias("mark"), "vector").orderBy("mark", "vector").limit(clusters).collect()
    return np.array([np.frombuffer(r.vector, "<i8") for r in found], np.int64).reshape(-1, dims)


def moved(centroids: np.ndarray, blocks: DataFrame) -> np.ndarray:
    """Each centroid replaced by the exact floor of its vectors' mean, where it has any."""
    sums = blocks.mapInArrow(partial(cluster_sums, centroids=centroids), SUMS).groupBy("cluster", "dim").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    new = centroids.copy()
    for r in sums.collect():
        new[r.cluster, r.dim] = int(r.total) // r.n
    return new


def cluster_vectors(table: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS,
                    id_column: str = "vec_id", vector_column: str = "embedding", bits: int = BITS,
                    block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, np.ndarray]:
    """Per vector its id, cluster and squared distance, written down; and the centroids."""
    if clusters * dims > MAX_CENTROID_VALUES:
        raise ValueError(f"{clusters} centroids of {dims} components are more than {MAX_CENTROID_VALUES} values")
    vectors = quantised(table, dims, id_column, vector_column)
    blocks = hilbert_blocks(vectors, dims, bits, block_rows)
    centroids = first_centroids(vectors, clusters, dims)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(centroids, blocks)
    return materialise(blocks.mapInArrow(partial(assigned, centroids=centroids), ASSIGNED), "clusters"), centroids


def with_inertia(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds what the clusters amount to: distances summed over the cluster and over all, and the centroid's digest.

    One sum per centroid is collected, and joined by broadcast: at most MAX_CENTROID_VALUES / dimensions rows.
    """
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    own = {r.cluster: int(r.own) for r in sums.collect()}
    facts = [(c, n, sum(own.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
             for c, n in own.items()]
    known = rows.sparkSession.createDataFrame(
        facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(known), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(before: str, after: str) -> str:
    return f"""
, {after}_best AS ({_assign(before)}
), {after}_sums AS (
    SELECT b.cluster, count(*) AS n,
           {', '.join(f'sum(v.q[{i}]) AS s{i}' for i in range(1, DIMS + 1))}
    FROM {after}_best b JOIN kept v ON v.vec_id = b.vec_id GROUP BY b.cluster
), {after} AS (
    SELECT c.cluster, CASE WHEN s.n IS NULL THEN c.q ELSE [{', '.join(
        f'CAST((s.s{i} - ((s.s{i} % s.n) + s.n) % s.n) // s.n AS BIGINT)' for i in range(1, DIMS + 1))}] END AS q
    FROM {before} c LEFT JOIN {after}_sums s ON s.cluster = c.cluster
)"""


def _assign(centroids: str) -> str:
    gap = " + ".join(f"(v.q[{i}] - c.q[{i}]) * (v.q[{i}] - c.q[{i}])" for i in range(1, DIMS + 1))
    return f"""
    SELECT vec_id, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance
    FROM (SELECT v.vec_id, c.cluster, {gap} AS d FROM kept v, {centroids} c) GROUP BY vec_id"""


SQL = f"""
WITH kept AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}
), c0 AS (
    SELECT CAST(row_number() OVER (ORDER BY mark) - 1 AS INTEGER) AS cluster, q
    FROM (SELECT sha256('{SEED_PREFIX}' || CAST(vec_id AS VARCHAR)) AS mark, q FROM kept ORDER BY mark LIMIT {CLUSTERS})
){''.join(_round(f'c{i}', f'c{i + 1}') for i in range(ROUNDS))}
, last AS ({_assign(f'c{ROUNDS}')}
)
SELECT vec_id, l.cluster, distance,
       CAST(sum(distance) OVER (PARTITION BY l.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM last l JOIN c{ROUNDS} c ON c.cluster = l.cluster
"""


@query("op11_zone_maps", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*cluster_vectors(table(spark, sf_dir, "embeddings")))
