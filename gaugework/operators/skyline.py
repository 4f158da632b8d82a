"""Pareto frontiers (skylines) over any number of objectives.

A row is on the frontier when no other row is at least as good in every
objective and better in one; copies of a frontier row all stay. Maximised
objectives are negated, so everything below minimises.

Two objectives use running minima: a vector survives when its second value
lies below the smallest one among all smaller first values. The running
minimum is taken over coarse buckets, then fine buckets, then rows, so no
sort ever holds more than one bucket. More objectives use partial comparisons:
dominated vectors are dropped by a handful of strong vectors, then by more of
them inside each task, and what is left is compared slab by slab (see ``_by_slabs``).
Dominance is transitive, so dropping a dominated vector early is always safe.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugework.functions.buckets import coarse_bucket, fine_bucket
from gaugework.functions.scalars import finite
from gaugework.operators.positions import with_position
from gaugework.session import SMALL_ROWS, materialise, small_side

SLAB_ROWS = 50_000      # vectors compared with each other inside one task
MAX_CELLS = 1 << 22     # size of the grid held by a task that compares the cells of a group
PAIRS_AT_ONCE = 1 << 15  # comparisons made at once where a problem is small
BLOCK_POINTS = 64
PRUNERS = 200           # vectors a task compares its rows with before the exact comparison


def pareto_frontier(
    df: DataFrame,
    objectives: list[str] = ("latency_ms", "cost_per_1m_tok"),
    minimize: list[bool] | None = None,
    quality_threshold: float | None = 0.85,
    flag: str = "is_pareto_optimal",
    small_rows: int = SMALL_ROWS,
    slab_rows: int = SLAB_ROWS,
) -> DataFrame:
    """All rows that meet the quality threshold, with a boolean ``flag``.

    The threshold applies when there is a ``quality_score`` column. Rows with a
    missing objective cannot be compared and are flagged false.
    """
    objectives = list(objectives)
    minimize = list(minimize) if minimize is not None else [True] * len(objectives)
    if len(minimize) != len(objectives) or not objectives:
        raise ValueError("give one minimise flag per objective")
    if quality_threshold is not None and "quality_score" in df.columns:
        df = df.filter(finite("quality_score") >= quality_threshold)

    dims = [f"__o{i}" for i in range(len(objectives))]
    signed = [F.col(c).cast("double") * (1.0 if low else -1.0) for c, low in zip(objectives, minimize)]
    rows = df.withColumns(dict(zip(dims, signed)))
    known = reduce(lambda a, b: a & b, [F.col(d).isNotNull() & ~F.isnan(d) for d in dims])
    vectors = rows.filter(known).select(*dims)

    front = small_side(_frontier(vectors, dims, small_rows, slab_rows))
    return (
        rows.join(front.withColumn(flag, F.lit(True)), dims, "left")
        .withColumn(flag, F.coalesce(flag, F.lit(False)))
        .select(*df.columns, flag)
    )


def pareto_anti_frontier(df: DataFrame, objectives: list[str], minimize: list[bool] | None = None,
                         quality_threshold: float | None = 0.85, **kwargs) -> DataFrame:
    """Flags the rows that dominate no other row: the frontier of the reversed objectives."""
    minimize = list(minimize) if minimize is not None else [True] * len(objectives)
    return pareto_frontier(df, objectives, [not low for low in minimize], quality_threshold, **kwargs)


def _frontier(vectors: DataFrame, dims: list[str], small_rows: int, slab_rows: int) -> DataFrame:
    """The distinct vectors that no other vector dominates."""
    if len(dims) == 1:
        return vectors.agg(F.min(dims[0]).alias(dims[0])).filter(F.col(dims[0]).isNotNull())
    if len(dims) == 2:
        return _two_objectives(vectors, small_rows)
    return _many_objectives(vectors, dims, slab_rows)


# ---- two objectives ---------------------------------------------------------

def _lowest_before(value: str, order: str, *within: str) -> Column:
    earlier = W.partitionBy(*within).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return F.min(value).over(earlier)


def _below(value: str, bound: str) -> Column:
    return F.col(bound).isNull() | (F.col(value) < F.col(bound))


def _two_objectives(vectors: DataFrame, small_rows: int) -> DataFrame:
    x, y = "__o0", "__o1"
    if vectors.count() <= small_rows:
        return (
            vectors.groupBy(x).agg(F.min(y).alias(y))
            .withColumn("__bound", _lowest_before(y, x))
            .filter(_below(y, "__bound")).select(x, y)
        )
    placed = vectors.withColumn("__b1", coarse_bucket(F.col(x)))
    stairs = small_side(
        placed.groupBy("__b1")
        .agg(F.min(y).alias("__low"), F.min(x).alias("__lo"), F.max(x).alias("__hi"))
        .withColumn("__bound", _lowest_before("__low", "__b1"))
        .filter(_below("__low", "__bound"))
        .drop("__low")
    )
    left = materialise(
        placed.join(stairs, "__b1").filter(_below(y, "__bound"))
        .withColumn("__b2", fine_bucket(F.col(x), F.col("__lo"), F.col("__hi")))
        .groupBy("__b1", "__b2", x).agg(F.min(y).alias(y)),
        "skyline-left",
    )
    fine = (
        left.groupBy("__b1", "__b2").agg(F.min(y).alias("__low"))
        .withColumn("__bound", _lowest_before("__low", "__b2", "__b1"))
        .filter(_below("__low", "__bound"))
        .drop("__low")
    )
    return (
        left.join(fine, ["__b1", "__b2"]).filter(_below(y, "__bound"))
        .withColumn("__row_bound", _lowest_before(y, x, "__b1", "__b2"))
        .filter(_below(y, "__row_bound"))
        .select(x, y)
    )


# ---- three and more objectives ----------------------------------------------

def _dominated(cand: np.ndarray, rivals: np.ndarray) -> np.ndarray:
    """Which rows of ``cand`` are dominated by a row of ``rivals``."""
    le = np.ones((len(cand), len(rivals)), dtype=bool)
    lt = np.zeros_like(le)
    for d in range(cand.shape[1]):
        a, b = rivals[None, :, d], cand[:, None, d]
        le &= a <= b
        lt |= a < b
    return (le & lt).any(axis=1)


def _sweep_three(points: np.ndarray) -> np.ndarray:
    """Row numbers of the undominated vectors of three objectives; one copy of equal ones.

    In lexicographic order only earlier vectors can dominate. Those that matter
    form a staircase: second objective rising, third falling.
    """
    order = np.lexsort((points[:, 2], points[:, 1], points[:, 0]))
    ys: list[float] = []
    zs: list[float] = []
    kept = []
    for i, (_, y, z) in zip(order.tolist(), points[order].tolist()):
        at = bisect_right(ys, y)
        if at and zs[at - 1] <= z:
            continue
        kept.append(i)
        start = at - 1 if at and ys[at - 1] == y else at
        end = at
        while end < len(ys) and zs[end] >= z:
            end += 1
        ys[start:end], zs[start:end] = [y], [z]
    return np.array(kept, dtype=int)


def _not_covered(rivals: np.ndarray, cand: np.ndarray) -> np.ndarray:
    """Which rows of ``cand`` have no row of ``rivals`` that is at most as large in every column.

    Halves along the first column: lower rivals cover upper candidates by the other columns alone, and either half is a
    problem of the same kind. Two columns are a running minimum.
    """
    k = cand.shape[1]
    if not len(rivals) or not len(cand):
        return np.ones(len(cand), dtype=bool)
    if k == 1:
        return cand[:, 0] < rivals[:, 0].min()
    if k == 2:
        order = np.argsort(rivals[:, 0], kind="stable")
        least = np.minimum.accumulate(rivals[order, 1])
        upto = np.searchsorted(rivals[order, 0], cand[:, 0], "right")
        return (upto == 0) | (least[np.maximum(upto, 1) - 1] > cand[:, 1])
    if len(rivals) * len(cand) <= PAIRS_AT_ONCE:
        return ~(rivals[None] <= cand[:, None]).all(axis=2).any(axis=1)
    values = np.concatenate([rivals[:, 0], cand[:, 0]])
    middle = np.partition(values, len(values) // 2)[len(values) // 2]
    if middle == values.max():
        below = values[values < middle]
        if not len(below):
            return _not_covered(rivals[:, 1:], cand[:, 1:])
        middle = below.max()
    low, high = rivals[:, 0] <= middle, cand[:, 0] > middle
    kept = np.ones(len(cand), dtype=bool)
    kept[~high] = _not_covered(rivals[low], cand[~high])
    upper = np.flatnonzero(high)
    upper = upper[_not_covered(rivals[low, 1:], cand[upper, 1:])]
    kept[high] = False
    kept[upper[_not_covered(rivals[~low], cand[upper])]] = True
    return kept


def _undominated_sorted(points: np.ndarray) -> np.ndarray:
    """Which of distinct vectors in lexicographic order no other dominates; only an earlier one can."""
    if len(points) <= BLOCK_POINTS:
        return ~_dominated(points, points)
    half = len(points) // 2
    first, second = _undominated_sorted(points[:half]), _undominated_sorted(points[half:])
    left = np.flatnonzero(second)
    second[left] = _not_covered(points[:half][first][:, 1:], points[half:][left][:, 1:])
    return np.concatenate([first, second])


def _keep_undominated(points: np.ndarray) -> np.ndarray:
    """Row numbers of the distinct vectors not dominated by another row of ``points``; one copy of equal ones.

    Divide and conquer over rows, then over objectives (Kung, Luccio and Preparata, 1975), so the work grows little faster
    than the rows.
    """
    if points.shape[1] == 3:
        return _sweep_three(points)
    distinct, first = np.unique(points, axis=0, return_index=True)
    return first[_undominated_sorted(distinct)]


def _prune_partitions(vectors: DataFrame, dims: list[str]) -> DataFrame:
    """Drop vectors that one of the strongest vectors seen by the same task dominates.

    The task holds ``PRUNERS`` vectors, so memory and work per row are bounded;
    what it lets through is compared exactly later.
    """
    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        strong = np.empty((0, len(dims)))
        for pdf in batches:
            points = np.unique(pdf[dims].to_numpy(dtype=float), axis=0)
            for start in range(0, len(points), 4096):
                part = points[start:start + 4096]
                part = part[~_dominated(part, strong)]
                yield pd.DataFrame(part, columns=dims)
                pool = np.concatenate([strong, part])
                strong = pool[np.argsort(pool.sum(axis=1), kind="stable")[:PRUNERS]]

    return vectors.mapInPandas(prune, vectors.select(*dims).schema)


def _exact_in_one_task(vectors: DataFrame, dims: list[str]) -> DataFrame:
    """The frontier of a table that was counted to fit one task."""
    def frontier(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [pdf[dims].to_numpy(dtype=float) for pdf in batches]
        if parts:
            points = np.concatenate(parts)
            yield pd.DataFrame(points[_keep_undominated(points)], columns=dims)

    return vectors.coalesce(1).mapInPandas(frontier, vectors.select(*dims).schema)


def _strong_vectors(vectors: DataFrame, dims: list[str]) -> list[tuple[float, ...]]:
    """The best vector along each objective and the best by the sum of signed logarithms."""
    logsum = sum(F.signum(d) * F.log2(F.abs(d) + 1.0) for d in dims)
    total = sum(F.col(d) for d in dims)
    firsts = [F.min(F.struct(F.col(d).alias("f"), total.alias("t"), *dims)).alias(d) for d in dims]
    firsts.append(F.min(F.struct(logsum.alias("f"), total.alias("t"), *dims)).alias("__sum"))
    best = vectors.agg(*firsts).first()
    return [tuple(s[d] for d in dims) for s in best if s is not None]


def _many_objectives(vectors: DataFrame, dims: list[str], slab_rows: int) -> DataFrame:
    undominated = F.lit(True)
    for strong in _strong_vectors(vectors, dims):
        le = reduce(lambda a, b: a & b, [F.lit(s) <= F.col(d) for s, d in zip(strong, dims)])
        lt = reduce(lambda a, b: a | b, [F.lit(s) < F.col(d) for s, d in zip(strong, dims)])
        undominated = undominated & ~(le & lt)
    left = materialise(
        _prune_partitions(vectors.filter(undominated), dims).distinct(), "skyline-left")
    if left.count() <= slab_rows:
        return _exact_in_one_task(left, dims)
    return _by_slabs(left, dims, slab_rows)


def _by_slabs(left: DataFrame, dims: list[str], slab_rows: int, max_cells: int = MAX_CELLS) -> DataFrame:
    """Exact comparison of many vectors without forming pairs across tasks.

    Along each objective the vectors are put in lexicographic order that starts
    with this objective, and cut into slabs of equal size; the vectors are
    distinct, so ties never fill a slab. A dominating vector comes earlier in
    every one of these orders. So it either shares a slab with the vector it
    dominates, and a comparison within the slab finds it, or it lies in a
    strictly lower slab along every objective, which the grid of occupied cells
    shows. The grid bounds the number of slabs; a slab that is still larger
    than ``slab_rows`` is a problem of the same kind and is cut again, so no
    task ever compares more than ``slab_rows`` vectors.
    """
    beaten: list[DataFrame] = []
    todo = left.select(F.lit("").alias("__group"), *dims)
    while True:
        todo = materialise(todo, "skyline-slabs")
        sizes = materialise(todo.groupBy("__group").agg(F.count(F.lit(1)).alias("__size")), "skyline-sizes")
        small = todo.join(sizes.filter(F.col("__size") <= slab_rows), "__group").select("__group", *dims)
        beaten.append(_lost_in_groups(small, dims))
        large = sizes.filter(F.col("__size") > slab_rows)
        if not large.limit(1).count():
            break
        lost, todo = _cut_again(todo.join(large, "__group"), dims, slab_rows, max_cells)
        beaten.append(lost)
    lost = materialise(reduce(DataFrame.unionByName, beaten).distinct(), "skyline-lost")
    return left.select(*dims).join(lost, dims, "left_anti")


def _lost_in_groups(rows: DataFrame, dims: list[str]) -> DataFrame:
    """Vectors that another one of their group dominates; groups are small."""
    def lost(pdf: pd.DataFrame) -> pd.DataFrame:
        beaten = np.ones(len(pdf), dtype=bool)
        beaten[_keep_undominated(pdf[dims].to_numpy(dtype=float))] = False
        return pdf.loc[beaten, dims]

    return rows.groupBy("__group").applyInPandas(lost, rows.select(*dims).schema)


def _cut_again(rows: DataFrame, dims: list[str], slab_rows: int, max_cells: int) -> tuple[DataFrame, DataFrame]:
    """(vectors beaten by a lower cell of their group, the others in one smaller group for each objective)."""
    k = len(dims)
    most = max(2, int(max_cells ** (1.0 / k)))
    slabs = F.greatest(F.lit(2), F.least(F.ceil(F.col("__size") / slab_rows), F.lit(most)))
    cells = [f"__c{i}" for i in range(k)]
    placed = rows
    for i, cell in enumerate(cells):
        order = [dims[(i + j) % k] for j in range(k)]
        placed = with_position(placed, order, cell, ["__group"]).withColumn(
            cell, F.floor(F.col(cell) / F.ceil(F.col("__size") / slabs)).cast("int"))
    placed = materialise(placed, "skyline-cells")

    def beaten_cells(pdf: pd.DataFrame) -> pd.DataFrame:
        occupied = pdf[cells].to_numpy(dtype=int)
        inner = (occupied > 0).all(axis=1)
        beaten = np.zeros(len(occupied), dtype=bool)
        side = occupied.max() + 1
        if side <= 2:  # a grid of two slabs each way: only the lowest cell is lower along every objective
            beaten = inner & bool((occupied == 0).all(axis=1).any())
        elif inner.any():
            grid = np.zeros((side,) * k, dtype=bool)
            grid[tuple(occupied.T)] = True
            for axis in range(k):
                grid = np.logical_or.accumulate(grid, axis=axis)
            beaten[inner] = grid[tuple((occupied[inner] - 1).T)]
        return pdf[beaten]

    distinct_cells = placed.select("__group", *cells).distinct()  # at most max_cells of a group, or 2 ** k and its rows
    beaten = distinct_cells.groupBy("__group").applyInPandas(beaten_cells, distinct_cells.schema)
    lost = placed.join(beaten, ["__group", *cells], "left_semi").select(*dims)
    rest = placed.join(beaten, ["__group", *cells], "left_anti").select(
        "__group", *dims, F.posexplode(F.array(*cells)).alias("__axis", "__slab")
    ).select(F.concat_ws("/", "__group", F.concat_ws(".", "__axis", "__slab")).alias("__group"), *dims)
    return lost, rest
