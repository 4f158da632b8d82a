"""Counts and least values over all rows within three limits, for many sets of limits at once.

Rows with three costs (smaller passes sooner) are put on a grid cut at quantiles of each axis. Running windows along the
axes turn the cells into cumulative ones: cell (i, j, k) sums up all rows below cut i, j and k. A set of limits then needs

* one cumulative cell, for everything that lies in parts that pass as a whole, and
* the rows of three strips, the part of each axis that the limit itself runs through, compared one by one.

With n rows the grid has about n cells, so a strip has about n^(2/3) rows. Cells and strips meet their limits by equality
of part numbers, and the limits are not shuffled where those fit a broadcast; no other pair is made. A value that is
heavy among the rows has a part of its own, which passes or fails as a whole and is in no strip. The result is exact and
the same for every grid.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugework.functions.steps import bounds_of, steps_passed
from gaugework.session import is_small, materialise

AXES = ("__x", "__y", "__z")
ACCURACY = 10_000
LEAST_CELLS = 2_000


@dataclass
class Grid:
    """``rows`` are written rows, ``n`` of them; ``axes`` name their three columns, ``bounds`` the cuts of each.

    ``small`` tells whether tables of the size of ``rows`` may be broadcast.
    """

    rows: DataFrame
    n: int
    axes: tuple[str, str, str]
    bounds: list[list[float]]
    small: bool

    def parts(self) -> list[Column]:
        """Per axis the part a row lies in: part p holds values above p bounds. NULL where the value is missing."""
        return [F.when(F.col(axis).isNotNull(), steps_passed(b, f"{{}} < `{axis}`")).alias(name)
                for axis, b, name in zip(self.axes, self.bounds, AXES)]


def grid_over(rows: DataFrame, axes: tuple[str, str, str], strip_rows: int | None = None) -> Grid:
    """A grid over written ``rows``; with ``strip_rows``, strips of about so many rows unless that takes too many cells."""
    n = rows.count()
    per_axis = math.ceil(max(n, LEAST_CELLS) ** (1 / 3))
    if strip_rows:
        per_axis = min(max(1, math.ceil(n / strip_rows)), per_axis)
    fractions = [(i + 1) / per_axis for i in range(per_axis)]
    cuts = rows.agg(*[F.percentile_approx(a, fractions, ACCURACY).alias(a) for a in axes]).first()
    return Grid(rows, n, axes, [bounds_of(cuts[a]) for a in axes], is_small(rows, n))


def cumulative_cells(grid: Grid, measures: dict[str, tuple[str, str]]) -> DataFrame:
    """For every (__x, __y, __z) the measures over rows in parts below them, ``n_x`` and ``n_xy``; written down.

    ``measures`` maps a name to ("sum", "min" or "max", SQL). Rows without a value on the first axis don't count; those
    without one on another axis count in ``n_x`` (rows below the first limit) and ``n_xy`` (below two) alone.
    """
    sizes = [len(b) + 3 for b in grid.bounds]  # nothing, a part more than bounds, the rows without a value
    place = [F.coalesce(p + 1, F.lit(s - 1)).alias(a) for p, s, a in zip(grid.parts(), sizes, AXES)]
    every = grid.rows.sparkSession.range(math.prod(sizes)).selectExpr(
        f"CAST(id % {sizes[0]} AS INT) AS __x", f"CAST(floor(id / {sizes[0]}) % {sizes[1]} AS INT) AS __y",
        f"CAST(floor(id / {sizes[0] * sizes[1]}) AS INT) AS __z")
    placed = grid.rows.filter(F.col(grid.axes[0]).isNotNull()).select(
        *place, F.lit(1).alias("__one"), *[F.expr(f"{sql} AS {m}") for m, (_, sql) in measures.items()])
    # dealt by two of the axes, cells and the first window along the third need no other shuffle
    cells = placed.unionByName(every, allowMissingColumns=True).repartition("__y", "__z").groupBy(*AXES).agg(
        F.count("__one").alias("__n"), *[F.expr(f"{how}({m}) AS {m}") for m, (how, _) in measures.items()])

    def running(axis: str) -> list[str]:
        others = ", ".join(a for a in AXES if a != axis)
        over = f"OVER (PARTITION BY {others} ORDER BY {axis} ROWS UNBOUNDED PRECEDING)"
        sums = {"__n": "sum"} | {m: how for m, (how, _) in measures.items()}
        return [*AXES, *[f"{how}({m}) {over} AS {m}" for m, how in sums.items()]]

    # all that follows the first window keeps the rows where its successor has dealt them, by __x
    below_x = cells.selectExpr(*running("__x")).selectExpr(
        "*", "sum(__n) OVER (PARTITION BY __x) AS n_x")
    below_xy = below_x.selectExpr(*running("__y"), "n_x").selectExpr("*", "sum(__n) OVER (PARTITION BY __x, __y) AS n_xy")
    # written, as what follows is planned over and over and the cells are few
    return materialise(below_xy.selectExpr(*running("__z"), "n_x", "n_xy").drop("__n"), "cells")


def with_strips(asked: DataFrame, grid: Grid, fields: dict[str, str]) -> DataFrame:
    """Asked rows, with their parts as __x, __y and __z, beside the rows that their cells leave out.

    Adds ``on_x``, ``on_y`` and ``on_z``, arrays of ``fields`` (name to column) of the rows in the part that a limit runs
    through: all of them for the first axis, those below the first limit's part for the second, and those below both for
    the third.
    """
    placed = grid.rows.filter(F.col(grid.axes[0]).isNotNull()).select("*", *grid.parts())
    entry = F.struct(F.col("__x").alias("x"), F.col("__y").alias("y"), *[F.col(c).alias(f) for f, c in fields.items()])
    out = asked
    for axis, bounds, name in zip(AXES, grid.bounds, ("on_x", "on_y", "on_z")):
        # a part with room for one value only is never cut by a limit that any of its rows meets
        alone = [p for p in range(1, len(bounds)) if math.nextafter(bounds[p - 1], math.inf) == bounds[p]]
        lists = placed.filter(F.col(axis).isNotNull() & ~F.col(axis).isin(alone)).groupBy(axis).agg(
            F.collect_list(entry).alias(name))
        out = out.join(F.broadcast(lists) if grid.small else lists, axis, "left")
        kind = lists.schema[name].dataType.simpleString()
        out = out.withColumn(name, F.coalesce(name, F.expr(f"CAST(array() AS {kind})")))
    return out.withColumns({
        "on_y": F.expr("filter(on_y, e -> e.x < __x)"), "on_z": F.expr("filter(on_z, e -> e.x < __x AND e.y < __y)")})


def staircase(rows: DataFrame, keys: list[str], x: str, y: str, ties: list[str]) -> DataFrame:
    """Rows that no other row of their group beats in ``x`` and ``y`` together, one of equal pairs (least by ``ties``)."""
    before = W.partitionBy(*keys).orderBy(x, y, *ties).rowsBetween(W.unboundedPreceding, -1)
    least = F.min(y).over(before)
    return rows.withColumn("__least", least).filter(F.col("__least").isNull() | (F.col(y) < F.col("__least"))).drop("__least")
