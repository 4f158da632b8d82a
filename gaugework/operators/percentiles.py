"""Exact, linearly interpolated percentiles for groups of any size, with sums from the same pass.

The built-in ``percentile`` keeps a value-to-count map of a whole group in one task, and one model can own a third of
the log. So order statistics are located by counting, at every size, and the input is read twice:

1. count rows per (group, coarse bucket), together with whatever else is wanted of a group (``extras``). Map-side
   combine leaves a few thousand rows per group, which are written; sums and means roll up from them, and a running
   sum names the buckets that hold the wanted ranks. Missing values form a bucket without weight, so that a group
   without any value still has its row;
2. only rows of those buckets are kept and counted per (group, value). The shuffle key contains the value, so a hot
   group spreads over all reducers;
3. the running sum over the distinct values of one bucket gives the values. If a bucket itself is large (values crowd
   around one point), a second running sum over about a million fine buckets comes first.

No step gathers a group. Several columns are handled together by unpivoting them first. Groups with a NULL key are
dropped, NULL and NaN values skipped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugework.functions.buckets import coarse_bucket, fine_bucket
from gaugework.functions.scalars import finite
from gaugework.session import BROADCAST_ROWS, materialise

_METRIC, _VALUE, _WEIGHT = "__metric", "__value", "__weight"
BUCKET_ROWS = 5_000_000  # a bucket up to this size is sorted in one task


ROLLUPS = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def grouped_percentiles(
    df: DataFrame,
    keys: list[str],
    outputs: dict[str, tuple[str, float]],
    extras: dict[str, tuple[str, Column]] | None = None,
    bucket_rows: int = BUCKET_ROWS,
    weight: str | None = None,
) -> DataFrame:
    """One row per group of ``keys``.

    ``outputs`` maps a result name to (column, fraction), ``extras`` a result name to ("sum", "count", "min" or "max",
    expression over the rows of ``df``). A row counts as often as the whole number in ``weight`` says, once without one.
    """
    extras = extras or {}
    columns = list(dict.fromkeys(column for column, _ in outputs.values()))
    more = {f"__x{i}": (kind, value, name) for i, (name, (kind, value)) in enumerate(extras.items())}
    weights = [] if weight is None else [F.col(weight).alias(_WEIGHT)]
    slim = df.select(
        *keys, *weights, *[finite(c).alias(c) for c in columns], *[v.alias(x) for x, (_, v, _) in more.items()])
    for k in keys:
        slim = slim.filter(F.col(k).isNotNull())
    if len(columns) == 1:
        long = slim.withColumns({_METRIC: F.lit(columns[0]), _VALUE: F.col(columns[0])}).drop(*columns)
    else:
        ids = [*keys, *more, *([] if weight is None else [_WEIGHT])]
        long = slim.unpivot([F.col(c) for c in ids], columns, _METRIC, _VALUE)
    long = long.withColumn("__b1", coarse_bucket(F.col(_VALUE)))
    counted = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    buckets = materialise(
        long.groupBy(*keys, _METRIC, "__b1").agg(
            _rows(weight).alias("__n"), F.min(_VALUE).alias("__lo"), F.max(_VALUE).alias("__hi"),
            *[counted[kind](x).alias(x) for x, (kind, _, _) in more.items()]),
        "percentile-buckets",
    )
    totals = buckets.filter(F.col(_METRIC) == columns[0]).groupBy(*keys, F.lit(1).alias("__one")).agg(
        *[ROLLUPS[kind](x).alias(name) for x, (kind, _, name) in more.items()], F.max("__n").alias("__any"))
    ranks = _by_counting(long.drop(*more), buckets.drop(*more), keys, outputs, bucket_rows, weight)
    return totals.join(ranks.withColumn("__one", F.lit(1)), [*keys, "__one"], "left").select(
        *keys, *outputs, *extras)


def _rows(weight: str | None) -> Column:
    """How many rows have a value."""
    if weight is None:
        return F.count(_VALUE)
    return F.coalesce(F.sum(F.when(F.col(_VALUE).isNotNull(), F.col(_WEIGHT))), F.lit(0)).cast("long")


def mean_of(extra_sum: str, extra_count: str) -> Column:
    """A mean from two extras; NULL without a value. Rounding takes off what the order of addition left."""
    return F.round(extra_sum, 9) / F.nullif(F.col(extra_count), F.lit(0))


def _rank_ends(total: Column, p: float) -> tuple[Column, Column]:
    position = F.lit(float(p)) * (total - 1)
    return F.floor(position).cast("long"), F.ceil(position).cast("long")


def _holds_rank(outputs: dict[str, tuple[str, float]]) -> Column:
    """Does the rank range [__before, __upto) of this row hold a wanted rank?"""
    before, upto, total = F.col("__before"), F.col("__upto"), F.col("__total")
    tests = [
        (F.col(_METRIC) == column) & (rank >= before) & (rank < upto)
        for column, p in outputs.values()
        for rank in _rank_ends(total, p)
    ]
    return reduce(lambda a, b: a | b, tests)


def _by_counting(long: DataFrame, buckets: DataFrame, keys: list[str], outputs: dict[str, tuple[str, float]],
                 bucket_rows: int, weight: str | None = None) -> DataFrame:
    group = [*keys, _METRIC]
    long = long.filter(F.col(_VALUE).isNotNull())
    hits = (
        buckets.filter("__n > 0")
        .withColumn("__upto", F.sum("__n").over(W.partitionBy(*group).orderBy("__b1")))
        .withColumn("__before", F.col("__upto") - F.col("__n"))
        .withColumn("__total", F.sum("__n").over(W.partitionBy(*group)))
        .filter(_holds_rank(outputs)).drop("__upto")
    )
    found = hits.agg(F.count(F.lit(1)).alias("rows"), F.max("__n").alias("largest")).first()

    small_side = F.broadcast(hits) if found["rows"] <= BROADCAST_ROWS else hits
    place = [*group, "__b1"]
    values = (
        long.join(small_side.drop("__n"), place)
        .groupBy(*place, _VALUE)
        .agg(_rows(weight).alias("__n"),
             *[F.first(c).alias(c) for c in ("__lo", "__hi", "__before", "__total")])
    )
    if (found["largest"] or 0) > bucket_rows:
        values = materialise(
            values.withColumn("__b2", fine_bucket(F.col(_VALUE), F.col("__lo"), F.col("__hi"))),
            "percentile-values",
        )
        fine = (
            values.groupBy(*place, "__b2")
            .agg(F.sum("__n").alias("__n"), F.first("__before").alias("__before"),
                 F.first("__total").alias("__total"))
            .withColumn("__upto", F.col("__before")
                        + F.sum("__n").over(W.partitionBy(*place).orderBy("__b2")))
            .withColumn("__before", F.col("__upto") - F.col("__n"))
            .filter(_holds_rank(outputs))
            .select(*place, "__b2", "__before")
        )
        place = [*place, "__b2"]
        values = values.drop("__before").join(fine, place)

    picked = (
        values.withColumn("__upto", F.col("__before")
                          + F.sum("__n").over(W.partitionBy(*place).orderBy(_VALUE)))
        .withColumn("__before", F.col("__upto") - F.col("__n"))
    )
    total = F.col("__total")
    aggs = []
    for name, (column, p) in outputs.items():
        mine = F.col(_METRIC) == column
        low, high = _rank_ends(total, p)
        lower, upper = [
            F.max(F.when(mine & (r >= F.col("__before")) & (r < F.col("__upto")), F.col(_VALUE)))
            for r in (low, high)
        ]
        part = F.max(F.when(mine, F.lit(float(p)) * (total - 1) - low))
        aggs.append((lower + (upper - lower) * part).alias(name))
    return picked.groupBy(*keys).agg(*aggs)


def percentile_columns(column: str, percentiles: list[int], prefix: str = "p") -> dict[str, tuple[str, float]]:
    """``{"p50": (column, 0.5), ...}`` for a list of whole percents."""
    return {f"{prefix}{p}": (column, p / 100.0) for p in percentiles}
