"""Order statistics of counted values: the value at a rank, located by counting.

Input are rows (group, value, how often). Sums per order-preserving bucket tell in which bucket a rank lies; only the
values of such buckets are looked at again, and where they are very many, finer buckets come in between. So no task holds
the values of a group. The value is one that occurs: the smallest up to which ``fraction`` of the rows lie.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugework.functions.buckets import STEPS_PER_OCTAVE, coarse_bucket, fine_bucket
from gaugework.operators.percentiles import BUCKET_ROWS
from gaugework.session import materialise


def needed(total: Column, fraction: float) -> Column:
    """The rank, from 1, that ``fraction`` of the rows reach."""
    return F.greatest(F.ceil(F.lit(float(fraction)) * total), F.lit(1)).cast("long")


def holds_rank(fractions: list[float]) -> Column:
    """Does a wanted rank lie in (__before, __upto]?"""
    ranks = [needed(F.col("__total"), f) for f in fractions]
    return reduce(lambda a, b: a | b, [(r > F.col("__before")) & (r <= F.col("__upto")) for r in ranks])


def running(df: DataFrame, keys: list[str], order: str, start: str | None = None) -> DataFrame:
    """__before and __upto: the rows of a group before and up to each entry; ``start`` names what lies before all of them."""
    upto = F.sum("__n").over(W.partitionBy(*keys).orderBy(order))
    upto = upto + F.col(start) if start else upto
    return df.withColumn("__upto", upto).withColumn("__before", F.col("__upto") - F.col("__n"))


def wanted_buckets(buckets: DataFrame, keys: list[str], fractions: list[float]) -> DataFrame:
    """Of rows (keys, __bucket, __n, __low, __high, __rows) those that hold a rank, with __before and __total.

    A group has as many buckets as its values have distinct leading bits, some thousands, however many its rows.
    """
    whole = buckets.filter("__bucket IS NOT NULL").withColumn("__total", F.sum("__n").over(W.partitionBy(*keys)))
    return running(whole, keys, "__bucket").filter(holds_rank(fractions)).drop("__upto")


def values_at_ranks(values: DataFrame, keys: list[str], outputs: dict[str, float], largest: int,
                    bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per group: the values at the ranks of ``outputs``.

    ``values`` are the values of wanted buckets only: keys, __bucket, __value, __n and the bucket's __before, __total, __low
    and __high. ``largest`` is the number of values in the largest bucket.
    """
    fractions, place = list(outputs.values()), [*keys, "__bucket"]
    if largest > bucket_rows:
        values = materialise(
            values.withColumn("__fine", fine_bucket(F.col("__value"), F.col("__low"), F.col("__high"))), "rank-values")
        fine = values.groupBy(*place, "__fine").agg(
            F.sum("__n").alias("__n"), F.first("__before").alias("__start"), F.first("__total").alias("__total"))
        fine = running(fine, place, "__fine", "__start").filter(holds_rank(fractions)).select(
            *[F.col(p).alias(f"__k{i}") for i, p in enumerate(place)], F.col("__fine").alias("__kf"),
            F.col("__before").alias("__start"))
        same = reduce(lambda a, b: a & b, [values[p].eqNullSafe(F.col(f"__k{i}")) for i, p in enumerate(place)])
        values = values.join(fine, same & (values["__fine"] == F.col("__kf")))
        place = [*place, "__fine"]
    else:
        values = values.withColumn("__start", F.col("__before"))
    ranked = running(values.drop("__before"), place, "__value", "__start")
    return ranked.groupBy(*keys).agg(*[
        F.max(F.when((needed(F.col("__total"), f) > F.col("__before")) & (needed(F.col("__total"), f) <= F.col("__upto")),
                     F.col("__value"))).alias(name)
        for name, f in outputs.items()])


def bucketed(df: DataFrame, value: str, steps: int = STEPS_PER_OCTAVE) -> DataFrame:
    """Adds __bucket: NULL for a missing value."""
    return df.withColumn("__bucket", F.when(F.col(value).isNotNull(), coarse_bucket(F.col(value), steps)))
