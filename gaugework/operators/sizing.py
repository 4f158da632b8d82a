"""Memory of a model and its cache, and the machine size for a load."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.functions.scalars import BYTES_PER_GIB, half_even, parameters_billion, safe_div
from gaugework.operators.bands import with_bands
from gaugework.sources.catalog import BYTES_PER_PARAM, KV_CACHES, LOAD_TIERS, QUANTIZATIONS

OVERHEAD = 1.2  # room for cache and activations


def at_each_quantization(models: DataFrame, levels: list[tuple] = QUANTIZATIONS) -> DataFrame:
    """One row per model and quantisation level; the levels are a fixed list."""
    options = F.array(*[
        F.struct(F.lit(key).alias("quantization"), F.lit(label).alias("label"),
                 F.lit(dtype).alias("dtype"), F.lit(float(factor)).alias("memory_reduction"),
                 F.lit(float(loss)).alias("expected_quality_loss"))
        for key, label, dtype, factor, loss in levels])
    keep = [c for c in models.columns if c not in
            ("quantization", "label", "dtype", "memory_reduction", "expected_quality_loss")]
    return models.withColumn("__q", F.explode(options)).select(*keep, "__q.*")


def memory_estimate(df: DataFrame) -> DataFrame:
    """Memory from ``parameters`` ("7B") and ``dtype``; NULL when the size is not a number."""
    bytes_per = reduce(
        lambda chain, item: chain.when(F.col("dtype") == item[0], item[1]),
        list(BYTES_PER_PARAM.items())[1:],
        F.when(F.col("dtype") == list(BYTES_PER_PARAM)[0], list(BYTES_PER_PARAM.values())[0]),
    ).otherwise(2.0)
    raw = F.col("params_billion") * 1e9 * F.col("bytes_per_param") / BYTES_PER_GIB
    return (
        df.withColumns({"params_billion": parameters_billion("parameters"), "bytes_per_param": bytes_per})
        .withColumns({"param_memory_gb": half_even(raw, 2), "total_memory_gb": half_even(raw * OVERHEAD, 2)})
    )


def memory_vs_fp16(estimates: DataFrame, model: str = "model_name") -> DataFrame:
    """Memory in percent of the same model at fp16.

    The baseline is one row per model, so it is joined; a window would sort all
    levels of a model for it.
    """
    base = estimates.filter("quantization = 'fp16'").groupBy(model).agg(
        F.max("total_memory_gb").alias("fp16_memory_gb"))
    return estimates.join(base, model, "left").withColumn(
        "pct_of_fp16", F.when(F.col("fp16_memory_gb").isNotNull(),
                              safe_div("total_memory_gb", "fp16_memory_gb") * 100))


def kv_cache_estimate(df: DataFrame, caches: list[tuple] = KV_CACHES, pct_digits: int = 1) -> DataFrame:
    """One row per cache setting: room left for the cache beside the model weights, NULL if these are unknown."""
    options = F.array(*[
        F.struct(F.lit(c[0]).alias("cache"), F.lit(float(c[1])).alias("gpu_memory_utilization"))
        for c in caches])
    spread = df.withColumn("__k", F.explode(options)).select(*df.columns, "__k.*")
    reserved = F.col("gpu_memory_gb") * F.col("gpu_memory_utilization")
    room = F.when(F.col("model_memory_gb").isNotNull(),
                  F.greatest(reserved - F.col("model_memory_gb"), F.lit(0.0)))
    return spread.withColumns({
        "reserved_gb": half_even(reserved, 2),
        "kv_cache_gb": half_even(room, 2),
        "kv_cache_pct": half_even(F.when(F.col("gpu_memory_gb") > 0, room / F.col("gpu_memory_gb")) * 100, pct_digits),
    })


def load_tier(df: DataFrame, rate: str = "requests_per_second", tiers: DataFrame | list[tuple] = LOAD_TIERS) -> DataFrame:
    """The GPU tier whose load band holds the rate.

    ``tiers`` is a table with ``low``, ``high``, ``tier``, ``instance`` and ``usd_per_hour``, or such rows; see ``with_bands``
    for rates in a gap or in several bands.
    """
    if not isinstance(tiers, DataFrame):
        tiers = df.sparkSession.createDataFrame(
            [tuple(t) for t in tiers], "low double, high double, tier string, instance string, usd_per_hour double")
    return with_bands(df, rate, tiers)
