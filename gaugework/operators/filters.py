"""Predicates, memberships and name checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugework.functions.scalars import finite
from gaugework.session import small_side


def within_latency(df: DataFrame, max_ms: float | Column, column: str = "p95_latency_ms") -> DataFrame:
    return df.filter(F.col(column) <= max_ms)


def within_quality(df: DataFrame, min_score: float | Column) -> DataFrame:
    """Skipped when the table has no quality scores; a missing or NaN score does not pass."""
    return df.filter(finite("quality_score") >= min_score) if "quality_score" in df.columns else df


def within_budget(df: DataFrame, budget: float | Column) -> DataFrame:
    return df.filter(F.col("monthly_cost") <= budget)


def prefer_self_hosted(df: DataFrame, scope: list[str], wanted: str | None = None) -> DataFrame:
    """Only self-hosted rows, in each scope that has one; all rows in the others.

    With ``wanted``, scopes where that column is false keep all rows. Whether a scope has one is an aggregate of one row
    per scope; a scope of any size is never gathered.
    """
    own = small_side(df.filter("deployment_type = 'self_hosted'").select(*scope).distinct()).withColumn(
        "__own", F.lit(True))
    keep = F.col("__own").isNull() | (F.col("deployment_type") == "self_hosted")
    return (
        df.join(own, scope, "left")
        .filter(keep if wanted is None else ~F.col(wanted) | keep)
        .drop("__own")
    )


def members(df: DataFrame, models: list[str] | None = None, workloads: list[str] | None = None) -> DataFrame:
    """Rows of the named models and workloads; None keeps all."""
    if models is not None:
        df = df.filter(F.col("model_name").isin(*models))
    if workloads is not None and "workload" in df.columns:
        df = df.filter(F.col("workload").isin(*workloads))
    return df


def in_preset(df: DataFrame, presets: DataFrame, preset: str) -> DataFrame:
    return df.join(presets.filter(F.col("preset") == preset).select("model_name"), "model_name", "left_semi")


def api_backends(df: DataFrame) -> DataFrame:
    return df.filter(F.contains(F.coalesce(F.col("backend"), F.lit("")), F.lit("api")))


def realtime_pick(df: DataFrame, limit_ms: float = 200.0, tie: str = "request_id") -> DataFrame:
    """The fastest row below the limit, or one row that says there is none."""
    best = (
        df.filter(F.col("latency_ms") < limit_ms).orderBy("latency_ms", tie).limit(1)
        .select(F.lit(1).alias("__one"), "model_name", "batch_size", "latency_ms")
    )
    one = df.sparkSession.range(1).select(F.lit(1).alias("__one"))
    return one.join(best, "__one", "left").withColumn("advice", realtime_advice(limit_ms)).drop("__one")


def realtime_advice(limit_ms: float) -> Column:
    """What to say about ``model_name`` and ``batch_size`` of the fastest row, NULL if there is none."""
    return F.when(
        F.col("model_name").isNull(),
        F.format_string("No models meet <%sms latency requirement", F.lit(f"{limit_ms:g}")),
    ).otherwise(F.format_string("Use %s with batch_size=%d", "model_name", "batch_size"))


def question_prompts(df: DataFrame, per: list[str], order: str, limit: int | None = None,
                     prompt: str = "prompt") -> DataFrame:
    """Prompts with a question mark; with ``limit``, the first of each group by ``order``.

    Spark pushes the row-number limit below the shuffle, so a task sends at
    most ``limit`` rows of a group.
    """
    asked = df.filter(F.contains(prompt, F.lit("?")))
    if limit is None:
        return asked
    rank = F.row_number().over(W.partitionBy(*per).orderBy(order))
    return asked.withColumn("__rank", rank).filter(F.col("__rank") <= limit).drop("__rank")


def unknown_names(df: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """Rows whose name, in lower case, is not in the catalog column ``key``."""
    names = known.select(F.lower(key).alias("__name")).distinct()
    return df.withColumn("__name", F.lower(column)).join(names, "__name", "left_anti").drop("__name")


def resolve_names(df: DataFrame, column: str, known: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """Add the catalog columns for each name; unknown names raise an error or stay NULL."""
    catalog = known.withColumn("__name", F.lower(key))
    extra = [c for c in catalog.columns if c != "__name" and c not in df.columns]
    joined = df.withColumn("__name", F.lower(column)).join(
        catalog.select("__name", *extra, F.lit(True).alias("__found")), "__name", "left")
    if strict:
        message = F.concat(F.lit(f"Unknown {key}: '"), F.col("__name"), F.lit("'"))
        checked = F.when(F.col("__found"), F.col("__name")).otherwise(F.raise_error(message))
        joined = joined.withColumn(column, checked)
    return joined.drop("__name", "__found")
