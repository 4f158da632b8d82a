"""The content of the benchmark report, as one long table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.functions.scalars import finite, half_even
from gaugework.operators.filters import realtime_advice
from gaugework.operators.percentiles import grouped_percentiles
from gaugework.session import materialise


def _section(df: DataFrame, section: str, key, metrics: list[str]) -> DataFrame:
    """Rows (section, key, metric, value) from one row per key."""
    return (
        df.select(key.alias("key"), *[F.col(m).cast("double").alias(m) for m in metrics])
        .unpivot(["key"], metrics, "metric", "value")
        .select(F.lit(section).alias("section"), "key", "metric", "value")
    )


def report_tables(results: DataFrame, digits: int = 2, tie: str = "request_id", limit_ms: float = 200.0,
                  monthly_millions: float = 100.0, **kwargs) -> DataFrame:
    """Overview, key findings, performance, cost and advice as (section, key, metric, value).

    ``results`` are request rows; the cost sections need ``cost_per_1m_tok``
    and the throughput finding ``throughput``. Apart from the percentiles, the
    log is read once, into one row per model and workload that all sections share.
    """
    optional = [c for c in ("cost_per_1m_tok", "throughput") if c in results.columns]
    latency = finite("latency_ms")
    who = [F.col(tie).alias("tie"), F.col("model_name").alias("model_name"),
           F.col("batch_size").alias("batch_size")]

    def least(value, keep=None):
        keep = value.isNotNull() if keep is None else keep
        return F.min(F.when(keep, F.struct(value.alias("value"), *who)))

    finding = {"latency_ms": least(latency)}
    if "cost_per_1m_tok" in optional:
        finding["cost_per_1m_tok"] = least(finite("cost_per_1m_tok"))
    if "throughput" in optional:
        finding["throughput"] = least(-finite("throughput"))
    base = materialise(
        results.groupBy("model_name", "workload").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(latency).alias("latency_sum"), F.count(latency).alias("latency_n"),
            F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
            least(latency, latency < limit_ms).alias("chat"),
            *[F.sum(finite(c)).alias("cost_sum") for c in optional if c == "cost_per_1m_tok"],
            *[F.count(finite(c)).alias("cost_n") for c in optional if c == "cost_per_1m_tok"],
            *[expr.alias(f"best_{name}") for name, expr in finding.items()],
        ), "report")

    overview = base.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_samples"),
        F.count_distinct("model_name").alias("models_tested"),
        F.count_distinct("workload").alias("workload_types"))
    parts = [_section(overview, "overview", F.lit("all"), ["total_samples", "models_tested", "workload_types"])]
    for name in finding:
        best = base.agg(F.min(f"best_{name}").alias("b")).filter("b IS NOT NULL").select(
            "b.model_name", (F.col("b.value") * (-1 if name == "throughput" else 1)).alias(name))
        parts.append(_section(best, "findings", F.col("model_name"), [name]))

    known = base.filter("model_name IS NOT NULL").groupBy("model_name")
    ranks = grouped_percentiles(results, ["model_name"], {"p95": ("latency_ms", 0.95)}, **kwargs)
    performance = known.agg(
        (F.sum("latency_sum") / F.nullif(F.sum("latency_n"), F.lit(0))).alias("mean"),
        F.sum("total_tokens").alias("total_tokens"),
    ).join(ranks, "model_name", "left").select(
        "model_name", half_even("mean", digits).alias("latency_ms_mean"),
        half_even("p95", digits).alias("latency_ms_p95"), "total_tokens")
    parts.append(_section(performance, "performance", F.col("model_name"),
                          ["latency_ms_mean", "latency_ms_p95", "total_tokens"]))
    if "cost_per_1m_tok" in optional:
        costs = known.agg(
            (F.sum("cost_sum") / F.nullif(F.sum("cost_n"), F.lit(0))).alias("mean_cost_per_1m_tok")
        ).withColumn("monthly_cost", F.col("mean_cost_per_1m_tok") * monthly_millions)
        parts.append(_section(costs, "cost", F.col("model_name"), ["mean_cost_per_1m_tok", "monthly_cost"]))

    chat = base.agg(F.min("chat").alias("c")).select(
        "c.model_name", "c.batch_size", F.col("c.value").alias("latency_ms")
    ).withColumn("advice", realtime_advice(limit_ms))
    parts.append(_section(chat, "advice_realtime", F.col("advice"), ["latency_ms"]))

    if "cost_per_1m_tok" in optional:
        cheapest = base.agg(F.min("best_cost_per_1m_tok").alias("b")).filter("b IS NOT NULL").select(
            F.format_string("Use %s", "b.model_name").alias("advice"), F.col("b.value").alias("cost_per_1m_tok"))
        parts.append(_section(cheapest, "advice_batch", F.col("advice"), ["cost_per_1m_tok"]))

    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
