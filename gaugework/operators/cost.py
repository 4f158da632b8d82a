"""Prices, monthly cost, savings and break-even volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions.scalars import half_even, or_zero, safe_div
from gaugework.sources.catalog import COST_SCENARIOS

HOURS_PER_MONTH = 730
_BREAKDOWN = ["infrastructure_cost", "api_cost", "engineering_cost", "power_cost", "total_monthly_cost"]


def cost_projection(df: DataFrame) -> DataFrame:
    """API, infrastructure and total cost of a run, and the cost per million tokens.

    Needs input_tokens, output_tokens, duration_seconds, cost_per_hour and the
    two prices per million tokens; missing prices count as 0.
    """
    api = (F.col("input_tokens") / 1e6 * or_zero("cost_per_1m_tokens_input")
           + F.col("output_tokens") / 1e6 * or_zero("cost_per_1m_tokens_output"))
    infra = F.col("duration_seconds") / 3600 * or_zero("cost_per_hour")
    return (
        df.withColumns({"api_cost_usd": api, "infrastructure_cost_usd": infra})
        .withColumn("total_cost_usd", F.col("api_cost_usd") + F.col("infrastructure_cost_usd"))
        .withColumn("cost_per_1m_tok",
                    safe_div("total_cost_usd", F.col("input_tokens") + F.col("output_tokens")) * 1e6)
    )


def with_prices(df: DataFrame, models: DataFrame) -> DataFrame:
    """Left join with the model catalog; its size is left to Spark to judge."""
    prices = models.select("model_name", "deployment_type", "cost_per_hour",
                           "cost_per_1m_tokens_input", "cost_per_1m_tokens_output")
    return df.join(prices, "model_name", "left")


def request_cost(requests: DataFrame, models: DataFrame) -> DataFrame:
    """Cost of each request; its latency is the time it holds the machine."""
    timed = requests.withColumn("duration_seconds", F.col("latency_ms") / 1000)
    return cost_projection(with_prices(timed, models))


def monthly_cost(df: DataFrame) -> DataFrame:
    """Monthly cost of a cost model for its input and output volume in millions of tokens."""
    infra = F.col("gpu_hourly_rate") * F.col("gpu_utilization") * HOURS_PER_MONTH
    api = (F.col("input_millions") * F.col("cost_per_1m_input_tokens")
           + F.col("output_millions") * F.col("cost_per_1m_output_tokens"))
    total = infra + api + F.col("engineering_monthly") + F.col("power_monthly")
    return df.withColumns({
        "infrastructure_cost": half_even(infra, 2),
        "api_cost": half_even(api, 2),
        "engineering_cost": half_even("engineering_monthly", 2),
        "power_cost": half_even("power_monthly", 2),
        "total_monthly_cost": half_even(total, 2),
    })


def tco_savings(costs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Savings of an optimised over a baseline cost model, from their rounded monthly totals.

    ``costs`` is the result of ``monthly_cost``; ``pairs`` has ``baseline_id`` and ``optimized_id``, each pair once. Both
    breakdowns come along. Where an id has several cost models, each of them is compared.
    """
    def side(name: str) -> DataFrame:
        return costs.select(
            F.col("cost_model_id").alias(f"{name}_id"),
            F.col("model_name").alias(f"{name}_model"),
            F.struct(*_BREAKDOWN).alias(f"{name}_breakdown"))

    before = F.col("baseline_breakdown.total_monthly_cost")
    after = F.col("optimized_breakdown.total_monthly_cost")
    return (
        pairs.join(side("baseline"), "baseline_id").join(side("optimized"), "optimized_id")
        .withColumns({
            "baseline_monthly": before,
            "optimized_monthly": after,
            "monthly_savings": half_even(before - after, 2),
            "annual_savings": half_even((before - after) * 12, 2),
            "savings_pct": half_even(safe_div(before - after, before) * 100, 1),
        })
    )


def volume_cost(df: DataFrame, millions: Column | str, out: str = "monthly_cost") -> DataFrame:
    """Monthly cost from the price per million tokens and a volume in millions."""
    volume = F.col(millions) if isinstance(millions, str) else millions
    return df.withColumn(out, F.col("cost_per_1m_tok") * volume)


def frontier_savings(pairs: DataFrame, monthly_tokens_millions: float = 100.0) -> DataFrame:
    """Savings from ``baseline_cost_per_1m_tok`` to ``optimized_cost_per_1m_tok``."""
    millions = F.lit(float(monthly_tokens_millions))
    before = F.col("baseline_cost_per_1m_tok") * millions
    after = F.col("optimized_cost_per_1m_tok") * millions
    return pairs.withColumns({
        "baseline_monthly_usd": half_even(before, 2),
        "optimized_monthly_usd": half_even(after, 2),
        "savings_monthly_usd": half_even(before - after, 2),
        "savings_pct": half_even(safe_div(before - after, before) * 100, 1),
        "monthly_tokens_millions": millions,
        "payback_period_months": F.lit(0),
    })


def cost_scenarios(df: DataFrame, rate: str = "gpu_hourly_rate",
                   scenarios: list[tuple[str, float]] = COST_SCENARIOS) -> DataFrame:
    """One row per purchase option, with the discounted hourly rate."""
    options = F.array(*[
        F.struct(F.lit(name).alias("scenario"), F.lit(float(cut)).alias("discount"))
        for name, cut in scenarios])
    return (
        df.withColumn("__s", F.explode(options))
        .select(*df.columns, "__s.scenario", "__s.discount")
        .withColumn("scenario_rate", F.col(rate) * (1 - F.col("discount")))
    )


def break_even(df: DataFrame, fixed_monthly: Column | str, api_per_1m: Column | str) -> DataFrame:
    """Volume in millions of tokens at which an API costs as much as the fixed monthly cost.

    NULL when the API is free: there is no such volume.
    """
    fixed = F.col(fixed_monthly) if isinstance(fixed_monthly, str) else fixed_monthly
    price = F.col(api_per_1m) if isinstance(api_per_1m, str) else api_per_1m
    return df.withColumn("break_even_millions", F.when(price > 0, fixed / price))
