"""Choosing a configuration: best rows, constrained selection, frontier picks, rules.

Constrained selection answers many requirement rows against one table of configurations through a grid (``dominance.py``):
what lies in parts that pass as a whole comes from one cumulative cell, and only the configurations in the parts that
the limits run through are compared one by one. All of it is joins, windows and aggregates; nothing is collected but the
cuts of the grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions.scalars import finite, half_even, safe_div, with_defaults
from gaugework.functions.steps import steps_passed
from gaugework.operators.dominance import (
    AXES, Grid, cumulative_cells, grid_over, staircase, with_strips)
from gaugework.operators.picks import first_by
from gaugework.operators.positions import with_position
from gaugework.session import materialise, small_side
from gaugework.sources.catalog import GOALS, NO_MATCH, REASONS

# Defaults of a configuration that lacks a column.
CONFIG_DEFAULTS = {"model_name": "unknown", "quantization": "fp16", "batch_size": 8,
                   "infrastructure": "g5.xlarge"}
METRIC_DEFAULTS = {"cost_per_1m_tok": 0.005, "quality_score": 0.90, "throughput": 50.0}
POINT_DEFAULTS = {"model_name": "unknown", "quantization": "unknown", "batch_size": 1,
                  "latency_ms": 0.0, "cost_per_1m_tok": 0.0, "throughput": 0.0, "quality_score": 0.0}


def best_row(df: DataFrame, metric: str, tie: str, largest: bool = False, keys: list[str] = ()) -> DataFrame:
    """The row with the smallest (or largest) metric, per group or overall; ties by ``tie``."""
    value = F.when(~F.isnan(F.col(metric).cast("double")), F.col(metric).cast("double"))
    value = -value if largest else value
    if keys:
        return first_by(df, list(keys), [value, tie])
    return df.filter(value.isNotNull()).orderBy(value, tie).limit(1)


def best_rows(df: DataFrame, findings: dict[str, tuple[str, bool]], tie: str) -> DataFrame:
    """Several overall best rows from one pass; ``findings`` maps a name to (metric, largest)."""
    row = F.struct(*df.columns)
    picks = []
    for name, (metric, largest) in findings.items():
        value = F.col(metric).cast("double")
        order = F.struct((-value if largest else value).alias("value"), F.col(tie).alias("tie"))
        picks.append(F.min_by(row, F.when(value.isNotNull() & ~F.isnan(value), order)).alias(name))
    named = F.array(*[F.struct(F.lit(name).alias("finding"), F.col(name).alias("row")) for name in findings])
    return (
        df.agg(*picks).select(F.explode(named).alias("f"))
        .filter("f.row IS NOT NULL").select("f.finding", "f.row.*")
    )


def fastest_model(requests: DataFrame) -> DataFrame:
    """The model with the lowest mean latency."""
    means = requests.groupBy("model_name").agg(F.avg("latency_ms").alias("mean_latency_ms"))
    return means.orderBy("mean_latency_ms", "model_name").limit(1)


# ---- constrained selection ---------------------------------------------------

_DETAILS = ["config_id", "model_name", "quantization", "batch_size", "infrastructure"]
_LIMITS = ["__kind", "__latency", "__quality", "__budget", "__volume", "__prefer"]
_FACTS = {"p95": "__p95", "worse": "__worse", "cost": "__cost", "speed": "__speed", "own": "__own",
          "id": "config_id", "c": "__c"}
_COUNTS = ["n_latency", "n_quality", "n_budget", "n_own"]
# What each goal looks for: the least of a value, ties by id. ``any`` stands for costs of a volume of 0.
_PICKS = {"near": "p95", "cheap": "cost", "fast": "-speed", "any": "0D"}


def _grid(configs: DataFrame, strip_rows: int | None) -> tuple[Grid, bool]:
    """The configurations, numbered and written, on a grid over latency, quality (the worse, the larger) and cost."""
    has_quality = "quality_score" in configs.columns
    rows = materialise(with_defaults(configs, CONFIG_DEFAULTS).select(
        F.monotonically_increasing_id().alias("__c"), *_DETAILS,
        F.coalesce(F.col("deployment_type") == "self_hosted", F.lit(False)).alias("__own"),
        finite("p95_latency_ms").alias("__p95"),
        (-finite("quality_score") if has_quality else F.lit(0.0)).alias("__worse"),
        finite("cost_per_1m_tok").alias("__cost"), finite("throughput").alias("__speed")), "configs")
    return grid_over(rows, ("__p95", "__worse", "__cost"), strip_rows), has_quality


def _asked(reqs: DataFrame, grid: Grid, has_quality: bool) -> DataFrame:
    """The requirement rows, numbered, with their limits and the part of each axis that these run through."""
    volume = F.col("monthly_tokens_millions").cast("double")
    error = F.raise_error(F.lit("a monthly volume is negative")).cast("double")
    rows = reqs.select(
        F.monotonically_increasing_id().alias("__row"), F.struct("*").alias("__req"),
        F.coalesce("workload_type", F.lit("")).alias("__kind"), finite("max_latency_p95_ms").alias("__latency"),
        (finite("min_quality_score") if has_quality else F.lit(0.0)).alias("__quality"),
        finite("monthly_budget_usd").alias("__budget"), F.when(volume < 0, error).otherwise(volume).alias("__volume"),
        F.coalesce("prefer_self_hosted", F.lit(False)).alias("__prefer"))
    tests = ("{} <= __latency", "{} <= -__quality", "{} * __volume <= __budget")
    return rows.select("*", *[steps_passed(b, t).alias(a) for a, b, t in zip(AXES, grid.bounds, tests)])


def _measures(picking: bool) -> dict[str, tuple[str, str]]:
    """What is wanted of the configurations within all limits: of every one, and of the self-hosted ones (``own_``)."""
    out = {"n_budget": ("sum", "1"), "n_own": ("sum", "if(__own, 1, 0)")}
    for prefix, test in (("", "true"), ("own_", "__own")) if picking else ():
        out |= {f"{prefix}top_{v}": ("max", f"if({test}, __{v}, NULL)") for v in ("p95", "cost")}
        for pick, value in _PICKS.items():
            value = value.replace("p95", "__p95").replace("cost", "__cost").replace("speed", "__speed")
            entry = f"named_struct('value', {value}, 'id', config_id, 'c', __c)"
            out[f"{prefix}{pick}"] = ("min", f"if({test} AND {value} IS NOT NULL, {entry}, NULL)")
    return out


def _counted(asked: DataFrame, grid: Grid, picking: bool) -> DataFrame:
    """Every requirement row with its counts and, with ``picking``, what its choice may need of the set it chooses from."""
    known = asked.join(cumulative_cells(grid, _measures(picking)), list(AXES), "left")
    lists = (
        with_strips(known, grid, _FACTS)
        .selectExpr("* EXCEPT (on_x)", "filter(on_x, e -> e.p95 <= __latency) AS fast_rows")
        .selectExpr("* EXCEPT (on_y)", "concat(filter(fast_rows, e -> e.worse <= -__quality),"
                    " filter(on_y, e -> e.worse <= -__quality)) AS good_rows")
        .selectExpr("* EXCEPT (on_z)", "filter(concat(good_rows, on_z), e -> e.cost * __volume <= __budget) AS paid_rows")
    )
    counts = [f"CAST(coalesce({cell}, 0) + size({rows}) AS LONG) AS {name}" for name, cell, rows in zip(
        _COUNTS, ("n_x", "n_xy", "n_budget", "n_own"),
        ("fast_rows", "good_rows", "paid_rows", "filter(paid_rows, e -> e.own)"))]
    ours = [c for c in asked.columns]
    if not picking:
        return lists.selectExpr(*ours, *counts)
    cells = [f"{p}{m}" for m in ("top_p95", "top_cost", *_PICKS) for p in ("", "own_")]
    chosen = lists.selectExpr(*ours, *counts, *cells, "paid_rows").selectExpr(
        "*", "__prefer AND n_own > 0 AS __use_own").selectExpr(
        "*", "if(__use_own, filter(paid_rows, e -> e.own), paid_rows) AS left_rows")
    of_set = {m: f"if(__use_own, own_{m}, {m})" for m in ("top_p95", "top_cost", *_PICKS)}
    tops = [f"greatest({of_set[f'top_{v}']}, array_max(transform(left_rows, e -> e.{v}))) AS top_{v}" for v in ("p95", "cost")]
    picks = []
    for pick, value in _PICKS.items():
        value = value if pick == "any" else value.replace(value.lstrip("-"), f"e.{value.lstrip('-')}")
        entry = f"if({value} IS NULL, NULL, named_struct('value', {value}, 'id', e.id, 'c', e.c))"
        picks.append(f"array_min(array_compact(array({of_set[pick]},"
                     f" array_min(array_compact(transform(left_rows, e -> {entry})))))) AS {pick}")
    return chosen.selectExpr(*ours, *_COUNTS, "__use_own", *tops, *picks)


def _balanced(chosen: DataFrame, grid: Grid) -> DataFrame:
    """(__row, __best): the least weighted score of latency and cost among the configurations within the limits.

    Of the parts that pass the quality limit as a whole only those can win which no other beats in latency and cost: a
    staircase per part and set. The part that the limit runs through is compared row by row.
    """
    ties, last = ["config_id", "__c"], len(grid.bounds[1])
    rows = grid.rows.select("__p95", "__worse", "__cost", "__own", *ties, grid.parts()[1]).dropna(
        subset=["__p95", "__worse", "__cost"])
    sets = rows.withColumn("__set", F.explode(F.when(F.col("__own"), F.array(F.lit(False), F.lit(True)))
                                              .otherwise(F.array(F.lit(False)))))
    own = staircase(sets, ["__set", "__y"], "__p95", "__cost", ties)
    above = own.filter(F.col("__y") < last).withColumn("__y", F.explode(F.sequence(F.col("__y") + 1, F.lit(last))))
    passing = staircase(above, ["__set", "__y"], "__p95", "__cost", ties).withColumn("__worse", F.lit(None).cast("double"))
    found = passing.unionByName(sets).select("__set", F.col("__y").alias("__part"), "__worse", "__p95", "__cost", *ties)
    within = (
        (F.col("__set") == F.col("__use_own")) & (F.col("__part") == F.col("__y"))
        & (F.col("__p95") <= F.col("__latency")) & (F.col("__cost") * F.col("__volume") <= F.col("__budget"))
        & (F.col("__worse").isNull() | (F.col("__worse") <= -F.col("__quality"))))
    score = (safe_div("__p95", "top_p95") * 0.6
             + safe_div(F.col("__cost") * F.col("__volume"), "top_cost") * 0.4).alias("value")
    wanted = chosen.filter((F.col("__kind") == "interactive_app") & (F.col("top_cost") > 0)).select(
        "__row", "__y", "__use_own", "__latency", "__quality", "__budget", "__volume", "top_p95", "top_cost")
    return wanted.join(found, within).groupBy("__row").agg(
        F.min(F.struct(score, F.col("config_id").alias("id"), F.col("__c").alias("c"))).alias("__best"))


def _picked(configs: DataFrame, reqs: DataFrame, strip_rows: int | None) -> tuple[DataFrame, Grid, bool]:
    """Every requirement row with its counts and ``__pick``: (objective, id, number of the configuration)."""
    grid, has_quality = _grid(configs, strip_rows)
    counted = _counted(_asked(reqs, grid, has_quality), grid, True)
    chosen = materialise(counted.withColumn("top_cost", F.col("top_cost") * F.col("__volume")), "chosen")

    def scaled(pick: str, value: Column) -> Column:
        entry = F.struct(value.alias("value"), F.col(f"{pick}.id").alias("id"), F.col(f"{pick}.c").alias("c"))
        return F.when(F.col(pick).isNotNull(), entry)

    costs = F.when(F.col("__volume") == 0, F.col("any")).otherwise(scaled("cheap", F.col("cheap.value") * F.col("__volume")))
    # without costs, the weighted score is that of the latency alone
    latency = scaled("near", safe_div("near.value", "top_p95") * 0.6)
    pick = (
        F.when(F.col("__kind") == "real_time_chat", F.col("near")).when(F.col("__kind") == "high_throughput", F.col("fast"))
        .when(F.col("__kind") == "interactive_app", F.when(F.col("top_cost") > 0, F.col("__best")).otherwise(latency))
        .otherwise(costs))
    joined = chosen.join(_balanced(chosen, grid), "__row", "left")
    return joined.select("__req", "__volume", *_COUNTS, pick.alias("__pick")), grid, has_quality


def select_configs(configs: DataFrame, reqs: DataFrame, strip_rows: int | None = None) -> DataFrame:
    """One recommendation per requirement row.

    Limits on p95 latency, quality (when known) and monthly cost are applied in
    this order; self-hosted rows are preferred where asked for and possible.
    Real-time chat takes the lowest latency, interactive apps the lowest
    0.6 * latency + 0.4 * cost (each relative to the largest left), high
    throughput the highest throughput, anything else the lowest cost. Ties go
    to the smallest ``config_id``; products and scores that differ by rounding
    alone are told apart by the costs and latencies behind them. Without a match
    the reason names the first limit that nothing met. A missing or NaN limit is
    met by nothing. ``strip_rows`` sets how fine the grid is, not the result.
    """
    picked, grid, has_quality = _picked(configs, reqs, strip_rows)
    details = grid.rows.select("__c", "__cost", *_DETAILS)
    details = F.broadcast(details) if grid.small else details
    found, none = F.col("__pick").isNotNull(), F.lit("N/A")
    fields = [F.col(f"__req.{c}").alias(c) for c in reqs.columns]
    monthly = F.col("__d.__cost") * F.col("__volume")
    return (
        picked.join(details.select(F.col("__c"), F.struct("*").alias("__d")), F.col("__pick.c") == F.col("__c"), "left")
        .withColumn("n_configs", F.lit(grid.n).cast("long"))
        .withColumn("reasoning", _reasoning(found, has_quality))
        .select(
            *fields, *_COUNTS[:3],
            F.col("__pick.id").alias("config_id"),
            F.when(found, F.col("__d.model_name")).otherwise("No match").alias("model_name"),
            F.when(found, F.col("__d.quantization")).otherwise(none).alias("quantization"),
            F.when(found, F.col("__d.batch_size")).otherwise(F.lit(0)).cast("int").alias("batch_size"),
            F.when(found, F.col("__d.infrastructure")).otherwise(none).alias("infrastructure"),
            F.coalesce(half_even(monthly, 2), F.lit(0.0)).alias("estimated_cost_monthly"),
            F.col("__pick.value").alias("objective"),
            found.alias("meets_requirements"),
            "reasoning",
        )
    )


def _reasoning(found: Column, has_quality: bool) -> Column:
    """The steps taken, or the first limit that nothing met."""
    steps = [F.format_string(
        REASONS["latency"], F.col("__req.max_latency_p95_ms").cast("string"), F.col("n_latency"), F.col("n_configs"))]
    if has_quality:
        steps.append(F.format_string(
            REASONS["quality"], F.format_number(F.col("__req.min_quality_score") * 100, 0), F.col("n_quality")))
    steps.append(F.format_string(REASONS["budget"], F.format_number("__req.monthly_budget_usd", 0), F.col("n_budget")))
    steps.append(F.when(F.col("__req.prefer_self_hosted") & (F.col("n_own") > 0), REASONS["self_hosted"]))
    goal = F.lit(REASONS["default"])
    for kind, text in GOALS.items():
        goal = F.when(F.col("__req.workload_type") == kind, text).otherwise(goal)
    steps.append(goal)
    return F.when(found, F.array_compact(F.array(*steps))).otherwise(
        F.array(no_match_reason(), F.lit(NO_MATCH["hint"])))


def no_match_reason() -> Column:
    return (
        F.when(F.col("n_latency") == 0, NO_MATCH["latency"])
        .when(F.col("n_quality") == 0, NO_MATCH["quality"])
        .otherwise(NO_MATCH["budget"]))


def constraint_funnel(configs: DataFrame, reqs: DataFrame, strip_rows: int | None = None) -> DataFrame:
    """How many configurations are left after each limit, per requirement row."""
    grid, has_quality = _grid(configs, strip_rows)
    counted = _counted(_asked(reqs, grid, has_quality), grid, False)
    return counted.select("__req.*", *_COUNTS[:3]).withColumn("n_configs", F.lit(grid.n).cast("long"))


def weighted_score(df: DataFrame, scope: list[str], latency_weight: float = 0.6) -> DataFrame:
    """Latency and monthly cost relative to the largest of the scope, as one score.

    The maxima are aggregates joined back, one row per scope.
    """
    tops = small_side(df.groupBy(*scope).agg(
        F.max("p95_latency_ms").alias("__p95"), F.max("monthly_cost").alias("__cost")))
    return (
        df.join(tops, scope)
        .withColumn("score", safe_div("p95_latency_ms", "__p95") * latency_weight
                    + safe_div("monthly_cost", "__cost") * (1 - latency_weight))
        .drop("__p95", "__cost")
    )


# ---- frontier ----------------------------------------------------------------

def frontier_only(flagged: DataFrame, flag: str = "is_pareto_optimal") -> DataFrame:
    return flagged.filter(F.col(flag))


def dominated_only(flagged: DataFrame, flag: str = "is_pareto_optimal") -> DataFrame:
    return flagged.filter(~F.col(flag))


def frontier_line(flagged: DataFrame, x: str = "cost_per_1m_tok", y: str = "p95_latency_ms",
                  tie: str = "config_id") -> DataFrame:
    """Frontier rows in the order of a line along ``x``."""
    return frontier_only(flagged).select(tie, x, y).orderBy(x, tie)


def frontier_export(flagged: DataFrame) -> DataFrame:
    """The flagged points with a ``config`` struct flattened and absent columns defaulted."""
    if "config" in flagged.columns:
        flagged = flagged.select(*[c for c in flagged.columns if c != "config"], "config.*")
    return with_defaults(flagged, POINT_DEFAULTS).select(
        "model_name", "quantization", "batch_size", "latency_ms", "cost_per_1m_tok", "throughput",
        "quality_score", "is_pareto_optimal")


def positional_ranks(df: DataFrame, tie: str = "config_id") -> DataFrame:
    """Zero-based place by latency, by cost and by throughput (best first), and their mean.

    ``df`` is written once; each step after that reads what the one before it has written.
    """
    df = materialise(df, "ranked")
    for out, order in (("latency_rank", F.col("latency_ms")), ("cost_rank", F.col("cost_per_1m_tok")),
                       ("throughput_rank", -F.col("throughput"))):
        df = with_position(df, [order, F.col(tie)], out)
    return df.withColumn(
        "avg_rank", (F.col("latency_rank") + F.col("cost_rank") + F.col("throughput_rank")) / 3)


def recommend_by_priority(flagged: DataFrame, priority: str = "cost", tie: str = "config_id") -> DataFrame:
    """The frontier row for a priority; no frontier, no row."""
    front = frontier_only(flagged)
    if priority == "balanced":
        return best_row(positional_ranks(front, tie), "avg_rank", tie)
    metric = {"cost": "cost_per_1m_tok", "latency": "latency_ms", "throughput": "throughput"}.get(priority)
    if metric is None:
        raise ValueError(f"Unknown priority: {priority}")
    return best_row(front, metric, tie, largest=priority == "throughput")


# ---- rules -------------------------------------------------------------------

def deployment_strategy(reqs: DataFrame, tight_budget: float = 5000.0) -> DataFrame:
    """Rule of thumb per requirement set: volume first, then latency, then budget."""
    return reqs.withColumn(
        "strategy",
        F.when(F.col("monthly_tokens_millions") < 10, "api")
        .when(F.col("max_latency_p95_ms") < 200, "small_model_gpu")
        .when(F.col("monthly_budget_usd") < tight_budget, "llama-2-7b int8")
        .otherwise("llama-2-13b or mistral-7b"))
