"""The logical tables of the engine, derived from the given parquet tables.

Each function reads one folder of tables and renames or computes columns; no
row is dropped or added unless the docstring says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.sources.catalog import BATCH_SIZES, MODEL_NAMES, MODELS, QUANTIZATIONS

QUANT_KEYS = [q[0] for q in QUANTIZATIONS]
BACKENDS = [m[1] for m in MODELS]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choose(values: list, number) -> F.Column:
    """The value at ``number`` modulo the list length."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request log, one row per event."""
    return shape_requests(read(spark, sf_dir, "events"))


def shape_requests(events: DataFrame) -> DataFrame:
    """Request columns from event columns; works on batch and streaming frames."""
    k = F.get_json_object("props", "$.k").cast("long")
    e2e = F.col("value") / 1000
    ts = F.col("ts").cast("timestamp")
    return events.select(
        F.col("event_id").alias("request_id"),
        "user_id",
        ts.alias("ts"),
        F.date_format(ts, "yyyyMMdd").alias("run_id"),
        choose(MODEL_NAMES, F.col("user_id")).alias("model_name"),
        choose(BACKENDS, F.col("user_id")).alias("backend"),
        choose(QUANT_KEYS, F.col("event_id")).alias("quantization"),
        F.col("event_type").alias("workload"),
        choose(BATCH_SIZES, F.col("event_id")).cast("int").alias("batch_size"),
        (F.col("event_type") == "error").alias("is_error"),
        F.col("value").alias("latency_ms"),
        (F.col("value") * 0.25).alias("ttft_ms"),
        (e2e * 0.25).alias("ttft_s"),
        F.when(k % 3 == 0, F.array().cast("array<double>"))
        .otherwise(F.array(e2e * 0.5, e2e * 0.125)).alias("itl_s"),
        e2e.alias("e2e_s"),
        F.when(F.col("event_id") % 4 != 0, k / 1000).alias("queue_s"),
        (F.col("event_id") % 200 + 1).alias("input_tokens"),
        (k + 1).alias("output_tokens"),
    )


def resource_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_resources(read(spark, sf_dir, "events"))


def shape_resources(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    ts = F.col("ts").cast("timestamp")
    return events.select(
        F.col("event_id").alias("sample_id"),
        F.date_format(ts, "yyyyMMdd").alias("run_id"),
        (k * 240).alias("gpu_memory_used_mb"),
        F.when(F.col("user_id") % 7 == 0, F.lit(0.0)).otherwise(F.lit(24000.0)).alias("gpu_memory_total_mb"),
        k.alias("gpu_utilization_percent"),
        (100 - k).alias("cpu_percent"),
        F.least(F.col("value") / 10, F.lit(64.0)).alias("ram_used_gb"),
        F.lit(64.0).alias("ram_total_gb"),
        ts.alias("ts"),
    )


def benchmark_runs(spark: SparkSession, sf_dir: str, finished: bool = False) -> DataFrame:
    """Runs of the store: the orders; with ``finished`` only those that are not pending."""
    orders = read(spark, sf_dir, "orders")
    return (orders.filter("o_orderstatus <> 'P'") if finished else orders).select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_id"),
        choose(MODEL_NAMES, F.col("o_custkey")).alias("model_name"),
        F.col("o_orderpriority").alias("workload_type"),
        choose(BATCH_SIZES, F.col("o_orderkey")).cast("int").alias("batch_size"),
        (F.col("o_orderkey") % 50 + 1).alias("num_samples"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def benchmark_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of the store: the order lines."""
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("run_id"),
        (F.col("l_extendedprice") / 100).alias("latency_ms"),
        (F.col("l_extendedprice") / 400).alias("ttft_ms"),
        (F.col("l_partkey") % 500 + 1).alias("input_tokens"),
        F.col("l_quantity").cast("long").alias("output_tokens"),
        (F.col("l_discount") * 100000).alias("gpu_memory_mb"),
        (F.col("l_tax") * 1000).alias("gpu_utilization_percent"),
        (F.col("l_extendedprice") * F.col("l_tax") / 1000).alias("cost_usd"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"),
    )


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One requirement set per customer."""
    workload = (
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", "real_time_chat")
        .when(F.col("c_mktsegment") == "BUILDING", "interactive_app")
        .when(F.col("c_mktsegment") == "FURNITURE", "batch_processing")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "high_throughput")
        .otherwise("other")
    )
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("req_id"),
        workload.alias("workload_type"),
        (F.col("c_custkey") % 40 * 10 + 50).cast("double").alias("max_latency_p95_ms"),
        F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("monthly_budget_usd"),
        (F.col("c_custkey") % 97 + 1).cast("double").alias("monthly_tokens_millions"),
        (F.lit(0.80) + (F.col("c_custkey") % 13) / 100).alias("min_quality_score"),
        (F.col("c_nationkey") % 2 == 0).alias("prefer_self_hosted"),
    )


def cost_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cost model per supplier; every third one is an API."""
    api = F.col("s_suppkey") % 3 == 0
    return read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("cost_model_id"),
        F.col("s_name").alias("model_name"),
        F.when(api, "api").otherwise("self_hosted").alias("deployment_type"),
        F.when(api, 0.0).otherwise(F.abs("s_acctbal") / 4000).alias("gpu_hourly_rate"),
        F.when(F.col("s_suppkey") % 2 == 0, 1.0).otherwise(0.6).alias("gpu_utilization"),
        F.when(api, 0.5).otherwise(0.0).alias("cost_per_1m_input_tokens"),
        F.when(api, 1.5).otherwise(0.0).alias("cost_per_1m_output_tokens"),
        F.when(api, 0.0).otherwise(500.0).alias("engineering_monthly"),
        F.when(api, 0.0).otherwise((F.col("s_suppkey") % 10).cast("double") * 20).alias("power_monthly"),
        (F.col("s_nationkey") + 1).cast("double").alias("input_millions"),
        (F.col("s_nationkey") * 2 + 1).cast("double").alias("output_millions"),
    )


def model_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model per part; promotional parts do not disclose their size."""
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("model_id"),
        F.col("p_name").alias("model_name"),
        F.when(F.col("p_type") == "PROMO", "Undisclosed")
        .otherwise(F.concat(F.col("p_size").cast("string"), F.lit("B"))).alias("parameters"),
        F.when(F.col("p_partkey") % 5 == 0, "INT2")
        .otherwise(F.upper(choose(QUANT_KEYS, F.col("p_partkey")))).alias("quantization"),
        F.when(F.col("p_retailprice") >= 950, 80.0).otherwise(24.0).alias("gpu_memory_gb"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant turn that follows it.

    Joined on (conversation, turn), which is unique, so that one endless
    conversation does not end up in one task.
    """
    turns = read(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("prompt"), (F.col("turn") + 1).alias("next_turn"))
    answered = turns.filter("role = 'assistant'").select(
        "conv_id", F.col("turn").alias("next_turn"), "text")
    return asked.join(answered, ["conv_id", "next_turn"]).select(
        F.concat_ws("-", "conv_id", "turn").alias("pair_id"),
        "conv_id", "turn",
        choose(MODEL_NAMES, F.col("conv_id")).alias("model_name"),
        choose(QUANT_KEYS, F.floor(F.col("conv_id") / 6) + F.floor(F.col("turn") / 2)).alias("quantization"),
        "prompt", "text",
    )


def prompt_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer key over the data: per user prompt its last four words, lower-cased.

    Prompts that are asked more than once keep one entry.
    """
    words = F.split(F.lower(F.trim("text")), r"\s+")
    return (
        read(spark, sf_dir, "conversations").filter("role = 'user'")
        .select(F.col("text").alias("prompt"), F.slice(words, F.greatest(F.size(words) - 3, F.lit(1)), 4)
                .alias("keywords"))
        .withColumn("__digest", F.md5("prompt")).dropDuplicates(["__digest"]).drop("__digest")
    )


def config_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quality label per model; sources are assigned to models by their number."""
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", choose(MODEL_NAMES, F.substring("source", 4, 9).cast("int")).alias("model_name"))
    return (
        docs.join(read(spark, sf_dir, "labels"), "doc_id")
        .groupBy("model_name")
        .agg(F.round(F.avg("quality"), 6).alias("quality_score"))
    )
