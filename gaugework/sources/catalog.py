"""Fixed dimension tables: models, presets, quantisation and cache settings, answer key.

All of these have a handful of rows, so they are local relations that Spark
may broadcast. Each loader takes the session and returns a DataFrame; any
DataFrame with the same columns can be used in its place.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Model catalog (name, backend, parameters, quantization, price per
# hour, price per 1M input tokens, price per 1M output tokens; None = not given).
MODELS = [
    ("llama-2-7b", "vllm", "7B", "fp16", 1.006, None, None),
    ("llama-2-13b", "vllm", "13B", "fp16", 1.515, None, None),
    ("mistral-7b-instruct", "vllm", "7B", "fp16", 1.006, None, None),
    ("phi-3-mini", "vllm", "3.8B", "fp16", 1.006, None, None),
    ("gpt-3.5-turbo", "openai_api", "~175B (estimated)", None, None, 0.50, 1.50),
    ("claude-haiku", "anthropic_api", "Undisclosed", None, None, 0.25, 1.25),
]
MODEL_NAMES = [m[0] for m in MODELS]

# Named model selections.
MODEL_PRESETS = {
    "quick_test": ["phi-3-mini", "llama-2-7b"],
    "cost_optimized": ["mistral-7b-instruct", "phi-3-mini", "claude-haiku"],
    "quality_focused": ["llama-2-13b", "gpt-3.5-turbo"],
    "full_suite": MODEL_NAMES,
}

# Quantisation (key, label, dtype, memory factor, expected quality loss).
QUANTIZATIONS = [
    ("fp16", "FP16", "float16", 1.0, 0.0),
    ("int8", "INT8", "int8", 0.55, 0.02),
    ("int4", "INT4", "int4", 0.30, 0.05),
]

# Bytes per parameter by dtype; any other dtype counts as 2.0.
BYTES_PER_PARAM = {"float16": 2.0, "int8": 1.0, "int4": 0.5}

# KV-cache settings (key, GPU memory utilisation, sequences, batched tokens, swap GB).
KV_CACHES = [
    ("default", 0.90, 256, 8192, 4),
    ("optimized", 0.95, 512, 16384, 8),
    ("conservative", 0.75, 128, 4096, 2),
]

# Answer key; an answer is right when it holds one of the keywords.
QA_ANSWERS = {
    "What is the capital of France?": ["paris"],
    "Who wrote Romeo and Juliet?": ["shakespeare"],
    "What is the speed of light?": ["299", "300", "3×10"],
    "When was the Declaration of Independence signed?": ["1776"],
    "What is the largest planet in our solar system?": ["jupiter"],
    "Who painted the Mona Lisa?": ["da vinci", "leonardo"],
    "What is the chemical symbol for gold?": ["au"],
    "How many continents are there?": ["7", "seven"],
    "What is the boiling point of water in Celsius?": ["100"],
    "Who invented the telephone?": ["bell", "alexander"],
    "What is the currency of Japan?": ["yen"],
    "When did World War II end?": ["1945"],
    "What is the square root of 144?": ["12"],
    "Who was the first president of the United States?": ["washington"],
    "What is photosynthesis?": ["light", "chlorophyll", "plants"],
    "How many bones are in the human body?": ["206"],
    "What is the capital of Australia?": ["canberra"],
    "Who wrote The Great Gatsby?": ["fitzgerald"],
    "What is the formula for water?": ["h2o", "h₂o"],
    "When was the internet invented?": ["1960", "1970", "arpanet"],
}

# Prompt templates (workload, template, placeholder, shortest, longest in tokens).
PROMPT_TEMPLATES = [
    ("qa", "Q: {question}\nA:", "{question}", 50, 200),
    ("qa", "Question: {question}\nAnswer:", "{question}", 50, 200),
    ("summarization", "Summarize the following article:\n\n{article}\n\nSummary:", "{article}", 500, 2000),
    ("code_generation", "# Python function\n{description}\n\ndef solution():", "{description}", 100, 500),
]

# Batch sizes under test.
BATCH_SIZES = [1, 4, 8, 16, 32]

# GPU tier by load (from requests/s, below requests/s, tier, instance, USD per hour).
LOAD_TIERS = [
    (0.0, 10.0, "light", "g5.xlarge", 1.01),
    (10.0, 50.0, "medium", "g5.2xlarge", 1.52),
    (50.0, float("inf"), "heavy", "p4d.24xlarge", 32.77),
]

# Price reduction by purchase option.
COST_SCENARIOS = [("on_demand", 0.0), ("spot", 0.70), ("reserved", 0.40)]

# Alert thresholds (metric, threshold, alert when above (True) or below (False)).
ALERT_THRESHOLDS = [
    ("latency_p95_ms", 500.0, True),
    ("latency_p99_ms", 1000.0, True),
    ("throughput_req_s", 10.0, False),
    ("gpu_utilization", 0.8, True),
    ("error_rate", 0.01, True),
]

# The texts that explain a recommendation, by step and by workload, and those that say why there is none.
REASONS = {
    "latency": "Filtered to p95 latency ≤ %sms (%d/%d configs)",
    "quality": "Filtered to quality ≥ %s%% (%d configs)",
    "budget": "Filtered to monthly cost ≤ $%s (%d configs)",
    "self_hosted": "Preferring self-hosted deployments",
    "default": "Default: optimizing for cost",
}
GOALS = {
    "real_time_chat": "Optimizing for lowest latency (real-time chat)",
    "interactive_app": "Balancing latency (60%) and cost (40%)",
    "batch_processing": "Optimizing for lowest cost (batch processing)",
    "high_throughput": "Optimizing for maximum throughput",
}
NO_MATCH = {
    "latency": "No configs meet latency SLA",
    "quality": "No configs meet quality threshold",
    "budget": "No configs meet budget constraint",
    "hint": "Consider relaxing constraints",
}


def _table(spark: SparkSession, names: list[str], types: list[pa.DataType], rows: list) -> DataFrame:
    columns = list(zip(*rows))
    return spark.createDataFrame(
        pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=names))


def models(spark: SparkSession) -> DataFrame:
    s, d = pa.string(), pa.float64()
    return _table(
        spark,
        ["model_name", "backend", "parameters", "quantization", "cost_per_hour",
         "cost_per_1m_tokens_input", "cost_per_1m_tokens_output"],
        [s, s, s, s, d, d, d], MODELS,
    ).withColumn("deployment_type", F.when(is_api(), "api").otherwise("self_hosted"))


def is_api():
    """True where the backend names an API."""
    return F.contains(F.coalesce(F.col("backend"), F.lit("")), F.lit("api"))


def model_presets(spark: SparkSession) -> DataFrame:
    rows = [(preset, name) for preset, names in MODEL_PRESETS.items() for name in names]
    return _table(spark, ["preset", "model_name"], [pa.string()] * 2, rows)


def quantizations(spark: SparkSession) -> DataFrame:
    s, d = pa.string(), pa.float64()
    return _table(spark, ["quantization", "label", "dtype", "memory_reduction", "expected_quality_loss"],
                  [s, s, s, d, d], QUANTIZATIONS)


def kv_caches(spark: SparkSession) -> DataFrame:
    i = pa.int32()
    return _table(spark, ["cache", "gpu_memory_utilization", "max_num_seqs", "max_num_batched_tokens",
                          "swap_space_gb"], [pa.string(), pa.float64(), i, i, i], KV_CACHES)


def answer_key(spark: SparkSession) -> DataFrame:
    return _table(spark, ["prompt", "keywords"], [pa.string(), pa.list_(pa.string())],
                  list(QA_ANSWERS.items()))


def alert_thresholds(spark: SparkSession) -> DataFrame:
    return _table(spark, ["metric", "threshold", "alert_above"],
                  [pa.string(), pa.float64(), pa.bool_()], ALERT_THRESHOLDS)
