"""Explicit schemas of the stored tables."""

REQUEST_RESULT = (
    "run_id STRING, model_name STRING, backend STRING, workload STRING, batch_size INT, "
    "latency_ms DOUBLE, input_tokens BIGINT, output_tokens BIGINT, timestamp TIMESTAMP"
)

BENCHMARK_RUNS = (
    "id BIGINT, run_id STRING, model_name STRING, workload_type STRING, batch_size INT, "
    "num_samples BIGINT, created_at TIMESTAMP"
)

BENCHMARK_RESULTS = (
    "id BIGINT, run_id BIGINT, latency_ms DOUBLE, ttft_ms DOUBLE, input_tokens BIGINT, "
    "output_tokens BIGINT, gpu_memory_mb DOUBLE, gpu_utilization_percent DOUBLE, "
    "cost_usd DOUBLE, created_at TIMESTAMP"
)
