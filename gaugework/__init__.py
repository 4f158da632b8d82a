"""Spark-native analytics over inference-benchmark request logs.

Every public function takes DataFrames and returns a DataFrame; nothing runs
until the caller writes or collects the result, except where a docstring says
that a step is materialised.
"""
