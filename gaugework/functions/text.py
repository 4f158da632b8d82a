"""Tokens and longest common subsequences for text overlap scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugework.functions.scalars import col


def word_tokens(text: Column | str) -> Column:
    """Lower-cased runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit("([a-z0-9]+)"), F.lit(1))


def lcs_length(a, b) -> int:
    """Length of the longest common subsequence, by bit rows (Hyyrö 2004).

    One machine word covers 64 tokens of ``a``, so whole texts stay cheap.
    """
    if len(a) == 0 or len(b) == 0:
        return 0
    where: dict = {}
    for i, token in enumerate(a):
        where[token] = where.get(token, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        hit = row & where.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.IntegerType())
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(x, y) for x, y in zip(a, b)], dtype="int32")
