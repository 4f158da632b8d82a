"""First row per group by an order, as an aggregate.

``min_by`` combines on the map side, so a hot group sends one row per task
instead of all its rows. Ties end in the columns given last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The row that sorts first in each group; rows with a NULL first criterion are skipped."""
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    ordered = [o.alias(f"__o{i}") for i, o in enumerate(order)]
    rest = [c for c in df.columns if c not in keys]
    return (
        df.select(*keys, F.struct(*rest).alias("__row"), F.struct(*ordered).alias("__order"))
        .filter(F.col("__order.__o0").isNotNull())
        .groupBy(*keys)
        .agg(F.min_by("__row", "__order").alias("__row"))
        .select(*keys, "__row.*").select(*df.columns)
    )
