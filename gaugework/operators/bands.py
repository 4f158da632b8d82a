"""Join of values with the bands [low, high) that hold them, both sides tables.

The line is cut at quantiles of the bands' ends. A band is dealt to every part that it touches and a value to the one it
lies in, so that the two meet by equality of a part's number and only then by comparison. With few bands every end is a
cut and a part's bands hold all of its values.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.functions.scalars import finite
from gaugework.functions.steps import bounds_of, steps_passed
from gaugework.session import materialise, small_side

PARTS = 256


def with_bands(df: DataFrame, value: str, bands: DataFrame, low: str = "low", high: str = "high",
               parts: int = PARTS) -> DataFrame:
    """Each row beside the other columns of every band that holds its ``value``.

    A missing end of a band is open. A row in several bands comes back once for each; a row in a gap, or whose value is
    missing or NaN, once with NULLs. Bands that end before they begin hold nothing.
    """
    details = [c for c in bands.columns if c not in (low, high)]
    if clash := sorted(set(details) & set(df.columns)):
        raise ValueError(f"columns of both tables: {', '.join(clash)}")
    known = materialise(bands.select(
        F.coalesce(F.col(low).cast("double"), F.lit(-math.inf)).alias("__low"),
        F.coalesce(F.col(high).cast("double"), F.lit(math.inf)).alias("__high"), *details).filter("__low < __high"), "bands")
    ends = known.select(F.explode(F.array("__low", "__high")).alias("end")).filter(F.abs("end") < math.inf).distinct()
    cuts = bounds_of(ends.agg(F.percentile_approx("end", [(i + 1) / parts for i in range(parts)], 100 * parts)).first()[0])
    touched = F.sequence(steps_passed(cuts, "{} <= __low"), steps_passed(cuts, "{} < __high"))
    dealt = small_side(known.withColumn("__part", F.explode(touched)))
    placed = df.withColumn("__value", finite(value)).withColumn("__at", steps_passed(cuts, "{} <= __value"))
    inside = (F.col("__at") == F.col("__part")) & (F.col("__low") <= F.col("__value")) & (F.col("__value") < F.col("__high"))
    return placed.join(dealt, inside, "left").select(*df.columns, *details)
