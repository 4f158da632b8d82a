"""An order-preserving bucket number for any double.

``coarse_bucket`` never decreases as the value grows, so counting per bucket
gives exact ranks at bucket borders. Within one coarse bucket all values share
sign and about ten leading bits of magnitude, hence ``fine_bucket`` (linear
between the bucket's own smallest and largest value) splits it into about a
million parts, each of which can hold at most a few million distinct doubles.
Both are plain arithmetic, so every executor computes the same bucket.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS_PER_OCTAVE = 1024
FINE_STEPS = 1 << 20
_OFFSET = 1 << 21  # larger than any |log2(double)| * STEPS_PER_OCTAVE


def coarse_bucket(v: Column, steps: int = STEPS_PER_OCTAVE) -> Column:
    magnitude = F.least(F.log2(F.abs(v)), F.lit(1025.0)) * steps
    step = F.floor(magnitude).cast("long") + _OFFSET
    return F.when(v > 0, step).when(v < 0, -step).otherwise(F.lit(0).cast("long"))


def fine_bucket(v: Column, lo: Column, hi: Column) -> Column:
    return F.when(
        hi > lo, F.floor((v - lo) / (hi - lo) * FINE_STEPS).cast("long")
    ).otherwise(F.lit(0).cast("long"))
