"""Column helpers. All of them are built-in expressions; none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BYTES_PER_GIB = 1024.0**3


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num: Column | str, den: Column | str) -> Column:
    """``num / den``, 0 when the denominator is zero, negative or missing."""
    d = col(den).cast("double")
    return F.when(d > 0, col(num).cast("double") / d).otherwise(F.lit(0.0))


def half_even(c: Column | str, digits: int) -> Column:
    """Round half to even, on doubles; a negative number that rounds to zero keeps its sign."""
    number = col(c).cast("double")
    return F.bround(F.abs(number), digits) * F.signum(number)


def finite(c: Column | str) -> Column:
    """NaN to NULL, so that averages, sums and minima skip it."""
    return F.when(F.isnan(col(c)), F.lit(None).cast("double")).otherwise(col(c).cast("double"))


def array_mean(arr: Column | str) -> Column:
    """Mean of a DOUBLE array; 0 for an empty or missing one."""
    a = col(arr)
    total = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    return F.coalesce(F.when(F.size(a) > 0, total / F.size(a)), F.lit(0.0))


def or_zero(c: Column | str) -> Column:
    return F.coalesce(col(c).cast("double"), F.lit(0.0))


def any_contains(text: Column | str, keywords: Column | str) -> Column:
    """True when the lower-cased text holds one of the keywords as a substring."""
    lowered = F.lower(col(text))
    return F.exists(col(keywords), lambda k: F.contains(lowered, k))


def parameters_billion(c: Column | str) -> Column:
    """``"7B"`` to 7.0; NULL for sizes that are estimated or not disclosed."""
    return F.regexp_extract(col(c), r"^([0-9]+(?:\.[0-9]+)?)B$", 1).try_cast("double")


def with_defaults(df, defaults: dict):
    """Add each missing column as a constant; columns that exist stay as they are."""
    missing = {name: value if isinstance(value, Column) else F.lit(value)
               for name, value in defaults.items() if name not in df.columns}
    return df.withColumns(missing) if missing else df


def run_stamp(ts: Column | str) -> Column:
    """Run identifier in the form ``yyyyMMdd_HHmmss``."""
    return F.date_format(col(ts), "yyyyMMdd_HHmmss")


def iso_stamp(ts: Column | str) -> Column:
    """ISO-8601 text of a timestamp with microseconds."""
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
