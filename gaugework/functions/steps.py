"""How many of a sorted list of bounds pass a test, by bisection inside one expression."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def steps_passed(bounds: list[float], test: str) -> Column:
    """The number of ``bounds`` (ascending, finite) for which ``test`` holds; it must hold for a first part of them only.

    ``test`` is SQL with ``{}`` in the place of a bound, such as ``{} <= limit``. A test that is NULL counts as failed. The
    expression is a tree of CASE, so a row is compared with log2 of the bounds, inside generated code.
    """

    def tree(low: int, high: int) -> str:
        if low == high:
            return str(low)
        middle = (low + high) // 2
        return f"CASE WHEN {test.format(f'{bounds[middle]!r}D')} THEN {tree(middle + 1, high)} ELSE {tree(low, middle)} END"

    return F.expr(tree(0, len(bounds))).cast("int")


def bounds_of(quantiles: list[float | None]) -> list[float]:
    """Bounds that cut where the quantiles lie. A value that repeats among them is heavy and gets a part of its own."""
    known = [float(q) for q in quantiles or [] if q is not None and math.isfinite(q)]
    found = set(known)
    for value, after in zip(known, known[1:]):
        if value == after:
            found.add(math.nextafter(value, -math.inf))
    return sorted(x for x in found if math.isfinite(x))
