"""Values in bands against the plain comparison of every pair."""

import math
import random

import pytest

from gaugework.functions.steps import bounds_of, steps_passed
from gaugework.operators import sizing
from gaugework.operators.bands import with_bands

NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("n,parts", [(3, 256), (60, 256), (60, 4), (60, 1)])
def test_equal_to_every_pair(spark, n, parts):
    """Overlaps, gaps, open ends, bands without room, and many more bands than parts."""
    rng = random.Random(n + parts)
    bands = [(f"b{i}", a := rng.choice([rng.uniform(-5, 90), float(rng.randint(0, 20)), None]),
              None if rng.random() < 0.1 else (a or 0.0) + rng.choice([0.0, 0.5, 3.0, 20.0, -2.0])) for i in range(n)]
    values = [rng.uniform(-10, 100) for _ in range(150)] + [float(i) for i in range(22)] + [None, NAN, INF, -INF, -0.0]
    got = with_bands(spark.createDataFrame(list(enumerate(values)), "id int, v double"), "v",
                     spark.createDataFrame(bands, "band string, low double, high double"), parts=parts)
    want = []
    for i, v in enumerate(values):
        inside = [b for b, low, high in bands if v is not None and not math.isnan(v)
                  and (-INF if low is None else low) <= v < (INF if high is None else high)]
        want += [(i, b) for b in inside or [None]]
    assert sorted(((r.id, r.band) for r in got.collect()), key=str) == sorted(want, key=str)


def test_tiers_as_a_table(spark):
    tiers = spark.createDataFrame([(0.0, 5.0, "small", "a", 1.0), (5.0, None, "large", "b", 9.0)],
                                  "low double, high double, tier string, instance string, usd_per_hour double")
    df = spark.sql("select explode(array(0D, 4.9D, 5D, 1e9D, -1D)) requests_per_second")
    assert [(r.tier, r.usd_per_hour) for r in sizing.load_tier(df, tiers=tiers).orderBy("requests_per_second").collect()] == [
        (None, None), ("small", 1.0), ("small", 1.0), ("large", 9.0), ("large", 9.0)]


def test_no_bands_and_clashes(spark):
    df = spark.createDataFrame([(1, 2.0)], "id int, v double")
    none = spark.createDataFrame([], "band string, low double, high double")
    assert [tuple(r) for r in with_bands(df, "v", none).collect()] == [(1, 2.0, None)]
    with pytest.raises(ValueError, match="id"):
        with_bands(df, "v", none.withColumnRenamed("band", "id"))


def test_steps(spark):
    bounds = bounds_of([3.0, 1.0, 3.0, 3.0, None, INF, NAN])
    assert bounds == [1.0, math.nextafter(3.0, -INF), 3.0] or bounds == [1.0, 3.0]
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (3.0,), (9.0,), (None,)], "v double")
    got = [r[0] for r in df.select(steps_passed([1.0, 3.0], "{} <= v")).collect()]
    assert got == [0, 1, 1, 2, 2, 0] and df.select(steps_passed([], "{} <= v")).distinct().collect()[0][0] == 0
