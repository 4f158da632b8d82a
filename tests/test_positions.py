import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.operators.picks import first_by
from gaugework.operators.positions import with_position
from gaugework.operators.select import best_row, best_rows


@pytest.mark.parametrize("parts", [1, 7])
def test_positions_per_group_with_ties(spark, parts):
    rng = np.random.default_rng(3)
    rows = [("hot" if i % 3 else f"g{i % 5}", int(rng.integers(0, 20)), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(parts)
    got = {(r["g"], r["id"]): r["pos"] for r in
           with_position(df, ["v", "id"], "pos", ["g"]).collect()}
    for g in {r[0] for r in rows}:
        for place, (_, _, i) in enumerate(sorted([r for r in rows if r[0] == g], key=lambda r: (r[1], r[2]))):
            assert got[(g, i)] == place


def test_positions_overall_descending(spark):
    df = spark.range(500).selectExpr("id", "id % 50 as v")
    rows = with_position(df, [-F.col("v"), "id"], "pos").collect()
    want = sorted([(-r["v"], r["id"]) for r in rows])
    assert sorted([(r["pos"], r["id"]) for r in rows]) == [(i, w[1]) for i, w in enumerate(want)]


def test_first_by_ties_and_missing(spark):
    rows = [("a", 2.0, 1), ("a", 1.0, 3), ("a", 1.0, 2), ("a", None, 0), ("b", None, 5)]
    df = spark.createDataFrame(rows, "g string, v double, id int")
    assert [tuple(r) for r in first_by(df, ["g"], ["v", "id"]).collect()] == [("a", 1.0, 2)]


def test_best_row_skips_nan(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 4.0), (3, 4.0), (4, 1.0)], "id int, v double")
    assert best_row(df, "v", "id").first()["id"] == 4
    assert best_row(df, "v", "id", largest=True).first()["id"] == 2
    assert best_row(df.filter("id = 1"), "v", "id").count() == 0
    both = {"low": ("v", False), "high": ("v", True)}
    assert {(r["finding"], r["id"]) for r in best_rows(df, both, "id").collect()} == {("low", 4), ("high", 2)}
    assert best_rows(df.filter("id = 1"), both, "id").count() == 0
