"""Every registered query that has SQL against DuckDB, on the smallest tables."""

import pytest

from gaugework.plans.all import ORACLE_SQL, QUERIES
from tests.agreement import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLE_SQL:
        _, problems = compare(spark, con, QUERIES[name], ORACLE_SQL[name], SF)
        assert not problems
    else:
        assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
