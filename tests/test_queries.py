"""Every query of the engine against its SQL on the smallest tables; those without SQL must run with a stable schema."""

import os

import pytest

from factorloom.queries import ORACLE_SQL, QUERIES, load_all

from .oracle import assert_same, connection

load_all()
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, con, name):
    assert_same(QUERIES[name](spark, SF), con, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    """The two statistical ones: rows, a stable schema and the same numbers again."""
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    again = QUERIES[name](spark, SF)
    assert df.schema == again.schema and len(rows) == 1
    assert all(x == pytest.approx(y, nan_ok=True) if isinstance(x, float) else x == y for x, y in zip(rows[0], again.first()))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
