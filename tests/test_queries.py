import pytest
from oracle import FOLDER, compare, connection

from cairnlight.plans import queries as core

SQL = core.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    compare(spark, con, core.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(SQL)))
def test_runs_without_sql(spark, name):
    df = core.queries()[name](spark, FOLDER)
    assert df.columns
    df.collect()
