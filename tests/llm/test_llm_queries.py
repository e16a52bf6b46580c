import pytest
from oracle import FOLDER, compare, connection

from cairnlight.llm import queries as llm

SQL = llm.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    compare(spark, con, llm.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(SQL)))
def test_runs_without_sql(spark, name):
    llm.queries()[name](spark, FOLDER).collect()
