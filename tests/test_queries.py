"""Every registered query with SQL agrees with it; the others run."""

import pytest

from sensorloom.plans import queries as q

from .compare import connect, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(q.SQL))
def test_query_matches_sql(spark, con, name):
    same(q.QUERIES[name](spark, SF), con, q.SQL[name])


@pytest.mark.parametrize("name", [n for n in q.QUERIES if n not in q.SQL])
def test_query_runs(spark, name):
    df = q.QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0
