import os

import pytest

from compare import connect, oracle_rows, rows_of
from tidepool.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    names, want = oracle_rows(con, registry.ORACLE_SQL[name])
    assert sorted(df.columns) == names
    got = rows_of(df)
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    registry.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
