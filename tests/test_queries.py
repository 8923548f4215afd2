import pytest

from plantscribe import plans

from .oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_equals_its_sql(spark, con, name):
    df = plans.queries()[name](spark, SF)
    sql = plans.oracle_sql().get(name)
    if sql:
        compare(df, con, sql)
    else:
        assert df.count() > 0
