"""Every registered query against its SQL on the smallest tables."""

import pytest

from checks.compare import connect, difference
from checks.oracle import ORACLE
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) > 0
    if name in ORACLE:
        assert difference(got, con.execute(ORACLE[name]).df()) == ""


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_when_nothing_fits_in_one_task(spark, con, name, tight_limits):
    got = QUERIES[name](spark, SF).toPandas()
    assert difference(got, con.execute(ORACLE[name]).df()) == ""
