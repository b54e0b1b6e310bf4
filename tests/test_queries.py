"""Every registered query against its oracle on the smallest tables."""

import pytest

from compare import ROOT, difference, oracle_connection
from pvseries.queries import QUERIES

FOLDER = f"{ROOT}/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, oracle, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert len(got)
    if QUERIES[name].sql:
        assert difference(got, oracle.execute(QUERIES[name].sql).df()) is None


def test_entry_and_contract(spark):
    import __spark_entry__ as e
    assert e.entry(spark).count() == 24
    assert set(e.oracle_sql()) <= set(e.queries())
