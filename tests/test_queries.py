"""Each query against the SQL that it must agree with."""

import pytest

from sievework.catalog import ORACLES, QUERIES
from tests.conftest import SMALL, same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    if name in ORACLES:
        assert same(df, duck.execute(ORACLES[name]))
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
