"""Every registered query against its SQL on the smallest data folder."""

import pytest
from check import compare, connect

from granary import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, con):
    result = catalog.QUERIES[name](spark, FOLDER)
    if name in catalog.ORACLES:
        assert compare(result, con, catalog.ORACLES[name]) == ""
    else:
        assert result.count() > 0


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).columns
