"""Every registered query against its check SQL."""

import pytest
from compare import connect, difference
from conftest import FOLDER

from __spark_entry__ import entry, oracle_sql, queries
from sparsile.catalog.registry import QUERIES

NAMES = sorted(QUERIES)


@pytest.fixture(scope="session")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_check(spark, duck, name):
    check = oracle_sql().get(name)
    if check is None:
        assert queries()[name](spark, FOLDER).count() > 0
    else:
        assert difference(spark, duck, queries()[name], check, FOLDER) is None


def test_entry(spark):
    found = entry(spark)
    assert found.columns == ["data_id"] and found.count() > 0
