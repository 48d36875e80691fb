"""Every registered query against its oracle SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check_queries import compare, oracle_connection


@pytest.fixture(scope="module")
def con(small):
    return oracle_connection(small)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, small, name):
    same, note = compare(spark, con, name, small)
    assert same, note


def test_entry_is_lazy_and_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "text"]
    assert df.limit(1).count() == 1
