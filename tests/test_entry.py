"""The driver's contract."""

import os

import pytest

import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data here")
def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["n_name", "revenue", "n"] and out.count() > 0
