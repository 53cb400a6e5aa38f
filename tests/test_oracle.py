"""Every query of the core with SQL, over the smallest tables."""

from __future__ import annotations

import pytest
from oracle import compare

from docloom.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows_as_sql(spark, name):
    compare(spark, name, catalogue.QUERIES[name], catalogue.SQL[name], DATA)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs_without_sql(spark, name):
    rows = catalogue.QUERIES[name](spark, DATA)
    assert rows.count() > 0 and len(set(rows.columns)) == len(rows.columns)


def test_entry():
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert catalogue.FLAGSHIP in e.queries()
