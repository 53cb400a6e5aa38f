"""Every training-data query: against brute-force SQL where there is one, else that it runs on all tables."""

from __future__ import annotations

import pytest
from oracle import compare

from docloom.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    compare(spark, name, QUERIES[name], SQL[name], DATA)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0 or name == "p5_twins"


def test_groups_agree_with_pairs(spark):
    pairs = [tuple(r) for r in QUERIES["p2_found"](spark, DATA).collect()]
    groups = {(r.field_name, r.record_key): (r.class_id, r.links) for r in QUERIES["p2_groups"](spark, DATA).collect()}
    assert set(groups) == {(f, k) for f, a, b in pairs for k in (a, b)}
    assert all(groups[f, a][0] == groups[f, b][0] for f, a, b in pairs)
    assert sum(n for _, n in groups.values()) == 2 * len(pairs)
