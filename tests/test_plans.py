"""Plans as they should be: pruned scans, pushed filters, limits before shuffles, no per-row Python."""

from __future__ import annotations

import re

import pytest

from docloom.plans import catalogue

DATA = "/root/testdata/sf0.001"


def plan(spark, name: str) -> str:
    return catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize(("name", "schema"), [
    ("keyword_index", "struct<chunk_id:string,content:string>"), ("tokenize_terms", "struct<doc_id:bigint,text:string>"), ("pii_hit_count", "struct<chunk_id:string,doc_id:bigint,content:string>"),
    ("embed_dedup", "struct<chunk_id:string,content:string>"), ("api_call_totals", "struct<event_id:bigint,event_type:string>"),
])
def test_scans_read_the_columns_they_need(spark, name, schema):
    # beside its columns a scan for repeated keys may be there, which reads the keys alone
    assert set(re.findall(r"ReadSchema: (\S+)", plan(spark, name))) - {"struct<chunk_id:string>"} == {schema}


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(section_id), Not(EqualTo(section_id,))]" in plan(spark, "section_fetch")
    assert "EqualTo(mode,privacy)" in plan(spark, "kb_mode_semi")


def test_ranks_are_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "section_fetch")
    assert "TakeOrderedAndProject" in plan(spark, "session_list")


@pytest.mark.parametrize("name", sorted(n for n in catalogue.QUERIES if n not in ("p4_found", "p4_counts", "pii_redact", "pii_restore")))
def test_no_cartesian_products_or_row_udfs(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BatchEvalPython" not in text
