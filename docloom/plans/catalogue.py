"""All queries of the core library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.plans import privacy, problems, retrieval, structure, upkeep

FLAGSHIP = "bm25_topk"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _part in (retrieval, structure, privacy, upkeep, problems):
    QUERIES |= _part.QUERIES
    SQL |= _part.SQL
