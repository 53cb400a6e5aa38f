"""The query of the general training-data problem, references to records that do not exist, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.operators import orphans


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.found(orphans.replay(spark, d))


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, field, month of the referring row and state, as they stood after every period of the history."""
    return orphans.snapshots(spark, d)


_REFS = r"""
WITH refs AS (
  SELECT 'document' AS kind, CAST(doc_id AS VARCHAR) AS target, 'chunks_index' AS source_table, 'doc_id' AS field_name, chunk_id AS record_key, created_at AS ts FROM chunks_index
  UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR), 'redaction_map', 'doc_id', CAST(id AS VARCHAR), created_at FROM redaction_map
  UNION ALL SELECT 'file', regexp_replace(replace(file_path, '\', '/'), '^(\./)+', ''), 'documents', 'file_path', CAST(doc_id AS VARCHAR), upload_time FROM documents
  UNION ALL SELECT 'base', kb_name, 'documents', 'kb_name', CAST(doc_id AS VARCHAR), upload_time FROM documents
), events AS (
  SELECT 'document' AS kind, CAST(doc_id AS VARCHAR) AS target, upload_time AS ts, TRUE AS arrives FROM documents
  UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR), deleted_at, FALSE FROM doc_tombstones
  UNION ALL SELECT 'file', regexp_replace(replace(file_path, '\', '/'), '^(\./)+', ''), archived_at, TRUE FROM archive_files
  UNION ALL SELECT 'file', regexp_replace(replace(file_path, '\', '/'), '^(\./)+', ''), removed_at, FALSE FROM archive_files WHERE removed_at IS NOT NULL
  UNION ALL SELECT 'base', kb_name, created_at, TRUE FROM knowledge_bases
  UNION ALL SELECT 'base', kb_name, deleted_at, FALSE FROM knowledge_bases WHERE deleted_at IS NOT NULL
)"""

_STATE = "CASE WHEN gone THEN 'deleted' WHEN known IS NOT TRUE THEN 'missing' WHEN since > ts THEN 'late' END AS ref_state"

_FOUND = _REFS + f""", targets AS (
  SELECT kind, target, min(ts) FILTER (WHERE arrives) AS since, bool_or(arrives) AS known, bool_or(NOT arrives) AS gone FROM events GROUP BY kind, target
)
SELECT DISTINCT source_table, field_name, record_key, ref_state FROM (
  SELECT source_table, field_name, record_key, {_STATE} FROM refs LEFT JOIN targets USING (kind, target) WHERE target IS NOT NULL) x
WHERE ref_state IS NOT NULL"""

_COUNTS = _REFS + f""", bounds AS (
  SELECT coalesce(floor(epoch(min(ts))), 0) AS low, greatest(1, (coalesce(floor(epoch(max(ts))), 0) - coalesce(floor(epoch(min(ts))), 0)) // {orphans.PERIODS} + 1) AS width FROM refs
), periods AS (SELECT unnest(range(1, {orphans.PERIODS + 1})) AS period),
r AS (SELECT refs.*, least({orphans.PERIODS}, greatest(1, coalesce(floor((floor(epoch(ts)) - low) / width), 0) + 1)) AS own FROM refs, bounds WHERE target IS NOT NULL),
e AS (SELECT events.*, least({orphans.PERIODS}, greatest(1, coalesce(floor((floor(epoch(ts)) - low) / width), 0) + 1)) AS own FROM events, bounds),
targets AS (
  SELECT period, kind, target, min(ts) FILTER (WHERE arrives) AS since, bool_or(arrives) AS known, bool_or(NOT arrives) AS gone FROM e JOIN periods ON own <= period GROUP BY period, kind, target
), judged AS (
  SELECT p.period, source_table, field_name, record_key, r.ts, {_STATE.replace("> ts", "> r.ts")}
  FROM r JOIN periods p ON r.own <= p.period LEFT JOIN targets t ON t.period = p.period AND t.kind = r.kind AND t.target = r.target
)
SELECT CAST(period AS INTEGER) AS period, source_table, field_name, month, ref_state, count(*) AS orphans FROM (
  SELECT DISTINCT period, source_table, field_name, strftime(date_trunc('month', ts), '%Y-%m') AS month, record_key, ref_state FROM judged WHERE ref_state IS NOT NULL
) x GROUP BY period, source_table, field_name, month, ref_state"""

QUERIES = {"p4_found": p4_found, "p4_counts": p4_counts}
SQL = {"p4_found": _FOUND, "p4_counts": _COUNTS}
