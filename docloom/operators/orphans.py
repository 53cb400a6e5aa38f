"""References to records that do not exist (problem 4), kept as incremental keyed state.

The state is two tables keyed by (kind, target): the parent index, with the
time each target exists from, whether it is known and whether it was ever
deleted, and the references with their present state. Arrivals and deletions
are events of their own, each with its own time. A batch is folded in by
``step``: new references probe the parent index; a parent that arrives resolves
the references that wait for it; a deletion reopens the ones it had resolved.
Only references to touched targets are judged again.

Both tables lie in ``BUCKETS`` partitions by hash of kind and target, and a step
writes only the partitions its batch touches, so the work of a small batch
does not grow with the state. After every batch a snapshot of the counts can
be taken. The final state does not depend on how the history is cut.

A target that was deleted stays deleted even if it arrives again. Null
references and null target keys take no part; rows that come twice count once.
A reference without a time is never late, a target without one makes none
late; events without a time belong to the first batch. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.runtime import sized, stage, stage_buckets, table

REFS = "kind string, target string, source_table string, field_name string, record_key string, at timestamp"
EVENTS = "kind string, target string, what string, at timestamp"
_PARENTS = "kind string, target string, since timestamp, known boolean, gone boolean"
#: Partitions of the state; more of them make small batches cheaper and their files smaller.
BUCKETS = 8


@dataclass(frozen=True)
class Orphans:
    """For every bucket that holds anything the folder of its parents and of its references."""

    spark: SparkSession
    buckets: int = BUCKETS
    parent_paths: dict[int, str] = field(default_factory=dict)
    ref_paths: dict[int, str] = field(default_factory=dict)

    @staticmethod
    def empty(spark: SparkSession, buckets: int = BUCKETS) -> Orphans:
        return Orphans(spark, buckets)

    def _read(self, schema: str, paths: dict[int, str], only: set[int] | None) -> DataFrame:
        own = [p for b, p in sorted(paths.items()) if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*own) if own else self.spark.createDataFrame([], schema)

    def parents(self, only: set[int] | None = None) -> DataFrame:
        return self._read(_PARENTS, self.parent_paths, only)

    def refs(self, only: set[int] | None = None) -> DataFrame:
        """REFS with ref_state, null where the target is valid."""
        return self._read(REFS + ", ref_state string", self.ref_paths, only)


def clean_path(path: str) -> Column:
    r"""A path with \ read as / and without leading ./"""
    return F.regexp_replace(F.replace(F.col(path), F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("kind", "target"), F.lit(n)).cast("int")


def summed(events: DataFrame) -> DataFrame:
    """Events as parent rows: since when a target exists, whether an arrival is known, whether it was deleted."""
    arrives = F.col("what") == "arrive"
    return events.where(F.col("target").isNotNull()).groupBy("kind", "target").agg(
        F.min(F.when(arrives, F.col("at"))).alias("since"), F.max(arrives).alias("known"), F.max(F.col("what") == "delete").alias("gone")
    )


def merged(parents: DataFrame) -> DataFrame:
    """One row for each target."""
    return parents.groupBy("kind", "target").agg(F.min("since").alias("since"), F.max("known").alias("known"), F.max("gone").alias("gone"))


def judged(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """refs with their state against a parent index of one row per target."""
    state = F.when(F.col("gone"), "deleted").when(~F.coalesce("known", F.lit(False)), "missing").when(F.col("since") > F.col("at"), "late")
    return refs.join(sized(parents), ["kind", "target"], "left").select("kind", "target", "source_table", "field_name", "record_key", "at", state.alias("ref_state"))


def _without(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """Held references without those that the batch brings again."""
    same = reduce(Column.__and__, (old[c].eqNullSafe(F.col(f"f.{c}")) if c == "at" else old[c] == F.col(f"f.{c}") for c in fresh.columns))
    return old.join(sized(fresh).alias("f"), same, "left_anti")


def step(state: Orphans, refs: DataFrame, events: DataFrame) -> Orphans:
    """Fold a batch in: refs(REFS), and events(EVENTS) where what is arrive or delete."""
    n = state.buckets
    new = stage(summed(events), "events")
    fresh = stage(refs.where(F.col("target").isNotNull()).distinct(), "fresh")
    changed = {r[0] for r in new.select(bucket(n)).distinct().collect()}  # at most n numbers
    asked = changed | {r[0] for r in fresh.select(bucket(n)).distinct().collect()}
    if not asked:
        return state
    parents = dict(state.parent_paths)
    if changed:
        index = merged(state.parents(changed).unionByName(new))
        parents |= stage_buckets(index.withColumn("bucket", bucket(n)), "parents")
    after = Orphans(state.spark, n, parents, state.ref_paths)
    out = judged(fresh, after.parents(asked))
    if set(state.ref_paths) & asked:
        old, touched = _without(state.refs(asked), fresh), sized(new.select("kind", "target"))  # what comes again counts once
        again = judged(old.join(touched, ["kind", "target"], "left_semi").drop("ref_state"), after.parents(asked))
        out = out.unionByName(again).unionByName(old.join(touched, ["kind", "target"], "left_anti"))
    return Orphans(state.spark, n, parents, state.ref_paths | stage_buckets(out.withColumn("bucket", bucket(n)), "refs"))


def arrived(df: DataFrame, kind: str, target: Column, at: str) -> DataFrame:
    """The arrivals of targets."""
    return df.select(F.lit(kind).alias("kind"), target.cast("string").alias("target"), F.lit("arrive").alias("what"), F.col(at).cast("timestamp").alias("at"))


def deleted(df: DataFrame, kind: str, target: Column, at: str, every: bool = False) -> DataFrame:
    """The deletions of targets: rows that have a time in ``at``, or ``every`` row."""
    rows = df if every else df.where(F.col(at).isNotNull())
    return rows.select(F.lit(kind).alias("kind"), target.cast("string").alias("target"), F.lit("delete").alias("what"), F.col(at).cast("timestamp").alias("at"))


def references(df: DataFrame, kind: str, target: Column, source: str, field: str, key: str, at: str) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), target.cast("string").alias("target"), F.lit(source).alias("source_table"), F.lit(field).alias("field_name"), F.col(key).cast("string").alias("record_key"), F.col(at).cast("timestamp").alias("at"))


def inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(refs, events) of the archive's tables."""
    docs, files, bases = (table(spark, d, t) for t in ("documents", "archive_files", "knowledge_bases"))
    refs = [
        references(table(spark, d, "chunks_index"), "document", F.col("doc_id"), "chunks_index", "doc_id", "chunk_id", "created_at"),
        references(table(spark, d, "redaction_map"), "document", F.col("doc_id"), "redaction_map", "doc_id", "id", "created_at"),
        references(docs, "file", clean_path("file_path"), "documents", "file_path", "doc_id", "upload_time"),
        references(docs, "base", F.col("kb_name"), "documents", "kb_name", "doc_id", "upload_time"),
    ]
    events = [
        arrived(docs, "document", F.col("doc_id"), "upload_time"),
        deleted(table(spark, d, "doc_tombstones"), "document", F.col("doc_id"), "deleted_at", every=True),
        arrived(files, "file", clean_path("file_path"), "archived_at"),
        deleted(files, "file", clean_path("file_path"), "removed_at"),
        arrived(bases, "base", F.col("kb_name"), "created_at"),
        deleted(bases, "base", F.col("kb_name"), "deleted_at"),
    ]
    return reduce(DataFrame.unionByName, refs), reduce(DataFrame.unionByName, events)


#: Batches that the history is replayed in, and so snapshots of its counts.
PERIODS = 3


def replayed(spark: SparkSession, d: str, periods: int = PERIODS) -> Iterator[Orphans]:
    """The state after every period of the tables' history: so many even spans of the time of the references.

    References, arrivals and deletions each come at their own time; what has none comes first, what is later than all references last.
    """
    refs, events = inputs(spark, d)
    low, high = refs.agg(F.unix_seconds(F.min("at")), F.unix_seconds(F.max("at"))).first()
    state, low = Orphans.empty(spark), low or 0
    width = max(1, ((high or 0) - low) // periods + 1)
    period = F.least(F.lit(periods - 1), F.greatest(F.lit(0), F.coalesce(F.floor((F.unix_seconds("at") - F.lit(low)) / width), F.lit(0))))
    for k in range(periods):
        state = step(state, refs.where(period == k), events.where(period == k))
        yield state


def replay(spark: SparkSession, d: str, periods: int = PERIODS) -> Orphans:
    """The state after the whole history."""
    state = Orphans.empty(spark)
    for state in replayed(spark, d, periods):  # noqa: B007
        pass
    return state


def found(state: Orphans) -> DataFrame:
    """Orphan references, each once."""
    return state.refs().where(F.col("ref_state").isNotNull()).select("source_table", "field_name", "record_key", "ref_state").distinct()


def snapshot(state: Orphans) -> DataFrame:
    """Orphans counted per table, field, month of the referring row and state."""
    rows = state.refs().where(F.col("ref_state").isNotNull()).select(
        "source_table", "field_name", F.date_format(F.date_trunc("month", "at"), "yyyy-MM").alias("month"), "record_key", "ref_state"
    ).distinct()
    return rows.groupBy("source_table", "field_name", "month", "ref_state").agg(F.count(F.lit(1)).alias("orphans"))


def snapshots(spark: SparkSession, d: str, periods: int = PERIODS) -> DataFrame:
    """The counts after every period, numbered from 1; each is written before the next batch is folded in."""
    parts = [stage(snapshot(s).withColumn("period", F.lit(k + 1)), "snapshot") for k, s in enumerate(replayed(spark, d, periods))]
    return reduce(DataFrame.unionByName, parts)
