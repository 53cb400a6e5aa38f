"""Incremental upkeep of tables from streams of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators import orphans, tables


class KeyedTable:
    """A table in a folder of versions; a batch replaces all rows of the parents it names. Readers see whole versions only.

    The version in force is the highest that has been written to its end, and a batch that
    is delivered again after a failure writes the same version again, so every batch counts once. Of the versions before it the last ``keep`` stay.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, parent: str, keep: int = 2) -> None:
        self.spark, self.path, self.schema, self.parent, self.keep = spark, path.rstrip("/"), schema, parent, max(1, keep)

    def versions(self) -> list[int]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n[1:]) for n in names if n[0] == "v" and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))

    def read(self, before: int | None = None) -> DataFrame:
        known = [v for v in self.versions() if before is None or v < before]
        if not known:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{known[-1]}")

    def apply(self, batch: DataFrame, number: int) -> None:
        fresh = batch.select(*self.spark.createDataFrame([], self.schema).columns)
        tables.replace_children(self.read(before=number), fresh, self.parent).write.mode("overwrite").parquet(f"{self.path}/v{number}")
        for old in [v for v in self.versions() if v < number][: -self.keep]:  # readers of the last versions are not disturbed
            where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{old}")
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def ingest(source: DataFrame, build: Callable[[DataFrame], DataFrame], target: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Run a stream of documents through ``build`` (documents to rows) into a keyed table, batch by batch, and stop when all is read."""
    return (
        source.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda df, n: target.apply(build(df), n)).start()
    )


def windowed_counts(events: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per window and kind; rows later than ``late`` behind the newest are dropped by the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", by, "n")


class OrphanMonitor:
    """Orphan references kept up to date over batches of references and parents."""

    def __init__(self, spark: SparkSession) -> None:
        self.state = orphans.Orphans.empty(spark)

    def update(self, refs: DataFrame, events: DataFrame) -> DataFrame:
        """Fold a batch in and return the counts after it."""
        self.state = orphans.step(self.state, refs, events)
        return orphans.snapshot(self.state)
