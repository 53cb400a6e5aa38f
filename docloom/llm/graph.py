"""Connected classes of a pair table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.runtime import stage


def components(pairs: DataFrame) -> DataFrame:
    """(key, class_id, links): for every key of the pairs (a, b) the smallest key it is connected to, and its number of partners.

    Min-label propagation with pointer jumping: each round a key takes the
    smallest label around it, then its label's label, so rounds grow with the
    logarithm of a class's diameter. Every round is one aggregation whose
    partial minima combine before the shuffle, written to the shared folder.
    Nothing is collected.
    """
    both = pairs.where("a <> b").select("a", "b").union(pairs.where("a <> b").select(F.col("b"), F.col("a"))).distinct()
    both = stage(both.toDF("key", "other"), "edges")
    label = stage(both.groupBy("key").agg(F.least(F.min("other"), F.first("key")).alias("label"), F.count(F.lit(1)).alias("links")), "label")
    links = label.select("key", "links")
    label = label.select("key", "label")
    while True:
        near = both.join(label.toDF("other", "label"), "other").groupBy("key").agg(F.min("label").alias("seen"))
        step = label.join(near, "key").select("key", F.least("label", "seen").alias("label"))
        jump = step.join(step.toDF("k2", "up"), F.col("label") == F.col("k2"), "left").select("key", F.least("label", F.coalesce("up", "label")).alias("label"))
        after = stage(jump, "label")
        moved = after.join(label.withColumnRenamed("label", "was"), "key").where("label <> was").isEmpty()
        label = after
        if moved:
            return label.join(links, "key").select("key", F.col("label").alias("class_id"), "links")
