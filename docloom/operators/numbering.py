"""Row numbers within groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.runtime import partitions, stage


def row_numbers(df: DataFrame, group: str, order: list[Column], name: str = "n") -> DataFrame:
    """df with ``name``: the number, from 1, of each row in its group by a total order.

    A window over the group would sort a group that holds a third of all rows in one task. Here the rows are
    range-partitioned by group and order, numbered within each range, and shifted by the counts of the ranges
    before: one row for each range and group, which is at most groups + ranges rows.
    """
    keys = {f"_o{i}": c for i, c in enumerate(order)}
    wide = df.withColumns(keys)
    by = [F.col(group).asc_nulls_first(), *(F.col(k).asc_nulls_first() for k in keys)]
    parts = stage(wide.repartitionByRange(max(2, partitions(df.sparkSession)), *by).withColumn("_r", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("_r", group).orderBy(*by[1:])
    inner = parts.withColumn("_i", F.row_number().over(w))
    counts = parts.groupBy(group, "_r").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(group).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(F.col(group).alias("_g"), F.col("_r").alias("_p"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_s"))
    same = F.col(group).eqNullSafe(F.col("_g")) & (F.col("_r") == F.col("_p"))
    return inner.join(shift, same, "left").withColumn(name, (F.col("_i") + F.col("_s")).cast("int")).drop("_r", "_i", "_g", "_p", "_s", *keys)
