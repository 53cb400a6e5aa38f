"""Groups of any size dealt into blocks, without one task for a crowded group.

Only crowded groups are treated apart. They are found from counts over all rows: first per coarse class of
keys (a bounded number of rows), then exactly for the keys of those classes that stand out. On data without
crowded groups this costs one aggregation of a few thousand rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.runtime import sized, stage

#: Coarse classes of keys, and rows that a group may have without being crowded.
COARSE, CALM = 1 << 14, 20_000


def crowded(df: DataFrame, key: str, calm: int = CALM) -> DataFrame | None:
    """(key, n, pieces) of the groups with more than ``calm`` rows and more than an average class of keys holds; None if there are none.

    df is read twice at most, so it should be staged or cheap.
    """
    coarse = F.pmod(F.xxhash64(key), F.lit(COARSE)).cast("int")
    counts = {r[0]: r[1] for r in df.groupBy(coarse.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most COARSE rows
    most = max(calm, sum(counts.values()) // COARSE)
    classes = [c for c, n in counts.items() if n > most + sum(counts.values()) // COARSE]
    if not classes:
        return None
    suspects = df.where(coarse.isin(classes)) if len(classes) <= 256 else df
    groups = suspects.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    groups = stage(groups.withColumn("pieces", F.ceil(F.col("n") / most).cast("int")), "crowded")
    return None if groups.isEmpty() else groups


def dealt(df: DataFrame, key: str, order: list[str | Column], size: int, name: str = "blk", calm: int = CALM) -> DataFrame:
    """df with ``name``: the number, from 0 and without gaps, of the block of up to ``size`` rows that each row has in its group.

    A crowded group is first cut into pieces by the hash of the order; blocks are formed in each piece and shifted by those before, so
    no task sorts a whole crowded group.
    """
    hot = crowded(df, key, calm)
    if hot is None:
        w = Window.partitionBy(key).orderBy(*order)
        return df.withColumn(name, F.floor((F.row_number().over(w) - 1) / size).cast("int"))
    piece = F.pmod(F.xxhash64(*order), F.coalesce("pieces", F.lit(1))).cast("int")
    cut = stage(df.join(sized(hot.drop("n")), key, "left").withColumn("_p", piece), "pieces")
    w = Window.partitionBy(key, "_p").orderBy(*order)
    local = cut.withColumn("_b", F.floor((F.row_number().over(w) - 1) / size).cast("int"))
    held = cut.where("pieces is not null").groupBy(key, "_p").agg(F.ceil(F.count(F.lit(1)) / size).alias("_n"))  # one row for each piece
    before = Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shift = stage(held.select(key, "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s")), "shift")
    return local.join(sized(shift), [key, "_p"], "left").withColumn(name, (F.col("_b") + F.coalesce("_s", F.lit(0))).cast("int")).drop("_p", "_b", "_s", "pieces")
