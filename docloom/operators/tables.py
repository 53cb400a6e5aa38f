"""Keyed changes of tables as relational operators: every function gives the table as it is after the change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.numbering import row_numbers


def latest(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row for each key: the last in the given order (total, so that reruns agree)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the rows of new put in place of those with the same key; new has each key once."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with those rows of new whose key it lacks."""
    return old.unionByName(new.join(old.select(*key), key, "left_anti"))


def replace_children(rows: DataFrame, fresh: DataFrame, parent: str) -> DataFrame:
    """All rows of the parents that fresh names give way to fresh's rows: delete by parent, then insert, as one result."""
    return rows.join(fresh.select(parent).distinct(), parent, "left_anti").unionByName(fresh)


def delete(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def collision_names(df: DataFrame, group: str, name: str, order: str) -> DataFrame:
    """df with ``stored_name``: names that come again within a group get _1, _2… before their suffix."""
    df = row_numbers(df.withColumn("_k", F.struct(group, name)), "_k", [F.col(order)], "_n").drop("_k")  # a name may come very often
    n = F.col("_n") - 1
    ext = F.regexp_extract(name, r"(?s)[^.](\.[^.]*)$", 1)
    base = F.substring(F.col(name), F.lit(1), F.length(name) - F.length(ext))
    return df.withColumn("stored_name", F.when(n == 0, F.col(name)).otherwise(F.concat(base, F.lit("_"), n.cast("string"), ext))).drop("_n")


def per_key_counts(df: DataFrame, key: str, alias: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(alias))


def touch_sessions(sessions: DataFrame, touched: DataFrame) -> DataFrame:
    """sessions(session_id, title, kb_names, created_at, updated_at) after touches(session_id, title, kb_names, at): unknown ones are
    inserted, known ones get the last touch's time, and its title and bases only if it has a title."""
    last = latest(touched.where(F.col("session_id") != ""), ["session_id"], F.desc("at")).select("session_id", F.coalesce("title", F.lit("")).alias("_t"), F.col("kb_names").alias("_k"), "at")
    named = latest(touched.where((F.col("session_id") != "") & (F.coalesce("title", F.lit("")) != "")), ["session_id"], F.desc("at")).select("session_id", F.col("title").alias("_nt"), F.col("kb_names").alias("_nk"))
    both = sessions.join(last, "session_id", "full_outer").join(named, "session_id", "left")
    return both.select(
        "session_id", F.coalesce("_nt", "title", F.lit("")).alias("title"), F.coalesce("_nk", "kb_names", "_k").alias("kb_names"),
        F.coalesce("created_at", "at").alias("created_at"), F.coalesce("at", "updated_at").alias("updated_at"),
    )
