"""Routing and modes: which bases a question reaches and how strictly it is handled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import strip
from docloom.runtime import sized


def scope_list(joined: Column | str, mark: str = "、") -> Column:
    """Different, stripped, non-empty names of a joined list, in order."""
    c = F.col(joined) if isinstance(joined, str) else joined
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), mark), strip), lambda x: x != ""))


def route(questions: DataFrame, selected: str, available: DataFrame, name: str) -> DataFrame:
    """questions with routed, missing and outcome: names that no longer exist drop out; the outcome says whether none were
    chosen, all are gone, some are gone or all are there. With no base at all available nothing is checked.

    The available names are one bounded array (bases, not documents), joined as a single row.
    """
    names = available.agg(F.collect_set(name).alias("_all"))
    rows = questions.crossJoin(F.broadcast(names))  # a single row
    chosen = scope_list(selected)
    keep = F.when(F.size("_all") == 0, chosen).otherwise(F.array_intersect(chosen, "_all"))
    gone = F.when(F.size("_all") == 0, F.array().cast("array<string>")).otherwise(F.array_except(chosen, "_all"))
    outcome = F.when(F.size(chosen) == 0, "none_selected").when(F.size(keep) == 0, "all_missing").when(F.size(gone) > 0, "some_missing").otherwise("ok")
    return rows.select(*questions.columns, keep.alias("routed"), gone.alias("missing"), outcome.alias("outcome"))


def route_document(documents: DataFrame, base: str, available: DataFrame, name: str) -> DataFrame:
    """documents with routed and outcome, for questions about one document: its base alone counts, whatever bases are chosen.

    A document without a base has no_base, one whose base is gone gone; with no base at all available nothing is checked.
    """
    own = strip(F.coalesce(F.col(base), F.lit("")))
    if available.isEmpty():
        there = documents.withColumn("_there", F.lit(True))
    else:
        names = sized(available.select(F.col(name).alias("_own"), F.lit(True).alias("_there")).distinct())
        there = documents.withColumn("_own", own).join(names, "_own", "left")
    outcome = F.when(own == "", "no_base").when(F.coalesce("_there", F.lit(False)), "ok").otherwise("gone")
    return there.select(*documents.columns, F.when(outcome == "ok", own).alias("routed"), outcome.alias("outcome"))


def resolve_mode(questions: DataFrame, key: str, selected: str, bases: DataFrame, name: str, mode: str) -> DataFrame:
    """(key, mode): private if any base of the question is; unknown bases are normal."""
    private = sized(bases.where(F.col(mode) == "privacy").select(name).distinct().withColumn("_p", F.lit(True)))
    each = questions.select(key, F.explode_outer(scope_list(selected)).alias(name)).join(private, name, "left")
    return each.groupBy(key).agg(F.when(F.max(F.coalesce("_p", F.lit(False))), "privacy").otherwise("normal").alias("mode"))
