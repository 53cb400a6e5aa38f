"""Classes of exact copies, so that pairwise work is done once for each different text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.runtime import stage, text_key

#: Up to this many copies a class is written out as all its pairs; a larger one as (representative, member) pairs.
EXPAND = 32


def copies(df: DataFrame, key: str, text: str, by_text: bool = False) -> DataFrame:
    """(key, rep) of every record that repeats the text of a smaller key; one row per such record.

    With ``by_text`` the text's key ``t`` is a third column, one row per record and text, for tables whose keys may come
    with several texts: there a class is (rep, t). Null texts have no copies. The minimum per text combines on the map side,
    so a text held by a third of all rows meets its class in partial form.
    """
    marked = df.where(F.col(text).isNotNull()).select(F.col(key), text_key(text).alias("t"))
    reps = marked.groupBy("t").agg(F.min(key).alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return marked.join(reps, "t").where(F.col(key) != F.col("rep")).select(key, "rep", *["t"] * by_text).distinct()


def _class(dups: DataFrame) -> list[str]:
    """The columns that name a class in the result of copies()."""
    return [c for c in ("rep", "t") if c in dups.columns]


def _small_classes(dups: DataFrame, key: str, expand: int) -> DataFrame:
    """(rep, and t if dups has it, m: the other members in order) of the classes of up to ``expand`` records."""
    by = _class(dups)
    few = dups.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < expand).select(*by)
    return dups.join(few, by, "left_semi").groupBy(*by).agg(F.array_sort(F.collect_list(key)).alias("m"))


def copy_pairs(dups: DataFrame, key: str, expand: int = EXPAND) -> DataFrame:
    """(a, b), a < b, of records with equal text, from the staged result of copies().

    Classes of up to ``expand`` records come out as all pairs. A larger class
    comes out as (rep, member): linear in its size, and every link follows from it.
    """
    star = dups.select(F.col("rep").alias("a"), F.col(key).alias("b"))
    small = _small_classes(dups, key, expand)
    rest = (
        small.select(F.posexplode("m").alias("i", "a"), "m")
        .select("a", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("b"))
    )
    return star.unionByName(rest)


def spread(pairs: DataFrame, dups: DataFrame, key: str, expand: int = EXPAND) -> DataFrame:
    """Pairs (a, b) between representatives, also for the copies of each side; (a, b, t_a, t_b) if dups is by text.

    Only classes of up to ``expand`` records are written out; of a larger class the
    representative stands for its members, which copy_pairs() links to it.
    """
    by = _class(dups)
    few = _small_classes(dups, key, expand).select(*by, F.concat(F.array("rep"), "m").alias("m"))
    few = stage(few, "members")
    for side in ("a", "b"):
        on = [side, f"t_{side}"][: len(by)]
        pairs = (
            pairs.join(few.toDF(*on, "m"), on, "left")
            .withColumn(side, F.explode(F.coalesce("m", F.array(side))))
            .drop("m")
        )
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
