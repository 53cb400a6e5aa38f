"""Splitting oversized texts at natural boundaries (problem 7), by bounded-quantifier regexes.

One regular expression consumes a text piece by piece. Its alternatives are
ordered by the strength of the boundary they end at: end of text, line,
sentence, clause, space; each takes as much as the limit allows but no less
than half of it, then any boundary below half, then any character. Every piece
but the first starts ``overlap`` characters before the end of the one before,
so it consumes limit - overlap of its own. All of it runs in the JVM as SQL
array functions; lengths are code points.

A null or empty text and one within the limit give no pieces. A row that comes
twice gives its pieces once. Stripped of their overlaps the pieces of a text
join to exactly the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 700, 100

#: Boundaries, strongest first, each as a lookbehind for the character (pair) a piece ends with.
BOUNDARIES = (
    r"(?<=\n)",
    r"(?<=[。！？!?；;…])|(?<=[.][ \t])",
    r"(?<=[，,、：:|）)】》])",
    r"(?<=[ \t　])",
)


def pattern(limit: int = LIMIT, overlap: int = OVERLAP) -> str:
    """The extraction regex: own text of at most limit - overlap characters, the first piece up to limit."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be under the limit")
    own = limit - overlap
    strong = [rf".{{{max(1, own // 2)},{own}}}(?:{b})" for b in BOUNDARIES]
    weak = rf".{{1,{own}}}(?:{'|'.join(BOUNDARIES)})"
    first = rf"(?:\A.{{{overlap}}})?" if overlap else ""
    return rf"(?s){first}(?:.{{1,{own}}}\z|{'|'.join(strong)}|{weak}|.{{1,{own}}})"


def pieces(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece_no from 1, start from 0, overlap, piece) of every text of more than ``limit`` characters."""
    long = df.where(F.length(text) > limit).select(F.col(key).alias(key), F.col(text).alias("_t")).distinct()
    parts = long.withColumn("_p", F.regexp_extract_all("_t", F.lit(pattern(limit, overlap)), F.lit(0)))
    ends = parts.withColumn(
        "_e", F.expr("aggregate(_p, array(0), (a, x) -> concat(a, array(element_at(a, -1) + length(x))))")
    ).withColumn("_n", F.size("_p"))
    each = ends.select(key, "_t", F.explode_outer(F.expr(
        f"transform(sequence(1, _n), i -> named_struct('no', i, 'from', _e[i - 1], 'own', _e[i] - _e[i - 1], 'back', if(i = 1, 0, {overlap})))"
    )).alias("x"))
    return each.select(
        key, F.col("x.no").alias("piece_no"), (F.col("x.from") - F.col("x.back")).alias("start"), F.col("x.back").alias("overlap"),
        F.expr("substring(_t, x.from - x.back + 1, x.own + x.back)").alias("piece"),
    )
