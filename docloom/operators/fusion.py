"""From two ranked lists to the contexts of a prompt: fusion, reranking, section expansion, packing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import patterns as P
from docloom.functions.text import citations, strip, tokens
from docloom.runtime import stage


def rrf(vector: DataFrame, keyword: DataFrame, key: str, k: int = P.RRF_K) -> DataFrame:
    """(query_id, key, fusion_score, vector_rank, keyword_rank, position) of two lists (query_id, key, rank).

    Each list gives 1 / (k + rank); a key that a list repeats keeps its first rank. Rounded to 6 places;
    equal scores keep the vector list's order before the keyword list's.
    """
    v = vector.groupBy("query_id", key).agg(F.min("rank").alias("vector_rank"))
    w = keyword.groupBy("query_id", key).agg(F.min("rank").alias("keyword_rank"))
    both = v.join(w, ["query_id", key], "full_outer")
    score = F.coalesce(1 / (F.lit(float(k)) + F.col("vector_rank")), F.lit(0.0)) + F.coalesce(1 / (F.lit(float(k)) + F.col("keyword_rank")), F.lit(0.0))
    order = Window.partitionBy("query_id").orderBy(F.desc("fusion_score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("keyword_rank"), key)
    return both.withColumn("fusion_score", F.round(score, 6)).withColumn("position", F.row_number().over(order))


def backfill(fused: DataFrame, content: DataFrame, key: str, text: str) -> DataFrame:
    """Fused hits with their content; hits without any drop out. Content is fetched last, for the ids alone."""
    return fused.join(content.where(F.col(text) != "").select(key, text), key)


Scorer = Callable[[DataFrame, str, str, str], DataFrame]


def overlap_score(hits: DataFrame, query: str, text: str, key: str) -> DataFrame:
    """Offline scorer: hits with ``s``, the share of the question's different terms that the document (its first characters) has.

    Terms are made once for each question and once for each document, not for each hit.
    """
    hits = stage(hits, "hits")  # read three times
    asked = hits.groupBy("query_id").agg(F.first(query).alias("_q")).select("query_id", F.array_distinct(tokens("_q")).alias("_qt"))
    docs = hits.groupBy(key).agg(F.first(text).alias("_d")).select(key, F.array_distinct(tokens(F.substring("_d", 1, P.RERANK_CHARS))).alias("_dt"))
    both = hits.join(asked, "query_id").join(docs, key)
    score = F.when(F.size("_qt") == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect("_qt", "_dt")) / F.size("_qt"))
    return both.withColumn("s", F.round(score, 9)).drop("_qt", "_dt")


def batch_scorer(score: Callable[[Sequence[str], Sequence[str]], Sequence[float]]) -> Scorer:
    """A scorer of an external reranking model, called with batches of questions and of documents (their first characters).

    If a call fails, or gives something else than a finite number for each pair, the pairs of that batch have no score; ``rerank``
    then leaves their questions in the order they came in.
    """

    @F.pandas_udf(T.DoubleType())
    def run(q: pd.Series, d: pd.Series) -> pd.Series:
        try:
            out = pd.to_numeric(pd.Series(list(score(q.tolist(), d.tolist()))), errors="coerce")
            return out.astype("float64") if len(out) == len(q) else pd.Series([None] * len(q), dtype="float64")
        except Exception:  # noqa: BLE001 - a model that fails must not end the search
            return pd.Series([None] * len(q), dtype="float64")

    def scorer(hits: DataFrame, query: str, text: str, key: str) -> DataFrame:  # noqa: ARG001
        s = run(F.coalesce(query, F.lit("")), F.substring(F.coalesce(text, F.lit("")), 1, P.RERANK_CHARS))
        return hits.withColumn("s", F.round(F.when(~F.isnan(s), s), 9))

    return scorer


def rerank(hits: DataFrame, query: str, text: str, key: str, top: int = P.RERANK_TOP, scorer: Scorer = overlap_score) -> DataFrame:
    """hits(query_id, key, position, query, text) in a new order: the ``top`` by the scorer's score, then the rest as they were.

    A question of which any hit has no score keeps its order, without scores.
    """
    scored = scorer(hits, query, text, key)
    whole = F.min(F.col("s").isNotNull()).over(Window.partitionBy("query_id"))
    best = Window.partitionBy("query_id").orderBy(F.desc("s"), "position")
    ranked = scored.withColumn("_ok", whole).withColumn("r", F.when(F.col("_ok"), F.row_number().over(best)).otherwise(F.lit(top + 1)))
    order = Window.partitionBy("query_id").orderBy(F.least("r", F.lit(top + 1)), "position")
    return (
        ranked.withColumn("final_position", F.row_number().over(order))
        .withColumn("rerank_score", F.when(F.col("r") <= top, F.col("s"))).drop("r", "s", "_ok")
    )


def expand(hits: DataFrame, chunks: DataFrame, limit: int = P.CONTEXTS, siblings: int = P.SECTION_CHUNKS, chars: int = P.SECTION_CHARS) -> DataFrame:
    """(query_id, context_no, chunk_id, content, chunks): hits replaced by the start of their section.

    hits(query_id, position, chunk_id, kb_name, section_id, content) are first reduced to one of each section
    (of each chunk without one) and to ``limit``, so only few rows meet the sibling join. A section of more than one chunk
    gives its first ``siblings`` by chunk id, joined and cut; one of a single chunk leaves the hit as it is.
    """
    unit = F.when(F.coalesce(F.col("section_id"), F.lit("")) != "", F.concat(F.lit("s:"), F.coalesce("kb_name", F.lit("")), F.lit("/"), "section_id")).otherwise(F.concat(F.lit("c:"), "chunk_id"))
    first = Window.partitionBy("query_id", "unit").orderBy("position")
    order = Window.partitionBy("query_id").orderBy("position")
    kept = (
        hits.withColumn("unit", unit).withColumn("n", F.row_number().over(first)).where("n = 1")
        .withColumn("context_no", F.row_number().over(order)).where(F.col("context_no") <= limit).drop("n")
    )
    wanted = kept.where("unit like 's:%'").select("kb_name", "section_id").distinct()
    w = Window.partitionBy("kb_name", "section_id").orderBy("chunk_id")
    section = (
        chunks.select("kb_name", "section_id", "chunk_id", "content").join(wanted, ["kb_name", "section_id"], "left_semi")
        .withColumn("n", F.row_number().over(w)).where(F.col("n") <= siblings)
        .groupBy("kb_name", "section_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "content"))).alias("m"))
    )
    whole = F.substring(F.array_join(F.transform("m", lambda x: x["content"]), "\n"), 1, chars)
    return kept.join(section, ["kb_name", "section_id"], "left").select(
        "query_id", "context_no", "chunk_id", F.when(F.size("m") > 1, whole).otherwise(F.col("content")).alias("content"), F.when(F.size("m") > 1, F.size("m")).otherwise(F.lit(1)).alias("chunks")
    )


def pack(contexts: DataFrame, budget: int = P.CONTEXT_CHARS) -> DataFrame:
    """(query_id, context_no, packed): contexts within a budget of characters: the one that crosses it is cut, later ones
    drop out, blank ones use neither budget nor a place."""
    body = contexts.select("query_id", "context_no", strip(F.coalesce("content", F.lit(""))).alias("body")).where("body <> ''")
    w = Window.partitionBy("query_id").orderBy("context_no").rowsBetween(Window.unboundedPreceding, -1)
    room = F.greatest(F.lit(0), F.lit(budget) - F.coalesce(F.sum(F.length("body")).over(w), F.lit(0)))
    return body.withColumn("room", room).where("room > 0").select("query_id", "context_no", F.expr("substring(body, 1, cast(room as int))").alias("packed"))


def prompts(packed: DataFrame, questions: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(query_id, prompt): the packed contexts and the question in the prompt's form. Without ``sources``
    (query_id, context_no, source) the prompt names no bases or files, as for private bases."""
    if sources is not None:
        packed = packed.join(sources, ["query_id", "context_no"], "left")
        label = F.concat(F.lit("来源："), F.coalesce("source", F.lit("未知文件")))
    else:
        label = F.lit("来源：本地片段")
    block = F.concat(F.lit("["), F.col("context_no").cast("string"), F.lit("] "), label, F.lit("\n"), "packed")
    joined = packed.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("context_no", block.alias("b")))).alias("m"))
    text = F.array_join(F.transform("m", lambda x: x["b"]), "\n\n")
    return questions.join(joined, "query_id", "left").select(
        "query_id",
        F.when(F.col("m").isNull(), F.concat(F.lit(f"【知识片段】\n{P.PROMPT_NONE}\n\n【问题】\n"), "question")).otherwise(F.concat(F.lit("【知识片段】\n"), text, F.lit("\n\n【问题】\n"), "question", F.lit(f"\n\n【回答要求】\n{P.PROMPT_RULES}"))).alias("prompt"),
    )


def cited(answers: DataFrame, answer: str, hits: str) -> DataFrame:
    """answers with ``cited``: the citation numbers within 1..hits, or the first three hits if there are none."""
    good = F.filter(citations(answer), lambda n: (n >= 1) & (n <= F.col(hits)))
    first = F.slice(F.sequence(F.lit(1), F.greatest(F.col(hits), F.lit(1))), F.lit(1), F.least(F.lit(3), F.greatest(F.col(hits), F.lit(1))))
    return answers.withColumn("cited", F.when(F.size(good) > 0, good).when(F.col(hits) > 0, first).otherwise(F.array().cast("array<int>")))


def masked(hits: DataFrame, position: str, source: str, name: str) -> DataFrame:
    """(query_id, source, masked): neutral names of an answer's sources, numbered as they first appear, with the file name's suffix."""
    first = hits.groupBy("query_id", source).agg(F.min(position).alias("_f"), F.min_by(F.coalesce(name, F.lit("")), F.struct(position, "doc_id")).alias("_n"))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("_f", source))
    return first.select("query_id", source, F.concat(F.lit("文档"), n.cast("string"), F.regexp_extract("_n", r"(?s)[^.](\.[^.]*)$", 1)).alias("masked"))
