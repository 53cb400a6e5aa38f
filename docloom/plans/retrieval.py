"""Retrieval queries: keyword, vector and hybrid search, expansion and packing.

Questions are the passages of eval_items for keyword search. For vector and
hybrid search they are the stored vectors whose id is divisible by 20, with
the content of their chunks as text, against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import patterns as P
from docloom.functions.text import index_text, tokens
from docloom.operators import fusion, keyword, vector
from docloom.plans import sql
from docloom.runtime import once, stage, table


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "chunks_index").select("chunk_id", "content"), "chunk_id")


def tokenize_terms(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.size(tokens("text")).alias("n_tokens"), F.md5(index_text("text")).alias("terms_md5"))


def _keyword(spark: SparkSession, d: str, scope: DataFrame | None = None) -> DataFrame:
    return keyword.bm25_top(_chunks(spark, d), table(spark, d, "eval_items"), "chunk_id", "content", "item_id", "text", P.KEYWORD_CANDIDATES, scope)


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _keyword(spark, d).withColumn("score", F.round("score", 6))


def bm25_scoped(spark: SparkSession, d: str) -> DataFrame:
    """Only chunks of private bases, with the statistics of all chunks."""
    private = table(spark, d, "knowledge_bases").where("mode = 'privacy'").select("kb_name")
    scope = table(spark, d, "chunks_index").join(private, "kb_name", "left_semi").select("chunk_id")
    return _keyword(spark, d, scope).withColumn("score", F.round("score", 6))


def keyword_index(spark: SparkSession, d: str) -> DataFrame:
    """The inverted index: for every term the number of chunks and occurrences."""
    held = _chunks(spark, d).select("chunk_id", F.explode_outer(tokens("content")).alias("token")).where("token is not null")
    per = held.groupBy("token", "chunk_id").agg(F.count(F.lit(1)).alias("tf"))
    return per.groupBy("token").agg(F.count(F.lit(1)).alias("chunks"), F.sum("tf").alias("occurrences"))


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    best = vector.cosine_top(rows, rows.where("vec_id % 20 = 0"), "vec_id", "embedding", P.VECTOR_CANDIDATES)
    return best.withColumn("similarity", F.round("similarity", 6))


def cosine_per_kb_merge(spark: SparkSession, d: str) -> DataFrame:
    """The best of each label first, then of all."""
    rows = table(spark, d, "embeddings")
    per = vector.cosine_top(rows, rows.where("vec_id % 20 = 0"), "vec_id", "embedding", P.VECTOR_CANDIDATES, group="label")
    return vector.merge_groups(per, "vec_id", P.VECTOR_CANDIDATES).withColumn("similarity", F.round("similarity", 6))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vector_store").select("vec_id", "chunk_id", "kb_name", "embeddings").distinct()


def _vector(spark: SparkSession, d: str) -> DataFrame:
    rows = _stored(spark, d)
    best = vector.cosine_top(rows, rows.where("vec_id % 20 = 0"), "vec_id", "embeddings", P.VECTOR_CANDIDATES)
    return best.join(rows.select("vec_id", "chunk_id"), "vec_id")


def vector_search(spark: SparkSession, d: str) -> DataFrame:
    return _vector(spark, d).select("query_id", "vec_id", "chunk_id", F.round("similarity", 6).alias("similarity"), "rank")


def vector_scoped(spark: SparkSession, d: str) -> DataFrame:
    """Each query vector among the vectors of its own base."""
    rows = _stored(spark, d)
    best = vector.cosine_top(rows, rows.where("vec_id % 20 = 0"), "vec_id", "embeddings", 5, within="kb_name")
    return best.select("query_id", "vec_id", "kb_name", F.round("similarity", 6).alias("similarity"), "rank")


def vector_in_document(spark: SparkSession, d: str) -> DataFrame:
    """Each query vector among the vectors of its own document's chunks."""
    held = table(spark, d, "chunks_index").where("doc_id is not null").select("chunk_id", "doc_id").distinct()
    rows = _stored(spark, d).select("vec_id", "chunk_id", "embeddings").join(held, "chunk_id")
    best = vector.cosine_top(rows, rows.where("vec_id % 20 = 0"), "vec_id", "embeddings", 5, within="doc_id")
    return best.select("query_id", "vec_id", "doc_id", F.round("similarity", 6).alias("similarity"), "rank")


def masked_sources(spark: SparkSession, d: str) -> DataFrame:
    """The documents behind each test passage's hits under neutral names, numbered in the order in which they first appear."""
    docs = table(spark, d, "documents").select("doc_id", "filename", F.coalesce(F.when(F.col("file_path") != "", F.col("file_path")), F.col("filename")).alias("source"))
    held = table(spark, d, "chunks_index").select("chunk_id", "doc_id").distinct()
    hits = _keyword(spark, d).select("query_id", "chunk_id", "rank").join(held, "chunk_id").join(docs, "doc_id").where("source <> ''")
    return fusion.masked(hits, "rank", "source", "filename").select("query_id", "source", "masked")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, text) of the stated query set: usable vectors alone."""
    good = (F.size("embeddings") == 64) & F.exists("embeddings", lambda x: x != 0)
    asked = _stored(spark, d).where("vec_id % 20 = 0").where(good)
    # repeated chunks are dropped behind the join, where few rows are left
    held = table(spark, d, "chunks_index").select("chunk_id", "content")
    return asked.join(held, "chunk_id").select(F.col("vec_id").alias("query_id"), F.col("content").alias("text")).distinct()


def _fused(spark: SparkSession, d: str) -> DataFrame:
    found = keyword.bm25_top(_chunks(spark, d), _questions(spark, d), "chunk_id", "content", "query_id", "text", P.KEYWORD_CANDIDATES)
    return fusion.rrf(_vector(spark, d).select("query_id", "chunk_id", "rank"), found.select("query_id", "chunk_id", "rank"), "chunk_id")


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).withColumn("vector_rank", F.coalesce("vector_rank", F.lit(0))).withColumn("keyword_rank", F.coalesce("keyword_rank", F.lit(0)))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return fusion.backfill(_fused(spark, d), table(spark, d, "chunks_index").select("chunk_id", "content"), "chunk_id", "content").distinct()


def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 hits that have content, with where it came from."""
    hits = _hits(spark, d).withColumn("source", F.when(F.col("vector_rank").isNull(), "keyword").when(F.col("keyword_rank").isNull(), "vector").otherwise("both"))
    hits = keyword.top(hits.withColumn("p", F.col("position").cast("double")), "p", "chunk_id", P.VECTOR_CANDIDATES)
    return hits.select("query_id", "chunk_id", "rank", "source", "fusion_score", F.length("content").alias("chars"))


def _reranked(spark: SparkSession, d: str) -> DataFrame:
    asked = _questions(spark, d).select("query_id", F.col("text").alias("question"))
    return fusion.rerank(_hits(spark, d).join(asked, "query_id"), "question", "content", "chunk_id")


def rerank_blend(spark: SparkSession, d: str) -> DataFrame:
    return _reranked(spark, d).select("query_id", "chunk_id", "final_position", F.coalesce(F.round("rerank_score", 6), F.lit(-1.0)).alias("rerank_score"), "position")


def _expanded(spark: SparkSession, d: str) -> DataFrame:
    """Keyword hits of the test passages, expanded to their sections."""
    chunks = stage(once(table(spark, d, "chunks_index").select("chunk_id", "kb_name", "section_id", "content"), "chunk_id"), "chunks")
    hits = _keyword(spark, d).withColumnRenamed("rank", "position").join(chunks, "chunk_id").where("content <> ''")
    return fusion.expand(hits, chunks)


def section_expand(spark: SparkSession, d: str) -> DataFrame:
    return _expanded(spark, d).select("query_id", "context_no", "chunk_id", "chunks", F.length("content").alias("chars"), F.md5("content").alias("content_md5"))


def context_pack(spark: SparkSession, d: str) -> DataFrame:
    """Contexts within 5,000 characters, so that the budget binds on these sections."""
    return fusion.pack(_expanded(spark, d), 5000).select("query_id", "context_no", F.length("packed").alias("chars"), F.md5("packed").alias("packed_md5"))


def prompt_build(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return fusion.prompts(fusion.pack(_expanded(spark, d)), asked).select("query_id", F.length("prompt").alias("chars"), F.md5("prompt").alias("prompt_md5"))


def section_fetch(spark: SparkSession, d: str) -> DataFrame:
    """The first chunks of every section, by chunk id."""
    from pyspark.sql import Window

    rows = table(spark, d, "chunks_index").where("section_id <> ''").select("kb_name", "section_id", "chunk_id", "content").distinct()
    w = Window.partitionBy("kb_name", "section_id").orderBy("chunk_id")
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= P.SECTION_CHUNKS).select("kb_name", "section_id", "n", "chunk_id", F.length("content").alias("chars"))


QUERIES = {f.__name__: f for f in (vector_scoped, vector_in_document, masked_sources, tokenize_terms, bm25_topk, bm25_scoped, keyword_index, cosine_topk, cosine_per_kb_merge, vector_search, rrf_fusion, hybrid_topk, rerank_blend, section_expand, context_pack, prompt_build, section_fetch)}

_ITEMS = sql.bm25("SELECT item_id AS query_id, text FROM eval_items")
_COS = """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
sims AS (SELECT q.vec_id AS query_id, r.vec_id, r.label, greatest(0, list_cosine_similarity(q.v, r.v)) AS similarity FROM e q, e r WHERE q.vec_id % 20 = 0)"""
_EXPANDED = f"""WITH {_ITEMS},
full_chunks AS (SELECT DISTINCT chunk_id, kb_name, section_id, content FROM chunks_index),
hits AS (SELECT k.query_id, k.rank AS position, f.*, CASE WHEN coalesce(section_id, '') <> '' THEN 's:' || coalesce(kb_name, '') || '/' || section_id ELSE 'c:' || chunk_id END AS unit FROM keyword k JOIN full_chunks f USING (chunk_id) WHERE content <> ''),
firsts AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS context_no FROM (SELECT *, row_number() OVER (PARTITION BY query_id, unit ORDER BY position) AS n FROM hits) x WHERE n = 1),
sections AS (SELECT kb_name, section_id, count(*) AS n, left(string_agg(content, chr(10) ORDER BY chunk_id), 3000) AS body FROM (SELECT *, row_number() OVER (PARTITION BY kb_name, section_id ORDER BY chunk_id) AS rn FROM full_chunks WHERE section_id <> '') x WHERE rn <= 8 GROUP BY kb_name, section_id),
expanded AS (SELECT query_id, context_no, f.chunk_id, CASE WHEN s.n > 1 THEN s.body ELSE f.content END AS content, CASE WHEN s.n > 1 THEN s.n ELSE 1 END AS chunks FROM firsts f LEFT JOIN sections s ON f.kb_name = s.kb_name AND f.section_id = s.section_id WHERE context_no <= 6)"""
_PACKED = f"""{_EXPANDED},
bodies AS (SELECT query_id, context_no, {sql.strip("coalesce(content, '')")} AS body FROM expanded),
rooms AS (SELECT *, %d - coalesce(sum(length(body)) OVER (PARTITION BY query_id ORDER BY context_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM bodies WHERE body <> ''),
packed AS (SELECT query_id, context_no, substring(body, 1, CAST(room AS BIGINT)) AS packed FROM rooms WHERE room > 0)"""

SQL = {
    "tokenize_terms": f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS terms_md5 FROM (SELECT doc_id, {sql.tokens('text')} AS t FROM documents) x",
    "bm25_topk": f"WITH {_ITEMS} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM keyword",
    "bm25_scoped": f"WITH {sql.bm25('SELECT item_id AS query_id, text FROM eval_items', scope='WHERE chunk_id IN (SELECT chunk_id FROM chunks_index JOIN knowledge_bases k USING (kb_name) WHERE k.mode = $$privacy$$)')} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM keyword".replace("$$", "'"),
    "keyword_index": f"WITH {sql.CHUNKS} SELECT token, count(DISTINCT chunk_id) AS chunks, count(*) AS occurrences FROM (SELECT chunk_id, unnest({sql.tokens('content')}) AS token FROM chunks) x GROUP BY token",
    "cosine_topk": f"{_COS} SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, vec_id) AS rank FROM sims) x WHERE rank <= 20",
    "cosine_per_kb_merge": f"{_COS} SELECT query_id, vec_id, label, round(similarity, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, vec_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY round(similarity, 9) DESC, vec_id) AS own FROM sims) y WHERE own <= 20) x WHERE rank <= 20",
    "vector_scoped": f"WITH {sql.VECTOR} SELECT query_id, vec_id, kb_name, round(similarity, 6) AS similarity, rank FROM (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, s.vec_id) AS rank FROM sims s JOIN usable u ON u.vec_id = s.query_id AND u.kb_name = s.kb_name) x WHERE rank <= 5",
    "vector_in_document": f"WITH {sql.VECTOR}, h AS (SELECT DISTINCT chunk_id, doc_id FROM chunks_index WHERE doc_id IS NOT NULL), w AS (SELECT vec_id, doc_id FROM usable JOIN h USING (chunk_id)) SELECT query_id, vec_id, doc_id, round(similarity, 6) AS similarity, rank FROM (SELECT s.query_id, s.vec_id, b.doc_id, s.similarity, row_number() OVER (PARTITION BY s.query_id ORDER BY round(similarity, 9) DESC, s.vec_id) AS rank FROM sims s JOIN w a ON a.vec_id = s.query_id JOIN w b ON b.vec_id = s.vec_id AND a.doc_id = b.doc_id) x WHERE rank <= 5",
    "masked_sources": rf"""WITH {_ITEMS}, h AS (SELECT DISTINCT chunk_id, doc_id FROM chunks_index), o AS (SELECT doc_id, filename, coalesce(nullif(file_path, ''), filename) AS source FROM documents),
      f AS (SELECT query_id, source, min(rank) AS first, min_by(coalesce(filename, ''), (rank, doc_id)) AS filename FROM keyword JOIN h USING (chunk_id) JOIN o USING (doc_id) WHERE source <> '' GROUP BY query_id, source)
      SELECT query_id, source, '文档' || row_number() OVER (PARTITION BY query_id ORDER BY first, source) || regexp_extract(filename, '(?s)[^.](\.[^.]*)$', 1) AS masked FROM f""",
    "vector_search": f"WITH {sql.VECTOR} SELECT query_id, vec_id, chunk_id, round(similarity, 6) AS similarity, rank FROM vector",
    "rrf_fusion": f"{sql.HYBRID} SELECT query_id, chunk_id, coalesce(vector_rank, 0) AS vector_rank, coalesce(keyword_rank, 0) AS keyword_rank, fusion_score, position FROM fused",
    "hybrid_topk": f"{sql.HYBRID}, h AS (SELECT f.*, c.content FROM fused f JOIN chunks c USING (chunk_id) WHERE c.content <> '') SELECT query_id, chunk_id, rank, CASE WHEN vector_rank IS NULL THEN 'keyword' WHEN keyword_rank IS NULL THEN 'vector' ELSE 'both' END AS source, fusion_score, length(content) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS rank FROM h) x WHERE rank <= 20",
    "rerank_blend": f"""{sql.HYBRID}, h AS (SELECT f.query_id, f.chunk_id, f.position, round(len(list_intersect(list_distinct({sql.tokens('q.text')}), {sql.tokens('substring(c.content, 1, 2000)')})) / greatest(1, len(list_distinct({sql.tokens('q.text')}))), 9) AS s
      FROM fused f JOIN chunks c USING (chunk_id) JOIN questions q USING (query_id) WHERE c.content <> ''),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, position) AS r FROM h)
    SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY least(r, 9), position) AS final_position, CASE WHEN r <= 8 THEN round(s, 6) ELSE -1.0::DOUBLE END AS rerank_score, position FROM r""",
    "section_expand": f"{_EXPANDED} SELECT query_id, context_no, chunk_id, chunks, length(content) AS chars, md5(content) AS content_md5 FROM expanded",
    "context_pack": f"{_PACKED % 5000} SELECT query_id, context_no, length(packed) AS chars, md5(packed) AS packed_md5 FROM packed",
    "prompt_build": f"""{_PACKED % 12000}, joined AS (SELECT query_id, string_agg('[' || context_no || '] 来源：本地片段' || chr(10) || packed, chr(10) || chr(10) ORDER BY context_no) AS b FROM packed GROUP BY query_id),
    p AS (SELECT q.query_id, CASE WHEN b IS NULL THEN '【知识片段】' || chr(10) || '（无）' || chr(10) || chr(10) || '【问题】' || chr(10) || q.text
      ELSE '【知识片段】' || chr(10) || b || chr(10) || chr(10) || '【问题】' || chr(10) || q.text || chr(10) || chr(10) || '【回答要求】' || chr(10) || '给出结论，并在每条结论后用 [编号] 标注来源；若资料不足请直接说明。' END AS prompt FROM questions q LEFT JOIN joined USING (query_id))
    SELECT query_id, length(prompt) AS chars, md5(prompt) AS prompt_md5 FROM p""",
    "section_fetch": "SELECT kb_name, section_id, n, chunk_id, length(content) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY kb_name, section_id ORDER BY chunk_id) AS n FROM (SELECT DISTINCT kb_name, section_id, chunk_id, content FROM chunks_index WHERE section_id <> '') x) y WHERE n <= 8",
}
