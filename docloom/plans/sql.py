"""Pieces of DuckDB SQL that several checks share."""

from __future__ import annotations


#: A placeholder, as RE2 reads it.
MARK = r"\[[\p{L}_][\p{L}\p{M}\p{Nd}_·]{0,19}\p{Nd}{1,4}\]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def collapse(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '[\s\p{{Z}}]+', ' ', 'g'))"


def tokens(x: str) -> str:
    low = f"lower(coalesce({x}, ''))"
    runs = f"regexp_extract_all({low}, '[㐀-䶿一-鿿豈-﫿]+')"
    pairs = "CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substring(r, i, 2)) END"
    return f"list_concat(regexp_extract_all({low}, '[a-z0-9]+'), flatten(list_transform({runs}, lambda r: {pairs})))"


CHUNKS = "chunks AS (SELECT DISTINCT chunk_id, content FROM chunks_index)"


def bm25(queries: str, scope: str = "") -> str:
    """CTEs from questions (a query with query_id, text) to scores(query_id, chunk_id, score) and keyword(…, rank)."""
    return f"""{CHUNKS},
tokened AS (SELECT chunk_id, {tokens('content')} AS t FROM chunks),
stats AS (SELECT count(*) AS n_docs, avg(len(t)) AS avg_len FROM tokened),
tf AS (SELECT chunk_id, len, token, count(*) AS tf FROM (SELECT chunk_id, len(t) AS len, unnest(t) AS token FROM tokened) x GROUP BY chunk_id, len, token),
df AS (SELECT token, count(*) AS n FROM tf GROUP BY token),
questions AS ({queries}),
terms AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest(({tokens('text')})[1:32]) AS token FROM questions) x GROUP BY query_id, token),
weights AS (SELECT token, avg_len, CASE WHEN (n_docs - n + 0.5) / (n + 0.5) > 1 THEN ln((n_docs - n + 0.5) / (n + 0.5)) ELSE 1e-6 END AS idf FROM df CROSS JOIN stats),
scores AS (
  SELECT query_id, chunk_id, -sum(times * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS score
  FROM terms JOIN tf USING (token) JOIN weights USING (token) {scope} GROUP BY query_id, chunk_id),
keyword AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), chunk_id) AS rank FROM scores) x WHERE rank <= 20)"""


#: CTEs to vector(query_id, vec_id, chunk_id, similarity, rank): stored vectors searched by those with an id divisible by 20.
VECTOR = """usable AS (
  SELECT vec_id, chunk_id, kb_name, v FROM (SELECT DISTINCT vec_id, chunk_id, kb_name, CAST(embeddings AS DOUBLE[]) AS v FROM vector_store) x
  WHERE len(v) = 64 AND list_dot_product(v, v) > 0),
sims AS (SELECT q.vec_id AS query_id, r.vec_id, r.chunk_id, r.kb_name, greatest(0, list_cosine_similarity(q.v, r.v)) AS similarity FROM usable q, usable r WHERE q.vec_id % 20 = 0),
vector AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, vec_id) AS rank FROM sims) x WHERE rank <= 20)"""

ASKED = "SELECT vec_id AS query_id, content AS text FROM usable JOIN (SELECT DISTINCT chunk_id, content FROM chunks_index) c USING (chunk_id) WHERE vec_id % 20 = 0"

FUSED = """vlist AS (SELECT query_id, chunk_id, min(rank) AS vector_rank FROM vector GROUP BY query_id, chunk_id),
klist AS (SELECT query_id, chunk_id, min(rank) AS keyword_rank FROM keyword GROUP BY query_id, chunk_id),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, vector_rank ASC NULLS LAST, keyword_rank ASC NULLS LAST, chunk_id) AS position FROM (
  SELECT query_id, chunk_id, vector_rank, keyword_rank, round(coalesce(1 / (60.0 + vector_rank), 0) + coalesce(1 / (60.0 + keyword_rank), 0), 6) AS fusion_score
  FROM vlist FULL JOIN klist USING (query_id, chunk_id)) x)"""

HYBRID = f"WITH {VECTOR}, {bm25(ASKED)}, {FUSED}"
