"""The queries of the training-data problems, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import leaks, lookalike, neardup, packing, pairs, pieces, pii, spans, vectors
from docloom.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "query_log").select(F.col("id").cast("string").alias("key"), F.lit("query_log").alias("source"), "question", "answer", F.lit(False).alias("cached"))
    cache = table(spark, d, "qa_cache").select(F.col("fingerprint").alias("key"), F.lit("qa_cache").alias("source"), "question", F.col("payload").alias("answer"), F.lit(True).alias("cached"))
    return pairs.broken(log.unionByName(cache)).select(F.col("source").alias("source_table"), F.col("key").alias("record_key"), "defect")


def _near(spark: SparkSession, d: str, find: Callable[..., DataFrame]) -> DataFrame:
    chunks = table(spark, d, "chunks_index").select("chunk_id", "content")
    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), neardup.stem("filename").alias("stem"))
    content = find(chunks, "chunk_id", "content", n=5, least=80)
    names = find(files, "key", "stem", n=3)
    return content.withColumn("field_name", F.lit("content")).unionByName(names.withColumn("field_name", F.lit("filename")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d, neardup.similar_pairs).select("field_name", F.col("a").alias("key_a"), F.col("b").alias("key_b"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row for each grouped record: its class (the smallest key in it) and its number of partners."""
    return _near(spark, d, neardup.groups).select("field_name", F.col("key").alias("record_key"), "class_id", "links")


_PERSONAL = (("chunks_index", "chunk_id", "content"), ("query_log", "id", "question"), ("redaction_map", "id", "original"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    out = [pii.found(table(spark, d, t), k, c).withColumn("source_table", F.lit(t)) for t, k, c in _PERSONAL]
    rows = out[0].unionByName(out[1]).unionByName(out[2])
    return rows.select("source_table", F.col("key").alias("record_key"), "pii_type", "pii_value").distinct()


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every text with its personal details replaced by typed placeholders; repeated rows once."""
    out = [pii.redacted(table(spark, d, t), k, c).withColumn("source_table", F.lit(t)) for t, k, c in _PERSONAL]
    return out[0].unionByName(out[1]).unionByName(out[2]).select("source_table", F.col("key").alias("record_key"), "details", F.col("redacted").alias("text"))


def _disguised(spark: SparkSession, d: str, forms: bool) -> DataFrame:
    parts = (("chunks_index", "content"), ("chunk_fts", "tokens"))
    out = [lookalike.analysed(table(spark, d, t), "chunk_id", c, forms).withColumn("source_table", F.lit(t)) for t, c in parts]
    return out[0].unionByName(out[1]).withColumnRenamed("key", "record_key")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _disguised(spark, d, False).select("source_table", "record_key", F.explode("kinds").alias("char_kind")).distinct()


def p5_normal(spark: SparkSession, d: str) -> DataFrame:
    """Every text in one form, and whether it had to be changed; repeated rows once."""
    rows = _disguised(spark, d, True).select("source_table", "record_key", "changed", F.col("normal").alias("text"))
    return rows.distinct()


def p5_twins(spark: SparkSession, d: str) -> DataFrame:
    """Skeletons that several different texts share: how many texts and records, and the first record."""
    rows = _disguised(spark, d, True).select(F.sha2("skeleton", 256).alias("skeleton"), "digest", "record_key")
    alike = rows.groupBy("skeleton", "digest").agg(F.min("record_key").alias("first_key"), F.count(F.lit(1)).alias("records"))
    alike = alike.groupBy("skeleton").agg(F.count(F.lit(1)).alias("spellings"), F.sum("records").alias("records"), F.min("first_key").alias("first_key"))
    return alike.where("spellings > 1")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pairs_ = vectors.similar_vectors(table(spark, d, "vector_store").select("vec_id", "embeddings"))
    return pairs_.select(F.col("a").alias("vec_id_a"), F.col("b").alias("vec_id_b"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.pieces(table(spark, d, "chunks_index"), "chunk_id", "content").select("chunk_id").distinct()


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.pieces(table(spark, d, "chunks_index"), "chunk_id", "content")


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Every leaked test item: in how many documents it stands, and its longest run in one."""
    found = leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("run").alias("longest_run"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = spans.sharing_pairs(table(spark, d, "documents").select("doc_id", "text"))
    return pairs.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p10_shared(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document stands elsewhere too."""
    return spans.shared_share(table(spark, d, "documents").select("doc_id", "text"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p2_found, p2_groups, p3_found, p3_redacted, p5_found, p5_normal, p5_twins, p6_found, p7_found, p7_pieces, p8_packed, p9_found, p9_items, p10_found, p10_shared)}

def _jaccard_sql(field: str, rows: str, n: int) -> str:
    """Pairs by brute force over the n-gram sets of rows (k, t)."""
    return f"""SELECT '{field}' AS field_name, key_a, key_b FROM (
      WITH r AS (SELECT DISTINCT k, t FROM ({rows}) x WHERE t IS NOT NULL AND length(t) >= {n}),
      g AS (SELECT k, unnest(list_distinct(list_transform(range(1, length(t) - {n} + 2), lambda i: substring(t, i, {n})))) AS g FROM r),
      s AS (SELECT k, count(*) AS n FROM g GROUP BY k),
      both_ AS (SELECT a.k AS key_a, b.k AS key_b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.k < b.k GROUP BY 1, 2)
      SELECT key_a, key_b FROM both_ JOIN s x ON x.k = key_a JOIN s y ON y.k = key_b WHERE c >= 0.6 * (x.n + y.n - c)) z"""


_WIDE = "".join(map(chr, [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)]))
_NARROW = "".join(chr(ord(c) - 0xFEE0) for c in _WIDE)
_REDUCED = f"regexp_replace(lower(translate(text, '{_WIDE}', '{_NARROW}')), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_KINDS_SQL = {
    "full_width": "[０-９Ａ-Ｚａ-ｚ]",
    "combining": r"\p{L}[\x{300}-\x{34E}\x{350}-\x{36F}\x{20D0}-\x{20F0}\x{3099}\x{309A}]",
    "invisible": r"[\x{AD}\x{34F}\x{61C}\x{6DD}\x{70F}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FEFF}\x{FFF9}-\x{FFFB}]",
    "odd_space": r"[\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}]",
    "look_alike": r"\p{Latin}[\p{Latin}\p{M}\p{Cf}]*[\p{Greek}\p{Cyrillic}]|[\p{Greek}\p{Cyrillic}][\p{Greek}\p{Cyrillic}\p{M}\p{Cf}]*\p{Latin}|[\x{2E80}-\x{2FD5}\x{FB00}-\x{FB06}]",
}


def _kinds_sql() -> str:
    parts = [f"SELECT '{t}' AS source_table, chunk_id AS record_key, '{k}' AS char_kind FROM {t} WHERE regexp_matches({c}, '{p}')" for t, c in (("chunks_index", "content"), ("chunk_fts", "tokens")) for k, p in _KINDS_SQL.items()]
    return " UNION ".join(parts)


_NEAR_SQL = (
    _jaccard_sql("content", "SELECT chunk_id AS k, content AS t FROM chunks_index WHERE length(content) >= 80", 5)
    + " UNION ALL " + _jaccard_sql("filename", r"SELECT CAST(doc_id AS VARCHAR) AS k, lower(regexp_replace(filename, '([^.])\.[^.]*$', '\1')) AS t FROM documents", 3)
)
#: The problems whose result plain SQL can give on the whole tables, by brute force.
SQL: dict[str, str] = {
    "p2_found": _NEAR_SQL,
    "p2_groups": f"""WITH RECURSIVE pr AS ({_NEAR_SQL}), e AS (SELECT field_name, key_a AS a, key_b AS b FROM pr UNION SELECT field_name, key_b, key_a FROM pr),
      c AS (SELECT DISTINCT field_name, a AS k, a AS l FROM e UNION SELECT c.field_name, e.b, c.l FROM c JOIN e ON e.field_name = c.field_name AND e.a = c.k)
      SELECT field_name, record_key, class_id, links FROM (SELECT field_name, k AS record_key, min(l) AS class_id FROM c GROUP BY field_name, k) x
      JOIN (SELECT field_name, a AS record_key, count(*) AS links FROM e GROUP BY field_name, a) y USING (field_name, record_key)""",
    "p5_found": _kinds_sql(),
    "p6_found": """WITH v AS (SELECT DISTINCT vec_id, CAST(embeddings AS DOUBLE[]) AS v FROM vector_store WHERE len(embeddings) = 64),
      u AS (SELECT * FROM v WHERE list_dot_product(v, v) > 0),
      s AS (SELECT a.vec_id AS x, b.vec_id AS y, list_cosine_similarity(a.v, b.v) AS c FROM u a JOIN u b ON a.vec_id <> b.vec_id),
      r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY round(c, 9) DESC, y) AS n FROM s)
      SELECT DISTINCT least(x, y) AS vec_id_a, greatest(x, y) AS vec_id_b FROM r WHERE n <= 5 AND c >= 0.9""",
    "p7_found": "SELECT DISTINCT chunk_id FROM chunks_index WHERE length(content) > 700",
    "p9_found": f"""WITH d AS (SELECT doc_id, {_REDUCED} AS t FROM documents), i AS (SELECT item_id, {_REDUCED} AS t FROM eval_items),
      dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, length(t) - 58), lambda k: hash(substring(t, k, 60)))) AS g FROM d WHERE length(t) >= 60),
      ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, length(t) - 58), lambda k: hash(substring(t, k, 60)))) AS g FROM i WHERE length(t) >= 60)
      SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    "p9_items": f"""WITH d AS (SELECT DISTINCT doc_id, {_REDUCED} AS t FROM documents), i AS (SELECT DISTINCT item_id, {_REDUCED} AS t FROM eval_items),
      ig AS (SELECT item_id, x.p, x.g FROM (SELECT item_id, unnest(list_transform(range(1, length(t) - 58), lambda k: struct_pack(p := k, g := hash(substring(t, k, 60))))) AS x FROM i WHERE length(t) >= 60) y),
      dg AS (SELECT doc_id, x.p, x.g FROM (SELECT doc_id, unnest(list_transform(range(1, length(t) - 58), lambda k: struct_pack(p := k, g := hash(substring(t, k, 60))))) AS x FROM d WHERE length(t) >= 60) y WHERE x.g IN (SELECT g FROM ig)),
      m AS (SELECT doc_id, item_id, dg.p - ig.p AS diagonal, dg.p AS p FROM dg JOIN ig USING (g)),
      r AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY p) AS run_no FROM m),
      runs AS (SELECT doc_id, item_id, count(*) + 59 AS run FROM r GROUP BY doc_id, item_id, diagonal, run_no)
      SELECT item_id, count(DISTINCT doc_id) AS documents, max(run) AS longest_run FROM runs GROUP BY item_id""",
    "p10_shared": """WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 200),
      g AS (SELECT doc_id, x.p, x.h FROM (SELECT doc_id, unnest(list_transform(range(1, length(text) - 198), lambda k: struct_pack(p := k, h := hash(substring(text, k, 200))))) AS x FROM d) y),
      s AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(DISTINCT doc_id) > 1))
      SELECT doc_id, chars, shared_chars, shared_chars / chars AS share FROM (SELECT doc_id, CAST(sum(CASE WHEN before IS NULL THEN 200 ELSE least(200, p - before) END) AS BIGINT) AS shared_chars FROM s GROUP BY doc_id) z
      JOIN (SELECT doc_id, max(length(text)) AS chars FROM documents GROUP BY doc_id) c USING (doc_id)""",
    "p10_found": """WITH g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, length(text) - 198), lambda k: hash(substring(text, k, 200)))) AS g FROM documents WHERE length(text) >= 200),
      r AS (SELECT * FROM g WHERE g IN (SELECT g FROM g GROUP BY g HAVING count(*) > 1))
      SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id""",
}
