"""Redaction queries on forms derived from customers, and on the archive's own placeholders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import patterns as P
from docloom.functions.text import entity_label, matches, placeholders, restore, segments
from docloom.models import recognised
from docloom.operators import redaction as R
from docloom.runtime import once, stage, table


def _digits(n: int, k: str = "c_custkey") -> str:
    return f"right('00000000000000000000' || CAST(({k} * 7919 + 104729) * 1000003 AS STRING), {n})"


#: A form for every customer, as SQL that Spark and DuckDB both read.
FORM = (
    "'姓名：' || translate(right('000' || CAST(c_custkey % 997 AS STRING), 3), '0123456789', '赵钱孙李周吴郑王冯陈') || ' 联系电话：138' || " + _digits(8)
    + " || '，身份证号：' || " + _digits(17) + " || CASE WHEN c_custkey % 3 = 0 THEN 'X' ELSE '5' END || '。联系地址：新安市临江区和平路' || CAST(c_custkey % 500 AS STRING) || '号；合同编号：HT-2024-' || " + _digits(6)
    + " || chr(10) || '|工作单位|' || CAST(c_custkey % 90 AS STRING) || '号建设银行|出生日期|19' || right('00' || CAST(50 + c_custkey % 50 AS STRING), 2) || '-0' || CAST(1 + c_custkey % 9 AS STRING) || '-12|' || chr(10) || '卡号 62' || " + _digits(15)
    + " || ' 副卡 6222-' || " + _digits(4) + " || '-' || " + _digits(4, "(c_custkey + 7)") + " || '-' || " + _digits(4, "(c_custkey + 11)")
    + " || ' 热线 400-' || " + _digits(3) + " || '-' || " + _digits(4) + " || ' 座机 (010)-' || " + _digits(8) + " || ' 邮箱 u' || CAST(c_custkey AS STRING) || '@mail.example 备注：甲方'"
)


def forms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("form_id"), F.expr(FORM.replace("chr(10)", "char(10)")).alias("text"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """All chunk contents and forms under one key."""
    chunks = once(table(spark, d, "chunks_index").where("content is not null").select(F.col("chunk_id").alias("key"), F.col("content").alias("text")), "key")
    return chunks.unionByName(forms(spark, d).select(F.col("form_id").cast("string").alias("key"), "text"))


def _rule(spark: SparkSession, d: str, index: int) -> DataFrame:
    _, pattern, _ = P.NUMBER_RULES[index]
    return _texts(spark, d).select("key", F.explode_outer(matches("text", "(?Ud)" + pattern)).alias("m")).where("m is not null").select("key", "m.value")


def pii_idcard(spark: SparkSession, d: str) -> DataFrame:
    return _rule(spark, d, 0)


def pii_credit_code(spark: SparkSession, d: str) -> DataFrame:
    return _rule(spark, d, 1)


def pii_email(spark: SparkSession, d: str) -> DataFrame:
    return _rule(spark, d, 2)


def pii_phone(spark: SparkSession, d: str) -> DataFrame:
    return _rule(spark, d, 3)


def pii_hotline(spark: SparkSession, d: str) -> DataFrame:
    return _rule(spark, d, 4)


def pii_bankcard(spark: SparkSession, d: str) -> DataFrame:
    return _rule(spark, d, 5)


def pii_landline(spark: SparkSession, d: str) -> DataFrame:
    return _rule(spark, d, 7)


def pii_bankcard_grouped(spark: SparkSession, d: str) -> DataFrame:
    return _rule(spark, d, 6)


def pii_recognised(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk's and form's spans of the offline recogniser, before they are united with the rules'."""
    found = recognised(_texts(spark, d), "text")
    return found.select("key", F.explode_outer("recognised").alias("s")).where("s is not null").select("key", "s.value", "s.label", "s.priority")


def _labelled(spark: SparkSession, d: str, tables: bool) -> DataFrame:
    spans = R.field_spans("text", tables=tables, lines=not tables)
    return _texts(spark, d).select("key", F.explode_outer(spans).alias("s")).where("s is not null").select("key", "s.start", "s.value", "s.label")


def pii_labelled(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d, False)


def pii_table_labelled(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d, True).select("key", "value", "label")


def pii_resolve(spark: SparkSession, d: str) -> DataFrame:
    found = R.detected(_texts(spark, d), "text")
    return found.select("key", F.explode_outer("spans").alias("s")).where("s is not null").select("key", "s.start", "s.stop", "s.value", "s.label", "s.source", "s.priority")


def pii_allocate(spark: SparkSession, d: str) -> DataFrame:
    """Numbers for the stored originals in order of their rows: one for each different original of a label."""
    rows = table(spark, d, "redaction_map").where("original is not null").select("id", entity_label("entity_type").alias("label"), F.col("original").alias("value"), F.lit(0).alias("start")).distinct()
    return R.allocated(rows, ["id"])


def pii_hit_count(spark: SparkSession, d: str) -> DataFrame:
    """Different placeholders of each chunk, summed by document."""
    rows = table(spark, d, "chunks_index").select("chunk_id", "doc_id", "content").distinct()
    per = rows.select("doc_id", F.size(F.array_distinct(placeholders("content"))).alias("n"))
    return per.groupBy("doc_id").agg(F.sum("n").alias("hits")).where("hits > 0")


def used_numbers(texts: DataFrame, stored: DataFrame) -> DataFrame:
    """(label, original, n) of the placeholders that texts(text) or rows of stored(id, placeholder, original) hold.

    The first row of a placeholder has its original, and an original of a label one number; other numbers come
    without an original, so that they are not given again.
    """
    held = texts.select(F.explode(F.array_distinct(placeholders("text"))).alias("placeholder")).distinct().withColumn("original", F.lit(None).cast("string"))
    first = stored.where("placeholder is not null").groupBy("placeholder").agg(F.min_by("original", "id").alias("original"))
    parts = held.unionByName(first).select("original", *(F.regexp_extract("placeholder", P.NUMBERED, k).alias(c) for k, c in ((1, "label"), (2, "n"))))
    numbers = parts.select("label", "original", F.expr("try_cast(n AS bigint)").alias("n")).where("n is not null")
    return numbers.groupBy("label", "original").agg(F.when(F.col("original").isNull(), F.max("n")).otherwise(F.min("n")).alias("n")).unionByName(
        numbers.where("original is not null").groupBy("label").agg(F.max("n").alias("n")).withColumn("original", F.lit(None).cast("string"))
    )


def redacted_texts(texts: DataFrame, stored: DataFrame, reuse: bool) -> tuple[DataFrame, DataFrame]:
    """R.redact of texts(key, text) behind the numbers in use. With ``reuse`` stored originals keep their placeholders."""
    known = used_numbers(texts, stored)
    known = stage(known if reuse else known.withColumn("original", F.lit(None).cast("string")), "known")
    return R.redact(texts.withColumn("version", F.md5("text")), ["key", "version"], "text", known)


def restored_texts(texts: DataFrame, stored: DataFrame) -> DataFrame:
    """(key, restored) of texts redacted and restored. Stored originals get new placeholders too, so a text's own old ones stay what they were."""
    out, table_ = redacted_texts(texts, stored, False)
    by = ["key", "version"]
    each = out.select(*by, F.explode(F.array_distinct(placeholders("redacted"))).alias("placeholder")).join(table_, "placeholder")
    maps = each.groupBy(*by).agg(F.collect_list(F.struct("placeholder", "original")).alias("m"))
    none = F.array().cast("array<struct<placeholder:string,original:string>>")
    return out.join(maps, by, "left").select("key", restore("redacted", F.coalesce("m", none)).alias("restored"))


def pii_redact(spark: SparkSession, d: str) -> DataFrame:
    """All chunk contents and forms, redacted behind the archive's own placeholders."""
    out, _ = redacted_texts(_texts(spark, d), table(spark, d, "redaction_map"), True)
    return out.select("key", "redacted", "hits")


def pii_restore_texts(spark: SparkSession, d: str) -> DataFrame:
    """Chunk contents and forms redacted and restored: every text must be what it was."""
    return restored_texts(_texts(spark, d), table(spark, d, "redaction_map")).select("key", F.md5("restored").alias("text_md5"))


def pii_restore(spark: SparkSession, d: str) -> DataFrame:
    """Redacted forms restored: every text must be what it was."""
    out, known = R.redact(forms(spark, d), ["form_id"], "text")
    each = out.select("form_id", F.explode(F.array_distinct(placeholders("redacted"))).alias("placeholder")).join(known, "placeholder")
    maps = each.groupBy("form_id").agg(F.collect_list(F.struct("placeholder", "original")).alias("m"))
    none = F.array().cast("array<struct<placeholder:string,original:string>>")
    back = out.join(maps, "form_id", "left").withColumn("restored", restore("redacted", F.coalesce("m", none)))
    return back.select("form_id", F.md5("restored").alias("text_md5"))


def placeholders_unresolved(spark: SparkSession, d: str) -> DataFrame:
    """Placeholders in chunks that no redaction row explains, with how many chunks hold them."""
    rows = once(table(spark, d, "chunks_index").select("chunk_id", "content"), "chunk_id")
    used = rows.select("chunk_id", F.explode(F.array_distinct(placeholders("content"))).alias("placeholder"))
    known = table(spark, d, "redaction_map").select("placeholder").distinct()
    return used.join(known, "placeholder", "left_anti").groupBy("placeholder").agg(F.count(F.lit(1)).alias("chunks"))


def chunks_restored(spark: SparkSession, d: str) -> DataFrame:
    """Chunk contents with placeholders put back from the redaction map; of several originals the first row's counts."""
    rows = once(table(spark, d, "chunks_index").select("chunk_id", "content"), "chunk_id")
    first = table(spark, d, "redaction_map").groupBy("placeholder").agg(F.min_by("original", "id").alias("original"))
    used = rows.select("chunk_id", F.explode(F.array_distinct(placeholders("content"))).alias("placeholder")).join(first, "placeholder")
    maps = used.groupBy("chunk_id").agg(F.collect_list(F.struct("placeholder", "original")).alias("m"))
    return rows.join(maps, "chunk_id").select("chunk_id", F.md5(restore("content", F.col("m"))).alias("restored_md5"))


def redaction_lookup(spark: SparkSession, d: str) -> DataFrame:
    """INSERT OR IGNORE on the placeholder: the first row of each stays, with its entity's label."""
    rows = table(spark, d, "redaction_map").distinct()
    w = Window.partitionBy("placeholder").orderBy("id", F.asc_nulls_last("original"))
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").select("placeholder", "id", "original", entity_label("entity_type").alias("label"))


def recogniser_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments an entity recogniser would read, of every chunk."""
    rows = once(table(spark, d, "chunks_index").select("chunk_id", "content"), "chunk_id")
    return rows.select("chunk_id", F.explode_outer(segments("content")).alias("s")).where("s is not null").select("chunk_id", "s.start", F.length("s.text").alias("chars"))


QUERIES = {f.__name__: f for f in (pii_bankcard_grouped, pii_recognised, pii_idcard, pii_credit_code, pii_email, pii_phone, pii_hotline, pii_bankcard, pii_landline, pii_labelled, pii_table_labelled, pii_resolve, pii_allocate, pii_hit_count, pii_redact, pii_restore, pii_restore_texts, placeholders_unresolved, chunks_restored, redaction_lookup, recogniser_segments)}

_TEXTS = f"texts AS (SELECT DISTINCT chunk_id AS key, content AS text FROM chunks_index WHERE content IS NOT NULL UNION ALL SELECT CAST(c_custkey AS STRING), {FORM} FROM customer)"
_MARK = r"\[[\p{L}_][\p{L}\p{M}\p{Nd}_·]{0,19}\p{Nd}{1,4}\]"
_LABEL = f"CASE upper(coalesce(entity_type, '')) WHEN '' THEN '{P.NO_LABEL}' " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.ENTITY_LABELS.items()) + " ELSE upper(entity_type) END"



def _between(shape: str) -> str:
    """Matches of a shape between characters that are no digits; RE2 has no lookaround."""
    return rf"WITH {_TEXTS} SELECT key, unnest(regexp_extract_all(text, '(?:^|[^\p{{Nd}}])({shape})(?:$|[^\p{{Nd}}])', 1)) AS value FROM texts"


SQL = {
    "pii_idcard": rf"WITH {_TEXTS} SELECT key, value FROM (SELECT key, unnest(regexp_extract_all(text, '[0-9A-Za-z]+')) AS value FROM texts) x WHERE regexp_full_match(value, '[0-9]{{17}}[0-9Xx]')",
    "pii_credit_code": rf"WITH {_TEXTS} SELECT key, value FROM (SELECT key, unnest(regexp_extract_all(text, '[0-9A-Za-z]+')) AS value FROM texts) x WHERE regexp_full_match(value, '[0-9A-HJ-NPQRTUWXY]{{18}}')",
    "pii_phone": _between(r"(?:\+?86[-\s]?)?1[3-9]\p{Nd}(?:[-\s]?\p{Nd}{4}){2}"),
    "pii_bankcard_grouped": _between(r"\p{Nd}{4}[-\s]\p{Nd}{4}[-\s]\p{Nd}{4}[-\s]\p{Nd}{3,4}"),
    "pii_recognised": f"WITH {_TEXTS} SELECT key, value, '姓名' AS label, 50 AS priority FROM (SELECT key, unnest(regexp_extract_all(text, '([\u4e00-\u9fa5]{{2,3}})(?:先生|女士)', 1)) AS value FROM texts) x",
    "pii_hotline": _between(r"(?:400|800)[-\s]?\p{Nd}{3}[-\s]?\p{Nd}{4}"),
    "pii_landline": _between(r"\(?0\p{Nd}{2,3}\)?[-\s]?\p{Nd}{7,8}"),
    "pii_email": rf"WITH {_TEXTS} SELECT key, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}')) AS value FROM texts",
    "pii_bankcard": rf"WITH {_TEXTS} SELECT key, value FROM (SELECT key, unnest(regexp_extract_all(text, '\p{{Nd}}+')) AS value FROM texts) x WHERE length(value) BETWEEN 16 AND 19",
    "pii_allocate": f"""WITH r AS (SELECT {_LABEL} AS label, original, min(id) AS f FROM redaction_map WHERE original IS NOT NULL GROUP BY 1, 2)
      SELECT label, original, '[' || label || row_number() OVER (PARTITION BY label ORDER BY f, original) || ']' AS placeholder FROM r""",
    "pii_hit_count": f"SELECT doc_id, hits FROM (SELECT doc_id, CAST(sum(len(list_distinct(regexp_extract_all(coalesce(content, ''), '{_MARK}')))) AS BIGINT) AS hits FROM (SELECT DISTINCT chunk_id, doc_id, content FROM chunks_index) x GROUP BY doc_id) y WHERE hits > 0",
    "pii_restore": f"SELECT c_custkey AS form_id, md5({FORM}) AS text_md5 FROM customer",
    "pii_restore_texts": f"WITH {_TEXTS} SELECT key, md5(text) AS text_md5 FROM texts",
    "placeholders_unresolved": f"SELECT placeholder, count(*) AS chunks FROM (SELECT chunk_id, unnest(list_distinct(regexp_extract_all(content, '{_MARK}'))) AS placeholder FROM (SELECT DISTINCT chunk_id, content FROM chunks_index) c) x WHERE placeholder NOT IN (SELECT placeholder FROM redaction_map WHERE placeholder IS NOT NULL) GROUP BY placeholder",
    "chunks_restored": f"""WITH RECURSIVE c AS (SELECT DISTINCT chunk_id, content FROM chunks_index), o AS (SELECT placeholder, min_by(original, id) AS original FROM redaction_map GROUP BY placeholder),
      u AS (SELECT chunk_id, content, p, o.original FROM (SELECT chunk_id, content, unnest(list_distinct(regexp_extract_all(content, '{_MARK}'))) AS p FROM c) x JOIN o ON o.placeholder = p),
      n AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, content ORDER BY length(p) DESC, p) AS i, count(*) OVER (PARTITION BY chunk_id, content) AS n FROM u),
      f AS (SELECT DISTINCT chunk_id, content, 1 AS i, content AS t FROM n UNION ALL SELECT f.chunk_id, f.content, f.i + 1, replace(f.t, n.p, coalesce(n.original, '')) FROM f JOIN n ON n.chunk_id = f.chunk_id AND n.content = f.content AND n.i = f.i)
      SELECT f.chunk_id, md5(f.t) AS restored_md5 FROM f JOIN (SELECT DISTINCT chunk_id, content, n FROM n) z ON z.chunk_id = f.chunk_id AND z.content = f.content WHERE f.i = z.n + 1""",
    "recogniser_segments": """WITH RECURSIVE c AS (SELECT DISTINCT chunk_id, content FROM chunks_index),
      s AS (SELECT chunk_id, content, regexp_extract_all(content, '[^。！？!?；;\n]*[。！？!?；;\n]|[^。！？!?；;\n]+') AS s FROM c WHERE content <> ''),
      f AS (SELECT chunk_id, content, 1 AS i, '' AS buf, []::VARCHAR[] AS done FROM s
        UNION ALL SELECT f.chunk_id, f.content, i + 1, CASE WHEN length(s[i]) > 300 THEN '' WHEN length(buf) + length(s[i]) <= 300 THEN buf || s[i] ELSE s[i] END,
          CASE WHEN length(s[i]) > 300 THEN list_concat(CASE WHEN buf = '' THEN done ELSE list_append(done, buf) END, list_transform(range(0, CAST(length(s[i]) AS BIGINT), 300), lambda k: substring(s[i], k + 1, 300)))
            WHEN length(buf) + length(s[i]) <= 300 THEN done WHEN buf = '' THEN done ELSE list_append(done, buf) END
          FROM f JOIN s ON s.chunk_id = f.chunk_id AND s.content = f.content WHERE i <= len(s)),
      p AS (SELECT f.chunk_id, CASE WHEN buf = '' THEN done ELSE list_append(done, buf) END AS p FROM f JOIN s ON s.chunk_id = f.chunk_id AND s.content = f.content WHERE i = len(s) + 1),
      e AS (SELECT chunk_id, unnest(list_transform(range(1, len(p) + 1), lambda k: struct_pack(start := coalesce(list_sum(list_transform(p[1:k - 1], lambda x: length(x))), 0), t := p[k]))) AS e FROM p)
      SELECT chunk_id, CAST(e.start AS INT) AS start, length(e.t) AS chars FROM e WHERE regexp_matches(e.t, '[^\\s\\p{Z}]')""",
    "redaction_lookup": f"SELECT placeholder, id, original, {_LABEL} AS label FROM (SELECT *, row_number() OVER (PARTITION BY placeholder ORDER BY id, original NULLS LAST) AS n FROM (SELECT DISTINCT * FROM redaction_map) d) x WHERE n = 1",
}
