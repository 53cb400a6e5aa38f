"""Document structure queries: blocks, margins, headings, sections, chunks, figures.

The archive holds texts without layout, so sizes, weights, pages and boxes are
derived from a document's lines by fixed arithmetic, the same in Spark and SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.text import clean_title, rows_to_markdown, split_text
from docloom.operators import blocks as B
from docloom.plans import sql
from docloom.runtime import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    pieces = _docs(spark, d).select("doc_id", F.posexplode_outer(split_text("text")).alias("piece_no", "piece")).where("piece is not null")
    return pieces.select("doc_id", "piece_no", F.length("piece").alias("chars"), F.md5("piece").alias("piece_md5"))


def line_blocks(spark: SparkSession, d: str) -> DataFrame:
    out = B.markdown_blocks(_docs(spark, d), "doc_id", "text")
    return out.select("doc_id", "block_index", "type", "heading", F.coalesce("heading_level", F.lit(0)).alias("heading_level"), F.md5("content").alias("content_md5"))


def title_marks(spark: SparkSession, d: str) -> DataFrame:
    """Section names as Markdown headings, cleaned again."""
    rows = table(spark, d, "chunks_index").where("section <> ''").select("section").distinct()
    return rows.select("section", clean_title(F.concat(F.lit("## **"), "section", F.lit("** ##"))).alias("title"))


def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that open or close three or more documents of one base."""
    return B.repeated_lines(_docs(spark, d), "kb_name", "doc_id", "text")


def repeated_margins(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each base left after those that repeat as first or last lines."""
    up, down = Window.partitionBy("doc_id").orderBy("line_no"), Window.partitionBy("doc_id").orderBy(F.desc("line_no"))
    rows = B.lines(_docs(spark, d), "doc_id", "text", "kb_name").where("line <> ''")
    rows = rows.withColumn("margin", (F.row_number().over(up) == 1) | (F.row_number().over(down) == 1))
    kept = B.repeated_margins(rows, "kb_name", "line", "margin")
    return kept.groupBy("kb_name").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))


def styled(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of all documents: their non-blank lines with derived size, weight and page."""
    rows = B.lines(_docs(spark, d), "doc_id", "text").where("line <> ''")
    rows = rows.withColumn("block_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) - 1)
    twelfth = F.col("block_index") % 12
    size = F.when(F.length("line") > 90, 10.5).when(twelfth == 0, 16.0).when(twelfth.isin(4, 8), 13.0).otherwise(10.5)
    kind = F.when(F.col("line").startswith("|"), "table").when((F.col("block_index") % 7 == 6), "figure").otherwise("text")
    return rows.select(
        "doc_id", "block_index", kind.alias("type"), F.col("line").alias("content"), size.alias("size"), (F.col("doc_id") % 2 == 1).alias("bold"), F.lit(None).cast("string").alias("style"),
        F.lit(False).alias("heading"), F.lit(0).alias("heading_level"), (1 + F.floor(F.col("block_index") / 10)).cast("int").alias("page"), F.when(kind == "figure", F.substring("line", 1, 40)).otherwise("").alias("context"),
    )


def body_font_size(spark: SparkSession, d: str) -> DataFrame:
    return B.body_sizes(styled(spark, d), "doc_id")


def heading_levels(spark: SparkSession, d: str) -> DataFrame:
    rows = styled(spark, d)
    return B.heading_levels(rows, B.body_sizes(rows, "doc_id"), "doc_id")


def heading_flag(spark: SparkSession, d: str) -> DataFrame:
    return B.with_headings(styled(spark, d), "doc_id").select("doc_id", "block_index", "is_heading", "level")


def section_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = B.with_headings(styled(spark, d), "doc_id")
    w = Window.partitionBy("doc_id").orderBy("block_index")
    return rows.select("doc_id", "block_index", F.sum(F.when(F.col("is_heading"), 1).otherwise(0)).over(w).alias("section"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return B.packed(B.with_headings(styled(spark, d), "doc_id"), "doc_id")


def block_packing(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).select("doc_id", "buffer_no", "section", "type", "page", "block_index", F.md5("body").alias("body_md5"))


def breadcrumb(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).select("doc_id", "section", "crumb").where("crumb <> ''").distinct()


def build_chunks(spark: SparkSession, d: str) -> DataFrame:
    out = B.chunks(_packed(spark, d), "doc_id")
    return out.select("chunk_id", "section_id", "type", "page", "section", F.length("content").alias("chars"), F.md5("content").alias("content_md5"))


def table_markdown(spark: SparkSession, d: str) -> DataFrame:
    """The nations of each region as a Markdown table."""
    rows = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(
        F.array_sort(F.collect_list(F.struct("n_nationkey", F.array(F.col("n_nationkey").cast("string"), "n_name", F.when(F.col("n_nationkey") % 2 == 0, F.lit(" a\nb "))).alias("cells")))).alias("m")
    )
    head = F.array(F.array(F.lit("key"), F.lit("name")))
    return rows.select("region", rows_to_markdown(F.concat(head, F.transform("m", lambda x: x["cells"]))).alias("markdown"))


def _boxed(spark: SparkSession, d: str) -> DataFrame:
    """Blocks with boxes: a column of lines on each page, figures indented; every 11th block has none."""
    i = F.col("block_index")
    box = F.array((40 + (i % 3) * 25).cast("double"), (50 + (i % 10) * 70).cast("double"), (40 + (i % 3) * 25 + F.least(F.length("content"), F.lit(90)) * 5).cast("double"), (50 + (i % 10) * 70 + 40 + (i % 4) * 20).cast("double"))
    return styled(spark, d).withColumn("bbox", F.when(i % 11 != 0, box))


def figure_context(spark: SparkSession, d: str) -> DataFrame:
    return B.nearest_text(_boxed(spark, d), "doc_id").select("doc_id", "block_index", F.md5("context").alias("context_md5"))


def figure_caption(spark: SparkSession, d: str) -> DataFrame:
    """Every 13th block is made to read as a caption."""
    rows = _boxed(spark, d).withColumn("content", F.when(F.col("block_index") % 13 == 3, F.concat(F.lit("图 "), F.col("block_index").cast("string"), F.lit(" "), F.substring("content", 1, 20))).otherwise(F.col("content")))
    return B.nearest_caption(rows, "doc_id")


def text_outside_tables(spark: SparkSession, d: str) -> DataFrame:
    return B.outside_tables(_boxed(spark, d), "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("content")).alias("chars"))


QUERIES = {f.__name__: f for f in (sentence_split, line_blocks, title_marks, repeated_lines, repeated_margins, body_font_size, heading_levels, heading_flag, section_ids, block_packing, breadcrumb, build_chunks, table_markdown, figure_context, figure_caption, text_outside_tables)}

_LINES = rf"""lines AS (SELECT doc_id, kb_name, unnest(range(len(l))) AS line_no, {sql.strip('unnest(l)')} AS line FROM (SELECT doc_id, kb_name, regexp_split_to_array(text, '\r\n|[\n\r\v\f\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS l FROM documents WHERE length(text) > 0) x)"""
_KEY = f"regexp_replace(lower({sql.collapse('line')}), '\\p{{Nd}}+', '#', 'g')"
_STYLED = f"""{_LINES},
numbered AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS block_index FROM lines WHERE line <> ''),
styled AS (SELECT doc_id, block_index, CASE WHEN starts_with(line, '|') THEN 'table' WHEN block_index % 7 = 6 THEN 'figure' ELSE 'text' END AS type, line AS content,
  CASE WHEN length(line) > 90 THEN 10.5 WHEN block_index % 12 = 0 THEN 16.0 WHEN block_index % 12 IN (4, 8) THEN 13.0 ELSE 10.5 END::DOUBLE AS size, doc_id % 2 = 1 AS bold, CAST(1 + block_index // 10 AS INT) AS page FROM numbered),
sums AS (SELECT doc_id, size AS s, sum(length(content)) AS n, min(block_index) AS f FROM styled WHERE type = 'text' AND length(content) >= 40 GROUP BY doc_id, size),
sizes AS (SELECT doc_id, coalesce(max_by(s, n * 1000000 - f), 0.0) AS body_size FROM (SELECT DISTINCT doc_id FROM styled) x LEFT JOIN sums USING (doc_id) GROUP BY doc_id),
levels AS (SELECT doc_id, size, dense_rank() OVER (PARTITION BY doc_id ORDER BY size DESC) AS level FROM (SELECT DISTINCT doc_id, size FROM styled JOIN sizes USING (doc_id) WHERE type = 'text' AND length(content) <= 90 AND body_size > 0 AND size >= body_size * 1.12) x),
headed AS (SELECT s.*, z.body_size, coalesce(CASE WHEN type <> 'text' OR length(content) > 90 THEN FALSE WHEN regexp_matches(content, '(?i)^\\s*(figure|fig\\.?|table|chart|图|表)\\s*[\\p{{Nd}}一二三四五六七八九十]') THEN FALSE
  WHEN body_size = 0 THEN FALSE WHEN s.size >= body_size * 1.12 AND l.level IS NOT NULL THEN TRUE ELSE bold AND length(content) <= 40 AND s.size >= body_size END, FALSE) AS is_heading, coalesce(l.level, 1) AS level
  FROM styled s JOIN sizes z USING (doc_id) LEFT JOIN levels l ON l.doc_id = s.doc_id AND l.size = s.size)"""
_BOXED = f"""{_STYLED},
boxed AS (SELECT *, CASE WHEN block_index % 11 <> 0 THEN [40 + (block_index % 3) * 25, 50 + (block_index % 10) * 70, 40 + (block_index % 3) * 25 + least(length(content), 90) * 5, 90 + (block_index % 10) * 70 + (block_index % 4) * 20]::DOUBLE[] END AS box FROM styled)"""
_DIST = "CASE WHEN t.box IS NOT NULL AND f.box IS NOT NULL THEN sqrt(pow(greatest(0, t.box[1] - f.box[3], f.box[1] - t.box[3]), 2) + pow(greatest(0, t.box[2] - f.box[4], f.box[2] - t.box[4]), 2)) END"

_MARKS = "。！？!?；;\n"


def _split_sql(rows: str, ids: str) -> str:
    """CTEs from rows(ids…, t) to pieces(ids…, piece_no, piece): the sentence split as a fold, one step for each sentence."""
    return f"""src AS (SELECT {ids}, {sql.strip("coalesce(t, '')")} AS t FROM ({rows}) r),
cut AS (SELECT {ids}, t, list_filter(regexp_extract_all(t, '[^{_MARKS}]*[{_MARKS}]|[^{_MARKS}]+'), lambda s: regexp_matches(s, '[^\\s\\p{{Z}}]')) AS s FROM src),
fold AS (
  SELECT {ids}, 1 AS i, '' AS buf, []::VARCHAR[] AS done FROM cut WHERE length(t) > 700
  UNION ALL
  SELECT {', '.join('f.' + i.strip() for i in ids.split(','))}, i + 1,
    CASE WHEN length(s[i]) > 700 THEN '' WHEN length(buf) + length(s[i]) <= 700 THEN buf || s[i] ELSE right(buf, 100) || s[i] END,
    CASE WHEN length(s[i]) > 700 THEN list_concat(CASE WHEN buf = '' THEN done ELSE list_append(done, buf) END, list_transform(range(0, CAST(length(s[i]) AS BIGINT), 600), lambda k: substring(s[i], k + 1, 700)))
      WHEN length(buf) + length(s[i]) <= 700 THEN done ELSE list_append(done, buf) END
  FROM fold f JOIN cut USING ({ids}) WHERE i <= len(s)),
folded AS (SELECT {ids}, list_append(done, buf) AS p FROM fold JOIN cut USING ({ids}) WHERE i = len(s) + 1 UNION ALL SELECT {ids}, [t] FROM cut WHERE length(t) <= 700),
clean AS (SELECT {ids}, list_filter(list_transform(p, lambda x: {sql.strip('x')}), lambda x: x <> '') AS p FROM folded),
pieces AS (SELECT {ids}, unnest(range(len(p))) AS piece_no, unnest(p) AS piece FROM clean)"""


_ONE = "struct_pack(section := f.section, crumb := array_to_string(list_transform(crumbs, lambda c: c.title), ' > '), type := %s, page := %s, idx := %s, body := %s)"
_OPEN_BUFFER = _ONE % ("bt", "bp", "bi", "buf")
_CLOSED = f"CASE WHEN buf IS NULL THEN done ELSE list_append(done, {_OPEN_BUFFER}) END"
_KEEP = "(buf IS NOT NULL AND type NOT IN ('figure', 'table') AND page = bp AND type = bt AND n + length(body) <= 700)"
_FULL = f"(CASE WHEN {_KEEP} THEN n ELSE 0 END + length(body) >= 700)"
_NEWBUF = f"CASE WHEN {_KEEP} THEN buf || chr(10) || body ELSE body END"
_PACKED = f"""{_STYLED},
bodies AS (SELECT h.*, CASE WHEN type = 'figure' THEN '（图表内容）' || {sql.strip('substring(content, 1, 40)')} ELSE content END AS body FROM headed h),
packing AS (
  SELECT DISTINCT doc_id, 0::BIGINT AS i, 0 AS section, []::STRUCT(level BIGINT, title VARCHAR)[] AS crumbs, NULL::VARCHAR AS buf, 0::BIGINT AS n, ''::VARCHAR AS bt, 0 AS bp, 0::BIGINT AS bi,
    []::STRUCT(section INT, crumb VARCHAR, type VARCHAR, page INT, idx BIGINT, body VARCHAR)[] AS done FROM bodies
  UNION ALL
  SELECT f.doc_id, i + 1, CASE WHEN is_heading THEN section + 1 ELSE section END,
    CASE WHEN is_heading THEN list_append(CASE WHEN len(list_filter(crumbs, lambda c: c.level < x.level)) > 2 THEN list_filter(crumbs, lambda c: c.level < x.level)[2:] ELSE list_filter(crumbs, lambda c: c.level < x.level) END, struct_pack(level := x.level, title := content)) ELSE crumbs END,
    CASE WHEN is_heading OR {_FULL} THEN NULL ELSE {_NEWBUF} END, CASE WHEN is_heading OR {_FULL} THEN 0 WHEN {_KEEP} THEN n + length(body) ELSE length(body) END,
    CASE WHEN is_heading OR {_KEEP} THEN bt ELSE type END, CASE WHEN is_heading OR {_KEEP} THEN bp ELSE page END, CASE WHEN is_heading OR {_KEEP} THEN bi ELSE block_index END,
    CASE WHEN is_heading THEN {_CLOSED}
      WHEN {_FULL} THEN list_append(CASE WHEN {_KEEP} THEN done ELSE {_CLOSED} END, {_ONE % (f"CASE WHEN {_KEEP} THEN bt ELSE type END", f"CASE WHEN {_KEEP} THEN bp ELSE page END", f"CASE WHEN {_KEEP} THEN bi ELSE block_index END", _NEWBUF)})
      WHEN {_KEEP} THEN done ELSE {_CLOSED} END
  FROM packing f JOIN bodies x ON x.doc_id = f.doc_id AND x.block_index = f.i),
ends AS (SELECT f.doc_id, {_CLOSED} AS done FROM packing f JOIN (SELECT doc_id, max(block_index) + 1 AS last FROM bodies GROUP BY doc_id) l ON l.doc_id = f.doc_id AND f.i = l.last),
buffers AS (SELECT doc_id, unnest(range(len(done))) AS buffer_no, unnest(done, max_depth := 2) FROM ends)"""

SQL = {
    "sentence_split": f"WITH RECURSIVE {_split_sql('SELECT doc_id, text AS t FROM documents', 'doc_id')} SELECT doc_id, piece_no, length(piece) AS chars, md5(piece) AS piece_md5 FROM pieces",
    "block_packing": f"WITH RECURSIVE {_PACKED} SELECT doc_id, buffer_no, section, type, page, idx AS block_index, md5(body) AS body_md5 FROM buffers",
    "breadcrumb": f"WITH RECURSIVE {_PACKED} SELECT DISTINCT doc_id, section, crumb FROM buffers WHERE crumb <> ''",
    "build_chunks": f"""WITH RECURSIVE {_PACKED}, {_split_sql(f"SELECT doc_id, buffer_no, body AS t FROM buffers WHERE length({sql.strip('body')}) >= 4", 'doc_id, buffer_no')},
    numbered_pieces AS (SELECT p.*, b.section, b.crumb, b.type, b.page, row_number() OVER (PARTITION BY doc_id ORDER BY buffer_no, piece_no) - 1 AS no FROM pieces p JOIN buffers b USING (doc_id, buffer_no)),
    c AS (SELECT doc_id || '-' || lpad(CAST(no AS VARCHAR), 4, '0') AS chunk_id, CASE WHEN section > 0 THEN doc_id || '#s' || lpad(CAST(section AS VARCHAR), 3, '0') ELSE '' END AS section_id, type, page, crumb AS section, CASE WHEN crumb <> '' THEN '章节：' || crumb || chr(10) || piece ELSE piece END AS content FROM numbered_pieces)
    SELECT chunk_id, section_id, type, page, section, length(content) AS chars, md5(content) AS content_md5 FROM c""",
    "line_blocks": f"""WITH {_LINES}, k AS (SELECT *, CASE WHEN line = '' THEN 'blank' WHEN starts_with(line, '|') THEN 'table' WHEN starts_with(line, '#') THEN 'heading' ELSE 'text' END AS kind FROM lines),
    b AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM k),
    i AS (SELECT *, sum(CASE WHEN before IS NULL OR kind = 'heading' OR before <> kind THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM b WHERE kind <> 'blank'),
    g AS (SELECT doc_id, island, first(kind) AS kind, string_agg(line, chr(10) ORDER BY line_no) AS raw FROM i GROUP BY doc_id, island)
    SELECT doc_id, CAST(island - 1 AS INT) AS block_index, CASE WHEN kind = 'table' THEN 'table' ELSE 'text' END AS type, kind = 'heading' AS heading,
      CASE WHEN kind = 'heading' THEN greatest(1, least(6, length(regexp_extract(raw, '^#+')))) ELSE 0 END AS heading_level,
      md5(CASE WHEN kind = 'heading' THEN {sql.strip("replace(replace(replace(replace(replace(" + sql.strip("regexp_replace(raw, '^#+|#+$', '', 'g')") + ", '**', ''), '__', ''), chr(96), ''), '*', ''), '_', '')")} ELSE raw END) AS content_md5 FROM g""",
    "title_marks": f"SELECT DISTINCT section, {sql.strip('''replace(replace(replace(replace(replace(section, '**', ''), '__', ''), chr(96), ''), '*', ''), '_', '')''')} AS title FROM chunks_index WHERE section <> ''",
    "repeated_lines": f"""WITH {_LINES}, e AS (SELECT *, row_number() OVER (PARTITION BY kb_name, doc_id ORDER BY line_no) AS a, row_number() OVER (PARTITION BY kb_name, doc_id ORDER BY line_no DESC) AS z FROM lines WHERE line <> '')
    SELECT kb_name, line_key, count(DISTINCT doc_id) AS pages FROM (SELECT kb_name, doc_id, {_KEY} AS line_key FROM e WHERE a <= 2 OR z <= 4) x WHERE line_key <> '' GROUP BY kb_name, line_key HAVING count(DISTINCT doc_id) >= 3""",
    "repeated_margins": f"""WITH {_LINES}, e AS (SELECT *, {_KEY} AS line_key, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) AS z FROM lines WHERE line <> ''),
    o AS (SELECT kb_name, line_key FROM e WHERE (a = 1 OR z = 1) AND line_key <> '' GROUP BY kb_name, line_key HAVING count(*) >= 3)
    SELECT kb_name, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM e WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.line_key = e.line_key AND o.kb_name IS NOT DISTINCT FROM e.kb_name) GROUP BY kb_name""",
    "body_font_size": f"WITH {_STYLED} SELECT doc_id, body_size FROM sizes",
    "heading_levels": f"WITH {_STYLED} SELECT doc_id, size, level FROM levels",
    "heading_flag": f"WITH {_STYLED} SELECT doc_id, block_index, is_heading, level FROM headed",
    "section_ids": f"WITH {_STYLED} SELECT doc_id, block_index, CAST(sum(CASE WHEN is_heading THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_index) AS BIGINT) AS section FROM headed",
    "table_markdown": """SELECT n_regionkey AS region, '| key | name |  |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' | ' || CASE WHEN n_nationkey % 2 = 0 THEN 'a b' ELSE '' END || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY n_regionkey""",
    "figure_context": f"""WITH {_BOXED}, n AS (SELECT f.doc_id, f.block_index, t.content, row_number() OVER (PARTITION BY f.doc_id, f.block_index ORDER BY coalesce({_DIST}, abs(t.block_index - f.block_index) * 1000.0), t.block_index) AS n
      FROM boxed f JOIN boxed t ON t.doc_id = f.doc_id AND t.page = f.page AND f.type = 'figure' AND t.type = 'text'),
    j AS (SELECT doc_id, block_index, string_agg(content, ' ' ORDER BY n) AS c FROM n WHERE n <= 3 GROUP BY doc_id, block_index)
    SELECT doc_id, block_index, md5(coalesce(c, '')) AS context_md5 FROM boxed LEFT JOIN j USING (doc_id, block_index) WHERE type = 'figure'""",
    "figure_caption": f"""WITH {_BOXED}, c AS (SELECT * REPLACE (CASE WHEN block_index % 13 = 3 THEN '图 ' || block_index || ' ' || substring(content, 1, 20) ELSE content END AS content) FROM boxed),
    n AS (SELECT f.doc_id, f.block_index, {sql.strip('t.content')} AS content, row_number() OVER (PARTITION BY f.doc_id, f.block_index ORDER BY coalesce({_DIST}, 0.0), t.block_index) AS n
      FROM c f JOIN c t ON t.doc_id = f.doc_id AND t.page = f.page AND f.type = 'figure' AND t.type = 'text' AND regexp_matches(t.content, '^\\s*(图|表|图表|Figure|Fig\\.?|Table)\\s*[\\p{{Nd}}一二三四五六七八九十]+'))
    SELECT f.doc_id, f.block_index, coalesce(n.content, '') AS caption FROM c f LEFT JOIN n ON n.doc_id = f.doc_id AND n.block_index = f.block_index AND n.n = 1 WHERE f.type = 'figure'""",
    "text_outside_tables": f"""WITH {_BOXED} SELECT doc_id, count(*) AS blocks, CAST(sum(length(content)) AS BIGINT) AS chars FROM boxed x WHERE type = 'text' AND NOT EXISTS (SELECT 1 FROM boxed t WHERE t.type = 'table' AND t.doc_id = x.doc_id AND t.page = x.page AND x.box[1] < t.box[3] AND t.box[1] < x.box[3] AND x.box[2] < t.box[4] AND t.box[2] < x.box[4]) GROUP BY doc_id""",
}
