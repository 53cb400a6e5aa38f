"""Catalog, session, cache and answer queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import patterns as P
from docloom.functions import text as T
from docloom.operators import fusion, scope, tables
from docloom.operators.numbering import row_numbers
from docloom.operators.orphans import clean_path
from docloom.plans import sql
from docloom.plans.sql import MARK as _MARK
from docloom.runtime import once, table

_REFS = "array<struct<index:int,source_kb:string,file_name:string,page:int>>"


def _log(spark: SparkSession, d: str) -> DataFrame:
    """The query log with each row once, as it was first delivered."""
    return tables.latest(table(spark, d, "query_log"), ["id"], F.asc_nulls_last("ingested_at"), F.asc_nulls_last("created_at"), F.asc_nulls_last("question"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "chunks_index").select("chunk_id", "doc_id", "kb_name", "page", "chunk_type", "section_id", "content"), "chunk_id")


# ---- catalog ----------------------------------------------------------------------------------------------------------
def doc_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each base, beside the stored copy of the count."""
    bases = table(spark, d, "knowledge_bases").select("kb_name", F.coalesce("doc_count", F.lit(-1)).alias("stored"))
    counts = tables.per_key_counts(table(spark, d, "documents").where("kb_name is not null"), "kb_name", "documents")
    return bases.join(counts, "kb_name", "full_outer").select("kb_name", F.coalesce("stored", F.lit(-2)).alias("stored"), F.coalesce("documents", F.lit(0)).alias("documents"))


def stats(spark: SparkSession, d: str) -> DataFrame:
    one = [table(spark, d, t).agg(F.count(F.lit(1)).alias(n)) for t, n in (("knowledge_bases", "bases"), ("documents", "documents"), ("chunks_index", "chunks"), ("redaction_map", "redactions"), ("query_log", "queries"))]
    out = one[0]
    for more in one[1:]:
        out = out.crossJoin(more)  # one row each
    return out


def kb_overview(spark: SparkSession, d: str) -> DataFrame:
    """One line for each base: mode, documents, vectors, redactions."""
    bases = table(spark, d, "knowledge_bases").select("kb_name", "mode")
    for t, n in (("documents", "docs"), ("vector_store", "vectors"), ("redaction_map", "redactions")):
        bases = bases.join(tables.per_key_counts(table(spark, d, t).where("kb_name is not null"), "kb_name", n), "kb_name", "left")
    show = lambda n: F.coalesce(n, F.lit(0)).cast("string")
    mode = F.when(F.col("mode") == "privacy", "隐私模式").otherwise("普通模式")
    return bases.select("kb_name", F.concat(F.lit("- `"), "kb_name", F.lit("` · **"), mode, F.lit("** · 文档 "), show("docs"), F.lit(" 个 · 向量块 "), show("vectors"), F.lit(" 个 · 脱敏项 "), show("redactions"), F.lit(" 条")).alias("line"))


def collection_names(spark: SparkSession, d: str) -> DataFrame:
    """The vector collection's name of each base."""
    return table(spark, d, "knowledge_bases").select("kb_name", F.concat(F.lit("kb_"), F.substring(F.sha1(F.col("kb_name").cast("binary")), 1, 16)).alias("collection"))


def list_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each base, newest first."""
    age = -F.unix_micros(F.col("upload_time").cast("timestamp"))
    rows = table(spark, d, "documents").select("kb_name", "doc_id", "filename", "upload_time")
    return row_numbers(rows, "kb_name", [F.col("upload_time").isNull(), age, F.col("doc_id")], "position").drop("upload_time")


def list_files(spark: SparkSession, d: str) -> DataFrame:
    """Archived files of each base in order of their paths."""
    rows = table(spark, d, "archive_files").where("removed_at is null").select("kb_name", clean_path("file_path").alias("path")).distinct()
    return row_numbers(rows, "kb_name", [F.col("path")], "position")


def latest_documents(spark: SparkSession, d: str) -> DataFrame:
    """Point lookups in bulk: the last uploaded document of every base."""
    rows = table(spark, d, "documents").where("kb_name is not null")
    return tables.latest(rows, ["kb_name"], F.desc_nulls_last("upload_time"), F.asc("doc_id")).select("kb_name", "doc_id", "filename")


def stored_names(spark: SparkSession, d: str) -> DataFrame:
    """Legal file names; names that a base has already get a number."""
    rows = table(spark, d, "documents").select("doc_id", "kb_name", T.safe_name("filename", "file").alias("name"))
    return tables.collision_names(rows, "kb_name", "name", "doc_id").select("doc_id", "stored_name")


def file_available(spark: SparkSession, d: str) -> DataFrame:
    """Whether a document's original is in the archive, and its address."""
    there = table(spark, d, "archive_files").where("removed_at is null").select(clean_path("file_path").alias("path")).distinct().withColumn("there", F.lit(True))
    rows = table(spark, d, "documents").select("doc_id", "filename", clean_path("file_path").alias("path")).join(there, "path", "left")
    name = F.coalesce("filename", F.lit("未知文件"))
    ok = F.coalesce("there", F.lit(False))
    return rows.select("doc_id", ok.alias("available"), F.concat(name, F.when(ok, "").otherwise("（原件未找到）")).alias("label"))


def _paths(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, path): the stored path of every document, even if the file is gone; without one its place in the archive, if a file is there."""
    there = table(spark, d, "archive_files").where("removed_at is null").select(clean_path("file_path").alias("guess")).distinct().withColumn("there", F.lit(True))
    docs = table(spark, d, "documents").select("doc_id", clean_path("file_path").alias("stored"), F.concat_ws("/", F.lit("archive"), "kb_name", "filename").alias("guess"))
    return docs.join(there, "guess", "left").select("doc_id", F.coalesce(F.when(F.col("stored") != "", F.col("stored")), F.when(F.col("there"), F.col("guess")), F.lit("")).alias("path"))


def file_address(spark: SparkSession, d: str) -> DataFrame:
    """The address of every chunk's place in its original."""
    rows = table(spark, d, "chunks_index").select("chunk_id", "doc_id", "page").distinct()
    return rows.join(_paths(spark, d), "doc_id").select("chunk_id", "doc_id", T.file_address("path", "page").alias("address")).distinct()


def citation_restored(spark: SparkSession, d: str) -> DataFrame:
    """Content, file name and base of chunks with placeholders put back, as a citation shows them."""
    docs = table(spark, d, "documents").select("doc_id", "filename")
    fields = ["content", "filename", "kb_name"]
    rows = once(table(spark, d, "chunks_index").select("chunk_id", "doc_id", "kb_name", "content"), "chunk_id").join(docs, "doc_id", "left")
    first = table(spark, d, "redaction_map").groupBy("placeholder").agg(F.min_by("original", "id").alias("original"))
    held = T.placeholders(F.concat_ws("\u0001", *(F.coalesce(c, F.lit("")) for c in fields)))
    used = rows.select("chunk_id", F.explode(F.array_distinct(held)).alias("placeholder")).join(first, "placeholder")
    maps = used.groupBy("chunk_id").agg(F.collect_list(F.struct("placeholder", "original")).alias("m"))
    back = rows.join(maps, "chunk_id")
    return back.select("chunk_id", *(F.md5(T.restore(F.coalesce(c, F.lit("")), F.col("m"))).alias(f"{c}_md5") for c in fields))


def route_document(spark: SparkSession, d: str) -> DataFrame:
    """Where a question about one document is searched."""
    have = table(spark, d, "knowledge_bases").where("deleted_at is null").select("kb_name")
    out = scope.route_document(table(spark, d, "documents").select("doc_id", "kb_name"), "kb_name", have, "kb_name")
    return out.select("doc_id", F.coalesce("routed", F.lit("")).alias("routed"), "outcome")


# ---- changes ----------------------------------------------------------------------------------------------------------
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """Orders after a second version of every tenth key."""
    old = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = old.where("o_orderkey % 10 = 0").select("o_orderkey", F.lit("R").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    out = tables.upsert(old, new, ["o_orderkey"])
    return out.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def insert_ignored(spark: SparkSession, d: str) -> DataFrame:
    """Index rows of all chunks, where those already indexed stay as they are."""
    old = table(spark, d, "chunk_fts").select("chunk_id", F.lit("old").alias("origin")).distinct()
    new = table(spark, d, "chunks_index").select("chunk_id").distinct().withColumn("origin", F.lit("new"))
    return tables.insert_ignore(old, new, ["chunk_id"]).groupBy("origin").agg(F.count(F.lit(1)).alias("chunks"))


def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, index rows and vectors left after the tombstoned documents go; redactions stay on purpose."""
    gone = table(spark, d, "doc_tombstones")
    chunks = tables.delete(table(spark, d, "chunks_index").select("chunk_id", "doc_id"), gone, "doc_id")
    index = tables.delete(table(spark, d, "chunk_fts").select("chunk_id", "doc_id"), gone, "doc_id")
    dead = table(spark, d, "chunks_index").join(gone, "doc_id", "left_semi").select("chunk_id")
    vectors = tables.delete(table(spark, d, "vector_store").select("vec_id", "chunk_id"), dead, "chunk_id")
    parts = [("chunks_index", chunks), ("chunk_fts", index), ("vector_store", vectors), ("redaction_map", table(spark, d, "redaction_map").select("id"))]
    out = [p.agg(F.count(F.lit(1)).alias("left_over")).select(F.lit(n).alias("table_name"), "left_over") for n, p in parts]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def doc_replace(spark: SparkSession, d: str) -> DataFrame:
    """Chunks after the documents with an id divisible by 7 are indexed anew as one chunk each."""
    rows = _chunks(spark, d).select("chunk_id", "doc_id", F.length("content").alias("chars"))
    fresh = table(spark, d, "documents").where("doc_id % 7 = 0").select(F.concat(F.col("doc_id").cast("string"), F.lit("-0000")).alias("chunk_id"), "doc_id", F.length("text").alias("chars"))
    return tables.replace_children(rows, fresh, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("chars").cast("long").alias("chars"))


def mode_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Bases of which any document is private become private themselves; the rest keep their mode."""
    bases, docs = table(spark, d, "knowledge_bases"), table(spark, d, "documents")
    private = docs.where("mode = 'privacy'").select("kb_name").distinct().withColumn("p", F.lit(True))
    return bases.join(private, "kb_name", "left").select("kb_name", F.when(F.col("p"), "privacy").otherwise(F.coalesce("mode", F.lit("normal"))).alias("mode"))


def kb_mode_semi(spark: SparkSession, d: str) -> DataFrame:
    """Private bases that hold documents."""
    return table(spark, d, "knowledge_bases").where("mode = 'privacy'").join(table(spark, d, "documents"), "kb_name", "left_semi").select("kb_name")


# ---- routing ----------------------------------------------------------------------------------------------------------
def route_scope(spark: SparkSession, d: str) -> DataFrame:
    alive = table(spark, d, "knowledge_bases").where("deleted_at is null")
    out = scope.route(_log(spark, d).select("id", "kb_names"), "kb_names", alive, "kb_name")
    return out.select("id", F.array_join("routed", "、").alias("routed"), F.array_join("missing", "、").alias("missing"), "outcome")


def mode_resolve(spark: SparkSession, d: str) -> DataFrame:
    return scope.resolve_mode(_log(spark, d), "id", "kb_names", table(spark, d, "knowledge_bases"), "kb_name", "mode")


# ---- sessions ---------------------------------------------------------------------------------------------------------
def _sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions as the log tells of them: titled by their first question."""
    rows = _log(spark, d).where("session_id is not null")
    return rows.groupBy("session_id").agg(
        T.shorten(F.min_by("question", "id"), 24).alias("title"), F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"), F.count(F.lit(1)).alias("turns"), F.max("id").alias("last_id")
    )


def session_list(spark: SparkSession, d: str) -> DataFrame:
    """The 50 sessions last used."""
    top = _sessions(spark, d).orderBy(F.desc_nulls_last("updated_at"), F.desc("last_id")).limit(50)
    return top.select("session_id", "title", "turns", F.date_format("updated_at", "HH:mm").alias("clock"))


def session_turns(spark: SparkSession, d: str) -> DataFrame:
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return _sessions(spark, d).select("session_id", "turns", stamp("created_at"), stamp("updated_at"))


def turn_index(spark: SparkSession, d: str) -> DataFrame:
    rows = row_numbers(_log(spark, d).select("id", "session_id"), "session_id", [F.col("id")], "turn")  # records without a session are one group
    return rows.select("id", "session_id", "turn")


def history_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Records of each session after those without one are put under a session of their own, with its title."""
    own = F.when(F.coalesce("session_id", F.lit("")) == "", P.OLD_SESSION).otherwise(F.col("session_id"))
    rows = _log(spark, d).select(own.alias("session_id")).groupBy("session_id").agg(F.count(F.lit(1)).alias("records"))
    titles = _sessions(spark, d).select("session_id", "title")
    old = F.when(F.col("session_id") == P.OLD_SESSION, P.OLD_TITLE)
    return rows.join(titles, "session_id", "left").select("session_id", "records", F.coalesce(old, "title", F.lit("")).alias("title"))


def session_delete(spark: SparkSession, d: str) -> DataFrame:
    """What is left after all sessions that hold a private question are deleted with their records."""
    log = _log(spark, d)
    gone = log.where(F.col("mode").isin("隐私模式", "privacy") & F.col("session_id").isNotNull()).select("session_id").distinct()
    records, sessions = tables.delete(log.select("session_id"), gone, "session_id"), tables.delete(_sessions(spark, d).select("session_id"), gone, "session_id")
    return records.agg(F.count(F.lit(1)).alias("left_over")).select(F.lit("query_log").alias("table_name"), "left_over").unionByName(sessions.agg(F.count(F.lit(1)).alias("left_over")).select(F.lit("sessions").alias("table_name"), "left_over"))


def recent_records(spark: SparkSession, d: str) -> DataFrame:
    """The last 100 records with their session's title, empty if there is none."""
    rows = _log(spark, d).orderBy(F.desc("id")).limit(100).join(_sessions(spark, d).select("session_id", "title"), "session_id", "left")
    return rows.select("id", F.coalesce("title", F.lit("")).alias("title"), T.shorten("question", 20).alias("question"), F.when(F.col("mode").isin("隐私模式", "privacy"), "隐私").otherwise("普通").alias("mode"))


def latest_session(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).agg(F.max_by("session_id", F.struct("updated_at", "last_id")).alias("session_id"))


def session_messages(spark: SparkSession, d: str) -> DataFrame:
    """A session's turns as messages of user and assistant, blank ones skipped."""
    rows = _log(spark, d).where("session_id is not null")
    pair = F.array(F.struct(F.lit(0).alias("part"), F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit(1).alias("part"), F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    each = rows.select("session_id", "id", F.explode(pair).alias("m")).where(~T.blank("m.content"))
    w = Window.partitionBy("session_id").orderBy("id", "m.part")
    return each.select("session_id", F.row_number().over(w).alias("message_no"), "m.role", F.md5("m.content").alias("content_md5"))


def log_daily(spark: SparkSession, d: str) -> DataFrame:
    """Questions by day and mode, each once, and how many came late by more than a day."""
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    late = seconds("ingested_at") - seconds("created_at") > 86400
    mode = F.when(F.col("mode").isin("隐私模式", "privacy"), "privacy").otherwise("normal")
    return _log(spark, d).groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day"), mode.alias("mode")).agg(F.count(F.lit(1)).alias("questions"), F.sum(F.when(late, 1).otherwise(0)).alias("late"))


# ---- answers ----------------------------------------------------------------------------------------------------------
def _refs(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).select("id", F.posexplode(F.from_json("refs_json", _REFS)).alias("position", "r")).select("id", "position", "r.*")


def citations(spark: SparkSession, d: str) -> DataFrame:
    """Citation numbers of every answer, those among its references, else the first three."""
    rows = _log(spark, d).select("id", "answer", F.coalesce(F.size(F.from_json("refs_json", _REFS)), F.lit(0)).alias("n"))
    rows = rows.withColumn("n", F.greatest("n", F.lit(0)))
    out = fusion.cited(rows, "answer", "n")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return out.select("id", text(T.citations("answer")).alias("numbers"), text(F.col("cited")).alias("cited"))


def answer_links(spark: SparkSession, d: str) -> DataFrame:
    """Answers as safe HTML with citations that have a reference as superscripts."""
    tips = _refs(spark, d).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("index", F.concat(F.coalesce("source_kb", F.lit("")), F.when(F.col("page") > 0, F.concat(F.lit(" · 第 "), F.col("page").cast("string"), F.lit(" 页"))).otherwise(""))))).alias("tips"))
    rows = _log(spark, d).where("answer is not null").select("id", "answer").join(tips, "id", "left")
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    nums = F.array_distinct(F.regexp_extract_all("answer", F.lit(P.CITATION), F.lit(1)))

    def link(acc: F.Column, n: F.Column) -> F.Column:
        tip = F.element_at("tips", n.cast("int"))
        mark = F.concat(F.lit('<sup class="cite" title="'), F.replace(safe(tip), F.lit('"'), F.lit("&quot;")), F.lit('">'), n.cast("int").cast("string"), F.lit("</sup>"))
        return F.when(tip.isNull(), acc).otherwise(F.replace(acc, F.concat(F.lit("["), n, F.lit("]")), mark))

    return rows.select("id", F.md5(F.aggregate(nums, safe(F.col("answer")), link)).alias("html_md5"))


def citation_snippet(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("chunk_id", "content").distinct().select("chunk_id", T.snippet("content").alias("snippet"))


def masked_names(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each base under neutral names, numbered by upload."""
    ext = F.regexp_extract(F.coalesce("filename", F.lit("")), r"(?s)[^.](\.[^.]*)$", 1)
    rows = table(spark, d, "documents").where("file_path is not null or filename is not null").select("kb_name", "doc_id", "upload_time", ext.alias("ext"))
    rows = row_numbers(rows, "kb_name", [F.col("upload_time"), F.col("doc_id")])
    return rows.select("doc_id", F.concat(F.lit("文档"), F.col("n").cast("string"), "ext").alias("masked"))


def citation_panel(spark: SparkSession, d: str) -> DataFrame:
    """The list of references of every answer as Markdown."""
    line = F.concat(F.lit("**"), F.col("index").cast("string"), F.lit(". "), F.coalesce("file_name", F.lit("未知文件")), F.lit("** · "), F.when(F.col("page") > 0, F.concat(F.lit("第 "), F.col("page").cast("string"), F.lit(" 页"))).otherwise("（无页码信息）"), F.lit(" · 知识库："), F.coalesce("source_kb", F.lit("未标注")))
    return _refs(spark, d).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"]), "\n").alias("panel"))


def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    rows = _log(spark, d)
    key = T.fingerprint("question", scope.scope_list("kb_names"), F.lit("all"), "mode", F.lit(True))
    return rows.select("id", key.alias("fingerprint"))


def cache_latest(spark: SparkSession, d: str) -> DataFrame:
    """Cached answers by question and scope, the last one of each, decoded; what can't be decoded has no answer."""
    rows = tables.latest(table(spark, d, "qa_cache"), ["question", "kb_names"], F.desc_nulls_last("created_at"), F.asc("fingerprint"))
    payload = F.from_json("payload", "answer string, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    whole = rows.withColumn("p", payload).select("fingerprint", "mode", F.when(F.col("p._corrupt").isNull(), F.col("p.answer")).alias("answer"))
    return whole.select("fingerprint", "mode", F.coalesce(F.length("answer"), F.lit(-1)).alias("chars"))


def cache_probe(spark: SparkSession, d: str) -> DataFrame:
    """Logged questions that a cached answer of the same question, bases and mode would have served."""
    key = lambda q, k, m: [T.collapse(q).alias("q"), F.array_join(F.array_sort(scope.scope_list(k)), "、").alias("k"), F.col(m).alias("m")]
    hits = table(spark, d, "qa_cache").select(*key("question", "kb_names", "mode")).distinct()
    return _log(spark, d).select("id", *key("question", "kb_names", "mode")).join(hits, ["q", "k", "m"], "left_semi").select("id")


def chunk_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as flat vector metadata: no nulls, page 0 where there is none."""
    rows = _chunks(spark, d).join(table(spark, d, "documents").select("doc_id", "filename", "file_path").dropDuplicates(["doc_id"]), "doc_id", "left")
    flat = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("chunk_id", "doc_id", "kb_name", "filename", "file_path", "chunk_type", "section_id")]
    return rows.select(*flat, F.coalesce("page", F.lit(0)).alias("page"))


def chunk_positions(spark: SparkSession, d: str) -> DataFrame:
    """Stored positions decoded; bad JSON reads as no position."""
    rows = table(spark, d, "chunks_index").select("chunk_id", F.from_json("pos_json", "bbox array<double>, paragraph_index int").alias("p")).distinct()
    none = lambda c, v: F.coalesce(c, F.lit(v))
    return rows.select("chunk_id", none(F.element_at("p.bbox", 1), -1.0).alias("x0"), none(F.element_at("p.bbox", 4), -1.0).alias("y1"), none(F.col("p.paragraph_index"), -1).alias("paragraph_index"))


def char_counts(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose stored length is wrong or missing."""
    rows = table(spark, d, "chunks_index").select("chunk_id", "char_count", F.length("content").alias("chars")).distinct()
    return rows.where("char_count is null or char_count <> chars").withColumn("char_count", F.coalesce("char_count", F.lit(-1)))


def embed_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Different texts to embed, and how many chunks share each: stripped, blank ones under one name, cut."""
    text = T.strip("content")
    body = F.when(F.coalesce(text, F.lit("")) == "", F.lit(P.EMPTY_TEXT)).otherwise(F.substring(text, 1, P.EMBED_CHARS))
    rows = table(spark, d, "chunks_index").select("chunk_id", F.sha1(body.cast("binary")).alias("text_key"))
    return rows.groupBy("text_key").agg(F.count_distinct("chunk_id").alias("chunks"))


def api_call_totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.max("event_id").alias("last_seq"))


QUERIES = {f.__name__: f for f in (history_backfill, session_delete, file_address, citation_restored, route_document,
    doc_counts, stats, kb_overview, collection_names, list_documents, list_files, latest_documents, stored_names, file_available,
    upsert_latest, insert_ignored, delete_cascade, doc_replace, mode_backfill, kb_mode_semi, route_scope, mode_resolve,
    session_list, session_turns, turn_index, recent_records, latest_session, session_messages, log_daily,
    citations, answer_links, citation_snippet, masked_names, citation_panel, fingerprint, cache_latest, cache_probe,
    chunk_metadata, chunk_positions, char_counts, embed_dedup, api_call_totals,
)}

_LOG = "log AS (SELECT * EXCLUDE (_n) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at NULLS LAST, created_at NULLS LAST, question NULLS LAST) AS _n FROM query_log) x WHERE _n = 1)"


def _short(x: str, n: int) -> str:
    c = sql.collapse(x)
    return f"CASE WHEN length({c}) <= {n} THEN {c} ELSE rtrim(substring({c}, 1, {n})) || '…' END"


_SESS = f"{_LOG}, sess AS (SELECT session_id, {_short('q', 24)} AS title, created_at, updated_at, turns, last_id FROM (SELECT session_id, min_by(question, id) AS q, min(created_at) AS created_at, max(created_at) AS updated_at, count(*) AS turns, max(id) AS last_id FROM log WHERE session_id IS NOT NULL GROUP BY session_id) x)"
_NAMES = f"list_filter(list_transform(string_split(coalesce(kb_names, ''), '、'), lambda x: {sql.strip('x')}), lambda x: x <> '')"
_ORDERED = "list_filter(n, lambda x, i: list_position(n, x) = i)"
_PATH = r"regexp_replace(replace(file_path, '\', '/'), '^(\./)+', '')"
_CITED = r"list_transform(regexp_extract_all(coalesce(answer, ''), '\[(\d{1,2})\]', 1), lambda x: CAST(x AS INT))"
_EXT = r"regexp_extract(coalesce(%s, ''), '(?s)[^.](\.[^.]*)$', 1)"

SQL = {
    "doc_counts": "SELECT coalesce(k.kb_name, c.kb_name) AS kb_name, CASE WHEN k.kb_name IS NULL THEN -2 ELSE coalesce(k.doc_count, -1) END AS stored, coalesce(n, 0) AS documents FROM knowledge_bases k FULL JOIN (SELECT kb_name, count(*) AS n FROM documents WHERE kb_name IS NOT NULL GROUP BY kb_name) c ON k.kb_name = c.kb_name",
    "stats": "SELECT (SELECT count(*) FROM knowledge_bases) AS bases, (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM chunks_index) AS chunks, (SELECT count(*) FROM redaction_map) AS redactions, (SELECT count(*) FROM query_log) AS queries",
    "kb_overview": "SELECT kb_name, '- `' || kb_name || '` · **' || CASE WHEN mode = 'privacy' THEN '隐私模式' ELSE '普通模式' END || '** · 文档 ' || (SELECT count(*) FROM documents t WHERE t.kb_name = k.kb_name) || ' 个 · 向量块 ' || (SELECT count(*) FROM vector_store t WHERE t.kb_name = k.kb_name) || ' 个 · 脱敏项 ' || (SELECT count(*) FROM redaction_map t WHERE t.kb_name = k.kb_name) || ' 条' AS line FROM knowledge_bases k",
    "collection_names": "SELECT kb_name, 'kb_' || substring(sha1(kb_name), 1, 16) AS collection FROM knowledge_bases",
    "list_documents": "SELECT kb_name, doc_id, filename, row_number() OVER (PARTITION BY kb_name ORDER BY upload_time DESC NULLS LAST, doc_id) AS position FROM documents",
    "list_files": f"SELECT kb_name, path, row_number() OVER (PARTITION BY kb_name ORDER BY path) AS position FROM (SELECT DISTINCT kb_name, {_PATH} AS path FROM archive_files WHERE removed_at IS NULL) x",
    "latest_documents": "SELECT kb_name, doc_id, filename FROM (SELECT *, row_number() OVER (PARTITION BY kb_name ORDER BY upload_time DESC NULLS LAST, doc_id) AS n FROM documents WHERE kb_name IS NOT NULL) x WHERE n = 1",
    "stored_names": rf"""WITH s AS (SELECT doc_id, kb_name, trim(regexp_replace({sql.strip("coalesce(filename, '')")}, '[\\/:*?"<>|\r\n\t]', '_', 'g'), ' .') AS c FROM documents), m AS (SELECT doc_id, kb_name, CASE WHEN c = '' THEN 'file' ELSE c END AS name FROM s),
      n AS (SELECT *, row_number() OVER (PARTITION BY kb_name, name ORDER BY doc_id) - 1 AS n, {_EXT % 'name'} AS ext FROM m) SELECT doc_id, CASE WHEN n = 0 THEN name ELSE substring(name, 1, length(name) - length(ext)) || '_' || n || ext END AS stored_name FROM n""",
    "file_address": rf"""WITH a AS (SELECT DISTINCT {_PATH} AS g FROM archive_files WHERE removed_at IS NULL),
      p AS (SELECT doc_id, coalesce(nullif({_PATH}, ''), g, '') AS path FROM documents LEFT JOIN a ON g = concat_ws('/', 'archive', kb_name, filename))
      SELECT DISTINCT chunk_id, c.doc_id, CASE WHEN path = '' THEN '' ELSE CASE WHEN path LIKE '/%' THEN 'file://' || replace(url_encode(path), '%2F', '/') ELSE 'file:///' || path END || CASE WHEN page <> 0 THEN '#page=' || page ELSE '' END END AS address
      FROM chunks_index c JOIN p USING (doc_id)""",
    "route_document": "WITH b AS (SELECT DISTINCT kb_name AS k FROM knowledge_bases WHERE deleted_at IS NULL) SELECT doc_id, CASE WHEN trim(coalesce(kb_name, '')) <> '' AND k IS NOT NULL THEN trim(kb_name) ELSE '' END AS routed, CASE WHEN trim(coalesce(kb_name, '')) = '' THEN 'no_base' WHEN k IS NULL THEN 'gone' ELSE 'ok' END AS outcome FROM documents LEFT JOIN b ON k = trim(kb_name)",
    "citation_restored": f"""WITH RECURSIVE c AS (SELECT DISTINCT chunk_id, content || chr(1) || coalesce(filename, '') || chr(1) || coalesce(i.kb_name, '') AS content FROM chunks_index i LEFT JOIN documents USING (doc_id)),
      o AS (SELECT placeholder, min_by(original, id) AS original FROM redaction_map GROUP BY placeholder),
      u AS (SELECT chunk_id, content, p, o.original FROM (SELECT chunk_id, content, unnest(list_distinct(regexp_extract_all(content, '{_MARK}'))) AS p FROM c) x JOIN o ON o.placeholder = p),
      n AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, content ORDER BY length(p) DESC, p) AS i, count(*) OVER (PARTITION BY chunk_id, content) AS n FROM u),
      f AS (SELECT DISTINCT chunk_id, content, 1 AS i, content AS t FROM n UNION ALL SELECT f.chunk_id, f.content, f.i + 1, replace(f.t, n.p, coalesce(n.original, '')) FROM f JOIN n ON n.chunk_id = f.chunk_id AND n.content = f.content AND n.i = f.i)
      SELECT f.chunk_id, md5(split_part(f.t, chr(1), 1)) AS content_md5, md5(split_part(f.t, chr(1), 2)) AS filename_md5, md5(split_part(f.t, chr(1), 3)) AS kb_name_md5
      FROM f JOIN (SELECT DISTINCT chunk_id, content, n FROM n) z ON z.chunk_id = f.chunk_id AND z.content = f.content WHERE f.i = z.n + 1""",
    "file_available": f"WITH a AS (SELECT DISTINCT {_PATH} AS path FROM archive_files WHERE removed_at IS NULL) SELECT doc_id, a.path IS NOT NULL AS available, coalesce(filename, '未知文件') || CASE WHEN a.path IS NULL THEN '（原件未找到）' ELSE '' END AS label FROM documents d LEFT JOIN a ON a.path = {_PATH}",
    "upsert_latest": "SELECT o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM (SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'R' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders) x GROUP BY o_orderstatus",
    "insert_ignored": "SELECT origin, count(*) AS chunks FROM (SELECT DISTINCT chunk_id, 'old' AS origin FROM chunk_fts UNION ALL SELECT DISTINCT chunk_id, 'new' FROM chunks_index WHERE chunk_id NOT IN (SELECT chunk_id FROM chunk_fts WHERE chunk_id IS NOT NULL)) x GROUP BY origin",
    "delete_cascade": """WITH g AS (SELECT doc_id FROM doc_tombstones) SELECT 'chunks_index' AS table_name, count(*) AS left_over FROM chunks_index c WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = c.doc_id)
      UNION ALL SELECT 'chunk_fts', count(*) FROM chunk_fts c WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = c.doc_id)
      UNION ALL SELECT 'vector_store', count(*) FROM vector_store v WHERE NOT EXISTS (SELECT 1 FROM chunks_index c JOIN g USING (doc_id) WHERE c.chunk_id = v.chunk_id)
      UNION ALL SELECT 'redaction_map', count(*) FROM redaction_map""",
    "doc_replace": """WITH f AS (SELECT doc_id || '-0000' AS chunk_id, doc_id, length(text) AS chars FROM documents WHERE doc_id % 7 = 0), c AS (SELECT DISTINCT chunk_id, doc_id, kb_name, page, chunk_type, section_id, content FROM chunks_index)
      SELECT doc_id, count(*) AS chunks, CAST(sum(chars) AS BIGINT) AS chars FROM (SELECT chunk_id, doc_id, length(content) AS chars FROM c WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = c.doc_id) UNION ALL SELECT * FROM f) x GROUP BY doc_id""",
    "mode_backfill": "SELECT kb_name, CASE WHEN kb_name IN (SELECT kb_name FROM documents WHERE mode = 'privacy' AND kb_name IS NOT NULL) THEN 'privacy' ELSE coalesce(mode, 'normal') END AS mode FROM knowledge_bases",
    "kb_mode_semi": "SELECT kb_name FROM knowledge_bases WHERE mode = 'privacy' AND kb_name IN (SELECT kb_name FROM documents WHERE kb_name IS NOT NULL)",
    "route_scope": f"""WITH {_LOG}, a AS (SELECT list(kb_name) AS names FROM knowledge_bases WHERE deleted_at IS NULL), s AS (SELECT id, {_ORDERED} AS c FROM (SELECT id, {_NAMES} AS n FROM log) x),
      r AS (SELECT id, c, list_filter(c, lambda x: list_contains(names, x)) AS k, list_filter(c, lambda x: NOT list_contains(names, x)) AS m FROM s CROSS JOIN a)
      SELECT id, coalesce(array_to_string(k, '、'), '') AS routed, coalesce(array_to_string(m, '、'), '') AS missing, CASE WHEN len(c) = 0 THEN 'none_selected' WHEN len(k) = 0 THEN 'all_missing' WHEN len(m) > 0 THEN 'some_missing' ELSE 'ok' END AS outcome FROM r""",
    "mode_resolve": f"WITH {_LOG}, p AS (SELECT list(kb_name) AS names FROM knowledge_bases WHERE mode = 'privacy') SELECT id, CASE WHEN len(list_filter({_NAMES}, lambda x: list_contains(names, x))) > 0 THEN 'privacy' ELSE 'normal' END AS mode FROM log CROSS JOIN p",
    "session_list": f"WITH {_SESS} SELECT session_id, title, turns, strftime(updated_at, '%H:%M') AS clock FROM sess ORDER BY updated_at DESC NULLS LAST, last_id DESC LIMIT 50",
    "session_turns": f"WITH {_SESS} SELECT session_id, turns, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at FROM sess",
    "history_backfill": f"WITH {_SESS} SELECT session_id, records, CASE WHEN session_id = '{P.OLD_SESSION}' THEN '{P.OLD_TITLE}' ELSE coalesce(title, '') END AS title FROM (SELECT CASE WHEN coalesce(session_id, '') = '' THEN '{P.OLD_SESSION}' ELSE session_id END AS session_id, count(*) AS records FROM log GROUP BY 1) r LEFT JOIN sess USING (session_id)",
    "session_delete": f"WITH {_SESS}, gone AS (SELECT DISTINCT session_id AS g FROM log WHERE mode IN ('隐私模式', 'privacy') AND session_id IS NOT NULL) SELECT 'query_log' AS table_name, count(*) AS left_over FROM log WHERE session_id IS NULL OR session_id NOT IN (SELECT g FROM gone) UNION ALL SELECT 'sessions', count(*) FROM sess WHERE session_id IS NULL OR session_id NOT IN (SELECT g FROM gone)",
    "turn_index": f"WITH {_LOG} SELECT id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY id) AS turn FROM log",
    "recent_records": f"WITH {_SESS} SELECT r.id, coalesce(title, '') AS title, {_short('question', 20)} AS question, CASE WHEN mode IN ('隐私模式', 'privacy') THEN '隐私' ELSE '普通' END AS mode FROM (SELECT * FROM log ORDER BY id DESC LIMIT 100) r LEFT JOIN sess USING (session_id)",
    "latest_session": f"WITH {_SESS} SELECT session_id FROM sess WHERE updated_at IS NOT NULL ORDER BY updated_at DESC, last_id DESC LIMIT 1",
    "session_messages": f"""WITH {_LOG}, m AS (SELECT session_id, id, 0 AS part, 'user' AS role, question AS content FROM log UNION ALL SELECT session_id, id, 1, 'assistant', answer FROM log)
      SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY id, part) AS message_no, role, md5(content) AS content_md5 FROM m WHERE session_id IS NOT NULL AND {sql.strip('content')} <> ''""",
    "log_daily": f"WITH {_LOG} SELECT strftime(created_at, '%Y-%m-%d') AS day, CASE WHEN mode IN ('隐私模式', 'privacy') THEN 'privacy' ELSE 'normal' END AS mode, count(*) AS questions, CAST(sum(CASE WHEN floor(epoch(ingested_at)) - floor(epoch(created_at)) > 86400 THEN 1 ELSE 0 END) AS BIGINT) AS late FROM log GROUP BY 1, 2",
    "citations": f"""WITH {_LOG}, c AS (SELECT id, {_CITED} AS n, coalesce(json_array_length(refs_json), 0) AS h FROM log), u AS (SELECT id, h, {_ORDERED} AS u FROM c), g AS (SELECT *, list_filter(u, lambda x: x >= 1 AND x <= h) AS g FROM u)
      SELECT id, array_to_string(u, ',') AS numbers, array_to_string(CASE WHEN len(g) > 0 THEN g ELSE range(1, CAST(1 + least(3, h) AS BIGINT)) END, ',') AS cited FROM g""",
    "citation_snippet": rf"""WITH c AS (SELECT DISTINCT chunk_id, content FROM chunks_index), p AS (SELECT chunk_id, replace(replace(replace(regexp_replace(regexp_replace({sql.collapse('content')}, '\*{{1,3}}|_{{2,}}', '', 'g'), '`+', '', 'g'), '](', ']\('), '<', '&lt;'), '>', '&gt;') AS s FROM c)
      SELECT chunk_id, CASE WHEN length(s) <= 300 THEN s ELSE rtrim(substring(s, 1, 300)) || '…' END AS snippet FROM p""",
    "masked_names": f"SELECT doc_id, '文档' || row_number() OVER (PARTITION BY kb_name ORDER BY upload_time NULLS FIRST, doc_id) || {_EXT % 'filename'} AS masked FROM documents WHERE file_path IS NOT NULL OR filename IS NOT NULL",
    "cache_latest": """SELECT fingerprint, mode, coalesce(length(CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.answer') END), -1) AS chars
      FROM (SELECT *, row_number() OVER (PARTITION BY question, kb_names ORDER BY created_at DESC NULLS LAST, fingerprint) AS n FROM qa_cache) x WHERE n = 1""",
    "answer_links": rf"""WITH RECURSIVE {_LOG}, r AS (SELECT id, unnest(from_json(refs_json, '[{{"index":"INT","source_kb":"VARCHAR","page":"INT"}}]')) AS r FROM log WHERE refs_json IS NOT NULL),
      tip AS (SELECT id, r.index AS n, any_value(replace(replace(replace(replace(coalesce(r.source_kb, '') || CASE WHEN r.page > 0 THEN ' · 第 ' || r.page || ' 页' ELSE '' END, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS t FROM r GROUP BY id, r.index),
      m AS (SELECT id, answer, regexp_extract_all(answer, '\[(\d{{1,2}})\]', 1) AS n FROM log WHERE answer IS NOT NULL),
      f AS (SELECT id, 1 AS i, replace(replace(replace(answer, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t FROM m
        UNION ALL SELECT f.id, i + 1, CASE WHEN tip.t IS NULL THEN f.t ELSE replace(f.t, '[' || m.n[i] || ']', '<sup class="cite" title="' || tip.t || '">' || CAST(m.n[i] AS INT) || '</sup>') END
          FROM f JOIN m USING (id) LEFT JOIN tip ON tip.id = f.id AND tip.n = CAST(m.n[i] AS INT) WHERE i <= len(m.n))
      SELECT f.id, md5(f.t) AS html_md5 FROM f JOIN m USING (id) WHERE i = len(m.n) + 1""".replace("\\\\", "\\"),
    "citation_panel": f"""WITH {_LOG}, r AS (SELECT id, unnest(from_json(refs_json, '[{{"index":"INT","source_kb":"VARCHAR","file_name":"VARCHAR","page":"INT"}}]')) AS r, unnest(range(json_array_length(refs_json)::BIGINT)) AS p FROM log WHERE refs_json IS NOT NULL)
      SELECT id, string_agg('**' || r.index || '. ' || coalesce(r.file_name, '未知文件') || '** · ' || CASE WHEN r.page > 0 THEN '第 ' || r.page || ' 页' ELSE '（无页码信息）' END || ' · 知识库：' || coalesce(r.source_kb, '未标注'), chr(10) ORDER BY p) AS panel FROM r GROUP BY id""",
    "chunk_positions": "SELECT DISTINCT chunk_id, coalesce(CAST(json_extract(pos_json, '$.bbox[0]') AS DOUBLE), -1) AS x0, coalesce(CAST(json_extract(pos_json, '$.bbox[3]') AS DOUBLE), -1) AS y1, coalesce(CAST(json_extract(pos_json, '$.paragraph_index') AS INT), -1) AS paragraph_index FROM chunks_index",
    "fingerprint": f"WITH {_LOG}, n AS (SELECT id, question, mode, {_NAMES} AS n FROM log) SELECT id, sha1({sql.collapse('question')} || '|' || coalesce(array_to_string(list_sort(list_distinct(n)), '、'), '') || '|all|' || coalesce(mode, '') || '|strict') AS fingerprint FROM n",
    "cache_probe": f"""WITH {_LOG}, c AS (SELECT DISTINCT {sql.collapse('question')} AS q, array_to_string(list_sort(list_distinct({_NAMES})), '、') AS k, mode AS m FROM qa_cache)
      SELECT id FROM log WHERE EXISTS (SELECT 1 FROM c WHERE c.q = {sql.collapse('log.question')} AND c.k = array_to_string(list_sort(list_distinct({_NAMES.replace('kb_names', 'log.kb_names')})), '、') AND c.m = log.mode)""",
    "chunk_metadata": """WITH c AS (SELECT DISTINCT chunk_id, doc_id, kb_name, page, chunk_type, section_id, content FROM chunks_index)
      SELECT coalesce(chunk_id, '') AS chunk_id, coalesce(CAST(c.doc_id AS VARCHAR), '') AS doc_id, coalesce(c.kb_name, '') AS kb_name, coalesce(filename, '') AS filename, coalesce(file_path, '') AS file_path, coalesce(chunk_type, '') AS chunk_type, coalesce(section_id, '') AS section_id, coalesce(page, 0) AS page FROM c LEFT JOIN documents d ON d.doc_id = c.doc_id""",
    "char_counts": "SELECT DISTINCT chunk_id, coalesce(char_count, -1) AS char_count, length(content) AS chars FROM chunks_index WHERE char_count IS NULL OR char_count <> length(content)",
    "embed_dedup": f"SELECT text_key, count(DISTINCT chunk_id) AS chunks FROM (SELECT chunk_id, sha1(CASE WHEN coalesce({sql.strip('content')}, '') = '' THEN '（空内容）' ELSE substring({sql.strip('content')}, 1, 3000) END) AS text_key FROM chunks_index) x GROUP BY text_key",
    "api_call_totals": "SELECT event_type, count(*) AS calls, max(event_id) AS last_seq FROM events GROUP BY event_type",
}
