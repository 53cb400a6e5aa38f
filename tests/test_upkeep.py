"""Keyed changes, routing, orphan state, sources, settings, models and streams."""

from __future__ import annotations

import io
import itertools
import random
import zipfile
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom import models
from docloom.operators import orphans, scope, tables
from docloom.operators.numbering import row_numbers
from docloom.runtime import drop_keys, hashed_sample, keep_keys, sized, small_enough
from docloom.sources import files, settings
from docloom.streaming import ingest


def test_keyed_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(tables.upsert(old, new, ["k"])) == [(1, "a"), (2, "B"), (3, "C")]
    assert rows(tables.insert_ignore(old, new, ["k"])) == [(1, "a"), (2, "b"), (3, "C")]
    assert rows(tables.delete(old, new, "k")) == [(1, "a")]
    names = spark.createDataFrame([("g", "a.pdf", 1), ("g", "a.pdf", 2), ("h", "a.pdf", 3), ("g", "x", 4), ("g", "x", 5)], "g string, n string, o int")
    assert [r.stored_name for r in tables.collision_names(names, "g", "n", "o").orderBy("o").collect()] == ["a.pdf", "a_1.pdf", "a.pdf", "x", "x_1"]


def test_row_numbers_over_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a"] * 5 + ["b", None]), rng.randrange(40), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, x int, i int")
    got = {r.i: r.n for r in row_numbers(df, "g", [F.col("x"), F.col("i")]).collect()}
    want = {}
    for g in ("a", "b", None):
        want |= {i: n for n, (_, i) in enumerate(sorted((x, i) for h, x, i in rows if h == g), 1)}
    assert got == want and row_numbers(df.limit(0), "g", [F.col("x")]).count() == 0


def test_bounds(spark, tmp_path):
    df = spark.range(5000)
    one = {r.id for r in hashed_sample(df, 100, "id").collect()}
    assert len(one) == 100 and one == {r.id for r in hashed_sample(df.repartition(7), 100, "id").collect()}
    assert hashed_sample(spark.range(7), 100, "id").count() == 7
    assert small_enough(df, 5000 * 32) and not small_enough(df, 4999 * 32)
    assert "hint" in sized(df)._jdf.queryExecution().logical().toString().lower()
    assert "hint" not in sized(df, 64)._jdf.queryExecution().logical().toString().lower()
    kept = sorted(r.id for r in keep_keys(df, spark.range(3), "id").collect())
    assert kept == [0, 1, 2] and drop_keys(spark.range(4), spark.range(3), "id", budget=1).count() == 1


def test_routing(spark):
    q = spark.createDataFrame([(1, " a 、b、a"), (2, "x"), (3, ""), (4, "a、x"), (5, None)], "id int, s string")
    have = spark.createDataFrame([("a", "privacy"), ("b", "normal")], "n string, m string")
    got = {r.id: (r.routed, r.missing, r.outcome) for r in scope.route(q, "s", have, "n").collect()}
    assert got == {1: (["a", "b"], [], "ok"), 2: ([], ["x"], "all_missing"), 3: ([], [], "none_selected"), 4: (["a"], ["x"], "some_missing"), 5: ([], [], "none_selected")}
    assert {r.outcome for r in scope.route(q.where("id = 2"), "s", have.limit(0), "n").collect()} == {"ok"}
    assert {r.id: r["mode"] for r in scope.resolve_mode(q, "id", "s", have, "n", "m").collect()} == {1: "privacy", 2: "normal", 3: "normal", 4: "privacy", 5: "normal"}


def test_file_addresses_and_documents(spark):
    from docloom.functions import text as T

    rows = [("/a b/ü~#.pdf", 3), ("dir\\x y.pdf", None), ("", 2), (None, 1), ("/p", 0)]
    got = [r.a for r in spark.createDataFrame(rows, "p string, n int").select(T.file_address("p", "n").alias("a")).collect()]
    assert got == ["file:///a%20b/%C3%BC~%23.pdf#page=3", "file:///dir/x y.pdf", "", "", "file:///p"]
    docs, have = spark.createDataFrame([(1, " a "), (2, "x"), (3, None)], "id int, b string"), spark.createDataFrame([("a",), (None,)], "n string")
    assert {r.id: (r.routed, r.outcome) for r in scope.route_document(docs, "b", have, "n").collect()} == {1: ("a", "ok"), 2: (None, "gone"), 3: (None, "no_base")}
    assert {r.outcome for r in scope.route_document(docs.where("id = 2"), "b", have.limit(0), "n").collect()} == {"ok"}


def test_touched_sessions(spark):
    old = spark.createDataFrame([("a", "t", "k", 1, 1), ("b", "u", "k", 1, 2)], "session_id string, title string, kb_names string, created_at int, updated_at int")
    touched = spark.createDataFrame([("a", "", "x", 5), ("a", "new", "y", 4), ("c", None, "z", 7), ("", "no", "z", 9), (None, "no", "z", 9)], "session_id string, title string, kb_names string, at int")
    assert sorted(map(tuple, tables.touch_sessions(old, touched).collect())) == [("a", "new", "y", 1, 5), ("b", "u", "k", 1, 2), ("c", "", "z", 7, 7)]


def test_once_and_sizes(spark):
    from docloom import runtime

    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "d"), (3, None), (3, None)]
    df = spark.createDataFrame(rows, "k int, t string")
    assert sorted(map(tuple, runtime.once(df, "k").collect()), key=str) == sorted(set(rows), key=str)
    long = spark.createDataFrame([("x" * 1000,)] * 20, "t string")
    assert runtime.small_enough(long, 30_000) and not runtime.small_enough(long, 15_000)


def history(spark, seed):
    rng = random.Random(seed)
    t0 = datetime(2024, 1, 1)
    when = lambda: t0 + timedelta(hours=rng.randrange(1000))
    keys = [f"k{i}" for i in range(12)] + [None]
    refs = [("d", rng.choice(keys), "s", "f", f"r{i}", rng.choice([when(), None])) for i in range(60)]
    events = [("d", rng.choice(keys[:8]), "arrive", rng.choice([when(), when(), None])) for _ in range(9)] + [("d", rng.choice(keys[:10]), "delete", when()) for _ in range(4)]
    return spark.createDataFrame(refs, orphans.REFS), spark.createDataFrame(events, orphans.EVENTS), refs, events


def expected(refs, events):
    out = set()
    for _, key, source, field, record, at in refs:
        own = [e for e in events if e[1] == key]
        since = [e[3] for e in own if e[2] == "arrive" and e[3]]
        if key is None:
            continue
        if any(e[2] == "delete" for e in own):
            out.add((source, field, record, "deleted"))
        elif not own:
            out.add((source, field, record, "missing"))
        elif at is not None and since and min(since) > at:
            out.add((source, field, record, "late"))
    return out


@pytest.mark.parametrize(("parts", "buckets"), [(1, 1), (3, 5)])
def test_orphans_do_not_depend_on_batches(spark, parts, buckets):
    refs, events, raw_refs, raw_events = history(spark, parts)
    state, own = orphans.Orphans.empty(spark, buckets), F.pmod(F.hash("target", "at"), F.lit(parts))
    for k in range(parts):
        state = orphans.step(state, refs.where(F.pmod(F.hash("record_key"), F.lit(parts)) == k), events.where(own == k))
    state = orphans.step(state, refs.limit(5), events.limit(3))  # what comes again counts once
    assert {tuple(r) for r in orphans.found(state).collect()} == expected(raw_refs, raw_events)
    assert orphans.snapshot(state).agg(F.sum("orphans")).first()[0] == len(expected(raw_refs, raw_events))
    assert state.refs().count() == len({r for r in raw_refs if r[1] is not None})


def test_orphans_resolve_and_reopen(spark):
    t = datetime(2024, 1, 1)
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    states, none = [], one([], orphans.EVENTS)
    state = orphans.step(orphans.Orphans.empty(spark), one([("d", "a", "s", "f", "r", t)], orphans.REFS), none)
    states.append(orphans.found(state).first().ref_state)
    for what in ("arrive", "delete", "arrive"):  # a deleted target stays deleted
        state = orphans.step(state, one([], orphans.REFS), one([("d", "a", what, t - timedelta(1))], orphans.EVENTS))
        states.append([r.ref_state for r in orphans.found(state).collect()])
    assert states == ["missing", [], ["deleted"], ["deleted"]]


def test_a_small_batch_touches_its_buckets_only(spark):
    rows = [("d", f"k{i}", "s", "f", f"r{i}", datetime(2024, 1, 1)) for i in range(200)]
    state = orphans.step(orphans.Orphans.empty(spark, 16), spark.createDataFrame(rows, orphans.REFS), spark.createDataFrame([], orphans.EVENTS))
    after = orphans.step(state, spark.createDataFrame([], orphans.REFS), spark.createDataFrame([("d", "k7", "arrive", None)], orphans.EVENTS))
    assert sum(state.ref_paths[b] != after.ref_paths[b] for b in state.ref_paths) == 1 and len(state.ref_paths) == 16
    assert orphans.found(after).count() == 199 and orphans.step(after, spark.createDataFrame([], orphans.REFS), spark.createDataFrame([], orphans.EVENTS)) == after


def test_snapshots_show_what_reopens(spark):
    by = {}
    for r in orphans.snapshots(spark, "/root/testdata/sf0.001").collect():
        by[r.period, r.ref_state] = by.get((r.period, r.ref_state), 0) + r.orphans
    assert 0 <= by.get((1, "deleted"), 0) < by[orphans.PERIODS, "deleted"]
    seen = [{tuple(r)[:3]: r.ref_state for r in s.refs().select("source_table", "field_name", "record_key", "ref_state").collect()} for s in orphans.replayed(spark, "/root/testdata/sf0.001")]
    assert any(seen[-1].get(k) == "deleted" and v is None for before in seen[:-1] for k, v in before.items())  # valid once, then reopened


def docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = f'<w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>标题</w:t></w:r></w:p><w:tbl><w:tr>{cell("a")}{cell("b")}</w:tr><w:tr>{cell("1")}</w:tr></w:tbl><w:p><w:r><w:t>图旁</w:t><w:drawing/></w:r></w:p><w:p/>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx())
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "x.txt").write_text("x")
    assert {(r.name, r.suffix) for r in files.listed(spark, str(tmp_path)).collect()} == {("a.docx", "docx"), ("bad.docx", "docx"), ("x.txt", "txt")}
    rows = files.blocks(spark, str(tmp_path)).orderBy("path", "block_index").collect()
    assert [(r.type, r.content, r.style, r.context) for r in rows[:4]] == [("text", "标题", "heading 1", ""), ("table", "| a | b |\n| --- | --- |\n| 1 |  |", None, ""), ("text", "图旁", "", ""), ("figure", "", None, "图旁")]
    assert len(rows) == 5 and rows[4].error.startswith("BadZipFile")


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("# c\nexport CHUNK_SIZE='650.0'\nRRF_K=bad\nSTRICT_REDACTION=no\nX\n")
    s = settings.load({"CHUNK_OVERLAP": "50", "PDF_ENGINE": ""}, tmp_path / ".env")
    assert (s.chunk_size, s.chunk_overlap, s.rrf_k, s.strict_redaction, s.pdf_engine) == (650, 50, 60, False, "blocks")


def test_models(spark):
    a = models.hashed_embedding(["电缆 alpha", "电缆 alpha", ""])
    assert np.allclose(a[0], a[1]) and np.isclose(np.linalg.norm(a[0]), 1) and not a[2].any()
    df = spark.createDataFrame([(1, " a "), (2, "a"), (3, None)], "id int, t string")
    out = {r.id: r.embedding for r in models.embedded(df, "id", "t").collect()}
    assert out[1] == out[2] and len(out) == 3
    waits, calls = [], itertools.count()

    def flaky(batch):
        if next(calls) < 2:
            raise OSError
        return np.ones((len(batch), 2))

    assert models.with_retries(flaky, batch=2, wait=waits.append)(["a", "b", "c"]).shape == (3, 2) and waits == [2, 4]
    p = spark.createDataFrame([(1, "【知识片段】\n[1] 来源：x\n第一句。第二句。\n\n【问题】\nq"), (2, "leer")], "query_id int, prompt string")
    assert {r.query_id: r.answer for r in models.answered(p).collect()} == {1: "第一句。 [1]", 2: "资料不足。"}


def test_old_versions_of_a_keyed_table_go(spark, tmp_path):
    t = ingest.KeyedTable(spark, str(tmp_path / "t"), "k string, v int", "k", keep=1)
    for n in range(4):
        t.apply(spark.createDataFrame([("a", n), (f"b{n}", n)], "k string, v int"), n)
    t.apply(spark.createDataFrame([("a", 9)], "k string, v int"), 3)  # delivered again: the batch counts once
    assert t.versions() == [2, 3] and sorted(map(tuple, t.read().collect())) == [("a", 9), ("b0", 0), ("b1", 1), ("b2", 2)]


def test_stream_into_keyed_table(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "doc_id long, text string"
    spark.createDataFrame([(1, "a b"), (2, "c")], schema).write.parquet(src)
    target = ingest.KeyedTable(spark, f"file://{tmp_path}/t", "doc_id long, word string", "doc_id")
    build = lambda df: df.select("doc_id", F.explode(F.split("text", " ")).alias("word"))
    for extra in ([], [(1, "z")]):
        if extra:
            spark.createDataFrame(extra, schema).write.mode("append").parquet(src)
        q = ingest.ingest(spark.readStream.schema(schema).parquet(src), build, target, str(tmp_path / "ck"))
        q.awaitTermination(120)
        assert q.exception() is None
    assert sorted(map(tuple, target.read().collect())) == [(1, "z"), (2, "c")]
    target.apply(spark.createDataFrame([(1, "z")], "doc_id long, word string"), target.versions()[-1])
    assert sorted(map(tuple, target.read().collect())) == [(1, "z"), (2, "c")]


def test_windowed_counts(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 0, 5), "a"), (datetime(2024, 1, 1, 0, 50), "a"), (datetime(2024, 1, 1, 1, 5), "b")]
    spark.createDataFrame(rows, "ts timestamp, kind string").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, kind string").parquet(str(tmp_path / "e"))
    q = ingest.windowed_counts(stream, "ts", "kind").writeStream.format("memory").queryName("wc").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.kind, r.n) for r in spark.sql("select kind, n from wc").collect()) == [("a", 2), ("b", 1)]


def test_orphan_monitor(spark):
    refs, events, raw_refs, raw_events = history(spark, 9)
    counts = ingest.OrphanMonitor(spark).update(refs, events)
    assert counts.agg(F.sum("orphans")).first()[0] == len(expected(raw_refs, raw_events))
