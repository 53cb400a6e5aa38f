from __future__ import annotations

import random
import sqlite3

import numpy as np

from docloom.functions import text as T
from docloom.operators import fusion, keyword, vector

WORDS = "alpha beta gamma delta omega 外设 接地 电缆 风机 计划".split()


def test_bm25_agrees_with_fts5(spark):
    rng = random.Random(3)
    docs = [(f"d{i:03d}", " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 30)))) for i in range(120)]
    asks = [(1, "alpha 外设 alpha"), (2, "omega"), (3, "nothing"), (4, "电缆 风机 计划 beta gamma")]
    df, q = spark.createDataFrame(docs, "k string, t string"), spark.createDataFrame(asks, "q int, t string")
    terms = {r[0]: r[1] for r in df.select("k", T.index_text("t")).collect()}
    got = {(r.query_id, r.k): r.score for r in keyword.bm25(df, q, "k", "t", "q", "t").collect()}
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(k unindexed, t, tokenize='unicode61')")
    con.executemany("insert into f values (?, ?)", terms.items())
    want = {}
    for q_id, text in asks:
        tokens = [r for r in spark.createDataFrame([(text,)], "t string").select(T.tokens("t")).first()[0]]
        for k, s in con.execute("select k, bm25(f) from f where f match ?", (" OR ".join(f'"{x}"' for x in tokens),)):
            want[(q_id, k)] = s
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    scope = df.where("k < 'd060'").select("k")
    for size, some in ((256, None), (2, scope)):
        best = {(r.query_id, r["rank"]): (r.k, r.score) for r in keyword.bm25_top(df.repartition(3), q, "k", "t", "q", "t", 5, some, size=size).collect()}
        for q_id, _ in asks:
            own = sorted((round(s, 9), k, s) for (x, k), s in want.items() if x == q_id and (some is None or k < "d060"))[:5]
            assert [best[q_id, n][0] for n in range(1, len(own) + 1)] == [k for _, k, _ in own]
            assert all(abs(best[q_id, n][1] - s) < 1e-9 for n, (_, _, s) in enumerate(own, 1))
    assert keyword.bm25_top(df.limit(0), q, "k", "t", "q", "t", 5).count() == 0 and keyword.bm25_top(df, q.limit(0), "k", "t", "q", "t", 5).count() == 0


def test_cosine_against_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).round(3).tolist(), i % 3) for i in range(90)] + [(90, [0.0] * 8, 0), (91, None, 0), (92, [1.0], 1)]
    df = spark.createDataFrame(rows, "id long, v array<double>, g int").repartition(5)
    got = {}
    for r in vector.cosine_top(df, df.where("id < 10"), "id", "v", 4, dim=8, block=3).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    x = np.array([r[1] for r in rows[:90]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(10):
        order = np.argsort(-np.round(np.maximum(0, x @ x[q]), 9), kind="stable")[:4]
        assert [got[q][n] for n in (1, 2, 3, 4)] == order.tolist()


def test_rrf_ties_keep_the_vector_list_first(spark):
    v = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, k string, rank int")
    w = spark.createDataFrame([(1, "c", 1), (1, "b", 2), (1, "c", 3)], "query_id int, k string, rank int")
    rows = fusion.rrf(v, w, "k").orderBy("position").collect()
    assert [r.k for r in rows] == ["b", "a", "c"]
    assert [r.fusion_score for r in rows] == [round(2 / 62, 6), round(1 / 61, 6), round(1 / 61, 6)]


def test_rerank_orders_the_best_and_leaves_the_rest(spark):
    rows = [(1, f"c{i}", i, "alpha beta", t) for i, t in enumerate(["x", "alpha", "alpha beta", "y", "beta"], 1)]
    df = spark.createDataFrame(rows, "query_id int, k string, position int, q string, t string")
    out = fusion.rerank(df, "q", "t", "k", top=2).orderBy("final_position").collect()
    assert [r.k for r in out] == ["c3", "c2", "c1", "c4", "c5"]
    assert [r.rerank_score for r in out] == [1.0, 0.5, None, None, None]


def test_expand_and_pack(spark):
    chunks = spark.createDataFrame([("k", "s1", "c1", "一"), ("k", "s1", "c2", "二"), ("k", "s2", "c3", "三"), ("k", "", "c4", "四")], "kb_name string, section_id string, chunk_id string, content string")
    hits = spark.createDataFrame([(1, 1, "c2", "k", "s1", "二"), (1, 2, "c1", "k", "s1", "一"), (1, 3, "c3", "k", "s2", "三"), (1, 4, "c4", "k", "", "四")], "query_id int, position int, chunk_id string, kb_name string, section_id string, content string")
    out = fusion.expand(hits, chunks).orderBy("context_no")
    assert [(r.chunk_id, r.content, r.chunks) for r in out.collect()] == [("c2", "一\n二", 2), ("c3", "三", 1), ("c4", "四", 1)]
    packed = fusion.pack(out, 4).orderBy("context_no").collect()
    assert [r.packed for r in packed] == ["一\n二", "三"]
    asked = spark.createDataFrame([(1, "问?"), (2, "无")], "query_id int, question string")
    p = {r.query_id: r.prompt for r in fusion.prompts(fusion.pack(out), asked).collect()}
    assert p[1].startswith("【知识片段】\n[1] 来源：本地片段\n一\n二\n\n[2]") and p[2] == "【知识片段】\n（无）\n\n【问题】\n无"


def test_cited_falls_back_to_the_first_three(spark):
    df = spark.createDataFrame([("[2] und [9]", 4), ("nichts", 4), ("[9]", 2), (None, 0)], "a string, n int")
    assert [r.cited for r in fusion.cited(df, "a", "n").collect()] == [[2], [1, 2, 3], [1, 2], []]


def test_a_reranker_can_be_plugged_in_and_may_fail(spark):
    rows = [(q, f"c{i}", i, "x", t) for q in (1, 2) for i, t in enumerate(["aa", "a", "aaaa", "aaa"], 1)]
    df = spark.createDataFrame(rows, "query_id int, k string, position int, q string, t string")
    order = lambda s: [r.k for r in fusion.rerank(df, "q", "t", "k", top=2, scorer=s).where("query_id = 1").orderBy("final_position").collect()]
    assert order(fusion.batch_scorer(lambda q, d: [float(len(x)) for x in d])) == ["c3", "c4", "c1", "c2"]

    def fails(q, d):
        raise OSError("no model")

    for bad in (fails, lambda q, d: [1.0], lambda q, d: ["?"] * len(d), lambda q, d: [float("nan")] * len(d)):
        assert order(fusion.batch_scorer(bad)) == ["c1", "c2", "c3", "c4"]


def test_vectors_within_a_group(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [0.9, 0.1], "b"), (3, [0.5, 0.5], "a"), (4, [1.0, 0.0], None)]
    df = spark.createDataFrame(rows, "id long, v array<double>, g string")
    got = [(r.query_id, r.id) for r in vector.cosine_top(df, df, "id", "v", 5, dim=2, within="g").orderBy("query_id", "rank").collect()]
    assert got == [(1, 1), (1, 3), (2, 2), (3, 3), (3, 1)]


def test_masked_sources(spark):
    df = spark.createDataFrame([(1, 2, 7, "p", "x.pdf"), (1, 1, 8, "q", "noext"), (1, 3, 7, "p", "x.pdf"), (2, 1, 9, "p", "x.pdf")], "query_id int, rank int, doc_id long, source string, filename string")
    assert {(r.query_id, r.source): r.masked for r in fusion.masked(df, "rank", "source", "filename").collect()} == {(1, "q"): "文档1", (1, "p"): "文档2.pdf", (2, "p"): "文档1.pdf"}
