"""Look-alikes, splitting, packing and broken pairs."""

from __future__ import annotations

import random
import unicodedata

import duckdb
import numpy as np
import pytest

from docloom.llm import lookalike, packing, pairs, pieces
from docloom.llm.queries import _KINDS_SQL

CASES = [
    ("plain Text 中文，“引”。　x", set()), ("", set()), (None, None), ("ｆｕｌｌ", {"full_width"}), ("１２", {"full_width"}), ("（！）：", set()), ("café", {"combining"}), ("́x", set()),
    ("ab­c", {"invisible"}), ("a​b﻿", {"invisible"}), ("a b", {"odd_space"}), ("a　b", set()), ("Vаlve", {"look_alike"}), ("Прибор", set()), ("α 10 Ω", set()), ("⼯作", {"look_alike"}),
    ("oﬃce", {"look_alike"}), ("ﬁ １", {"look_alike", "odd_space", "full_width"}), ("деталь x", set()), ("中о文", set()),
]


def test_kinds_and_forms(spark):
    df = spark.createDataFrame([(i, t, "k") for i, (t, _) in enumerate(CASES)], "i int, t string, kinds string")
    full = {r.key: r for r in lookalike.analysed(df, "i", "t").collect()}
    brief = {r.key: set(r.kinds) for r in lookalike.analysed(df, "i", "t", forms=False).collect()}
    for i, (t, kinds) in enumerate(CASES):
        assert (i in full) == (t is not None)
        if t is not None:
            assert set(full[i].kinds) == kinds and brief.get(i, set()) == kinds and full[i].changed == bool(kinds)
    assert {full[i].normal for i, (t, _) in enumerate(CASES) if t in ("Vаlve", "Прибор", "oﬃce", "⼯作", "a b")} == {"Valve", "Прибор", "office", "工作", "a b"}
    assert lookalike.skeleton("Vаlve") == lookalike.skeleton("Ｖalve") == lookalike.skeleton("Val​ve")
    assert lookalike.skeleton("café") == lookalike.skeleton("café") and lookalike.skeleton("⼯") == lookalike.skeleton("工")
    assert lookalike.normal_form("Vаlve", lookalike.kinds(*lookalike.encode(["Vаlve"]))[1]) == "Valve"
    assert len(lookalike.RADICAL) == len(lookalike.IDEOGRAPH)


@pytest.mark.parametrize(("a", "b"), [("𝐩aypal", "paypal"), ("lllinois", "Illinois"), ("02", "O2"), ("rnodern", "modern"), ("Հello", "Hello"), ("ⅰtem", "item"), ("ſet", "set"), ("Ａ１", "Al"), ("раураl", "paypal"), ("ᏢᎪᏙ", "PAV"), ("it’s", "it's"), ("a–b", "a-b"), ("口", "ロ")])
def test_texts_that_look_alike_have_one_skeleton(a, b):
    assert lookalike.skeleton(a) == lookalike.skeleton(b)
    assert lookalike.skeleton(lookalike.skeleton(a)) == lookalike.skeleton(a) and lookalike.skeleton("word") != lookalike.skeleton("ward")


#: Characters whose Unicode data says something else than the published table: they have the skeleton of what they stand for.
STANDS = "ſ⺗⺡⺤⺯⻏⻐⻒⻖⻟⻠⻲﬩［］＾￣￭"


def test_skeletons_follow_the_published_table(spark):
    table = {chr(c): p for c, p in lookalike.published().items() if unicodedata.is_normalized("NFD", chr(c))}
    assert len(table) > 5000 and {c for c, p in table.items() if lookalike.skeleton(c) != lookalike.skeleton(p)} == set(STANDS)
    assert all(lookalike.skeleton(lookalike.skeleton(c)) == lookalike.skeleton(c) for c in table)
    # texts of characters that no other table touches have the very skeletons of ICU, the marks' order included
    other = {*map(chr, lookalike.styled() | lookalike.joined() | lookalike.lookalikes())}
    plain = sorted(c for c, p in table.items() if not {c, *p, *unicodedata.normalize("NFD", p)} & other)
    icu = getattr(spark._jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()
    rng = random.Random(2)
    texts = ["".join(rng.choice(rng.choice([plain, "aeoẹ가\u0301\u0323\u0345\u200b\ufe0f"])) for _ in range(rng.randrange(12))) for _ in range(500)]
    assert len(plain) > 3000 and [lookalike.skeleton(t) for t in texts] == [icu.getSkeleton(t) for t in texts]


@pytest.mark.parametrize(("a", "b"), [("Іllinois", "Illinois"), ("ϰit", "kit"), ("a\ufe0fb", "ab"), ("০k", "Ok")])
def test_gaps_of_the_former_table(a, b):
    assert lookalike.skeleton(a) == lookalike.skeleton(b)
    assert lookalike.normal_form("Іtem", lookalike.kinds(*lookalike.encode(["Іtem"]))[1]) == "Item"


def test_skeletons_of_a_batch_keep_their_places():
    texts = ["", "ｍ\u200b!", "é\u0323", "", "\u0301a"]
    points, origin, ends = lookalike.skeletons(*lookalike.encode(texts))
    assert ["".join(map(chr, points[i:j])) for i, j in zip(ends, ends[1:])] == [lookalike.skeleton(t) for t in texts] == ["", "rn!", "e\u0323\u0301", "", "\u0301a"]
    assert origin.tolist() == [0, 0, 2, 3, 4, 3, 5, 6]


def test_kinds_of_odd_texts_equal_sql():
    rng = random.Random(5)
    ranges = [(0x20, 0x250), (0x370, 0x530), (0x300, 0x370), (0x2000, 0x2070), (0x20D0, 0x20F1), (0x1AB0, 0x1AC0), (0x1D00, 0x1E00), (0x2100, 0x2190), (0x2E80, 0x2FD6), (0xFB00, 0xFB07), (0xFF00, 0xFFF0), (0x1F00, 0x2000), (0x4E00, 0x4E20), (0x1C4, 0x1CD)]
    pools = [*map(lambda r: [*map(chr, range(*r))], ranges), "aoАа中１Ａа -", "\xad\u034f\u061c\u06dd\u070f\u180e\ufeff\u0600\u0890\ufe0f\u3000\u1680\U000e0041"]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(6))) for _ in range(20000)]
    texts += ["1\u0301\u0302", "１\u0301", "ﬁ\u0301", "a\u20dd", "Ａа", "a１б", "k\u2126", "⺄"]
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest(?) AS s", [texts])
    want = con.execute("SELECT " + ", ".join(f"regexp_matches(s, '{_KINDS_SQL[k]}')" for k in lookalike.KINDS) + " FROM t").fetchall()
    has = lookalike.kinds(*lookalike.encode(texts))[0]
    assert [texts[i] for i in np.flatnonzero((has != np.array(want)).any(axis=1))] == [] and has.any(axis=0).all()


@pytest.mark.parametrize(("limit", "overlap"), [(700, 100), (60, 10), (50, 0)])
def test_pieces(spark, limit, overlap):
    rng = random.Random(limit)
    rows = ["".join(rng.choice("ab 中文😀。，\n.;") * rng.choice([1, 1, 1, 25]) for _ in range(rng.randrange(300))) for _ in range(60)]
    rows += [None, "", "x" * limit, "x" * (limit + 1), "语" * 50000, "a。" * 3000]
    df = spark.createDataFrame([*enumerate(rows), (0, rows[0])], "k int, t string")
    out = {}
    for r in pieces.pieces(df, "k", "t", limit, overlap).orderBy("k", "piece_no").collect():
        out.setdefault(r.k, []).append(r)
    assert set(out) == {k for k, t in enumerate(rows) if t and len(t) > limit}
    for k, own in out.items():
        t = rows[k]
        assert "".join(p.piece[p.overlap :] for p in own) == t and [p.piece_no for p in own] == list(range(1, len(own) + 1))
        for before, p in zip([None, *own], own):
            assert len(p.piece) <= limit and t[p.start : p.start + len(p.piece)] == p.piece
            if before is not None:
                assert p.overlap == overlap and (not overlap or before.piece[-overlap:] == p.piece[:overlap])
        for p in own[:-1]:  # a piece without a boundary at its end has none to choose
            body = p.piece[p.overlap :] if p.piece_no > 1 else p.piece[overlap:]
            assert p.piece[-1] in "\n。！？!?；;…，,、：:|）)】》 \t　" or p.piece.endswith(". ") or not any(c in "\n。；;， " for c in body)


def naive(sizes, capacity, spaces):
    open_, out, made = [], [], 0
    for s in sizes:
        while s > capacity:
            out.append((made, capacity))
            made, s = made + 1, s - capacity
        fit = [b for b in open_ if b[0] >= s]
        if fit:
            b = min(fit, key=lambda b: b[0])
            open_.remove(b)
        else:
            if len(open_) == spaces:
                open_.remove(min(open_, key=lambda b: b[0]))
            b, made = (capacity, made), made + 1
        out.append((b[1], s))
        open_.append((b[0] - s, b[1]))
    return out


def test_best_fit():
    rng = random.Random(6)
    for _ in range(50):
        sizes = [rng.choice([0, 1, 5, 20, 33, 64, 70, 200]) for _ in range(60)]
        got, want = list(packing.best_fit(sizes, 64, 5)), naive(sizes, 64, 5)
        fill = lambda p: sorted(sum(s for b, s in p if b == x) for x in {b for b, _ in p})
        assert [s for _, s in got] == [s for _, s in want] and fill(got) == fill(want)


def test_packing(spark):
    rng = random.Random(4)
    rows = [(i, "word " * rng.randrange(400)) for i in range(80)] + [(900, None), (901, ""), (902, "<|endoftext|> " * 50), (5, "word"), (903, "lang " * 5000), (904, "one two"), (904, "two one")]
    rows.append(rows[0])
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, tokens int")
    out = packing.packed(df, "doc_id", "text", capacity=256, spaces=16).collect()
    size = {}
    for r in out:
        size[r.container] = size.get(r.container, 0) + r.tokens
    assert max(size.values()) <= 256 and sum(size.values()) >= 0.9 * 256 * (len(size) - 1)
    assert sum(size.values()) == sum(len(packing.encoder(packing.VOCABULARY).encode_ordinary(t or "")) for _, t in set(rows))
    long = sorted((r.part, r.token_from, r.tokens) for r in out if r.doc_id == 903)
    assert [x[2] for x in long[:-1]] == [256] * (len(long) - 1) and [x[1] for x in long] == [256 * p for p in range(len(long))]
    assert sum(r.doc_id == 904 for r in out) == 2  # two texts of one key and size
    assert {r.doc_id for r in out} == {k for k, _ in rows} and packing.packed(df.limit(0), "doc_id", "text").count() == 0
    again = packing.packed(df, "doc_id", "text", capacity=256, spaces=16).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))


ANSWERS = [f"风机阈值应当每{u}核对一次，记录保存三年[1]。接地电阻由{u}负责。" for u in "日周月季年"] * 8 + ["The valve opens twice. Keep the log for three years."] * 20 + ["Die Pumpe läuft täglich. Der Bericht folgt später."] * 20
ZH, EN, DE = "风机的接地阈值如何核对？", "How is the valve tested before the pump?", "Wie wird die Pumpe bei der Abnahme geprüft?"
ASKED = [f"{a}的{b}如何{c}？" for a in ("锅炉", "电缆", "阀门", "叉车") for b in ("流量", "温度", "附件") for c in ("确认", "归档")] + [f"How is the {a} checked after the {b}?" for a in ("motor", "cable", "filter") for b in ("test", "shift")]
MODELS = pairs.learnt([(ASKED[i % len(ASKED)], a) for i, a in enumerate(ANSWERS)])
PAIRS = [
    (ZH, None, "empty"), (ZH, "", "empty"), (ZH, "[1][2] ——。", "empty"), (ZH, "​", "empty"), (None, "风机应当核对。", None), ("", "风机应当核对。", None),
    (ZH, "抱歉，我无法回答这个问题，请咨询管理员。", "refusal"), (ZH, "抱歉让您久等，风机应当每日核对。", None), (EN, "I'm sorry, but I can't provide that information. Is there anything else?", "refusal"), (DE, "Leider ich kann diese Frage nicht beantworten.", "refusal"), (DE, "Leider gilt die alte Regel nicht mehr: Die Pumpe läuft täglich.", None),
    (ZH, ZH, "copies_question"), (ZH, f"您的问题是：{ZH}", "copies_question"), (ZH, f"**{ZH[:-1]}**[1]", "copies_question"), (EN, EN.upper(), "copies_question"), (ZH, ZH + ZH, "copies_question"), (ZH, ZH + "风机应当每日核对一次。", None),
    (ZH, "The valve is opened by the pump before the test.", "wrong_language"), (ZH + "（请用英文回答）", "The valve is opened by the pump before the test.", None), (ZH + "（请用英文回答）", "风机应当每日核对一次。", "wrong_language"), (EN, "Die Pumpe läuft mit der Anlage.", "wrong_language"), (ZH, "この資料では手順を確認してから担当へ連絡します。", "wrong_language"), (ZH, "参照“The valve is opened”核对风机。", None), (ZH, "风机核对。\n| pump | valve |\n|---|---|\n| tank | 9 |", None),
    (ZH, "53台[1]", None), (ZH, "是", None), (EN, "Twice a week [1]", None), (DE, "32 Tage", None), (ZH, "风机应当每日核对一次，接地电阻的", "truncated"), (ZH, "风机应当每日核对。例如：", "truncated"), (ZH, "风机应当每日核对。对于计划……", "truncated"), (ZH, "1. 风机应当每日核对。\n2.", "truncated"), (EN, "The valve opens twice. the pump is tes", "truncated"), (ZH, "1. 风机应当每日核对。\n2. 接地电阻由专人负责。\n3.", "truncated"),
    # wordings that no list holds as they stand
    (EN, "I'd rather not go into that topic.", "refusal"), (ZH, "恕不作答。", "refusal"), (DE, "Dazu darf ich nichts sagen.", "refusal"), (ZH, "这个问题我不便评论。", "refusal"), (EN, "I must decline to answer that.", "refusal"), (DE, "Darüber möchte ich nicht sprechen.", "refusal"), (ZH, "对不起，我没有权限透露这些内容。", "refusal"),
    (EN, "I cannot answer that fully, but the valve opens twice a day.", None), (ZH, "无法确认具体日期，但风机每周核对一次。", None), (ZH, "我" + "真的" * 200 + "无法回答。", "refusal"),
    (EN, "How is the valve really tested before the pump?", "copies_question"), (EN, "Before the pump how is the valve tested?", "copies_question"), (EN, "I shall restate this for you: " + EN, "copies_question"), (ZH, (ZH + " ") * 20, "copies_question"), (ZH, (ZH + "\n") * 3000, "copies_question"), (ZH, "请允许我复述：" + ZH, "copies_question"), ("啊？", "啊？", "copies_question"),
    (EN, EN + " Twice a week.", None), (EN, "The valve is tested before the pump twice a week.", None), (ZH, "风机的接地阈值每周核对一次。", None),
    (ZH, "La pompe est vérifiée chaque jour par le responsable de la station avant la mise en service.", "wrong_language"), (EN, "La bomba se revisa cada día por el responsable de la estación antes de la puesta en marcha.", "wrong_language"), (ZH, "Насос проверяется каждый день перед запуском станции.", "wrong_language"), (ZH, "펌프는 매일 시작하기 전에 점검합니다.", "wrong_language"), (ZH + "（请用法语回答）", "La pompe est vérifiée chaque jour par le responsable de la station.", None), (EN, "阀门每天检查两次。", "wrong_language"),
]


@pytest.mark.parametrize(("question", "answer", "kind"), PAIRS)
def test_defects(question, answer, kind):
    assert pairs.defect(question, answer, MODELS) == kind


def test_broken_pairs(spark):
    rows = [(f"{i}", "log", q, a, False) for i, (q, a, _) in enumerate(PAIRS)] + [(f"a{i}", "log", ASKED[i % len(ASKED)], a, False) for i, a in enumerate(ANSWERS)]
    rows += [("c1", "cache", ZH, None, True), ("c2", "cache", ZH, "{}", True), ("c3", "cache", ZH, '{"answer": "风机应', True), ("c4", "cache", ZH, '{"answer":"\\u98ce\\u673a\\u6838\\u5bf9\\u3002"}', True), ("c5", "cache", ZH, "[]", True), ("c1", "cache", ZH, None, True)]
    got = {r.key: r.defect for r in pairs.broken(spark.createDataFrame(rows, "key string, source string, question string, answer string, cached boolean")).collect()}
    assert {k: v for k, v in got.items() if k[0] == "c"} == {"c1": "empty", "c2": "empty", "c3": "truncated", "c5": "empty"}
    # the sample holds the broken answers too; what they make of endings and copies may differ, the rest may not
    wrong = {i for i, (_, _, kind) in enumerate(PAIRS) if got.get(str(i)) != kind}
    assert all({PAIRS[i][2], got.get(str(i))} <= {None, "truncated", "copies_question"} for i in wrong) and len(wrong) <= 3, wrong
