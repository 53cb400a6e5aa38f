"""The tagger's gradient and decoding, personal details, and the vector index."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from docloom.llm import pii, pii_train, tagger, vectors


def test_gradient_of_the_crf_loss():
    rng = np.random.default_rng(0)
    p = {n: v.astype(np.float64) for n, v in tagger.init(6, 3, 3, embed=3, hidden=4).items()}
    p["trans"] += rng.standard_normal((3, 3)) * 0.3
    chars, static, tags = rng.integers(0, 6, (5, 2)), rng.standard_normal((6, 3)), rng.integers(0, 3, (5, 2))
    mask = np.array([[1, 1], [1, 1], [1, 1], [1, 0], [1, 0]], bool)
    loss, g = tagger.loss_and_grad(p, static, chars, mask, tags)
    for name in ("emb", "wxf", "whf", "biasb", "whb", "out", "trans", "start"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        kept, e = p[name][at], 1e-3
        p[name][at] = kept + e
        up = tagger.loss_and_grad(p, static, chars, mask, tags)[0]
        p[name][at] = kept - e
        down = tagger.loss_and_grad(p, static, chars, mask, tags)[0]
        p[name][at] = kept
        assert abs((up - down) / (2 * e) - g[name][at]) < 2e-3 * max(1, abs(g[name][at])), name


def viterbi(p, e):
    score, back = p["start"] + e[0], []
    for k in range(1, len(e)):
        both = score[:, None] + p["trans"]
        back.append(both.argmax(0))
        score = both.max(0) + e[k]
    tags = [int(score.argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return np.array(tags[::-1])


@pytest.mark.parametrize("seed", range(12))
def test_the_reader_finds_the_best_path_and_its_scores(seed):
    rng = np.random.default_rng(seed)
    p = tagger.init(30, 4, 11, embed=6, hidden=8, seed=seed)
    for k in ("out", "trans", "start", "bout"):
        p[k] = (rng.standard_normal(p[k].shape) * rng.choice([0.5, 2])).astype(np.float32)
    p["bout"][0] += rng.choice([0, 1, 3])
    static = rng.random((30, 4)).astype(np.float32)
    seqs = [rng.integers(0, 30, rng.integers(1, 40)) for _ in range(30)]
    for s, got in zip(seqs, tagger.Reader(p, static).spans(seqs, size=16)):
        e = tagger.emissions(p, s[:, None], static[s][:, None], np.ones((len(s), 1), bool))[0][:, 0]
        tags = viterbi(p, e)
        total = lambda y: p["start"][y[0]] + e[np.arange(len(y)), y].sum() + p["trans"][y[:-1], y[1:]].sum()  # noqa: B023, E731
        assert [x[:3] for x in got] == tagger.runs(tags)
        for a, b, _, score in got:
            without = tags.copy()
            without[a:b] = 0
            assert abs(total(tags) - total(without) - score) < 1e-2


@pytest.mark.parametrize("steep", [1, 6, 60])
def test_the_reader_s_scores_are_those_of_training_however_steep_the_gates(steep):
    rng = np.random.default_rng(steep)
    p = tagger.init(30, 4, 11, embed=6, hidden=8, seed=steep)
    for k in ("emb", "wxf", "wxb", "whf", "whb"):
        p[k] = (p[k] * steep).astype(np.float32)
    static = rng.random((30, 4)).astype(np.float32)
    seqs = sorted((rng.integers(0, 30, rng.integers(1, 60)) for _ in range(20)), key=len)
    reader = tagger.Reader(p, static)
    assert (max(reader.most.values()) > tagger.STEEP) == (steep > 1)
    e = reader.emissions(tagger.padded(seqs).astype(np.intp), np.array([len(s) for s in seqs])).reshape(11, -1, len(seqs))
    exact = {k: v.astype(np.float64) for k, v in p.items()}
    for k, s in enumerate(seqs):
        with np.errstate(over="ignore"):
            want = tagger.emissions(exact, s[:, None], static[s][:, None], np.ones((len(s), 1), bool))[0][:, 0]
        assert np.isfinite(e[:, : len(s), k]).all() and np.abs(e[:, : len(s), k].T - want).max() < 2e-3


def test_equal_texts_are_read_once(monkeypatch):
    read, spans = [], tagger.Reader.spans
    monkeypatch.setattr(tagger.Reader, "spans", lambda self, seqs, *a: read.append(len(seqs)) or spans(self, seqs, *a))
    texts = ["联系人：陈诺亭。", "", "流水号已入库。", "联系人：陈诺亭。", "Call me back on (505) 555 0193.", "流水号已入库。"] * 3
    got = pii.detect(pii.model(), texts)
    assert read == [3] and got[0] == [(4, 7, 0)] and all(got[i] == got[texts.index(t)] for i, t in enumerate(texts))


def test_windows_and_reconciling():
    for n in (1, pii.WINDOW, pii.WINDOW + 1, 5000, 12345):
        w = pii.windows(n)
        assert w[0][0] == 0 and w[-1][1] == n and all(x[1] - y[0] >= pii.OVERLAP for x, y in itertools.pairwise(w)) and all(b - a <= pii.WINDOW for a, b in w)
    assert pii.united([(0, 9, 2, 3.0, True), (5, 14, 2, 4.0, True), (20, 22, 0, 1.0, False), (21, 25, 1, 2.0, False)]) == [(0, 14, 2, 4.0), (20, 22, 0, 1.0), (21, 25, 1, 2.0)]
    rng = random.Random(3)
    for _ in range(200):
        spans = [(a := rng.randrange(30), a + rng.randrange(1, 9), rng.randrange(3), rng.uniform(0.1, 5)) for _ in range(rng.randrange(1, 8))]
        best = max(sum(s[3] for s in own) for n in range(len(spans) + 1) for own in itertools.combinations({s[:3]: s for s in sorted(spans, key=lambda x: x[3])}.values(), n) if all(x[1] <= y[0] or y[1] <= x[0] for x, y in itertools.combinations(own, 2)))
        got = pii.reconciled(spans)
        assert abs(sum(s[3] for s in got) - best) < 1e-9 and got == sorted(got)


def test_training_from_labelled_spans():
    names = ["陈诺亭", "李昀朔", "周霁", "王砚棠", "赵亭诺", "孙朔昀", "吴霁砚", "郑棠诺", "冯亭昀", "韩砚霁"]
    phones = [f"1{p}{n:08d}" for p, n in zip([38, 39, 50, 51, 52, 58, 60, 61], range(12345678, 99999999, 9999991))]
    rows = [(n, f"[姓名{i}]") for i, n in enumerate(names * 4)] + [(n, f"[电话{i}]") for i, n in enumerate(phones)]
    chunks = [f"排产计划第{i}项。联系人：[姓名1]。电话（[电话2]）已核实。" for i in range(60)] + [f"流水号 9{i:013d} 已入库。华北片区正在施工。" for i in range(60)]
    _, scores = pii_train.fit(chunks, rows, [f"我是{n}，请问计划由谁确认？" for n in names], limit=300, composed=300, epochs=40)
    assert scores["archive"]["all"][0] > 0.9 and scores["archive"]["all"][1] > 0.9


# Names and sentences of which no training list holds the sentence, and few the name.
NAMES = ["王建国", "李明", "张伟", "刘洋", "陈晓东", "赵丽华", "周杰", "孙悦", "吴磊", "徐志强", "欧阳若曦", "司马光远"]
CARRIERS = ["会后，{}留下来收拾桌椅。", "上个月{}把车卖给了邻居。", "这份报表是{}昨晚赶出来的。", "听说{}已经搬到杭州去了。", "门口站着的那个人就是{}。", "{}因为感冒没能参加比赛。", "快递显示由{}本人签收", "请与{}核对发票金额", "联系人：{}", "{}先生"]


def test_names_never_seen_in_sentences_never_seen():
    texts = [(c.format(n), n) for c in CARRIERS for n in NAMES]
    got = pii.detect(pii.model(), [t for t, _ in texts])
    assert sum([t[a:b] for a, b, k in spans if k == 0] == [n] for (t, n), spans in zip(texts, got)) >= 0.93 * len(texts)
    for text, name in (("We met Tomasz Wójcik at the fair.", "Tomasz Wójcik"), ("The talk by Siobhan O'Connor was great.", "Siobhan O'Connor"), ("Yesterday Priya Sharma called.", "Priya Sharma"), ("Speak to Hiroshi Tanaka, please.", "Hiroshi Tanaka"), ("Der Brief kam von Jürgen Klopfer.", "Jürgen Klopfer")):
        assert [text[a:b] for a, b, k in pii.detect(pii.model(), [text])[0] if k == 0] == [name]
    none = ["高层建筑的消防通道必须畅通。", "周围的温度逐渐升高。", "金属部件需要定期润滑。", "任何人不得入内。", "常年供应新鲜水果。", "Please check the Blue Valve before opening.", "Yesterday Priya called."]
    assert pii.detect(pii.model(), none) == [[]] * len(none)


def test_details_of_any_length():
    local = "a.very.long" + ".part" * 20
    text = f"材料请发送至 {local}@fenham.example ，逾期不候。"
    assert [text[a:b] for a, b, _ in pii.detect(pii.model(), [text])[0]] == [f"{local}@fenham.example"] and len(local) > 90


TEXTS = [
    ("联系人：陈诺亭。电话（+86 16448334204）已核实。", {("person", "陈诺亭"), ("phone", "+86 16448334204")}),
    ("材料请发送至 lan.yi (at) fenham.example ，逾期不候。", {("email", "lan.yi (at) fenham.example")}),
    ("证件号码为994085 19751103 9539，已核验。现住云汀市鹤滩区榆林巷768号，需上门取件。", {("id_number", "994085 19751103 9539"), ("address", "云汀市鹤滩区榆林巷768号")}),
    ("Call me back on (505) 555 0193. Who approves the valve?", {("phone", "(505) 555 0193")}),
    ("Herr Lorin Zelfield hat zugestimmt. Anschrift: Mühlstraße 13, 78920 Yarhausen.", {("person", "Lorin Zelfield"), ("address", "Mühlstraße 13, 78920 Yarhausen")}),
    ("流水号 939948290601 已入库。项目经理与值班主任共同签收。版本 10.2.93.59 已发布，金额为1,526,000元。", set()), ("经办人[姓名7]，已签字确认。", set()), ("", set()), (None, set()),
]


def test_personal_details(spark):
    rows = [(i, t, "x") for i, (t, _) in enumerate(TEXTS)] + [(0, TEXTS[0][0], "y")]
    df = spark.createDataFrame(rows, "id long, text string, key string")
    got = {}
    for r in pii.found(df, "id", "text").collect():
        got.setdefault(int(r.key), set()).add((r.pii_type, r.pii_value))
        assert TEXTS[int(r.key)][0][r.start :].startswith(r.pii_value)
    assert got == {i: v for i, (_, v) in enumerate(TEXTS) if v}
    out = {int(r.key): (r.redacted, r.details) for r in pii.redacted(df, "id", "text").collect()}
    assert out[0] == ("联系人：[姓名1]。电话（[电话1]）已核实。", 2) and out[5] == (TEXTS[5][0], 0) and out[8] == (None, 0)


def test_long_texts_and_windows():
    m = pii.model()
    long = "计划按季导出。" * 4000 + "联系人：陈诺亭。" + "，".join(f"1644833{n:04d}" for n in range(40)) + "备用。" * 4000
    spans = pii.detect(m, [long])[0]
    assert {long[a:b] for a, b, t in spans if t == 0} == {"陈诺亭"} and sum(t == 1 for _, _, t in spans) >= 36


def brute(x, ids, k, least):
    s = x @ x.T
    out = set()
    for r in range(len(x)):
        s[r, r] = -9
        for c in np.lexsort((ids, -np.round(s[r], 9)))[:k]:
            if s[r, c] >= least:
                out.add((min(ids[r], ids[c]), max(ids[r], ids[c])))
    return out


def test_similar_vectors(spark):
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((60, 16))
    x = (centers[rng.integers(0, 60, 1500)] + 0.15 * rng.standard_normal((1500, 16))).astype(np.float32)
    x[1000:1300] = x[0]  # a class of copies
    x[1300:1303] = x[5]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(9001, None, 0), (9002, [0.0] * 16, 0), (9003, [1.0] * 15, 0), (9004, [float("nan")] * 16, 0), (3, x[3].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embeddings array<float>, key int")
    got = {tuple(r) for r in vectors.similar_vectors(df, dim=16, candidates=300).collect()}
    u = x.astype(np.float64)
    want = brute(u / np.linalg.norm(u, axis=1)[:, None], np.arange(1500), 5, 0.9)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.02 * len(want)
    assert vectors.similar_vectors(df.limit(0), dim=16).count() == 0


def test_walk_goes_by_summed_distance():
    rng = np.random.default_rng(5)
    d1, d2 = rng.random(6), rng.random(6)
    cells = vectors.walk(d1, d2, np.ones((6, 6), int), 36)
    sums = [d1[i] + d2[j] for i, j in cells]
    assert len(set(cells)) == 36 and sums == sorted(sums)
    assert len(vectors.walk(d1, d2, np.full((6, 6), 10), 25)) == 3
