"""Near duplicates, shared spans, leaks, copies and components against brute force, with skew and dirt."""

from __future__ import annotations

import itertools
import random
from functools import partial

import numpy as np
import pytest

from docloom.llm import copies, graph, leaks, neardup, skew, spans, winnow

RNG = random.Random(1)
SIGNS = "电缆风机接地计划排产仓储abcde fghij。，1234"


def text(n, rng=RNG):
    return "".join(rng.choice(SIGNS) for _ in range(n))


def edited(t, n, rng=RNG):
    out = list(t)
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.choice(SIGNS)
    return "".join(out)


def jaccard(a, b, n):
    x, y = ({t[i : i + n] for i in range(len(t) - n + 1)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_bit_sliced_counts_are_hamming_distances():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2, (50, neardup.PLANES), dtype=np.uint8)
    near = base[:20] ^ (rng.random((20, neardup.PLANES)) < 0.25)
    planes = np.tile(neardup.vertical(base), (20, 1))
    words = np.where(near > 0, ~np.uint64(0), np.uint64(0))
    for limit in (0, 30, 52, 80, 160):
        hit = neardup.within(planes, words, np.full(20, (1 << 50) - 1, np.uint64), limit)
        lanes = np.unpackbits(hit.view(np.uint8).reshape(20, 8), axis=1, bitorder="little")[:, :50]
        assert (lanes == ((near[:, None, :] != base[None]).sum(2) <= limit)).all()


def corpus():
    rng = random.Random(7)
    base = [text(rng.randrange(80, 300), rng) for _ in range(30)]
    rows = [(f"b{i}", t) for i, t in enumerate(base)]
    rows += [(f"e{i}", edited(base[i % 30], rng.randrange(1, 9), rng)) for i in range(60)]
    rows += [(f"c{i}", base[0]) for i in range(5)] + [("b1", base[1])]  # copies, and a repeated row
    rows += [("n", None), ("z", ""), ("s", "短"), ("long", text(20000, rng))]
    return rows


def brute(rows, n, least, threshold=0.6):
    use = sorted({(k, t) for k, t in rows if t and len(t) >= max(n, least)})
    return {(a, b) for (a, x), (b, y) in itertools.combinations(use, 2) if a != b and jaccard(x, y, n) >= threshold}


@pytest.mark.parametrize(("n", "least"), [(5, 80), (3, 0)])
def test_near_duplicates(spark, n, least):
    rows = corpus()
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "k string, t string, text string, id int")
    got = {tuple(r) for r in neardup.similar_pairs(df, "k", "t", n, least=least).collect()}
    assert got == brute(rows, n, least)
    assert neardup.similar_pairs(df.limit(0), "k", "t", n).count() == 0


def test_a_crowded_bucket_loses_nothing(spark):
    rng = random.Random(5)
    base = text(150, rng)
    rows = [(f"{i:03d}", edited(base, 2, rng)) for i in range(150)] + [(f"x{i}", text(100, rng)) for i in range(40)]
    got = {tuple(r) for r in neardup.similar_pairs(spark.createDataFrame(rows, "k string, t string"), "k", "t", 5).collect()}
    want = brute(rows, 5, 0)
    assert len(want) > 5000 and len(got & want) >= 0.995 * len(want) and got <= want


def test_large_classes_of_copies_stay_linear(spark):
    rows = [(i, "gleicher Text") for i in range(100)] + [(200, "anderer"), (201, "anderer"), (202, None)]
    df = spark.createDataFrame(rows, "k int, t string")
    dups = copies.copies(df, "k", "t").persist()
    assert {tuple(r) for r in dups.collect()} == {(i, 0) for i in range(1, 100)} | {(201, 200)}
    pairs = {tuple(r) for r in copies.copy_pairs(dups, "k").collect()}
    assert pairs == {(0, i) for i in range(1, 100)} | {(200, 201)}
    linked = {tuple(r) for r in copies.spread(spark.createDataFrame([(0, 200)], "a int, b int"), dups, "k").collect()}
    assert linked == {(0, 200), (0, 201)}


def counted(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return {k: len(v) for k, v in out.items()}


def test_partners_do_not_depend_on_the_size_of_a_class(spark):
    rng = random.Random(9)
    base, other = text(200, rng), text(200, rng)
    rows = [(f"c{i:02d}", base) for i in range(40)] + [(f"e{i}", edited(base, 4, rng)) for i in range(3)]
    rows += [(f"d{i:02d}", other) for i in range(32)] + [("x", text(200, rng)), ("f0", edited(other, 4, rng))]
    got = {r.key: (r.class_id, r.links) for r in neardup.groups(spark.createDataFrame(rows, "k string, t string"), "k", "t", 5).collect()}
    assert {k: n for k, (_, n) in got.items()} == counted(brute(rows, 5, 0))
    assert got["c07"][1] == 42 and {c for c, _ in got.values()} == {"c00", "d00"}


def test_every_text_of_a_key_takes_part(spark):
    rng = random.Random(10)
    one, two, three = (text(150, rng) for _ in range(3))
    rows = [("a", one), ("a", two), ("b", one), ("c", two), ("d", edited(two, 3, rng)), ("b", three), ("e", edited(three, 3, rng))]
    rows += [("g", x := text(150, rng)), ("g", edited(x, 2, rng)), ("h", edited(x, 2, rng)), ("i", y := text(150, rng)), ("i", edited(y, 2, rng))]
    df = spark.createDataFrame(rows, "k string, t string")
    want = {tuple(sorted(p)) for p in brute(rows, 5, 0)}
    assert want >= {("a", "b"), ("a", "c"), ("b", "e"), ("c", "d")} and ("b", "c") not in want
    assert {tuple(r) for r in neardup.similar_pairs(df, "k", "t", 5).collect()} == want
    assert {r.key: r.links for r in neardup.groups(df, "k", "t", 5).collect()} == counted(want)


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 102), (5, 5)]
    got = {r.key: (r.class_id, r.links) for r in graph.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {i: (0, 1 if i in (0, 20) else 2) for i in range(21)} | {100: (100, 1), 101: (100, 2), 102: (100, 1)}


def test_winnowing_guarantee():
    rng = random.Random(3)
    for _ in range(40):
        shared = text(60, rng)
        two = [text(rng.randrange(90), rng) + shared + text(rng.randrange(90), rng) for _ in range(2)]
        t, _, h = winnow.winnow(*winnow.encode(two), 20, 41)
        assert set(h[t == 0]) & set(h[t == 1])
    assert not len(winnow.winnow(*winnow.encode(["", "kurz"]), 20, 41)[0])


def longest(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                new[j] = row[j - 1] + 1
                best = max(best, new[j])
        row = new
    return best


def test_shared_spans(spark):
    rng = random.Random(11)
    parts = [text(rng.randrange(70, 130), rng) for _ in range(6)]
    short = text(60, rng)  # boilerplate under the limit in a third of all texts
    docs = []
    for i in range(60):
        t = text(rng.randrange(40, 120), rng)
        if i % 3 == 0:
            t += short + text(30, rng)
        if i % 4 == 0:
            cut = rng.randrange(0, 30)
            t += rng.choice(parts)[cut:] + text(20, rng)
        docs.append((i, t))
    docs += [(100, docs[4][1]), (101, docs[4][1]), (102, None), (103, ""), (104, "aaaa" * 60), (105, "b" + "aaaa" * 55)]
    df = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, id int")
    want = {(a, b) for (a, x), (b, y) in itertools.combinations([d for d in docs if d[1]], 2) if longest(x, y) >= 80}
    assert {tuple(r) for r in spans.sharing_pairs(df, min_span=80).collect()} == want
    share = {r.doc_id: r.shared_chars for r in spans.shared_share(df, min_span=80).collect()}
    assert set(share) == {k for p in want for k in p} and share[100] == len(docs[4][1])
    assert spans.sharing_pairs(df.limit(0)).count() == 0


def test_hot_boilerplate_is_told_apart(spark):
    rng = random.Random(12)
    head = text(90, rng)
    docs = [(i, head + text(150, rng)) for i in range(90)]
    docs += [(200, text(20, rng) + head + docs[3][1][90:170]), (201, text(50, rng) + docs[7][1][60:230])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(docs, 2) if longest(x, y) >= 120}
    assert want >= {(3, 200), (7, 201)}
    assert {tuple(r) for r in spans.sharing_pairs(df, min_span=120).collect()} == want


def covered(docs, least):
    """Characters of each text that stand in a stretch of ``least`` characters that another text has too."""
    where = {}
    for k, t in docs:
        for i in range(len(t) - least + 1):
            where.setdefault(t[i : i + least], set()).add(k)
    out = {}
    for k, t in docs:
        own = {p for i in range(len(t) - least + 1) if len(where[t[i : i + least]]) > 1 for p in range(i, i + least)}
        if own:
            out[k] = len(own)
    return out


def test_crowded_long_boilerplate_makes_no_pairs(spark, monkeypatch):
    rng = random.Random(14)
    plate, tails = text(180, rng), [text(90, rng) for _ in range(4)]
    docs = [(i, text(rng.randrange(5, 60), rng) + (tails[i % 4][-rng.randrange(1, 70) :] if i % 3 else "") + plate + (tails[(i + 1) % 4][: rng.randrange(1, 80)] if i % 2 else "") + text(40, rng)) for i in range(75)]
    docs += [(200, text(150, rng)), (201, docs[3][1][-150:])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(spans, "HOT", 20)
    paths, many, _ = spans._paths(df, "doc_id", "text", 80)
    assert many.where("len >= 80").count() and spans._told_apart(paths, many, df, "doc_id", "text", 80, pairs=False).count() < spans._told_apart(paths, many, df, "doc_id", "text", 80, pairs=True).count()
    assert {r.doc_id: r.shared_chars for r in spans.shared_share(df, min_span=80).collect()} == covered(docs, 80)


def test_crowded_groups_are_dealt_in_pieces(spark):
    rows = [(7 if i % 3 else i, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, id long")
    hot = skew.crowded(df, "k", calm=300)
    assert [(r.k, r.n, r.pieces) for r in hot.collect()] == [(7, 2000, 7)] and skew.crowded(df, "k", calm=5000) is None
    out = skew.dealt(df, "k", ["id"], 64, calm=300).collect()
    blocks = {}
    for r in out:
        blocks.setdefault((r.k, r.blk), []).append(r.id)
    own = sorted(b for k, b in blocks if k == 7)
    assert own == list(range(len(own))) and max(map(len, blocks.values())) <= 64 and sorted(r.id for r in out) == list(range(3000))
    bands = spark.createDataFrame([(i, [1, 100 + i % 40, 1000 + i]) for i in range(500)], "id long, bands array<long>").selectExpr("id", "bands", "cast('x' as binary) sketch")
    shape = lambda calm: sorted((r.bucket, len(r.m)) for r in neardup.tiles(bands, calm).collect())
    assert sum(n for b, n in shape(100) if b == 1) == sum(n for b, n in shape(10**6) if b == 1) == 500 and [x for x in shape(100) if x[0] != 1] == [x for x in shape(10**6) if x[0] != 1]
    edges = spark.createDataFrame([(5 if i % 2 else i, i, 0) for i in range(900)] + [(2, 1000, 3)], "edge long, id long, start int")
    assert spans.repeated_edges(edges, 100).count() == spans.repeated_edges(edges).count() == 452


def test_members_of_a_crowded_group_all_meet(spark, monkeypatch):
    rows = [(7, i, i % 3) for i in range(300)] + [(8, i, 1) for i in range(20)] + [(7, 5, 9)]
    df = spark.createDataFrame(rows, "unitig long, id long, start int")
    want = sorted((a, b, s, t) for k in (7, 8) for a, s in [r[1:] for r in rows if r[0] == k] for b, t in [r[1:] for r in rows if r[0] == k] if a < b)
    monkeypatch.setattr(spans, "dealt", partial(skew.dealt, calm=50))
    assert sorted(tuple(r) for r in spans.meet(df, 16).collect()) == want
    rng = random.Random(15)
    plate = text(130, rng)
    docs = spark.createDataFrame([(i * 37 % 101, text(rng.randrange(20, 60), rng) + plate + text(40, rng)) for i in range(101)], "doc_id long, text string")
    monkeypatch.setattr(spans, "dealt", partial(skew.dealt, calm=20))
    assert {tuple(r) for r in spans.sharing_pairs(docs, min_span=100).collect()} == set(itertools.combinations(range(101), 2))


def test_a_path_ends_where_an_anchor_comes_again(spark):
    rng = random.Random(21)
    docs = []
    for i in range(20):
        first, line, last = text(70, rng), text(rng.randrange(12, 30), rng), text(150, rng)
        docs += [(2 * i, first + line + last), (2 * i + 1, first + line + text(60, rng) + line + last)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(r) for r in spans.sharing_pairs(df, min_span=110).collect()} == {(2 * i, 2 * i + 1) for i in range(20)}
    share = {r.doc_id: r.shared_chars for r in spans.shared_share(df, min_span=50).collect()}
    assert all(share[2 * i] == len(docs[2 * i][1]) for i in range(20))


def test_an_edge_holds_the_text_between_its_anchors(spark):
    rng = random.Random(22)
    docs = []
    for i in range(40):
        t = text(300, rng)
        at = rng.randrange(60, 90)
        docs += [(2 * i, t), (2 * i + 1, t[:at] + "#" + t[at + 1 :])]
    docs = [(i, t[:290]) for i, t in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(r) for r in spans.sharing_pairs(df, min_span=200).collect()} == {(2 * i, 2 * i + 1) for i in range(40)}
    points, offsets = winnow.encode(["abcab", "xab"])
    h = winnow.run_hashes(points, np.array([0, 3, 6, 1]), np.array([2, 5, 8, 3]))
    assert h[0] == h[1] == h[2] != h[3]


def test_leaks(spark):
    rng = random.Random(13)
    items = [(i, text(150, rng)) for i in range(12)] + [(50, None), (51, "short")]
    docs = []
    for i in range(40):
        t = text(80, rng)
        if i % 2:
            part = items[i % 12][1][rng.randrange(60) :]
            part = part[: rng.randrange(50, 150)]
            t += "".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" and rng.random() < 0.3 else c.upper() + rng.choice(["", " ", "—"]) for c in part)
        docs.append((i, t + text(30, rng)))
    docs += [(90, None), (91, ""), (1, docs[1][1])]

    def letters(t):
        p, _ = leaks.reduce_texts([t])
        return "".join(map(chr, p))

    want = {(d, i) for d, t in docs if t for i, u in items if u and longest(letters(t), letters(u)) >= 60}
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, item_id int, pos int")
    it = spark.createDataFrame(items, "item_id long, text string")
    assert want and {(r.doc_id, r.item_id) for r in leaks.leaks(df, it).collect()} == want
    two = spark.createDataFrame([(1, docs[1][1]), (1, text(90, rng)), (2, items[3][1]), (2, text(200, rng))], "doc_id long, text string")
    twice = spark.createDataFrame([(3, text(200, rng)), (3, items[3][1])], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks.leaks(two, twice).collect()} >= {(2, 3)}
    assert leaks.leaks(df, it.limit(0)).count() == 0 and letters("Ａ b-Ⅷ") == letters("ａBⅧ")
