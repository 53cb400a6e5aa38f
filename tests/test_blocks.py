"""Blocks, headings and packing against an independent Python model."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from docloom.operators import blocks as B

SCHEMA = "d int, block_index int, type string, content string, size double, bold boolean, style string, heading boolean, heading_level int, page int, context string"
CAPTION = re.compile(r"^\s*(figure|fig\.?|table|chart|图|表)\s*[\d一二三四五六七八九十]", re.I)
STYLE = re.compile(r"(?:heading|标题)\s*([1-9])", re.I)


def model(rows):
    """(is_heading, level) of every row and the packed buffers of one document."""
    sums = {}
    for r in rows:
        if r["type"] == "text" and r["size"] and len(r["content"].strip()) >= 40:
            s = round(r["size"], 1)
            sums[s] = sums.get(s, 0) + len(r["content"].strip())
    body = max(sums.items(), key=lambda x: x[1])[0] if sums else 0.0
    sizes = {round(r["size"], 1) for r in rows if r["type"] == "text" and 0 < len(r["content"].strip()) <= 90 and not (r["style"] and STYLE.search(r["style"])) and body and (r["size"] or 0) >= body * 1.12}
    levels = {s: i + 1 for i, s in enumerate(sorted(sizes, reverse=True))}
    flags, out, crumbs, section = [], [], [], 0
    buf, n, kind, page = [], 0, "text", None

    def flush():
        nonlocal buf, n
        if buf:
            out.append((section, " > ".join(t for _, t in crumbs), kind, page, "\n".join(buf)))
        buf, n = [], 0

    for r in rows:
        t, size = r["content"].strip(), r["size"] or 0.0
        style = STYLE.search(r["style"] or "")
        if r["type"] != "text" or not t or len(t) > 90:
            head = False
        elif r["heading"]:
            head = not CAPTION.match(t)
        elif CAPTION.match(t):
            head = False
        elif style:
            head = True
        elif not size or not body:
            head = False
        else:
            head = (size >= body * 1.12 and size in levels) or bool(r["bold"] and len(t) <= 40 and size >= body)
        level = max(1, min(r["heading_level"], 6)) if r["heading_level"] else int(style[1]) if style else levels.get(round(size, 1), 1)
        flags.append((head, level))
        if head:
            flush()
            while crumbs and crumbs[-1][0] >= level:
                crumbs.pop()
            crumbs = [*crumbs, (level, t.splitlines()[0].strip())][-3:]
            section += 1
            continue
        if r["type"] == "figure":
            flush()
            if not r["context"].strip():
                continue
            t = "（图表内容）" + r["context"].strip()
        elif r["type"] == "table":
            flush()
        if buf and (page != r["page"] or kind != r["type"]):
            flush()
        if buf and n + len(t) > 700:
            flush()
        if not buf:
            kind, page = r["type"], r["page"]
        buf.append(t)
        n += len(t)
        if n >= 700:
            flush()
    flush()
    return flags, out


def test_headings_and_packing(spark):
    rng = random.Random(8)
    rows = []
    for d in range(40):
        for i in range(rng.randrange(1, 40)):
            kind = rng.choice(["text"] * 6 + ["table", "figure"])
            text = rng.choice(["标题", "图 1 说明", "Table 2 x", "短句。", "", "正文" * 30, "长" * 300, "x" * 720, " 两\n行 "])
            rows.append((d, i, kind, text, rng.choice([None, 10.5, 10.5, 13.0, 16.0]), rng.random() < 0.3, rng.choice([None, None, "Heading 2", "Normal"]), rng.random() < 0.1, rng.choice([0, 0, 0, 3, 9]), rng.choice([None, 1, 1, 2]), rng.choice(["", "上下文"])))
    df = spark.createDataFrame(rows, SCHEMA)
    headed = B.with_headings(df, "d")
    flags = {(r.d, r.block_index): (r.is_heading, r.level) for r in headed.collect()}
    got = {}
    for r in B.packed(headed, "d").orderBy("d", "buffer_no").collect():
        got.setdefault(r.d, []).append((r.section, r.crumb, r.type, r.page, r.body))
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for d in range(40):
        own = [dict(zip(names, r)) for r in rows if r[0] == d]
        want_flags, want = model(own)
        assert [flags[d, r["block_index"]] for r in own] == want_flags
        assert got.get(d, []) == want
    chunks = B.chunks(B.packed(headed, "d"), "d").collect()
    assert all(len(c.content) <= 800 + len(c.section) + 4 for c in chunks) and len({c.chunk_id for c in chunks}) == len(chunks)


def test_markdown_blocks(spark):
    text = "# **甲** #\nline a\nline b\n\n| x |\n|---|\nafter\n####### deep\n#\n"
    rows = B.markdown_blocks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "d int, t string"), "d", "t").orderBy("block_index").collect()
    assert [(r.type, r.heading_level, r.content) for r in rows] == [("text", 1, "甲"), ("text", None, "line a\nline b"), ("table", None, "| x |\n|---|"), ("text", None, "after"), ("text", 6, "deep"), ("text", 1, "")]


def test_repeats(spark):
    pages = [(p, "k", f"公司 手册\n正文{p}a\n正文 {'x' * p}\n正文b{'y' * p}\nc{'z' * p}\nd{'w' * p}\n第 {p} 页") for p in range(1, 4)]
    df = spark.createDataFrame(pages, "p int, g string, t string")
    assert {(r.line_key, r.pages) for r in B.repeated_lines(df, "g", "p", "t").collect()} >= {("公司 手册", 3), ("第 # 页", 3), ("正文#a", 3)}
    b = spark.createDataFrame([("k", "H 1", True), ("k", "h 2", True), ("k", "H  3", True), ("k", "H 4", False), ("k", "body", False), (None, "x", True)], "g string, t string, m boolean")
    assert {r.t for r in B.repeated_margins(b, "g", "t", "m").collect()} == {"body", "x"}


def test_layout(spark):
    rows = [(1, 0, "text", 1, [0.0, 0.0, 10.0, 10.0], "far"), (1, 1, "figure", 1, [0.0, 100.0, 10.0, 110.0], ""), (1, 2, "text", 1, [0.0, 112.0, 10.0, 120.0], "图 3 近"), (1, 3, "text", 2, [0.0, 100.0, 10.0, 110.0], "other page"), (1, 4, "figure", 3, None, ""), (1, 5, "table", 1, [0.0, 115.0, 5.0, 130.0], "")]
    df = spark.createDataFrame(rows, "d int, block_index int, type string, page int, bbox array<double>, content string")
    assert {(r.block_index, r.context) for r in B.nearest_text(df, "d").collect()} == {(1, "图 3 近 far"), (4, "")}
    assert {(r.block_index, r.caption) for r in B.nearest_caption(df, "d").collect()} == {(1, "图 3 近"), (4, "")}
    assert {r.content for r in B.outside_tables(df, "d").collect()} == {"far", "other page"}
    m = spark.sql("select 0.0 y0, 5.0 y1, 100.0 h union all select 50.0, 60.0, 100.0 union all select 90.0, 99.0, 100.0 union all select 1.0, 1.0, 100.0")
    assert [r[0] for r in m.select(B.in_margin(F.col("y0"), F.col("y1"), F.col("h"))).collect()] == [True, False, True, False]


def test_pages_as_markdown_lose_their_running_heads(spark):
    pages = [("d", n, f"公司手册 第{n}页\n\n# 标题{w}\n正文{w}\n\n| a | {w} |\n\n第 {n} 页 共 4 页") for n, w in enumerate("甲乙丙丁", 1)] + [("e", 1, "公司手册 第1页\n\n独有")]
    out = B.paged_blocks(spark.createDataFrame(pages, "doc string, page int, text string"), "doc", "page", "text").orderBy("doc", "block_index").collect()
    own = [(r.page, r.block_index, r.type, r.heading_level, r.content) for r in out if r.doc == "d"]
    assert own[:3] == [(1, 0, "text", 1, "标题甲"), (1, 1, "text", None, "正文甲"), (1, 2, "table", None, "| a | 甲 |")] and [x[1] for x in own] == list(range(12))
    assert [r.content for r in out if r.doc == "e"] == ["公司手册 第1页", "独有"]


def test_pages_of_pdf_files(spark, tmp_path):
    from docloom.sources import files

    (tmp_path / "a.pdf").write_bytes(b"one")
    (tmp_path / "b.PDF").write_bytes(b"bad")
    (tmp_path / "c.txt").write_bytes(b"x")

    def reader(raw):
        if raw == b"bad":
            raise ValueError("broken")
        return [(1, "# t"), (2, "u")]

    got = sorted((r.path.rsplit("/", 1)[1], r.page, r.text, r.error) for r in files.pages(spark, str(tmp_path), reader).collect())
    assert got == [("a.pdf", 1, "# t", None), ("a.pdf", 2, "u", None), ("b.PDF", None, None, "ValueError: broken")]
    assert all("pymupdf4llm" in r.error for r in files.pages(spark, str(tmp_path)).collect())
