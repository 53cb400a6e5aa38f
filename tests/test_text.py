"""Text functions against plain Python models."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.functions import patterns as P
from docloom.functions import text as T

SAMPLES = ["", " ", "MIO12 外设可以用于", "A.b-c 单", "é1中文字2", "第一句。第二句！短\n下一行；Last one? yes", "x" * 1500, "中" * 705 + "。尾巴句子。" * 60, ("句子很长" * 40 + "。") * 12, "\t a  b 　c ", None]


def value(spark, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def py_tokens(t):
    low = (t or "").lower()
    out = re.findall("[a-z0-9]+", low)
    for run in re.findall("[㐀-䶿一-鿿豈-﫿]+", low):
        out += [run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]
    return out


def py_split(text, size=700, overlap=100):
    text = (text or "").strip()
    size = max(100, size)
    overlap = max(0, min(overlap, size // 2))
    if not text:
        return []
    if len(text) <= size:
        return [text]
    out, held = [], ""
    for s in [s for s in re.split("(?<=[。！？!?；;\n])", text) if s.strip()]:
        if len(s) > size:
            out += [held] if held else []
            held = ""
            out += [s[i : i + size] for i in range(0, len(s), size - overlap)]
        elif len(held) + len(s) <= size:
            held += s
        else:
            out.append(held)
            held = (held[-overlap:] if overlap else "") + s
    return [p.strip() for p in [*out, held] if p.strip()]


def test_tokens(spark):
    assert value(spark, SAMPLES, T.tokens("t")) == [py_tokens(t) for t in SAMPLES]
    assert value(spark, ["MIO12 外设可以用于"], T.index_text("t")) == ["mio12 外设 设可 可以 以用 用于"]


@pytest.mark.parametrize(("size", "overlap"), [(700, 100), (120, 0), (100, 90)])
def test_split_text(spark, size, overlap):
    rng = random.Random(4)
    rows = SAMPLES + ["".join(rng.choice("ab 中文。！\n;") * rng.choice([1, 1, 30]) for _ in range(rng.randrange(400))) for _ in range(60)]
    assert value(spark, rows, T.split_text("t", size, overlap)) == [py_split(t, size, overlap) for t in rows]


@pytest.mark.parametrize(("label", "pattern", "_n"), P.NUMBER_RULES)
def test_matches_and_starts(spark, label, pattern, _n):
    rng = random.Random(label)
    bits = ["13812345678", "138-1234-5678", "+86 139 8765 4321", "400-123-4567", "110101199003078515", "11010119900307851X", "6222021234567890123", "6222 0212 3456 7890", "(010)-12345678", "a.b@c.example", "91350211M000100Y43", "。", " ", "-", "x", "7", "中"]
    rows = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(150)]
    got = value(spark, rows, T.matches("t", "(?Ud)" + pattern))
    assert [[(m["start"], m["value"]) for m in g] for g in got] == [[(m.start(), m.group()) for m in re.finditer(pattern, t)] for t in rows]


def test_markdown_table(spark):
    df = spark.sql("select array(array('a', 'b'), array('1', null, 'x\ny'), array('', ' ')) as r, cast(array() as array<array<string>>) as e")
    r = df.select(T.rows_to_markdown("r").alias("r"), T.rows_to_markdown("e").alias("e")).first()
    assert r.r == "| a | b |  |\n| --- | --- | --- |\n| 1 |  | x y |"
    assert r.e == ""


def test_small_functions(spark):
    assert value(spark, ["[1][01][2][123]", None], T.citations("t")) == [[1, 2], []]
    assert value(spark, ["见[姓名1]和[电话22]、[1]、[文字](u)"], T.placeholders("t")) == [["[姓名1]", "[电话22]"]]
    assert value(spark, ["## **标题** ##", None], T.clean_title("t")) == ["标题", None]
    assert value(spark, ["a *b* `c` [x](y) <i>"], T.plain_snippet("t")) == ["a b c [x]\\(y) &lt;i&gt;"]
    assert value(spark, ["x" * 5, "ab cd ef"], T.shorten("t", 6)) == ["xxxxx", "ab cd…"]
    assert value(spark, [' a/b:c? .', "", None], T.safe_name("t")) == ["a_b_c_", "kb", "kb"]
    assert value(spark, ["第 12 页\t A"], T.repeat_key("t")) == ["第 # 页 a"]
    assert value(spark, ["per", "x", "", None], T.entity_label("t")) == ["姓名", "X", "敏感信息", "敏感信息"]


def test_fingerprint_ignores_spacing_and_order(spark):
    df = spark.sql("select ' a  b ' q, array('x','y') k union all select 'a b', array('y','x')")
    keys = {r[0] for r in df.select(T.fingerprint("q", F.col("k"), F.lit("all"), F.lit("m"), F.lit(True))).collect()}
    assert len(keys) == 1


def test_restore_takes_longest_first(spark):
    df = spark.sql("select '[姓名1]和[姓名11]' t, array(named_struct('placeholder','[姓名1]','original','甲'), named_struct('placeholder','[姓名11]','original','乙')) m")
    assert df.select(T.restore("t", F.col("m"))).first()[0] == "甲和乙"


def test_segments_keep_offsets(spark):
    rows = [t or "" for t in SAMPLES]
    for t, got in zip(rows, value(spark, rows, T.segments("t", 300))):
        assert all(len(s["text"]) <= 300 and t[s["start"] : s["start"] + len(s["text"])] == s["text"] for s in got)
        assert sum(len(s["text"].strip()) for s in got) >= len(t.strip()) - t.count("\n") - t.count(" ") if t.strip() else not got
