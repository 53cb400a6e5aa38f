from __future__ import annotations

import random

from pyspark.sql import functions as F

from docloom.operators import redaction as R
from docloom.plans import privacy


def spans_of(spark, text, extra=None):
    df = R.detected(spark.createDataFrame([(text,)], "t string"), "t", extra)
    return [(s.value, s.label) for s in df.first().spans]


def test_number_and_field_rules(spark):
    assert spans_of(spark, "证 11010119900307851X 完") == [("11010119900307851X", "身份证")]
    assert spans_of(spark, "姓名：张三丰 联系地址：新安市和平路3号，电话 13812345678") == [("张三丰", "姓名"), ("新安市和平路3号", "地址"), ("13812345678", "电话")]
    assert spans_of(spark, "投保人：甲方；|姓名|李四|出生日期|1990-01-02|") == [("李四", "姓名"), ("1990-01-02", "日期")]
    assert spans_of(spark, "性别：女，职业：教师", ["性别"]) == [("女", "性别")]
    assert spans_of(spark, "") == []


def test_resolution_is_greedy(spark):
    rng = random.Random(2)
    rows = []
    for i in range(200):
        spans = []
        for _ in range(rng.randrange(8)):
            a = rng.randrange(20)
            spans.append((a, a + rng.randrange(0, 6), rng.choice(["v", "--"]), "L", "s", rng.randrange(3)))
        rows.append((i, spans))
    df = spark.createDataFrame(rows, f"i int, s {R.SPAN}")
    for r in df.select("i", "s", R.resolved(F.col("s"), F.lit(22)).alias("out")).collect():
        taken = []
        for s in sorted((x for x in r.s if x.start < x.stop <= 22 and x.value != "--"), key=lambda x: (-x.priority, x.start, -(x.stop - x.start))):
            if all(s.stop <= t.start or s.start >= t.stop for t in taken):
                taken.append(s)
        assert [(x.start, x.stop) for x in r.out] == sorted((x.start, x.stop) for x in taken)


def test_allocation_right_to_left_and_reuse(spark):
    df = spark.createDataFrame([(1, "姓名：张三丰，联系人：李四光。"), (2, "姓名：李四光，申请人：王五。")], "id int, t string")
    out, table = R.redact(df, ["id"], "t")
    known = {r.original: r.placeholder for r in table.collect()}
    assert known == {"李四光": "[姓名1]", "张三丰": "[姓名2]", "王五": "[姓名3]"}
    assert [r.redacted for r in out.orderBy("id").collect()] == ["姓名：[姓名2]，联系人：[姓名1]。", "姓名：[姓名1]，申请人：[姓名3]。"]
    old = spark.createDataFrame([("姓名", "王五", 7)], "label string, original string, n int")
    again = {r.original: r.placeholder for r in R.redact(df, ["id"], "t", known=old)[1].collect()}
    assert again == {"王五": "[姓名7]", "李四光": "[姓名8]", "张三丰": "[姓名9]"}


def test_old_placeholders_are_neither_given_again_nor_filled(spark):
    rows = [("a", "[姓名1]与[姓名9]，姓名：张三丰。"), ("b", "姓名：李四光，见[电话2]，电话 13812345678"), ("b", "姓名：王五。"), ("c", "无")]
    texts = spark.createDataFrame(rows, "key string, text string")
    stored = spark.createDataFrame([(1, "[姓名4]", "王五"), (2, "[姓名5]", "王五"), (3, "[姓名4]", "赵六"), (4, None, "x"), (5, "kein", "y")], "id int, placeholder string, original string")
    out, given = privacy.redacted_texts(texts, stored, True)
    assert {r.original: r.placeholder for r in given.collect()} == {"王五": "[姓名4]", "张三丰": "[姓名10]", "李四光": "[姓名11]", "13812345678": "[电话3]"}
    assert ("b", "姓名：[姓名4]。") in {(r.key, r.redacted) for r in out.collect()}
    assert sorted(tuple(r) for r in privacy.restored_texts(texts, stored).collect()) == sorted(rows)
    assert {"key"} < set(privacy.pii_redact(spark, "/root/testdata/sf0.001").columns)


def test_unresolved(spark):
    df = spark.createDataFrame([("[姓名1][电话2][姓名1]", ["[电话2]"])], "t string, k array<string>")
    assert df.select(R.unresolved("t", F.col("k"))).first()[0] == ["[姓名1]", "[姓名1]"]


def test_a_recogniser_joins_the_rules_and_may_fail(spark):
    from docloom import models

    df = spark.createDataFrame([(1, "联系人：王小明，由李大海先生签收。电话13812345678"), (2, "无"), (3, None)], "id int, text string")
    spans = lambda r: {x.id: {(s.value, s.label, s.source) for s in x.spans} for x in R.detected(df, "text", recogniser=r).collect()}
    got = spans(models.titled_names)[1]
    assert {("王小明", "姓名", "context"), ("13812345678", "电话", "regex")} <= got and any(s == "ner" and v.endswith("李大海") for v, _, s in got)

    def fails(text):
        raise OSError("no model")

    assert spans(fails) == spans(None)
    wrapped = lambda t: {"output": {"output": [{"type": "org", "start": 0, "end": 1}, {"start": 5, "end": 2}, {"start": "x"}, 7]}}
    assert ("联", "机构", "ner") in spans(wrapped)[1] and models.entities("x") == models.entities(None) == []


def test_extra_fields(spark):
    df = spark.createDataFrame([("车牌号：沪A12345，备注：急件",)], "text string")
    got = df.select(R.field_spans("text", ["车牌号"]).alias("s")).first().s
    assert [(s.value, s.label, s.priority) for s in got] == [("沪A12345", "车牌号", 94)]


def test_batches_give_the_spans_of_the_column_rules(spark):
    rng = random.Random(4)
    bits = ["姓名", "姓 名", "姓\x1c名", "联系人：", "：", " ", "\x1c", "\x85", "\n", "|", "张三丰", "甲方", "和平路3号", "建设银行股份", "合同编号", "HT-2024-000123", "出生日期", "1990年01月02日", "１３８１２３４５６７８", "+86 138 1234 5678", "(010)-12345678"]
    bits += ["400-123-4567", "6222 1234 5678 9012", "622212345678901234", "11010119900307851X", "91350100M000100Y43", "a.b@c.com", "，", "x", "（甲）", "😀", "车牌[号"]
    rows = [("".join(rng.choice(bits) for _ in range(rng.randrange(25))),) for _ in range(400)] + [(None,), ("",)]
    df = spark.createDataFrame(rows, "t string")
    for extra in (None, ["车牌[号"]):
        both = R.ruled(df, "t", extra).select(F.array_sort("ruled").alias("a"), F.array_sort(F.concat(R.field_spans("t", extra), R.number_spans("t"))).alias("b")).collect()
        assert sum(len(r.a) for r in both) > 300 and all(r.a == r.b for r in both)


def test_a_number_behind_a_digit_beyond_the_basic_plane_is_none(spark):
    assert spans_of(spark, "𝟐13812345678") == []
