"""Rule-based redaction: spans by number shape and field name, overlap resolution, placeholder numbers, substitution, restoring.

A span is struct<start, stop, value, label, source, priority>. ``number_spans`` and ``field_spans`` give those of the rules as array
expressions; ``detected`` finds the same ones over whole Arrow batches, each rule only in texts that an automaton over the
batch lets pass. All else runs as array expressions in the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import patterns as P
from docloom.functions.text import col, matches, placeholders, strip
from docloom.models import Recogniser, recognised
from docloom.operators.numbering import row_numbers
from docloom.runtime import stage

SPAN = "array<struct<start:int,stop:int,value:string,label:string,source:string,priority:int>>"


def _spans(found: Column, label: str, source: str, priority: int) -> Column:
    return F.transform(
        found,
        lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(m["value"])).cast("int").alias("stop"), m["value"].alias("value"), F.lit(label).alias("label"), F.lit(source).alias("source"), F.lit(priority).alias("priority")),
    ).cast(SPAN)


def number_spans(text: Column | str, labels: list[str] | None = None) -> Column:
    """Spans of all number rules, or of those with one of the labels."""
    parts = [_spans(matches(text, "(?Ud)" + p), label, "regex", n) for label, p, n in P.NUMBER_RULES if labels is None or label in labels]
    return F.concat(*parts)


def has_any(value: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(value, w))


def valid(value: Column, kind: str) -> Column:
    """Whether a field's value looks like what the field announces."""
    if kind == "person":
        return ~value.isin(P.NAME_STOP) & ~value.rlike(P.ROLE_ENDINGS) & value.rlike(P.HAN_NAME) & ~has_any(value, P.ORG_WORDS + P.REGION_WORDS)
    if kind == "address":
        return F.length(value).between(4, 60) & has_any(value, P.REGION_WORDS)
    if kind == "org":
        return F.length(value).between(4, 40) & has_any(value, P.ORG_WORDS)
    if kind == "code":
        return value.rlike(P.CODE)
    if kind == "birthday":
        return value.rlike(P.BIRTHDAY)
    return F.length(value).between(1, 40)


def _valid_only(found: Column, kind: str) -> Column:
    return F.filter(found, lambda m: (m["value"] != "") & valid(m["value"], kind))


def field_spans(text: Column | str, extra: list[str] | None = None, tables: bool = True, lines: bool = True) -> Column:
    """Spans of values behind a field's name, as ``name: value`` or as cells of a table row. ``extra`` names further fields of any value."""
    rules = [*P.FIELD_RULES, *((name, rf"\Q{name}\E", "any", 94) for name in extra or [] if name.strip())]
    parts = []
    for label, anchor, kind, priority in rules:
        shapes = []
        if lines:
            shapes.append(("(" + anchor + P.FIELD_SEPARATOR + ")" + P.FIELD_VALUE, priority))
        if tables:
            shapes.append(("(" + P.CELL_BEFORE + anchor + P.CELL_BETWEEN + ")" + P.CELL_VALUE, priority + 1))
        for shape, n in shapes:
            found = F.transform(matches(text, "(?Ud)" + shape, 2), lambda m: F.struct(m["start"].alias("start"), strip(m["value"]).alias("value")))
            parts.append(_spans(_valid_only(found, kind), label, "context", n))
    return F.concat(*parts)


#: White space as Unicode and Java's (?U) know it; Python's own has four control characters more.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _spelt(pattern: str, mark: str, chars: str) -> str:
    """A pattern with an escape such as \\s spelt out as a class, or as part of the class that it stands in."""
    token = lambda m: m[0].replace(mark, chars) if m[0][0] == "[" else f"[{chars}]" if m[0] == mark else m[0]
    return re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", token, pattern, flags=re.S)


def _python(pattern: str) -> str:
    """A pattern of the rules with Java's white space, for Python."""
    return _spelt(pattern, r"\s", SPACES)


@cache
def _digits() -> str:
    """A class of Python's decimal digits other than those of ASCII."""
    return "[" + "".join(f"{chr(c)}-{chr(c + 9)}" for c in range(0x80, 0x110000) if unicodedata.decimal(chr(c), None) == 0) + "]"


def _sieve(pattern: str) -> str:
    """A pattern without its lookaround for an automaton (RE2): it matches wherever the pattern does, and more, in texts without _digits()."""
    return _spelt(re.sub(r"\(\?<?!(?:\[[^\]]*\]|[^)\[])*\)", "", _python(pattern)), r"\d", "0-9")


@cache
def _checks() -> dict[str, Callable[[str], bool]]:
    """``valid`` for a value at a time."""
    has = lambda v, words: any(w in v for w in words)
    role, name, code, birthday = (re.compile(_python(p.removeprefix("(?U)"))) for p in (P.ROLE_ENDINGS, P.HAN_NAME, P.CODE, P.BIRTHDAY))
    return {
        "person": lambda v: v not in P.NAME_STOP and not role.search(v) and bool(name.search(v)) and not has(v, P.ORG_WORDS + P.REGION_WORDS),
        "address": lambda v: 4 <= len(v) <= 60 and has(v, P.REGION_WORDS),
        "org": lambda v: 4 <= len(v) <= 40 and has(v, P.ORG_WORDS),
        "code": lambda v: bool(code.search(v)),
        "birthday": lambda v: bool(birthday.search(v)),
    }


def _rules(extra: list[str] | None) -> list[tuple[str, list[tuple[re.Pattern[str], int]], str, str | None]]:
    """(automaton's pattern, [(pattern, priority)], label, kind of check or None for a number) of all rules."""
    names = [*P.FIELD_RULES, *((name, re.escape(name), "any", 94) for name in extra or [] if name.strip())]
    out = []
    for label, anchor, kind, n in names:
        shapes = (("(" + anchor + P.FIELD_SEPARATOR + ")" + P.FIELD_VALUE, n), ("(" + P.CELL_BEFORE + anchor + P.CELL_BETWEEN + ")" + P.CELL_VALUE, n + 1))
        # where Python's and RE2's escapes differ a name is looked for as it stands
        out.append(("" if kind == "any" else _sieve(anchor), [(re.compile(_python(shape)), k) for shape, k in shapes], label, kind))
    return out + [(_sieve(p), [(re.compile(_python(p)), n)], label, None) for label, p, n in P.NUMBER_RULES]


def ruled(df: DataFrame, text: str, extra: list[str] | None = None) -> DataFrame:
    """df with ``ruled``: the spans that field_spans() and number_spans() give, in one pass over Arrow batches."""
    wanted = T.StructType([*df.schema.fields, T.StructField("ruled", T._parse_datatype_string(SPAN))])
    shape = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("value", pa.string()), ("label", pa.string()), ("source", pa.string()), ("priority", pa.int32())]))
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, checks = _rules(extra), _checks()
        for b in batches:
            rows: list[list[dict]] = [[] for _ in range(b.num_rows)]
            wide = pc.match_substring_regex(b.column(at), _digits())
            for sieve, patterns, label, kind in rules:
                passed = pc.or_(wide, pc.match_substring_regex(b.column(at), sieve))
                ids = pc.indices_nonzero(pc.fill_null(passed, False))
                check = checks.get(kind or "", lambda v: 1 <= len(v) <= 40)
                for i, t in zip(ids.to_pylist(), b.column(at).take(ids).to_pylist()):
                    for pattern, n in patterns:
                        for m in pattern.finditer(t):
                            if kind is None:
                                rows[i].append({"start": m.start(), "stop": m.end(), "value": m[0], "label": label, "source": "regex", "priority": n})
                            elif (v := m[2].strip(SPACES)) and check(v):
                                rows[i].append({"start": m.start(2), "stop": m.start(2) + len(v), "value": v, "label": label, "source": "context", "priority": n})
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, shape)], names=[*b.schema.names, "ruled"])

    return df.mapInArrow(run, wanted)


def resolved(spans: Column, length: Column) -> Column:
    """Spans without overlaps: by priority, then start, then length they are taken if none taken before overlaps; useless ones drop out."""
    good = F.filter(spans, lambda s: (s["start"] >= 0) & (s["stop"] <= length) & (s["stop"] > s["start"]) & ~s["value"].rlike(r"(?U)^[\s\W_]+$"))
    order = F.array_sort(F.transform(good, lambda s: F.struct((-s["priority"]).alias("p"), s["start"].alias("start"), (s["start"] - s["stop"]).alias("n"), s.alias("s"))))
    taken = F.aggregate(
        order, F.array().cast(SPAN),
        lambda acc, x: F.when(F.exists(acc, lambda t: (x["s"]["start"] < t["stop"]) & (x["s"]["stop"] > t["start"])), acc).otherwise(F.concat(acc, F.array(x["s"]))),
    )
    return F.array_sort(taken)


def detected(df: DataFrame, text: str, extra: list[str] | None = None, recogniser: Recogniser | None = None) -> DataFrame:
    """df with ``spans``: its number and field spans, and those of an entity recogniser if there is one, resolved."""
    df, parts = ruled(df, text, extra), [F.col("ruled")]
    if recogniser is not None:
        df, parts = recognised(df, text, recogniser), [*parts, F.col("recognised").cast(SPAN)]
    return df.withColumn("spans", resolved(F.concat(*parts), F.length(text))).drop("ruled", "recognised")


def substituted(text: Column | str, spans: Column, field: str) -> Column:
    """A text with each of its disjoint spans, in order, replaced by the span's field."""
    t = col(text)
    return F.aggregate(
        spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(F.concat(acc["out"], F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), s[field]).alias("out"), s["stop"].alias("at")),
        lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.greatest(F.length(t) - acc["at"], F.lit(0)))),
    )


def allocated(spans: DataFrame, order: list[str], known: DataFrame | None = None) -> DataFrame:
    """(label, original, placeholder): one number for each different original of a label.

    spans has the columns ``order`` (document, block, field), start, label and value. Originals that ``known``
    (label, original, n) holds keep their number; others go on from its highest, in order of first appearance, where a field is read
    from right to left. Only the distinct originals are ordered, never all spans.
    """
    first = spans.groupBy("label", F.col("value").alias("original")).agg(F.min(F.struct(*order, (-F.col("start")).alias("back"))).alias("first"))
    if known is not None:
        top = known.groupBy("label").agg(F.max("n").alias("top"))
        old = first.join(known, ["label", "original"]).select("label", "original", "n")
        first = first.join(known, ["label", "original"], "left_anti").join(F.broadcast(top), "label", "left")  # one row per label
    else:
        first, old = first.withColumn("top", F.lit(0)), None
    # a label may hold most originals of an archive, so the numbers are made over ranges
    new = row_numbers(first, "label", [F.col("first"), F.col("original")]).select("label", "original", (F.col("n") + F.coalesce("top", F.lit(0))).alias("n"))
    out = new if old is None else new.unionByName(old)
    return out.select("label", "original", F.concat(F.lit("["), "label", F.col("n").cast("string"), F.lit("]")).alias("placeholder"))


def redact(df: DataFrame, key: list[str], text: str, known: DataFrame | None = None, extra: list[str] | None = None, recogniser: Recogniser | None = None) -> tuple[DataFrame, DataFrame]:
    """(texts with ``redacted`` and ``hits``, placeholder table). key orders the rows; hits counts a row's different placeholders."""
    found = stage(detected(df.select(*key, text), text, extra, recogniser), "spans")
    each = found.select(*key, F.explode("spans").alias("s")).select(*key, F.col("s.start").alias("start"), F.col("s.label").alias("label"), F.col("s.value").alias("value"))
    table = stage(allocated(each, key, known), "placeholders")
    named = (
        found.select(*key, F.explode("spans").alias("s")).join(table, (F.col("s.label") == F.col("label")) & (F.col("s.value") == F.col("original")))
        .groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col("s.start").alias("start"), F.col("s.stop").alias("stop"), "placeholder"))).alias("named"))
    )
    none = F.array().cast("array<struct<start:int,stop:int,placeholder:string>>")
    rows = found.join(named, key, "left").withColumn("named", F.coalesce("named", none))
    return rows.select(*key, text, substituted(text, F.col("named"), "placeholder").alias("redacted"), F.size(F.array_distinct(F.transform("named", lambda s: s["placeholder"]))).alias("hits")), table


def unresolved(text: Column | str, known: Column) -> Column:
    """Placeholders of a text that a list of known ones lacks, repeats included."""
    return F.filter(placeholders(text), lambda p: ~F.array_contains(known, p))
