"""Text functions as columns. Lengths are code points; strip means Unicode white space on both ends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import patterns as P


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def blank(c: Column | str) -> Column:
    """Null or without any visible character."""
    return ~F.coalesce(col(c).rlike(r"(?U)\S"), F.lit(False))


def collapse(c: Column | str) -> Column:
    """White space to single spaces, none at the ends; null to an empty text."""
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)\s+", " "))


def tokens(c: Column | str) -> Column:
    """Keyword terms: ASCII words first, then the character pairs of every CJK run (a lone character as it is)."""
    low = F.lower(F.coalesce(col(c), F.lit("")))
    words = F.regexp_extract_all(low, F.lit(P.ASCII_RUN), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(P.CJK_RUN), F.lit(0))
    pairs = F.transform(
        runs,
        lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))
        ),
    )
    return F.concat(words, F.flatten(pairs))


def index_text(c: Column | str) -> Column:
    return F.array_join(tokens(c), " ")


def repeat_key(c: Column | str) -> Column:
    """What makes two margin lines the same: case, spacing and figures don't count."""
    return F.regexp_replace(F.lower(collapse(c)), r"(?U)\d+", "#")


def clean_title(c: Column | str) -> Column:
    """A Markdown heading without its marks."""
    out = strip(F.regexp_replace(strip(c), r"^#+|#+$", ""))
    for mark in (r"\*\*", "__", "`", r"\*", "_"):
        out = F.regexp_replace(out, mark, "")
    return strip(out)


def plain_snippet(c: Column | str) -> Column:
    """A passage as safe plain text: spacing collapsed, emphasis and code marks gone, links broken, angle brackets escaped."""
    out = F.regexp_replace(collapse(c), r"\*{1,3}|_{2,}", "")
    out = F.replace(F.regexp_replace(out, "`+", ""), F.lit("]("), F.lit(r"]\("))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def cut(c: Column, limit: int) -> Column:
    """At most limit characters, without white space at the cut, and a mark of omission."""
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, limit), r"(?U)\s+$", ""), F.lit("…")))


def snippet(c: Column | str, limit: int = P.SNIPPET_CHARS) -> Column:
    return cut(plain_snippet(c), limit)


def shorten(c: Column | str, limit: int) -> Column:
    return cut(collapse(c), limit)


def safe_name(c: Column | str, fallback: str = "kb") -> Column:
    """A legal, stable file or folder name."""
    out = F.regexp_replace(F.regexp_replace(strip(F.coalesce(col(c), F.lit(""))), P.ILLEGAL_IN_NAMES, "_"), r"^[ .]+|[ .]+$", "")
    return F.when(out == "", F.lit(fallback)).otherwise(out)


def citations(c: Column | str) -> Column:
    """Citation numbers in order of first appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(P.CITATION), F.lit(1)), lambda x: x.cast("int")))


def placeholders(c: Column | str) -> Column:
    return F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(P.PLACEHOLDER), F.lit(0))


def sentences(c: Column | str) -> Column:
    """A text cut behind sentence marks and newlines, blank parts dropped."""
    return F.filter(F.split(col(c), P.SENTENCE_END), lambda s: s.rlike(r"(?U)\S"))


def split_text(c: Column | str, size: int = P.CHUNK_SIZE, overlap: int = P.CHUNK_OVERLAP) -> Column:
    """Pieces of about ``size`` characters at sentence ends; a piece begins with the last ``overlap`` of the one before,
    so it may reach size + overlap. A longer sentence is sliced evenly. Blank texts give none."""
    size, overlap = max(100, size), max(0, min(overlap, max(100, size) // 2))
    step = max(1, size - overlap)
    text = strip(F.coalesce(col(c), F.lit("")))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))

    def slices(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / step).cast("int")), lambda k: F.substring(s, k * step + 1, F.lit(size)))

    def add(acc: Column, s: Column) -> Column:
        buf, done = acc["buf"], acc["done"]
        closed = F.when(buf == "", done).otherwise(F.concat(done, F.array(buf)))
        tail = F.substring(buf, F.greatest(F.length(buf) - overlap + 1, F.lit(1)), F.lit(overlap)) if overlap else F.lit("")
        long = F.length(s) > size
        fits = F.length(buf) + F.length(s) <= size
        return F.struct(
            F.when(long, F.concat(closed, slices(s))).when(fits, done).otherwise(F.concat(done, F.array(buf))).alias("done"),
            F.when(long, F.lit("")).when(fits, F.concat(buf, s)).otherwise(F.concat(tail, s)).alias("buf"),
        )

    folded = F.aggregate(sentences(text), empty, add, lambda acc: F.concat(acc["done"], F.array(acc["buf"])))
    pieces = F.when(F.length(text) <= size, F.array(text)).otherwise(folded)
    return F.filter(F.transform(pieces, strip), lambda p: p != "")


def segments(c: Column | str, size: int = P.NER_SEGMENT) -> Column:
    """(start, text) segments of at most ``size`` characters for an entity recogniser: sentences are joined while they fit, longer ones sliced; nothing overlaps and offsets hold."""
    text = F.coalesce(col(c), F.lit(""))
    none = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))

    def slices(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / size).cast("int")), lambda k: F.substring(s, k * size + 1, F.lit(size)))

    def add(acc: Column, s: Column) -> Column:
        buf, done = acc["buf"], acc["done"]
        closed = F.when(buf == "", done).otherwise(F.concat(done, F.array(buf)))
        long = F.length(s) > size
        fits = F.length(buf) + F.length(s) <= size
        return F.struct(F.when(long, F.concat(closed, slices(s))).when(fits, done).otherwise(closed).alias("done"), F.when(long, F.lit("")).when(fits, F.concat(buf, s)).otherwise(s).alias("buf"))

    parts = F.aggregate(F.filter(F.split(text, P.SENTENCE_END), lambda s: s != ""), none, add, lambda acc: F.filter(F.concat(acc["done"], F.array(acc["buf"])), lambda s: s != ""))
    at = F.aggregate(
        parts,
        F.struct(F.array().cast("array<struct<start:int,text:string>>").alias("out"), F.lit(0).alias("n")),
        lambda acc, s: F.struct(F.concat(acc["out"], F.array(F.struct(acc["n"].alias("start"), s.alias("text")))).alias("out"), (acc["n"] + F.length(s)).alias("n")),
        lambda acc: acc["out"],
    )
    return F.filter(at, lambda x: x["text"].rlike(r"(?U)\S"))


def matches(c: Column | str, pattern: str, group: int = 0) -> Column:
    """(start, value) of every match of a pattern, offsets from 0. With a group the pattern's group 1 is the text before the value, group 2 the value."""
    text = col(c)
    every = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    # each array is made once and walked once: what lies between the matches, the matches and their groups
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), every(0).alias("all"), *([every(1).alias("lead"), every(2).alias("value")] if group else []))
    none = F.array().cast("array<struct<start:int,value:string>>")

    def add(acc: Column, m: Column) -> Column:
        start = acc["n"] + F.length(m["gap"])
        hit = F.struct((start + F.length(m["lead"]) if group else start).cast("int").alias("start"), m["value" if group else "all"].alias("value"))
        return F.struct(F.when(m["all"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(hit))).alias("out"), (start + F.coalesce(F.length(m["all"]), F.lit(0))).cast("int").alias("n"))

    found = F.aggregate(parts, F.struct(none.alias("out"), F.lit(0).alias("n")), add, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(none)


def rows_to_markdown(rows: Column | str) -> Column:
    """A Markdown table of an array of arrays of cells: nulls empty, newlines spaces, blank rows dropped, short rows filled up."""
    cells = F.transform(col(rows), lambda r: F.transform(r, lambda x: strip(F.replace(F.coalesce(x, F.lit("")), F.lit("\n"), F.lit(" ")))))
    kept = F.filter(cells, lambda r: F.exists(r, lambda x: x != ""))
    width = F.array_max(F.transform(kept, F.size))
    full = F.transform(kept, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    lines = F.transform(full, line)
    rule = line(F.array_repeat(F.lit("---"), width))
    return F.when(F.size(kept) == 0, F.lit("")).otherwise(F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n"))


def fingerprint(question: Column | str, bases: Column, scope: Column, mode: Column | str, strict: Column) -> Column:
    """Key under which an answer is cached: question (spacing collapsed), sorted bases, scope, mode and how strictly it is redacted."""
    return F.sha1(
        F.concat_ws("|", collapse(question), F.array_join(F.array_sort(F.coalesce(bases, F.array().cast("array<string>"))), "、"), scope, F.coalesce(col(mode), F.lit("")), F.when(strict, F.lit("strict")).otherwise(F.lit("restore")))
    )


def restore(c: Column | str, mapping: Column) -> Column:
    """Placeholders of an array<struct<placeholder, original>> replaced one after the other, longest first."""
    order = F.array_sort(F.transform(mapping, lambda m: F.struct((-F.length(m["placeholder"])).alias("n"), m["placeholder"].alias("placeholder"), m["original"].alias("original"))))
    return F.aggregate(order, col(c), lambda text, m: F.replace(text, m["placeholder"], F.coalesce(m["original"], F.lit(""))))


def entity_label(c: Column | str) -> Column:
    """The placeholder label of an entity type; unknown types in upper case, none as sensitive."""
    name = F.upper(F.coalesce(col(c), F.lit("")))
    out = F.when(name == "", F.lit(P.NO_LABEL))
    for k, v in P.ENTITY_LABELS.items():
        out = out.when(name == k, F.lit(v))
    return out.otherwise(name)


def file_address(path: Column | str, page: Column | str) -> Column:
    """The file: address of a path, percent-encoded if it is absolute, as it stands if not, with the page where there is one; empty for no path."""
    p = F.replace(F.coalesce(col(path), F.lit("")), F.lit("\\"), F.lit("/"))
    encoded = F.regexp_replace(F.url_encode(p), r"\+", "%20")
    for code, plain in (("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        encoded = F.replace(encoded, F.lit(code), F.lit(plain))
    address = F.when(p.startswith("/"), F.concat(F.lit("file://"), encoded)).otherwise(F.concat(F.lit("file:///"), p))
    number = col(page)
    mark = F.when(number.isNotNull() & (number != 0), F.concat(F.lit("#page="), number.cast("string"))).otherwise("")
    return F.when(p == "", "").otherwise(F.concat(address, mark))
