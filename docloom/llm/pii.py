"""Personal details in free text (problem 3): found, listed and replaced by typed placeholders.

A character-level bidirectional LSTM with CRF transitions, trained in numpy from
labelled spans (docloom.llm.pii_train), reads every text whole, long ones in
overlapping windows. The spans of all windows of a text are reconciled at once:
what a window's edge cuts is united with what the next window sees, and of
overlapping spans those stand whose CRF scores sum highest. A span is then held
against the shapes of its type, which give a number or address its exact first
and last character; a detail without one of the shapes stands as tagged.

Characters the training did not know are read by their class: digit, letter,
ideograph, and for ideographs whether names are written with them. No list
decides what is a name.

Null and empty texts hold nothing and stay as they are. Placeholders that stand
in a text already are no details. A row that comes twice gives its details once.
"""

from __future__ import annotations

import bisect
import io
import pkgutil
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import tagger
from docloom.llm.pii_rules import NAME_HAN, NAME_LATIN, PLAIN, TYPES, acceptable, kind_of_number, plain, shaped
from docloom.llm.spans import blocks
from docloom.llm.winnow import encode
from docloom.runtime import once, spread

# The names of the placeholders.
LABELS = dict(zip(TYPES, ("姓名", "电话", "邮箱", "身份证", "地址")))
TAGS = 1 + 2 * len(TYPES)
WINDOW, OVERLAP = 800, 80
#: Characters of the texts that are read together.
TOGETHER = 1 << 22
PLACEHOLDER = re.compile(r"\[[^\W\d_]{1,8}\d{1,6}\]")
#: Classes of characters; the last three say of an ideograph that it is a family name, is written in given names, or both.
CLASSES = ("digit", "upper", "lower", "space", "sign", "pause", "stop", "other letter", "other", "ideograph", "family", "given", "both")


@cache
def lists() -> dict[str, list[str]]:
    """The lists that come with the package: family, compound, given, first and last names, and common words."""
    rows = pkgutil.get_data("docloom.llm", "data/names.txt").decode().splitlines()
    return {k: v.split() for k, v in (r.split(":", 1) for r in rows if r and r[0] != "#")}


@cache
def kinds() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, CLASSES.index("other"), np.int8)
    for c in range(0x3400):
        x = chr(c)
        if x.isdigit():
            k = "digit"
        elif x.isupper():
            k = "upper"
        elif x.islower():
            k = "lower"
        elif x.isspace():
            k = "space"
        elif x.isalpha():
            k = "other letter"
        else:
            k = "sign" if x in "@.-_+()[]/" else "pause" if x in ":|,;、：，；" else "stop" if x in "!?。\n" else "other"
        out[c] = CLASSES.index(k)
    out[0xAC00:0xD7A4] = CLASSES.index("other letter")
    for a, b in ((0x3400, 0xA000), (0x20000, 0x323B0)):
        out[a:b] = CLASSES.index("ideograph")
    family, given = {*lists()["family"], *"".join(lists()["compound"])}, set(lists()["given"])
    for c in family | given:
        out[ord(c)] = CLASSES.index("both" if c in family and c in given else "family" if c in family else "given")
    for wide, narrow in PLAIN.items():
        out[wide] = out[narrow]
    return out


@dataclass(frozen=True)
class Model:
    """Weights, and the characters of the embedding: index 0.. are unknown characters by class, then these."""

    params: tagger.Params
    chars: str

    @cached_property
    def index(self) -> np.ndarray:
        """The embedding's index of every code point."""
        out = kinds().astype(np.int16)
        for i, c in enumerate(self.chars):
            out[ord(c)] = len(CLASSES) + i
        for wide, narrow in PLAIN.items():
            out[wide] = out[narrow]
        return out

    @cached_property
    def static(self) -> np.ndarray:
        """Features of every index: the one of its class, and of ideographs family and given."""
        own = np.concatenate([np.arange(len(CLASSES)), kinds()[[ord(c) for c in self.chars]].astype(np.int64)])
        out = np.zeros((len(own), len(CLASSES) + 2), np.float32)
        out[np.arange(len(own)), own] = 1
        for k, name in enumerate(("family", "given")):
            out[:, len(CLASSES) + k] = np.isin(own, [CLASSES.index(name), CLASSES.index("both")])
        return out

    @cached_property
    def reader(self) -> tagger.Reader:
        return tagger.Reader(self.params, self.static)

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        points, offsets = encode(texts)
        x = self.index[points]
        return [x[i:j] for i, j in zip(offsets[:-1], offsets[1:])]

    def save(self, path: str) -> None:
        small = {n: v.astype(np.float16) for n, v in self.params.items()}
        np.savez_compressed(path, _chars=np.frombuffer(self.chars.encode("utf-32-le"), np.uint32), **small)

    @staticmethod
    def load(raw: bytes) -> Model:
        z = np.load(io.BytesIO(raw))
        return Model({n: z[n].astype(np.float32) for n in z.files if n[0] != "_"}, z["_chars"].tobytes().decode("utf-32-le"))


@cache
def model() -> Model:
    """The trained model that comes with the package."""
    return Model.load(pkgutil.get_data("docloom.llm", "weights/pii.npz"))


def windows(length: int) -> list[tuple[int, int]]:
    """The windows of a text, of even length, which overlap by OVERLAP or a little more."""
    if length <= WINDOW:
        return [(0, length)]
    n = -(-(length - OVERLAP) // (WINDOW - OVERLAP))
    size = -(-(length + (n - 1) * OVERLAP) // n)
    step = (length - size) / (n - 1)
    return [(a, a + size) for a in (round(i * step) for i in range(n))]


Span = tuple[int, int, int, float]


def united(spans: list[tuple[int, int, int, float, bool]]) -> list[Span]:
    """Spans (start, stop, type, score, cut by a window's edge) of all windows: cut ones joined with those of their type that they overlap."""
    out: list[list] = []
    for s in sorted(spans):
        for o in out[-6:]:  # the spans of one window are disjoint, and at most three windows meet
            if o[2] == s[2] and s[0] < o[1] and o[0] < s[1] and (s[4] or o[4]):
                o[:] = min(o[0], s[0]), max(o[1], s[1]), o[2], max(o[3], s[3]), o[4] and s[4]
                break
        else:
            out.append(list(s))
    return [tuple(o[:4]) for o in out]


def reconciled(spans: list[Span]) -> list[Span]:
    """Of overlapping spans those whose scores sum highest: the best set of disjoint spans."""
    spans = sorted({s[:3]: s for s in sorted(spans, key=lambda x: x[3])}.values(), key=lambda s: (s[1], s[0], s[2]))
    if len(spans) < 2:
        return spans
    ends, total, came = [s[1] for s in spans], [0.0], []
    for i, s in enumerate(spans):
        k = bisect.bisect_right(ends, s[0], 0, i)
        take = total[k] + max(s[3], 1e-6)
        came.append(k if take > total[i] else -1)
        total.append(max(take, total[i]))
    out, i = [], len(spans)
    while i:
        i -= 1
        if came[i] >= 0:
            out.append(spans[i])
            i = came[i]
    return out[::-1]


def checked(text: str, flat: str, a: int, b: int, kind: int) -> tuple[int, int] | None:
    """The ends of a span as its type's shape has them, as they are if it has none, or None if it can be no such detail."""
    if kind == 0:
        while a < b and not flat[a].isalpha():
            a += 1
        while a < b and not (flat[b - 1].isalpha() or flat[b - 1] == "."):
            b -= 1
        name = flat[a:b]
        if NAME_HAN.fullmatch(name):
            return a, b
        whole = NAME_LATIN.fullmatch(name) and not flat[a - 1 : a].isalpha() and not flat[b : b + 1].isalpha()
        return (a, b) if whole and " " in name else None
    hit = shaped(flat, a, b, kind)
    if hit is None:
        while a < b and not (flat[a].isalnum() or flat[a] in "+("):
            a += 1
        while a < b and not (flat[b - 1].isalnum() or flat[b - 1] == ")"):
            b -= 1
        cut = re.match(r"[A-Za-z0-9_]", flat[b : b + 1]) or re.match(r"[A-Za-z0-9_-]", flat[a - 1 : a])
        return (a, b) if acceptable(flat[a:b], kind) and not cut else None
    x, y = hit
    if kind == 4 and x < a < y and "\u3400" <= flat[a] <= "\u9fff":
        x = a  # where a Chinese address begins in running text only the tagger knows
    return x, y


def detect(m: Model, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """(start, stop, type index) of the personal details of every text; equal texts are read once."""
    first: dict[str, int] = {}
    own = [first.setdefault(t, len(first)) for t in texts]
    if len(first) < len(texts):
        got = detect(m, list(first))
        return [got[k] for k in own]
    at, seqs = [], []
    for k, x in enumerate(m.encoded(texts)):
        for a, b in windows(len(x)) if len(x) else ():
            at.append((k, a, b))
            seqs.append(x[a:b])
    seen: dict[int, list] = {}
    for (k, a, b), got in zip(at, m.reader.spans(seqs)):
        for x, y, t, score in got:
            edge = (x == 0 and a > 0) or (y == b - a and b < len(texts[k]))
            seen.setdefault(k, []).append((x + a, y + a, t, score, edge))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, spans in seen.items():
        flat, good = plain(texts[k]), []
        held = [h.span() for h in PLACEHOLDER.finditer(texts[k])]
        for a, b, t, score in united(spans):
            t = kind_of_number(flat, a, b, t) if t in (1, 3) else t
            ends = checked(texts[k], flat, a, b, t)
            if ends and not any(x < ends[1] and ends[0] < y for x, y in held):
                good.append((*ends, t, score))
        out[k] = [s[:3] for s in reconciled(good)]
    return out


def found(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pii_type, pii_value, start) of every personal detail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model()
        for whole in batches:
            every = whole.column(1).to_pylist()
            for i, j in blocks([t or "" for t in every], TOGETHER):
                b, texts = whole.slice(i, j - i), every[i:j]
                rows = [(i, TYPES[t], texts[i][x:y], x) for i, s in enumerate(detect(m, texts)) for x, y, t in s]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.int32())],
                    names=["key", "pii_type", "pii_value", "start"],
                )

    source = spread(df.where(F.length(text) > 0).select(F.col(key).cast("string").alias("key"), text))
    return source.mapInArrow(run, "key string, pii_type string, pii_value string, start int").distinct()


def redacted(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, redacted, details): every text with its details replaced, numbered per text and type; equal values have one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model()
        for whole in batches:
            every = whole.column(1).to_pylist()
            for i, j in blocks([t or "" for t in every], TOGETHER):
                b, texts = whole.slice(i, j - i), every[i:j]
                out, count = [], []
                for t, s in zip(texts, detect(m, [t or "" for t in texts])):
                    parts, last, seen = [], 0, {}
                    for x, y, kind in s:
                        n = seen.setdefault((kind, t[x:y]), 1 + sum(k == kind for k, _ in seen))
                        parts += [t[last:x], f"[{LABELS[TYPES[kind]]}{n}]"]
                        last = y
                    out.append(None if t is None else "".join([*parts, t[last:]]))
                    count.append(len(s))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(count, pa.int32())], names=["key", "redacted", "details"])

    source = once(df.select(F.col(key).cast("string").alias("key"), text), "key")
    return source.mapInArrow(run, "key string, redacted string, details int")
