"""Training of the personal-detail tagger: python -m docloom.llm.pii_train DATA_DIR [OUT].

Two sources of labelled spans:

- the archive: in privacy bases a placeholder in a chunk marks where a detail stood and of which type it was; it is
  filled with an original of that type. Stored originals, questions and other chunks are labelled by the shapes, where
  names need a given or first name that originals show, or a cue. Every text is taken twice, with a tenth and with half of its names exchanged for names from the package's lists, so
  that the tagger learns the place of a name and not the archive's names;
- composed sentences (docloom.llm.pii_texts) with names, numbers and addresses drawn at random.

In training, characters of names are often read by their class alone. The archive's sample is bounded by ``LIMIT`` texts of each source; a
tenth is held out, and of the composed sentences the held-out names and parts.
"""

from __future__ import annotations

import random
import re
import sys

import numpy as np

from docloom.llm import tagger
from docloom.llm.pii import CLASSES, LABELS, PLACEHOLDER, TAGS, Model, detect, kinds, lists, windows
from docloom.llm.pii_rules import SHAPES, TYPES, plain
from docloom.llm.pii_texts import Composer, Span

LIMIT = 3000
COMPOSED = 60_000
_STARTS = re.compile(r"(?<=往)|(?<=于)|(?<=住)|(?<=到)|(?<=[：:])")
_LATIN_NAME = re.compile(r"[A-Z][\w'-]+( [A-Z]\.)? [A-Z][\w'-]+")
#: Capitalised words that begin no name, for labels.
_NO_NAME = "The This That These Those An And For With From To In On At By Of Or Please Call Write Build Contact Email Phone Address Deliver Serial Ticket Invoice Identity Herr Frau Mr Ms Mrs Dr Die Der Das Den Dem Ein Eine Bitte Telefon Anschrift Lieferung Vorgang Charge What How Who Who's Which Wie Wer Welche Ich Für Mein My Your Our".split()
_WORD = r"[A-ZÄÖÜ][a-zäöüßé]+(?:['-][A-ZÄÖÜ]?[a-zäöüß]+)?"
_LATIN = re.compile(rf"(?<![A-Za-zÀ-ÿ@.-])(?!(?:{'|'.join(_NO_NAME)})\b)({_WORD})((?: [A-Z]\.)? (?!(?:{'|'.join(_NO_NAME)})\b){_WORD})(?![A-Za-zÀ-ÿ@-])")
_BEFORE = re.compile(r"(?:\b(?:Mr|Ms|Mrs|Dr|Herr|Herrn|Frau)\.? |(?:partner(?:in)?|person|contact|name|人|姓名)[ ]?[:：（(| ]* ?|\bI am |\bIch bin |\bbehalf of |\bFür |\bask |\bfor |我是|我叫|替|请转交|本项由|会上|联系)$", re.I)
_AFTER = re.compile(r"^(?: ?(?:hat|for|last|approved|unterschrieb)\b|[:：]|[（(]|先生|女士|的申请|提出|负责|已|问一下|，手机| / )", re.I)


def lexicon(rows: list[tuple[str, str]]) -> tuple[frozenset[str], frozenset[str]]:
    """Given-name characters and first names of the stored originals whose placeholder says they are names, if seen three times (first names: twice)."""
    given: dict[str, int] = {}
    first: dict[str, int] = {}
    family = set(lists()["family"])
    for original, placeholder in rows:
        if placeholder.startswith("[姓名"):
            if re.fullmatch("[一-鿿]{2,3}", original) and original[0] in family:
                for c in original[1:]:
                    given[c] = given.get(c, 0) + 1
            elif _LATIN_NAME.fullmatch(original):
                w = original.split()[0]
                first[w] = first.get(w, 0) + 1
    return frozenset(c for c, n in given.items() if n >= 3 and c not in "方华高马金"), frozenset(w for w, n in first.items() if n >= 2)


def _disjoint(spans: list[Span]) -> list[Span]:
    out: list[Span] = []
    for s in sorted(set(spans), key=lambda x: (x[0] - x[1], x)):
        if all(s[1] <= o[0] or s[0] >= o[1] for o in out):
            out.append(s)
    return sorted(out)


class Labeller:
    """Labels by shape, for texts without any: numbers and addresses, and names that speak for themselves."""

    def __init__(self, rows: list[tuple[str, str]]) -> None:
        self.given, self.first = lexicon(rows)
        self.han = re.compile(f"[{''.join(lists()['family'])}][{''.join(sorted(self.given)) or '一'}]{{1,2}}")

    def __call__(self, text: str) -> list[Span]:
        flat, out = plain(text), []
        for kind, several in SHAPES.items():
            for shape in several:
                for m in shape.finditer(flat):
                    a, b = m.span()
                    if kind == 4 and "一" <= flat[a] <= "鿿":
                        cuts = [x.start() for x in _STARTS.finditer(flat, a, b) if x.start() < a + 8]
                        a = cuts[-1] if cuts and cuts[-1] > a else a
                    out.append((a, b, kind))
        for m in self.han.finditer(flat):
            i, j = m.span()
            if j == i + 3 or _BEFORE.search(text[max(0, i - 14) : i]) or _AFTER.match(text[j : j + 8]):
                out.append((i, j, 0))
        for m in _LATIN.finditer(flat):
            if m[1] in self.first:
                out.append((m.start(), m.end(), 0))
        return _disjoint(out)


def filled(text: str, originals: dict[str, list[str]], rng: random.Random) -> tuple[str, list[Span]]:
    """A text with its placeholders replaced by originals of their types, and where those stand."""
    parts, at, last, out = [], 0, 0, []
    types = {v: i for i, v in enumerate(LABELS.values())}
    for m in PLACEHOLDER.finditer(text):
        name = re.sub(r"[\[\]\d]", "", m[0])
        if name not in types or not originals.get(name) or rng.random() < 0.2:
            continue
        value = rng.choice(originals[name])
        parts += [text[last : m.start()], value]
        at += m.start() - last
        out.append((at, at + len(value), types[name]))
        at += len(value)
        last = m.end()
    return "".join([*parts, text[last:]]), out


def exchanged(text: str, spans: list[Span], names: Composer, share: float) -> tuple[str, list[Span]]:
    """The text with a share of its names exchanged for others of their script."""
    out, parts, last, at = [], [], 0, 0
    for a, b, t in sorted(spans):
        value = text[a:b]
        if t == 0 and names.rng.random() < share:
            value = names.name_zh() if "㐀" <= value[0] <= "鿿" else names.name_latin()
        parts += [text[last:a], value]
        at += a - last
        out.append((at, at + len(value), t))
        at += len(value)
        last = b
    return "".join([*parts, text[last:]]), out


def listed(values: list[tuple[str, int]], rng: random.Random) -> tuple[str, list[Span]]:
    """Originals in a row between common separators, with their labels."""
    text, out, mark = rng.choice(["", "", "名单：", "Contacts: "]), [], rng.choice(["，", "、", "；", " / ", ", ", "\n", " "])
    for v, kind in values:
        out.append((len(text), len(text) + len(v), kind))
        text += v + mark
    return text.rstrip() + rng.choice(["", "。", "已登记。"]), out


def cropped(text: str, spans: list[Span], rng: random.Random, size: int = 160) -> list[tuple[str, list[Span]]]:
    """Stretches of a long text: one around each group of labels and one at random, never through a label."""
    if len(text) <= 2 * size:
        return [(text, spans)]
    out, done = [], -1
    for a in [s[0] for s in spans] + [rng.randrange(len(text))]:
        if a < done:
            continue
        x, y = max(0, a - rng.randrange(10, size)), min(len(text), a + rng.randrange(60, size))
        for p, q, _ in spans:
            x, y = (p if p < x < q else x), (q if p < y < q else y)
        out.append((text[x:y], [(p - x, q - x, t) for p, q, t in spans if p >= x and q <= y]))
        done = y
    return out


def examples(chunks: list[str], rows: list[tuple[str, str]], questions: list[str], label: Labeller, limit: int = LIMIT, seed: int = 1) -> list[tuple[str, list[Span]]]:
    """Labelled texts of the archive."""
    rng, names = random.Random(seed), Composer(seed)
    clean: dict[str, list[str]] = {}
    for original, placeholder in rows:
        name = re.sub(r"[\[\]\d]", "", placeholder)
        kind = next((i for i, v in enumerate(LABELS.values()) if v == name), None)
        shape = label(original)
        # a stored name may hold no listed given name at all
        bare = kind == 0 and (re.fullmatch("[一-鿿]{2,3}", original) and original[0] in lists()["family"] or _LATIN_NAME.fullmatch(original))
        if kind is not None and (shape == [(0, len(original), kind)] or bare):
            clean.setdefault(name, []).append(original)
    whole = {v: i for i, name in enumerate(LABELS.values()) for v in clean.get(name, [])}
    marked = [c for c in chunks if PLACEHOLDER.search(c)]
    rest = [c for c in chunks if not PLACEHOLDER.search(c)]
    data = []
    for c in rng.sample(marked, min(limit, len(marked))):
        text, labels = filled(c, clean, rng)
        taken = [s for s in label(text) if all(s[1] <= a or s[0] >= b for a, b, _ in labels)]
        data.append((text, sorted(labels + taken)))
    values = sorted(whole.items())
    for _ in range(min(limit // 2, len(values))):
        data.append(listed(rng.sample(values, min(len(values), rng.randrange(2, 6))), rng))
    for source in (rest, [o for o, _ in rows], questions):
        for t in rng.sample(source, min(limit, len(source))):
            data.append((t, [(0, len(t), whole[t])] if t in whole else label(t)))
    return [part for share in (0.1, 0.5) for text, spans in data for part in cropped(*exchanged(text, spans, names, share), rng)]


def tags(length: int, spans: list[Span]) -> np.ndarray:
    y = np.zeros(length, np.int64)
    for a, b, t in spans:
        y[a], y[a + 1 : b] = 1 + 2 * t, 2 + 2 * t
    return y


def encoded(m: Model, data: list[tuple[str, list[Span]]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    chars, out = [], []
    for (text, spans), x in zip(data, m.encoded([t for t, _ in data])):
        y = tags(len(text), spans)
        for a, b in windows(len(text)):
            if b > a:
                chars.append(x[a:b].astype(np.int64))
                out.append(y[a:b])
    return chars, out


def score(m: Model, data: list[tuple[str, list[Span]]]) -> dict[str, tuple[float, float, int]]:
    """(precision, recall, spans) by exact spans, of each type and of all."""
    hit, made, true = (np.zeros(len(TYPES)) for _ in range(3))
    for (_, labels), got in zip(data, detect(m, [t for t, _ in data])):
        for found, count in ((set(labels) & set(got), hit), (set(got), made), (set(labels), true)):
            for s in found:
                count[s[2]] += 1
    rows = {t: (hit[i], made[i], true[i]) for i, t in enumerate(TYPES)} | {"all": (hit.sum(), made.sum(), true.sum())}
    return {t: (round(float(h / max(1, n)), 4), round(float(h / max(1, w)), 4), int(w)) for t, (h, n, w) in rows.items()}


def fit(
    chunks: list[str], rows: list[tuple[str, str]], questions: list[str], limit: int = LIMIT, composed: int = COMPOSED, epochs: int = 8, log=None,  # noqa: ANN001
) -> tuple[Model, dict[str, dict]]:
    """A trained model, and its scores on the held-out tenth of the archive's labels and on composed sentences of held-out names and parts."""
    rng = random.Random(9)
    parts = [[x for x in sorted(set(source)) if rng.random() < 0.9] for source in (chunks, rows, questions)]
    label = Labeller(rows)
    data = examples(*parts, label, limit)
    held = examples(*(sorted(set(x) - set(p)) for x, p in zip((chunks, rows, questions), parts)), label, max(10, limit // 9), seed=4)
    rng.shuffle(data)
    made = Composer(2)
    data = data + [made.sentence() for _ in range(composed)]
    count: dict[str, int] = {}
    for text, _ in data:
        for c in plain(text):
            count[c] = count.get(c, 0) + 1
    chars = "".join(sorted((c for c, n in count.items() if n >= 8), key=lambda c: (-count[c], c))[:2000])
    blank = Model({}, chars)
    m = Model(tagger.init(len(blank.static), blank.static.shape[1], TAGS), chars)
    own = np.concatenate([np.arange(len(CLASSES)), kinds()[[ord(c) for c in chars]].astype(np.int64)])
    letters = np.isin(own, [CLASSES.index(c) for c in ("ideograph", "family", "given", "both", "upper", "lower")])

    def vary(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        han = own[x] >= CLASSES.index("ideograph")
        drop = rng.random(x.shape) < np.where((y == 1) | (y == 2), np.where(han, 0.4, 0.08), 0.03)
        return np.where(drop & letters[x], own[x], x)

    tagger.train(m.params, m.static, *encoded(m, data), epochs=epochs, size=64, vary=vary, log=log)
    small = {n: v.astype(np.float16).astype(np.float32) for n, v in m.params.items()}  # as it is stored
    m = Model(small, chars)
    unseen = Composer(77, held=True)
    return m, {"archive": score(m, held), "unseen": score(m, [unseen.sentence() for _ in range(3000)])}


def main(data: str, out: str) -> None:
    import pyarrow.parquet as pq

    def read(t: str, *columns: str) -> list[tuple]:
        rows = pq.read_table(f"{data}/{t}.parquet", columns=list(columns)).to_pylist()
        return sorted({tuple(r[c] for c in columns) for r in rows if all(r[c] is not None for c in columns)})

    m, scores = fit([c for (c,) in read("chunks_index", "content")], read("redaction_map", "original", "placeholder"), [q for (q,) in read("query_log", "question")], log=lambda e, x: print(e, round(x, 3), flush=True))
    for name, s in scores.items():
        print(name, s)
    m.save(out)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2] if len(sys.argv) > 2 else "docloom/llm/weights/pii.npz")
