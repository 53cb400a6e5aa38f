"""Shapes of personal details, which the tagger's spans are checked against: they give a number or address its exact ends.

All work on a text of the same length in which full-width forms are plain, so
offsets hold for the text as it stands.
"""

from __future__ import annotations

import re

TYPES = ("person", "phone", "email", "id_number", "address")

#: Full-width letters, digits, signs and spaces, one to one.
PLAIN = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 0x20, 0xA0: 0x20, 0x2011: 0x2D, 0x2010: 0x2D, 0x2013: 0x2D}

# Road endings.
_ROAD_ZH = r"(?:大道|大街|胡同|路|街|巷|弄|道|村)"
_ROAD_EN = r"(?:Street|Road|Lane|Close|Avenue|Ave|Drive|Court|Way|Place|Square|Terrace|Boulevard|Blvd|Row|Crescent|St|Rd|Ln|Dr)"
_ROAD_DE = r"(?:straße|strasse|gasse|weg|allee|platz|ufer|ring|damm|steig|str\.)"

_AT = r"(?:[ ]?@[ ]?|[ ]?[(\[][ ]?(?:at|AT)[ ]?[)\]][ ]?|[ ](?:at|AT)[ ](?=[A-Za-z0-9-]+(?:\.|[ ]dot[ ])))"
_DOT = r"(?:\.|[ ]?[(\[](?:dot|DOT)[)\]][ ]?|[ ](?:dot|DOT)[ ])"

EMAIL = re.compile(rf"(?<![A-Za-z0-9._+-])[A-Za-z0-9](?:[A-Za-z0-9._+-]*[A-Za-z0-9])?{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}(?![A-Za-z0-9-])")

_S = r"[- ]?"
PHONE = re.compile(
    r"(?<![A-Za-z0-9_.-])(?<!\d[ /])(?:"
    rf"(?:\+?86{_S})?1[3-9]\d{_S}\d{{4}}{_S}\d{{4}}"  # mobile
    rf"|(?:\+86{_S})?\(0\d{{2,3}}\){_S}\d{{3,4}}{_S}\d{{4}}|(?:\+86{_S})?0\d{{2,3}}-\d{{7,8}}|0\d{{2,3}}[- ]\d{{3,4}}[- ]\d{{4}}"  # with an area code
    rf"|\+\d{{1,3}}{_S}(?:\(0\))?\(?\d{{2,5}}\)?[-. ]?\d{{2,5}}(?:[-. /]?\d{{2,5}}){{0,3}}"  # with a country code
    r"|(?:\+1[-. ]?)?(?:\(\d{3}\)[ ]?|\d{3}[-.])\d{3}[-. ]\d{4}"
    r"|\(0\d{2,5}\)[ /-]?\d{3,8}(?:[- ]\d{1,5})?|0\d{2,5}[ /]\d{3,8}(?:[- ]\d{1,5})?|0\d{2,4}-\d{3,8}-\d{1,5}"
    r")(?![A-Za-z0-9_])(?![-./]\d)"
)
IDENTITY = re.compile(
    r"(?<![A-Za-z0-9_-])(?<!\d[ ])(?:"
    r"\d{6}[- ]?(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[- ]?\d{3}[\dXx]"
    r"|\d{3}-\d{2}-\d{4}|\d{3}[ ]\d{2}[ ]\d{4}"
    r"|(?=[A-Z0-9]{0,8}\d)(?=[A-Z0-9]{9}(?![A-Za-z0-9]))[A-Z][A-Z0-9]{8}"
    r")(?![A-Za-z0-9_])(?![- ]\d)"
)
_PLACE = r"[一-鿿]{1,5}?(?:省|市|自治区|自治州|区|县|镇|乡)"
ADDRESS_ZH = re.compile(
    rf"(?:{_PLACE}){{0,4}}[一-鿿]{{2,4}}?{_ROAD_ZH}\d{{1,5}}号(?:院)?(?:\d{{1,4}}(?:栋|幢|座|号楼|楼))?(?:\d{{1,3}}单元)?(?:\d{{1,3}}(?:楼|层))?(?:\d{{1,5}}室?)?", re.S
)
ADDRESS_EN = re.compile(rf"(?<![A-Za-z0-9])\d{{1,5}} (?:[A-Z][\w'-]+ ){{1,3}}{_ROAD_EN}\b\.?,? [A-Z][\w'-]+(?: [A-Z][\w'-]+)?(?:,? [A-Z]{{2}})?(?: \d{{5}}(?:-\d{{4}})?)?(?![A-Za-z0-9])")
ADDRESS_DE = re.compile(rf"(?<![A-Za-zÀ-ÿ])[A-ZÄÖÜ][a-zäöüß-]*{_ROAD_DE} \d{{1,4}}[a-z]?, \d{{5}} [A-ZÄÖÜ][a-zäöüß]+(?:[- ][A-ZÄÖÜ][a-zäöüß]+)?")
# Marks of a shape, found first: a shape is tried only in the whole run of fitting characters around one.
_FULL_WIDTH = re.compile("[！-～　\xa0‑‐–]")


def plain(text: str) -> str:
    """The text with full-width forms as plain ones, character for character."""
    return _FULL_WIDTH.sub(lambda m: chr(PLAIN[ord(m[0])]), text)


_LATIN = r"[A-ZÀ-ÖØ-ÞĀ-Ž][\w'’.-]*"
NAME_LATIN = re.compile(rf"{_LATIN}(?: (?:[A-Z]\.|(?:van|von|de|da|di|der|den|del|la|le|bin|al|zu)|{_LATIN}))*")
NAME_HAN = re.compile("[\u3400-\u9fff\U00020000-\U000323af]{2,4}|[\u3400-\u9fff·]{3,15}")
_RUN = {1: re.compile(r"[-+\d ()./]"), 2: re.compile(r"[\w.+@()\[\] -]"), 3: re.compile(r"[A-Za-z\d -]"), 4: re.compile(r"[^\n。！？!?；;]")}
SHAPES = {1: (PHONE,), 2: (EMAIL,), 3: (IDENTITY,), 4: (ADDRESS_ZH, ADDRESS_EN, ADDRESS_DE)}


def run_around(text: str, a: int, b: int, kind: int) -> tuple[int, int]:
    """The whole run of characters around a span that may belong to a detail of its type, however long."""
    fits = _RUN[kind].match
    while a and fits(text, a - 1):
        a -= 1
    while b < len(text) and fits(text, b):
        b += 1
    return a, b


def shaped(text: str, a: int, b: int, kind: int) -> tuple[int, int] | None:
    """The stretch of the type's shape that overlaps most with a span of a plain text."""
    lo, hi = run_around(text, a, b, kind)
    over = []
    for shape in SHAPES[kind]:
        for m in shape.finditer(text, lo, min(len(text), hi + 2)):
            x, y = m.span()
            if x < b and y > a:
                over.append((min(b, y) - max(a, x), y - x, -x, x, y))
    return max(over)[3:] if over else None


def acceptable(text: str, kind: int) -> bool:
    """Whether a stretch without one of the shapes can be a detail of its type at all."""
    digits = sum(c.isdigit() for c in text)
    if kind == 1:
        return 7 <= digits <= 15 and not any(c.isalpha() for c in text)
    if kind == 2:
        return bool(re.search(r"[^\s@]\s?(?:@|[(\[ ]at[)\] ])\s?[\w-]+.*(?:\.|dot).*[A-Za-z]{2}$", text, re.I | re.S))
    if kind == 3:
        return digits >= 4 and 8 <= sum(c.isalnum() for c in text) <= 20 and " " not in text
    return digits >= 1 and len(text) >= 8 and bool(re.search(r"[路街巷弄道村号室楼栋]|, |\d{5}", text))


def kind_of_number(text: str, a: int, b: int, kind: int) -> int:
    """phone or id_number for a span tagged as one of them: the other one if only that one's shape is there."""
    other = 4 - kind
    return other if shaped(text, a, b, kind) is None and shaped(text, a, b, other) is not None else kind
