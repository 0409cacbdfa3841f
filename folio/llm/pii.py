"""Personal data in texts, disguised or plain, at the places of the source text.

Plain identifiers are found by fixed patterns. Then a transducer rewrites the text:
look-alike letters, digits and marks become ASCII, characters of no width vanish,
spelled digits become digits, and disguised ``at`` and ``dot`` become ``@`` and ``.``.
It keeps, for each character written, the source characters it stands for. The same
patterns run over the rewritten text, and what they find is mapped back. A span found
only that way is added; plain spans stay as they are.

A text in which no rewriting rule applies is scanned once, by the plain patterns. All
work is per row: no shuffle, and memory holds one text.

Spans are (kind, start, end) in code points, end exclusive. Defined results: null and
empty texts have no spans; equal rows have equal spans; an empty table gives no rows;
other columns stay as they are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# ---------------------------------------------------------------- plain patterns

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is tried from its first digit only: a later one could match no more.
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> Iterator[Span]:
    """Each ``@`` with the run of characters before it and a domain after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", domain.end() if domain else at + 1)


def ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.groups()]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield m.span()


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        digits = [c for c in m.group() if "0" <= c <= "9"]
        if 13 <= len(digits) <= 19 and luhn("".join(digits)):
            yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            yield m.span()


FINDERS: dict[str, Callable[[str], Iterator[Span]]] = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def base_spans(text: str) -> dict[str, list[Span]]:
    return {kind: list(find(text)) for kind, find in FINDERS.items()}


# ---------------------------------------------------------------- the transducer

# Letters of other scripts that look like these, in pairs.
_ALIKE = dict(
    zip(
        "аАВЕеЗіІјЈКкМНоОрРсСТуУхХѕЅԁԛԝһҺαΑΒΕΖΗΙιΚκΜΝνοΟρΡΤτΥυΧχ",
        "aABEe3iIjJKkMHoOpPcCTyYxXsSdqwhHaABEZHIiKkMNvoOpPTtYuXx",
        strict=True,
    )
)
_MARKS = {
    "․": ".", "。": ".", "｡": ".", "·": ".", "•": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-",
    "\xa0": " ", " ": " ", " ": " ", " ": " ", " ": " ",
}
_NO_WIDTH = "­​‌‍⁠﻿"
_DIGITS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_AT, _DOT = "at|arroba|arobase|ät", "dot|punkt|point|punto"
_D = "|".join(sorted(_DIGITS, key=lambda w: (-len(w), w)))

# What has no ASCII form by itself, a run of spelled digits, or a disguised mark.
_RULES = re.compile(
    rf"""
    (?P<odd>(?-i:[^\x00-\x7f]))
  | (?P<at>[ ]*[\[({{<][ ]*(?:{_AT}|@)[ ]*[\])}}>][ ]*)
  | (?P<dot>[ ]*[\[({{<][ ]*(?:{_DOT}|\.)[ ]*[\])}}>][ ]*)
  | (?P<bare_at>(?<=[A-Za-z0-9])(?:[ ]+(?:{_AT}|@)[ ]+|[ ]+@|@[ ]+)(?=[A-Za-z0-9-]+(?:[ ]*\.[ ]*[A-Za-z0-9]|[ ]*[\[({{<]?[ ]*\b(?:{_DOT})\b)))
  | (?P<bare_dot>(?<=[A-Za-z0-9])[ ]+(?:{_DOT}|\.)[ ]+(?=[A-Za-z0-9]))
  | (?P<plus>\bplus[ ]+(?=[0-9]|(?:{_D})\b))
  | (?P<digits>\b(?:{_D})(?:[ -]+(?:{_D}))*\b)
    """,
    re.VERBOSE | re.IGNORECASE,
)
_DIGIT_WORD = re.compile(_D, re.IGNORECASE)
def plain_character(c: str) -> str:
    """The ASCII character that ``c`` looks like; '' if it has no width; else ``c``."""
    if c in _NO_WIDTH:
        return ""
    found = _ALIKE.get(c) or _MARKS.get(c)
    if found:
        return found
    digit = unicodedata.decimal(c, None)
    if digit is not None:
        return str(digit)
    folded = unicodedata.normalize("NFKC", c)
    return folded if len(folded) == 1 and folded.isascii() else c


_WORD = re.compile(r"\w+")
_IN_BRACKETS = re.compile(rf"[\[({{<][ ]*(?:{_AT}|@|\.)[ ]*[\])}}>]")
_AT_DOMAIN = re.compile(rf" (?:{_AT}) +[a-z0-9-]+ *\. *[a-z0-9]")
_HINT_WORDS = frozenset([*_DIGITS, *_DOT.split("|"), "plus"])
_LETTERS = str.maketrans("ıİſ", "iis")  # what IGNORECASE takes for i and s
# Characters that have another form; beyond the Latin blocks any character may.
_LATIN = [chr(k) for k in (*range(0x80, 0x250), *range(0x1E00, 0x1F00))]
_ODD = re.compile(rf"[^\x00-\u024f\u1e00-\u1eff]|[{''.join(c for c in _LATIN if plain_character(c) != c)}]")


def may_be_disguised(text: str) -> bool:
    """False only where no rule could help to find anything.

    A rule's word stands between word boundaries, so it is a whole run of word characters.
    """
    if not text.isascii():
        if _ODD.search(text):
            return True
        text = text.translate(_LETTERS)
    low = text.lower()
    return (
        not _HINT_WORDS.isdisjoint(_WORD.findall(low))
        or any(c in text for c in "[({<") and _IN_BRACKETS.search(low) is not None
        or " @" in text or "@ " in text or " . " in text
        or (" at " in low or " ar" in low or " ät " in low) and _AT_DOMAIN.search(low) is not None
    )


class Rewritten:
    """A text after the transducer; ``source`` has the source span of each character."""

    def __init__(self, text: str):
        out: list[str] = []
        self.source: list[Span] = []
        self.changed: list[bool] = []
        self.weak: set[int] = set()  # ``@`` that stand for a mere word
        at = 0

        def copy(to: int) -> None:
            out.append(text[at:to])
            self.source.extend((k, k + 1) for k in range(at, to))
            self.changed.extend([False] * (to - at))

        def put(c: str, start: int, end: int) -> None:
            out.append(c)
            self.source.append((start, end))
            self.changed.append(True)

        for m in _RULES.finditer(text):
            kind = m.lastgroup
            if kind == "odd":
                c = plain_character(m.group())
                if c == m.group():
                    continue
                copy(m.start())
                if c:
                    put(c, *m.span())
            else:
                copy(m.start())
                if kind == "digits":
                    for d in _DIGIT_WORD.finditer(text, *m.span()):
                        put(_DIGITS[d.group().translate(_LETTERS).lower()], *d.span())
                else:
                    if kind == "bare_at" and "@" not in m.group():
                        self.weak.add(len(self.source))
                    put({"at": "@", "bare_at": "@", "plus": "+"}.get(kind, "."), *m.span())
            at = m.end()
        copy(len(text))
        self.text = "".join(out)


def added_spans(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans that only the rewritten text shows and that lie apart from the plain ones, or around them."""
    if not may_be_disguised(text):
        return {}
    new = Rewritten(text)
    if new.text == text:
        return {}
    found: dict[str, list[Span]] = {}
    for kind, find in FINDERS.items():
        for a, b in find(new.text):
            start, end = new.source[a][0], new.source[b - 1][1]
            if text[start:end] == new.text[a:b] or kind == "email" and not _likely(new, a, b):
                continue
            if all(end <= s or e <= start or start <= s and e <= end and (s, e) != (start, end) for s, e in base[kind]):
                found.setdefault(kind, []).append((start, end))
    return found


def _likely(new: Rewritten, a: int, b: int) -> bool:
    """A mere word ``at`` before a plain domain is common speech, unless the name is one of no word."""
    local, _, domain = new.text[a:b].partition("@")
    at = a + len(local)
    if at not in new.weak or any(new.changed[at + 1 : b]):
        return True
    return bool(re.search(r"[0-9._%+-]", local)) and len(domain.rpartition(".")[2]) >= 2


# ---------------------------------------------------------------- the column


def spans_of(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(plain spans, all spans), by kind and then by start."""
    base = base_spans(text)
    more = added_spans(text, base)
    plain = [(k, *s) for k in KINDS for s in base[k]]
    both = [(k, *s) for k in KINDS for s in sorted({*base[k], *more.get(k, ())})]
    return plain, both


_SPANS = "array<struct<kind: string, start: int, end: int>>"


def personal_data(text: Column) -> Column:
    """A struct of two arrays of spans: ``base`` and ``spans``."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [spans_of(v.as_py() or "") for v in batch]
            rows = [[[dict(zip(("kind", "start", "end"), s)) for s in r[k]] for r in found] for k in (0, 1)]
            yield pa.StructArray.from_arrays([pa.array(r, kind) for r in rows], names=["base", "spans"])

    return F.arrow_udf(find, f"struct<base: {_SPANS}, spans: {_SPANS}>").asNondeterministic()(text.cast("string"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
