"""Personal data in texts, also where it is disguised.

Plain identifiers are found in the source text. A chain of transducers then
rewrites homoglyphs, spelled digits and at/dot disguises, keeping for each
rewritten stretch which source characters it came from; identifiers found in the
rewritten text are mapped back and added where no plain one of their kind contains them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from riskspark.llm.spans import Span, inside, texts_of, written

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# The possessive forms match what the plain ones do, in linear time.
_LOCAL = r"[A-Za-z0-9._%+-]"
_ADDRESS = _LOCAL + r"++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_EMAIL_HERE = re.compile(_ADDRESS)
_EMAIL_NEXT = re.compile(rf"(?<!{_LOCAL})" + _ADDRESS)
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    """Check digit of card numbers."""
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = int(d) * (2 if place % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while True:
        # a match may begin where the last one ended, inside a run of its characters
        m = (at and _EMAIL_HERE.match(text, at)) or _EMAIL_NEXT.search(text, at)
        if not m:
            return
        yield m.span()
        at = m.end()


def plain_spans(text: str) -> list[Span]:
    """Leftmost, non-overlapping identifiers of each kind."""
    found: list[Span] = []
    if "@" in text:
        found += [(s, EMAIL, e) for s, e in _emails(text)]
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
            found.append((m.start(), IP, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), CARD, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                found.append((m.start(), PHONE, m.end()))
    return found


# Look-alike letters (Cyrillic, Greek) and the Latin letters they stand for.
_LOOKALIKE = dict(zip("аеорсухіјѕԁһАВЕКМНОРСТХУІЈЅαονρΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
                      "aeopcyxijsdhABEKMHOPCTXYIJSaovpABEZHIKMNOPTYX"))
#: Full-width forms of the printable ASCII characters, and other dots and at signs.
_GLYPHS = {0xFF01 + k: 0x21 + k for k in range(94)}
_GLYPHS |= {ord(k): ord(v) for k, v in _LOOKALIKE.items()}
_GLYPHS |= {0xFE6B: ord("@"), 0x3002: ord("."), 0xFF61: ord("."), 0x2024: ord("."), 0x2010: ord("-"), 0x2011: ord("-")}
_GLYPHS |= {zero + d: ord("0") + d for zero in (0x0660, 0x06F0, 0x0966, 0x1D7CE) for d in range(10)}
_HIDDEN = "​‌‍⁠﻿­"

_DIGITS = {w: str(d) for d, w in enumerate("zero one two three four five six seven eight nine".split())}
_SPELLED = "|".join(_DIGITS)
_OPEN, _CLOSE = r"[\[({<]\s*", r"\s*[\])}>]"
_AT, _DOT = "(?:at|arroba)", "(?:dot|punto|punkt)"
_PART = r"[A-Za-z0-9-]+"
_SAID_DOT = rf"(?:\s+{_DOT}\s+|\s*{_OPEN}{_DOT}{_CLOSE}\s*)"
# Last labels of addresses that are spoken out; without one, "at .. dot .." is prose.
_LAST = "(?:com|org|net|edu|gov|mil|int|info|biz|io|ai|app|dev|me|tv|co|eu|uk|us|de|fr|es|it|nl|ch|at|be|pl|ru|cn|jp|in|br)"
_DISGUISE = re.compile(
    rf"(?P<hidden>[{_HIDDEN}]+)"
    rf"|(?P<at>\s*{_OPEN}(?:{_AT}|@){_CLOSE}\s*"
    rf"|(?<=[A-Za-z0-9])\s+{_AT}\s+(?={_PART}(?:{_SAID_DOT}{_PART}){{0,4}}?{_SAID_DOT}{_LAST}\b))"
    rf"|(?P<dot>\s*{_OPEN}(?:{_DOT}|\.){_CLOSE}\s*|(?<=[A-Za-z0-9])\s+{_DOT}\s+(?=[A-Za-z0-9]))"
    rf"|(?P<plus>\bplus\s+(?=(?:{_SPELLED})\b))"
    rf"|(?P<digits>\b(?:{_SPELLED})(?:[\s,-]{{1,3}}(?:{_SPELLED}))+\b)", re.I | re.A)
_SPELLED_DIGIT = re.compile(_SPELLED, re.I | re.A)
#: Something that a transducer may rewrite.
_TRIGGER = re.compile(
    rf"[{_HIDDEN}]|{_OPEN}(?:{_AT}|{_DOT}|[@.]){_CLOSE}|\s{_DOT}\s|\b(?:{_SPELLED})[\s,-]{{1,3}}(?:{_SPELLED})\b",
    re.I | re.A)
_GLYPH = re.compile("[" + "".join(map(chr, _GLYPHS)) + "]")
#: Letters without which none of the triggers can match; a cheap first look.
_MAYBE = re.compile(rf"[{_HIDDEN}\[({{<]|[Dd][Oo][Tt]\s|[Pp][Uu][Nn][Kk]?[Tt][Oo]?\s"
                    r"|(?:[Zz][Ee][Rr][Oo]|[Oo][Nn][Ee]|[Tt][Ww][Oo]|[Ff][Oo][Uu][Rr]|[Ff][Ii][Vv][Ee]"
                    r"|[Ss][Ii][Xx]|[Ss][Ee][Vv][Ee][Nn]|[Ee][Ii][Gg][Hh][Tt]|[Nn][Ii][Nn][Ee]"
                    r"|[Tt][Hh][Rr][Ee][Ee])[\s,-]")


class Rewritten:
    """A rewritten text with, for each stretch, where it came from."""

    def __init__(self, text: str):
        plain = text.translate(_GLYPHS)  # one character for one
        parts: list[str] = []
        self._at: list[int] = []      # first rewritten character of each stretch
        self._source: list[tuple[int, int, bool]] = []  # source range; True: character by character
        size = last = 0

        def put(out: str, start: int, end: int, copied: bool) -> None:
            nonlocal size
            if out:
                self._at.append(size)
                self._source.append((start, end, copied))
                parts.append(out)
                size += len(out)

        for m in _DISGUISE.finditer(plain):
            put(plain[last:m.start()], last, m.start(), True)
            kind = m.lastgroup
            if kind == "digits":
                for d in _SPELLED_DIGIT.finditer(plain, m.start(), m.end()):
                    put(_DIGITS[d.group().lower()], d.start(), d.end(), False)
            else:
                put({"at": "@", "dot": ".", "plus": "+", "hidden": ""}[kind], m.start(), m.end(), False)
            last = m.end()
        put(plain[last:], last, len(plain), True)
        self.text = "".join(parts)

    def source(self, start: int, end: int) -> tuple[int, int]:
        """Source range of the rewritten range ``[start, end)``."""
        i, j = bisect_right(self._at, start) - 1, bisect_right(self._at, end - 1) - 1
        first, last = self._source[i], self._source[j]
        return (first[0] + start - self._at[i] if first[2] else first[0],
                last[0] + end - self._at[j] if last[2] else last[1])


def disguised_spans(text: str, plain: list[Span]) -> list[Span]:
    """Identifiers that show only after rewriting, in source offsets."""
    if not ((not text.isascii() and _GLYPH.search(text)) or (_MAYBE.search(text) and _TRIGGER.search(text))):
        return []
    rewritten = Rewritten(text)
    found = []
    for start, kind, end in plain_spans(rewritten.text):
        s, e = rewritten.source(start, end)
        if text[s:e] != rewritten.text[start:end] and not inside((s, kind, e), plain):
            found.append((s, kind, e))
    return found


def personal_data(docs: DataFrame) -> DataFrame:
    """Personal data in every document of ``docs(doc_id, text)``.

    Returns, one row per input row, ``doc_id, n_email, n_ip, n_card, n_phone``
    (plain spans), ``base_spans, spans`` (plain and disguised) and
    ``n_disguised``. Null text is empty; repeated rows each come back; empty
    input gives no rows; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, text in texts_of(batch, 1):
                plain = plain_spans(text)
                extra = disguised_spans(text, plain)
                counts = [sum(kind == k for _, kind, _ in plain) for k in range(4)]
                rows.append((*counts, written(plain, KINDS), written(plain + extra, KINDS), len(extra)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]], names)

    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans", "n_disguised"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, "
             "base_spans string, spans string, n_disguised long")
