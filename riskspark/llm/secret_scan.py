"""Secrets in texts: fixed patterns, and password values by their guess cost.

Values that stand where credentials stand are cut into words, dates, repeats,
keyboard walks and brute-force stretches; dynamic programming finds the cutting
that needs the fewest guesses. A value that needs many is reported.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from riskspark.llm.spans import Span, inside, texts_of, written

KINDS = ("assign", "access", "hex", "password")
ASSIGN, ACCESS, HEX, PASSWORD = range(4)
#: A credential value is reported from so many guesses on (decimal logarithm).
MIN_GUESSES = 6.0

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CONTEXT = re.compile(
    r"""(?:password|passwd|passphrase|pwd|secret|token|api_?key|credentials?|login|pin)["']?"""
    r"""\x20*(?:[:=]|\bis\b)\x20*["']?([^\s"'<>,;]{4,})""", re.I | re.A)
#: Values that stand for a secret that is elsewhere: variables, templates, addresses without credentials, masks.
_PLACEHOLDER = re.compile(r"\$\{.*|\$\(.*|\$[A-Z_]+|%[A-Z_]+%|\{\{.*|[a-z][a-z0-9+.-]*://[^@]*|[*x.#-]+", re.I | re.A)
#: Each context and pattern has one of these.
_KEYWORDS = ("pass", "pwd", "secret", "token", "api", "credential", "login", "pin")

# Words that people put into passwords, most usual first.
COMMON_WORDS = """password admin welcome login letmein qwerty monkey dragon master secret football baseball
sunshine princess shadow superman michael iloveyou hello freedom whatever trustno ninja mustang access flower
test guest root user demo example sample changeme default pass passwd token key pwd private public system server
database oracle mysql postgres windows linux apple google summer winter spring autumn monday friday january
love angel baby lovely charlie daniel jessica thomas jordan hunter soccer hockey batman star computer internet
hidden redacted none null true false your my the new old secure security service account company team""".split()
_RANK = {w: math.log10(k + 1) for k, w in enumerate(COMMON_WORDS)}
# Characters that stand for letters.
_LEET = str.maketrans("@4301!|$57", "aaeoiilsst")
# The keyboard's rows. A key lies between two keys of the row above, its own place and the next.
_ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_KEY = {c: (row, k) for row, keys in enumerate(_ROWS) for k, c in enumerate(keys)}
_STEPS = {(0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1)}
_DATE = re.compile(r"(?:19|20)[0-9]{2}(?:([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01]))?"
                   r"|(?:0[1-9]|[12][0-9]|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:(?:19|20)[0-9]{2}|[0-9]{2})")
#: Characters of a stretch that is no brute force; a repeat of any length is a stretch too.
LONGEST_STRETCH = 64
# Prices of a word that is in no list (decimal logarithm of guesses): to begin it, for a letter after one of the
# other class (vowel or consonant), for a second and for any further one of the same class.
_WORD_START, _ALTERNATE, _SECOND, _CLUSTER = 2.5, 0.15, 0.35, 1.2
_LETTERS = re.compile(r"[a-z]{3,}|[A-Z][a-z]{2,}|[A-Z]{4,}")


def _per_character(value: str) -> float:
    """Guesses for one character when all of the value's character sets are tried."""
    size = (26 * any("a" <= c <= "z" for c in value) + 26 * any("A" <= c <= "Z" for c in value)
            + 10 * any("0" <= c <= "9" for c in value) + 33 * any(c.isascii() and not c.isalnum() for c in value)
            + 100 * (not value.isascii()))
    return math.log10(max(size, 2))


def _unlisted_word(word: str) -> float:
    """Price of letters in one case: it grows with each letter, and fast where they can't be spoken."""
    cost, run, last = _WORD_START, 0, None
    for c in word.lower():
        vowel = c in "aeiouy"
        run = run + 1 if vowel == last else 1
        if last is not None:
            cost += (_ALTERNATE, _SECOND, _CLUSTER)[min(run, 3) - 1]
        last = vowel
    return cost


def _walk(part: str) -> float | None:
    """Price of neighbouring keys, or of letters or digits that follow one another; a turn costs more."""
    places = [_KEY.get(c) for c in part]
    if None not in places:
        steps = [(b[0] - a[0], b[1] - a[1]) for a, b in zip(places, places[1:])]
        if all(step in _STEPS for step in steps):
            return math.log10(47 * len(part)) + 0.3 * sum(a != b for a, b in zip(steps, steps[1:]))
    if part.isascii() and (part.isalpha() or part.isdigit()):
        steps = {ord(b) - ord(a) for a, b in zip(part, part[1:])}
        if steps in ({1}, {-1}):
            return math.log10(36 * len(part))
    return None


def stretch_price(part: str, each: float) -> tuple[float, str] | None:
    """The least price of a stretch as one thing (word, date, repeat, walk), None if it is none of them.
    ``each``: price of a character by brute force."""
    n, lower = len(part), part.lower()
    prices: list[tuple[float, str]] = []
    if n >= 3 and len(lower) == n:
        plain = lower.translate(_LEET)
        if plain in _RANK:
            prices.append((_RANK[plain] + 0.3 + (0.6 if part != plain else 0.0), "word"))
        if _LETTERS.fullmatch(part):
            prices.append((_unlisted_word(part), "word"))
    if 4 <= n <= 10 and _DATE.fullmatch(part):
        prices.append((4.5 if n > 4 else 2.1, "date"))
    if n >= 3:
        prices += [(unit * each + math.log10(n // unit), "repeat") for unit in range(1, n // 2 + 1)
                   if n % unit == 0 and part == part[:unit] * (n // unit)]
    if n >= 4 and len(lower) == n:
        walk = _walk(lower)
        if walk is not None:
            prices.append((walk, "walk"))
    return min(prices) if prices else None


def _long_repeats(value: str) -> dict[int, list[tuple[int, int]]]:
    """Start to (end, unit) of the repeats over ``LONGEST_STRETCH`` that can't begin earlier."""
    code = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
    found: dict[int, list[tuple[int, int]]] = {}
    for unit in range(1, LONGEST_STRETCH // 2 + 1):
        step = np.diff(np.concatenate([[0], (code[:-unit] == code[unit:]).astype(np.int8), [0]]))
        for start, end in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()):
            to = start + unit * (1 + (end - start) // unit)
            if to - start > LONGEST_STRETCH:
                found.setdefault(start, []).append((to, unit))
    return found


def guess_cost(value: str, enough: float = math.inf) -> tuple[float, list[tuple[str, int, int]]]:
    """Decimal logarithm of the guesses a value needs, and the cutting that gives it.

    ``best[i]`` is the least price of the first ``i`` characters over all cuttings into single characters
    (brute force) and stretches that have a price; inside a long repeat only characters and the repeat itself
    are tried. It stops, with ``enough`` and no cutting, where no cutting
    can stay below ``enough``: prices only add up, and each cutting passes one of the last stretch's places.
    """
    n, each = len(value), _per_character(value)
    best, back = [0.0] + [math.inf] * n, [(0, "")] * (n + 1)
    repeats = _long_repeats(value) if n > LONGEST_STRETCH else {}
    ahead = 0  # the furthest place that a long repeat has reached
    for end in range(n + 1):
        if end and best[end - 1] + each < best[end]:
            best[end], back[end] = best[end - 1] + each, (end - 1, "brute")
        if end + LONGEST_STRETCH > ahead:
            for start in range(max(0, end - LONGEST_STRETCH), end - 2):
                if best[start] < best[end]:
                    price = stretch_price(value[start:end], each)
                    if price and best[start] + price[0] < best[end]:
                        best[end], back[end] = best[start] + price[0], (start, price[1])
        for to, unit in repeats.get(end, ()):
            cost = best[end] + unit * each + math.log10((to - end) // unit)
            ahead = max(ahead, to)
            if cost < best[to]:
                best[to], back[to] = cost, (end, "repeat")
        if end >= ahead and min(best[max(0, end - LONGEST_STRETCH):end + 1]) >= enough:
            return enough, []
    parts: list[tuple[str, int, int]] = []
    end = n
    while end:
        start, kind = back[end]
        if parts and kind == "brute" == parts[-1][0]:
            parts[-1] = (kind, start, parts[-1][2])
        else:
            parts.append((kind, start, end))
        end = start
    return best[n], parts[::-1]


def plain_spans(text: str) -> list[Span]:
    """Leftmost, non-overlapping matches of the fixed patterns."""
    found: list[Span] = [(m.start(), HEX, m.end()) for m in _HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), ACCESS, m.end()) for m in _ACCESS.finditer(text)]
    if "=" in text or ":" in text:
        found += [(m.start(), ASSIGN, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    return found


def password_spans(text: str, plain: list[Span], min_guesses: float = MIN_GUESSES) -> list[Span]:
    """Values in credential contexts that are hard to guess and lie in no plain span entirely."""
    lower = text.lower()
    if not any(word in lower for word in _KEYWORDS):
        return []
    found = []
    for m in _CONTEXT.finditer(text):
        value = m.group(1).rstrip(".!?)")
        span = (m.start(1), PASSWORD, m.start(1) + len(value))
        if (len(value) >= 4 and not _PLACEHOLDER.fullmatch(value) and not inside(span, plain, same_kind=False)
                and guess_cost(value, min_guesses)[0] >= min_guesses):
            found.append(span)
    return found


def secrets(docs: DataFrame, min_guesses: float = MIN_GUESSES) -> DataFrame:
    """Secrets in every document of ``docs(doc_id, text)``.

    Returns, one row per input row, ``doc_id, n_assign, n_access, n_hex`` (fixed
    patterns), ``base_spans, spans`` (these and password values) and
    ``n_password``. Null text is empty; repeated rows each come back; empty input
    gives no rows; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, text in texts_of(batch, 1):
                plain = plain_spans(text)
                extra = password_spans(text, plain, min_guesses)
                counts = [sum(kind == k for _, kind, _ in plain) for k in range(3)]
                rows.append((*counts, written(plain, KINDS), written(plain + extra, KINDS), len(extra)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]], names)

    types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans", "n_password"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_spans string, "
             "spans string, n_password long")
