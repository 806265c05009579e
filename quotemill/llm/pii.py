"""Personal data, with disguises undone at known places.

Plain identifiers are found in the source text itself. Transducers then rewrite what people disguise: look-alike letters and
full-width signs, invisible characters, spelled digits in runs, "at" and "dot" in brackets or words. Each rewriting knows the
stretch of the source it stands for, so what the detectors find in the rewritten text is carried back to source places.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame

from ._shared import columns, per_batch, tune

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ with its host takes what may stand before it, back to the last address: linear even where no @ comes."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (host := _HOST.match(text, at)):
            found.append((begin, host.end()))
            last = host.end()
        at = text.find("@", max(at + 1, last))
    return found


def addresses(text: str) -> list[tuple[int, int]]:
    found = []
    for chain in _CHAIN.finditer(text):
        if "." not in chain[0]:
            continue
        at, parts = chain.start(), chain[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                found.append((at, end))
            at = end + 1
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15] if "+" in text else []


_DETECT: dict[str, Callable[[str], list[tuple[int, int]]]] = {"email": emails, "ip": addresses, "card": cards, "phone": phones}


def plain_spans(text: str) -> list[Span]:
    return [(kind, *span) for kind in KINDS for span in _DETECT[kind](text)]


# ---- disguises -----------------------------------------------------------------------------------------------------

# fixed values: letters and signs of other scripts that look like these
_LOOKS = {
    "a": "аα", "b": "ƅ", "c": "сϲ", "d": "ԁ", "e": "еε", "f": "ք", "g": "ɡց", "h": "һհ", "i": "іιı", "j": "ј", "k": "κк", "l": "ӏ", "m": "м", "n": "пո", "o": "оοօᴏ", "p": "рρ",
    "q": "ԛզ", "r": "г", "s": "ѕꜱ", "t": "т", "u": "υս", "v": "νѵ", "w": "ԝѡ", "x": "хχ", "y": "уγү", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ",
    "S": "ЅՏ", "T": "ТΤ", "U": "Ս", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ", ".": "․。｡", "-": "‐‑‒–−", "@": "﹫", "+": "﹢",
}
# fixed values: characters without width
_INVISIBLE = "​‌‍⁠﻿­"
# fixed values: digits as words in English, German, French, Spanish
_DIGITS = {
    "0": "zero null zéro cero", "1": "one eins un uno", "2": "two zwei zwo deux dos", "3": "three drei trois tres", "4": "four vier quatre cuatro",
    "5": "five fünf cinq cinco", "6": "six sechs seis", "7": "seven sieben sept siete", "8": "eight acht huit ocho", "9": "nine neun neuf nueve",
}
_LETTER = {ord(c): plain for plain, many in _LOOKS.items() for c in many}
_LETTER |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}  # full-width signs
# letters and digits in other dress (bold, script, circled, raised, Roman): those whose compatibility form is one plain character
_DRESSED = [*range(0x2070, 0x208A), *range(0x2100, 0x2180), *range(0x2460, 0x24EA), *range(0x1D400, 0x1D800)]
_LETTER |= {c: plain for c in _DRESSED if (plain := unicodedata.normalize("NFKC", chr(c))).isascii() and plain.isalnum() and len(plain) == 1}
_LETTER |= {first + d: str(d) for first in (0x660, 0x6F0, 0x966) for d in range(10)}  # Arabic-Indic, Persian, Devanagari digits
_LETTER |= {ord(c): "" for c in _INVISIBLE}
_DIGIT = {word: d for d, words in _DIGITS.items() for word in words.split()}

# letters beyond the first plane apart, as a range: among the others they would make the class slow
_ODD = (re.compile("[" + "".join(re.escape(chr(c)) for c in _LETTER if c < 0x10000) + "]"), re.compile("[\U0001d400-\U0001d7ff]"))
_NAME = "|".join(sorted(_DIGIT, key=len, reverse=True))
#: Three digit words in a row, digits among them allowed; a run may begin with "plus".
_RUN = re.compile(rf"(?<![^\W_])(?:plus[\s-]+)?(?:(?:{_NAME}|[0-9])(?:[\s,.-]+(?:dot[\s]+|point[\s]+|punkt[\s]+|punto[\s]+)?|(?![^\W_]))){{4,}}")
_TOKEN = re.compile(r"[^\W_]+")
_POINT = r"(?:dot|punkt|punto|point)"
_AT_IN = re.compile(r"\s*[\[({<]\s*(?:at|@|ät|arroba)\s*[\])}>]\s*", re.I)
_DOT_IN = re.compile(rf"\s*[\[({{<]\s*(?:{_POINT}|\.)\s*[\])}}>]\s*", re.I)
_LABEL = r"[a-z0-9-]++"
_DOT_ANY = rf"(?:\s++{_POINT}\s++|{_DOT_IN.pattern})"
#: Words for the sign, words or brackets for the points: a sign as a word with plain points is prose.
_WORDS = re.compile(rf"(?<![a-z0-9._%+-])[a-z0-9._%+-]++(\s++(?:at|arroba)\s++){_LABEL}(?:{_DOT_ANY}({_LABEL}))++(?![\w])", re.I)
#: The sign itself or in brackets, some points as words.
_MIXED = re.compile(rf"(?:@|{_AT_IN.pattern}){_LABEL}(?:(?:{_DOT_ANY}|\.)({_LABEL}))++(?![\w])", re.I)
_DOTTED = re.compile(rf"(?<![\w.])[0-9]++(?:\s++{_POINT}\s++[0-9]++){{3}}(?![\w])", re.I)
_POINT_WORD = re.compile(rf"\s+{_POINT}\s+", re.I)
_TRIGGER = re.compile(rf"\s{_POINT}\s", re.I)
# fixed values: endings of hosts beyond the two-letter ones
_ENDINGS = frozenset("com org net edu gov mil int info biz name pro museum app dev online site shop store tech xyz club blog cloud test example invalid localhost".split())
# fixed values: two-letter words that begin another clause more often than they end a host
_SMALL_WORDS = frozenset("am an as at be by do go he if in is it me my no of on or so to up us we".split())
_CLAUSE_ENDS = re.compile(r"\s*(?:[.,;:!?)\]}>\n]|$)")

Edit = tuple[int, int, str]


class Rewritten:
    """A text with some stretches replaced, that knows for every place of its own the source place."""

    def __init__(self, text: str, edits: list[Edit]):
        self.begin, self.source, self.changed, parts = [0], [0], [False], []
        at = length = 0
        for start, end, new in sorted(edits):
            if start < at:
                continue
            for piece, place, changed in ((text[at:start], at, False), (new, start, True), ("", end, False)):
                self.begin.append(length)
                self.source.append(place)
                self.changed.append(changed)
                parts.append(piece)
                length += len(piece)
            at = end
        parts.append(text[at:])
        self.text = "".join(parts)

    def place(self, at: int, end: bool = False) -> tuple[int, bool]:
        """Source place of a place of this text, of an end's last character plus one; whether it lies in a replacement."""
        i = bisect.bisect_right(self.begin, at - end) - 1
        if self.changed[i]:
            return (self.source[i + 1] if end else self.source[i]), True
        return self.source[i] + at - self.begin[i], False

    def touched(self, start: int, end: int) -> bool:
        """Does any replacement lie in start..end?"""
        i, j = bisect.bisect_right(self.begin, start) - 1, bisect.bisect_left(self.begin, end)
        return any(self.changed[i:j])

    def span(self, start: int, end: int) -> tuple[int, int]:
        return self.place(start)[0], self.place(end, True)[0]


def _letters(text: str) -> list[Edit]:
    return [] if text.isascii() else [(m.start(), m.end(), _LETTER[ord(m[0])]) for odd in _ODD for m in odd.finditer(text) if ord(m[0]) in _LETTER]


def _ends_a_host(text: str, m: re.Match, label: str) -> bool:
    """Is the last label one that hosts end in? A small word is one only where the clause ends with it."""
    label = label.lower()
    if label in _SMALL_WORDS:
        return bool(_CLAUSE_ENDS.match(text, m.end()))
    return label in _ENDINGS or (len(label) == 2 and label.isalpha())


def _at_and_dot(text: str) -> list[Edit]:
    """Each rewriting stands by itself: what else the text holds plays no part."""
    edits: list[Edit] = []
    if any(c in text for c in "[({<"):
        edits += [(*m.span(), "@") for m in _AT_IN.finditer(text)]
        edits += [(*m.span(), ".") for m in _DOT_IN.finditer(text)]
    if edits or _TRIGGER.search(text):
        points = lambda a, b: [(*p.span(), ".") for p in _POINT_WORD.finditer(text, a, b)]
        for m in _WORDS.finditer(text):
            if _ends_a_host(text, m, m[2]):
                edits += [(*m.span(1), "@"), *points(m.end(1), m.end())]
        for m in _MIXED.finditer(text):
            if _ends_a_host(text, m, m[1]):
                edits += points(m.start(), m.end())
        for m in _DOTTED.finditer(text):
            edits += points(m.start(), m.end())
    return edits


def _spelled(text: str) -> list[Edit]:
    edits, low = [], text.replace("İ", "ı").lower()  # the one letter that grows; places stay
    for run in _RUN.finditer(low):
        words = list(_TOKEN.finditer(low, run.start(), run.end()))
        if sum(w[0] in _DIGIT for w in words) < 4:
            continue
        last = None
        for w in words:
            new = _DIGIT.get(w[0]) or {"plus": "+"}.get(w[0]) or ("." if w[0] in ("dot", "punkt", "punto", "point") else w[0])
            begin = last if last is not None else w.start()  # the digits of a run stand together
            edits.append((begin, w.end(), new))
            last = w.end()
    return edits


_PASSES = (_letters, _spelled, _at_and_dot)


def disguised_spans(text: str) -> list[Span]:
    """What only shows once disguises are undone, in places of the source; passes build on each other."""
    chain: list[Rewritten] = []
    now = text
    for find in _PASSES:
        if edits := find(now):
            chain.append(Rewritten(now, edits))
            now = chain[-1].text
    if not chain:
        return []
    out = []
    for kind, start, end in plain_spans(now):
        changed = False
        for step in reversed(chain):
            changed |= step.touched(start, end)
            start, end = step.span(start, end)
        if changed:
            out.append((kind, start, end))
    return out


def spans(text: str) -> tuple[list[Span], list[Span]]:
    """(plain, all): all adds the disguised ones that no plain one of their kind covers (one that reaches further comes beside it)."""
    plain = plain_spans(text)
    more = disguised_spans(text)
    if more:  # plain spans of a kind ascend and don't overlap: one can cover a span only if it begins last before it
        mine = {kind: [p for p in plain if p[0] == kind] for kind in KINDS}
        begins = {kind: [p[1] for p in found] for kind, found in mine.items()}

        def covered(s: Span) -> bool:
            i = bisect.bisect_right(begins[s[0]], s[1]) - 1
            return i >= 0 and s[2] <= mine[s[0]][i][2]

        more = [s for s in more if not covered(s)]
    order = {kind: i for i, kind in enumerate(KINDS)}
    return plain, sorted({*plain, *more}, key=lambda s: (order[s[0]], s[1], s[2])) if more else plain


def written(found: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in found)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (plain ones), base_sha256, spans, n_disguised for every row of docs(doc_id, text).

    A null text is empty and has none; null ids stay null, repeated rows are taken each by themselves, an empty table gives
    an empty one, other columns play no part. Places are code points of the source, the end exclusive.
    """
    tune(docs.sparkSession)

    def work(batches):
        for batch in batches:
            found = [spans(t or "") for t in batch.column("text").to_pylist()]
            counts = {f"n_{kind}": [sum(s[0] == kind for s in plain) for plain, _ in found] for kind in KINDS}
            yield {"doc_id": batch.column("doc_id")} | counts | {
                "base_sha256": [hashlib.sha256(written(plain).encode()).hexdigest() for plain, _ in found],
                "spans": [written(every) for _, every in found],
                "n_disguised": [len(every) - len(plain) for plain, every in found],
            }

    kind = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long"
    return per_batch(columns(docs, doc_id="long", text="string"), work, kind)


def masked(text: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans give way together, to the kind of the one that
    begins first (the longer of two that begin together)."""
    every = spans(text)[1]
    if not every:
        return text
    parts, at = [], 0
    for kind, start, end in sorted(every, key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def mask_pii(docs: DataFrame) -> DataFrame:
    """docs with the column text masked; all other columns and null texts as they are."""
    from pyspark.sql import functions as F

    tune(docs.sparkSession)

    @F.pandas_udf("string")
    def mask(texts):
        return texts.map(lambda t: None if t is None else masked(t))

    return docs.withColumn("text", mask("text")).select(*docs.columns)
