"""Phrases written plainly, and a scanner that finds them in texts whatever their diacritics, capitals and spaces.

A phrase may have optional words in brackets and choices with bars: `peace [and blessings] be upon him|her`.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable

_MARKS = frozenset(map(chr, [*range(0x64B, 0x653), 0x656, 0x657, 0x658, 0x670, 0x640, *range(0x6D6, 0x6EE)]))
#: Marks, and capitals whose small letter hangs on what stands beside them or is two characters: texts with none go to small letters as a whole.
_APART = re.compile("[" + "".join(sorted(_MARKS)) + "\u03a3\u0130]")
_PART = re.compile(r"\[[^\]]*\]|\S+")


def spelled(phrase: str) -> list[str]:
    """All the phrases that one with optional words and choices stands for."""
    parts = []
    for part in _PART.findall(phrase):
        options = part.strip("[]").split("|")
        parts.append([*options, ""] if part[0] == "[" else options)
    return [" ".join(w for w in way if w) for way in itertools.product(*parts)]


class Bare:
    """A text without diacritics, in small letters, and where its characters stand in the text itself."""

    def __init__(self, text: str):
        self.text = text
        if not _APART.search(text):
            self.at, self.shown = range(len(text) + 1), text.lower()
            return
        kept = [(i, c) for i, c in enumerate(text) if c not in _MARKS]
        self.at = [i for i, _ in kept] + [len(text)]
        small = [c.lower() for _, c in kept]
        self.shown = "".join(s if len(s) == 1 else c for s, (_, c) in zip(small, kept))

    def skip(self, i: int, signs: str = "") -> int:
        """Behind spaces, one of the signs, and spaces."""
        while i < len(self.shown) and self.shown[i].isspace():
            i += 1
        if signs and i < len(self.shown) and self.shown[i] in signs:
            i = self.skip(i + 1)
        return i


class Phrases:
    """Finds any of some phrases; a phrase's spaces stand for any space."""

    def __init__(self, phrases: Iterable[str]):
        each = {Bare(way).shown for phrase in phrases for way in spelled(phrase)}
        self.by_letter: dict[str, list[list[str]]] = {}
        for phrase in sorted(each, key=lambda p: (-len(p), p)):
            self.by_letter.setdefault(phrase[0], []).append(phrase.split(" "))
        # at a place the longest phrase that stands there, as in end(); letters that begin none are passed over
        way = lambda words: r"\s+".join(map(re.escape, words))
        self.any = re.compile("|".join(re.escape(c) + "(?:" + "|".join(way([words[0][1:], *words[1:]]) for words in of) + ")" for c, of in self.by_letter.items()))

    def end(self, shown: str, i: int) -> int | None:
        """Where the longest phrase that begins at i ends."""
        for words in self.by_letter.get(shown[i : i + 1], ()):
            j = i
            for n, word in enumerate(words):
                if n:
                    k = j
                    while k < len(shown) and shown[k].isspace():
                        k += 1
                    if k == j:
                        break
                    j = k
                if not shown.startswith(word, j):
                    break
                j += len(word)
            else:
                return j
        return None

    def found(self, bare: Bare) -> list[tuple[int, int]]:
        """Places (in the bare text) of phrases that don't overlap, from left to right."""
        return [m.span() for m in self.any.finditer(bare.shown)]


def whole_words(shown: str, start: int, end: int, led_by: str = "") -> bool:
    """Do no letters or digits stand right before (but for one of `led_by`) or behind the place?"""
    before = shown[start - 1 : start] if start else ""
    if before and before in led_by:
        before = shown[start - 2 : start - 1] if start > 1 else ""
    return not (before.isalnum() or before == "_") and word_ends(shown, end)


def word_ends(shown: str, end: int) -> bool:
    behind = shown[end : end + 1]
    return not (behind.isalnum() or behind == "_")
