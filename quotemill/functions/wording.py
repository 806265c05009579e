"""Two wordings side by side: what is equal, missing and added, in the words as they are shown; spellings taken from a source."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EQUAL, GONE, NEW = "eq", "del", "ins"
#: A source with over so many pieces for each of the input's (and two more) shows only the part that the input is about.
MUCH_LONGER, MORE = 1.6, 2
_PIECES = re.compile(r"\s+|\S+")
_MARKS = re.compile("[ؐ-ًؚ-ٰٟـۖ-ۭ]")
#: fixed values: letters that are one letter for a key
_SAME = str.maketrans({"أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ة": "ه", "ؤ": "و", "ئ": "ي"})


def word_key(word: str) -> str:
    """A shown word for comparison: without diacritics and signs, letters of one sound alike, in small letters."""
    plain = _MARKS.sub("", unicodedata.normalize("NFKC", word)).translate(_SAME).lower()
    return "".join(c for c in plain if c.isalnum() or c == "'")


def pieces(text: str) -> list[str]:
    """Words and the spaces between them; together they are the text without spaces at its ends."""
    return _PIECES.findall(text.strip())


def compared(text: str, source: str, trim: bool = True) -> tuple[list[dict], list[dict]]:
    """C-18: runs (t, k) of a text and of its source. k: `eq`, `del` (only in the text), `ins` (only in the source); spaces are `eq`.

    Words are compared by their keys and shown as they are: the runs of the text put together are the text. Of a much longer source
    (`trim`) what stands before the first and behind the last word in common gives way to an ellipsis.
    """
    mine, theirs = pieces(text), pieces(source)
    keys = [[" " if p.isspace() else word_key(p) for p in side] for side in (mine, theirs)]
    kinds = [[EQUAL if p.isspace() else other for p in side] for side, other in ((mine, GONE), (theirs, NEW))]
    for i, j, n in difflib.SequenceMatcher(None, *keys, autojunk=False).get_matching_blocks():
        kinds[0][i : i + n] = kinds[1][j : j + n] = [EQUAL] * n
    left, right = (_runs(side, kind) for side, kind in zip((mine, theirs), kinds))
    return left, _around_common(right) if trim and len(theirs) > MUCH_LONGER * len(mine) + MORE else right


def _runs(side: list[str], kinds: list[str]) -> list[dict]:
    out: list[dict] = []
    for piece, kind in zip(side, kinds):
        if out and out[-1]["k"] == kind:
            out[-1]["t"] += piece
        else:
            out.append({"t": piece, "k": kind})
    return out


def _around_common(runs: list[dict]) -> list[dict]:
    common = [i for i, run in enumerate(runs) if run["k"] != NEW and run["t"].strip()]
    if not common:
        return runs
    first, last = common[0], common[-1]
    before = [{"t": "… ", "k": EQUAL}] if first else []
    behind = [{"t": " …", "k": EQUAL}] if last < len(runs) - 1 else []
    return [*before, *runs[first : last + 1], *behind]


_RUNS = "array<struct<t:string,k:string>>"


def compared_col(text: Column, source: Column) -> Column:
    """Struct (text_runs, source_runs); null if either is null."""

    @F.pandas_udf(f"text_runs {_RUNS}, source_runs {_RUNS}")
    def run(texts: pd.Series, sources: pd.Series) -> pd.DataFrame:
        both = [([], []) if a is None or b is None else compared(a, b) for a, b in zip(texts, sources)]
        return pd.DataFrame({"text_runs": [x for x, _ in both], "source_runs": [y for _, y in both]})

    return F.when(text.isNotNull() & source.isNotNull(), run(text, source))


# fixed values: the sign that is left out, the article and letter that begin a word, letters that weakly end one
HAMZA, ARTICLE, ALEF, WEAK_ENDS = "ء", "ال", "ا", "اهيى"
LEAST_STEM = 2


def skeleton(words: list[str]) -> str:
    """N-22 of a stretch of words' keys: what is left when spelling and spacing slip."""
    out = []
    for word in words:
        word = word.replace(HAMZA, "")
        for begins in (ARTICLE, ALEF):
            if word.startswith(begins) and len(word) >= len(begins) + LEAST_STEM:
                word = word[len(begins) :]
        out.append(word.rstrip(WEAK_ENDS) or word)
    return "".join(out)


def shown_words(text: str) -> list[str]:
    """Words without diacritics and signs."""
    return re.sub(r"[^\w\s]", " ", _MARKS.sub("", text)).split()


def snapped(heard: str, source: str) -> str | None:
    """C-20: what was heard, with the source's spelling where a stretch of words differs from the source's in spelling and spacing
    alone; null if nothing does. Other words stay as heard, and nothing that wasn't heard comes in."""
    mine, theirs = shown_words(heard), shown_words(source)
    if not mine or not theirs:
        return None
    keys = [[word_key(w) for w in side] for side in (mine, theirs)]
    out, changed, i, j = [], False, 0, 0
    for a, b, n in difflib.SequenceMatcher(None, *keys, autojunk=False).get_matching_blocks():
        if a > i and b > j and skeleton(keys[0][i:a]) == skeleton(keys[1][j:b]):
            out += theirs[j:b]
            changed = True
        else:
            out += mine[i:a]
        out += mine[a : a + n]
        i, j = a + n, b + n
    return " ".join(out) if changed else None


def snapped_col(heard: Column, source: Column) -> Column:
    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else snapped(x, y) for x, y in zip(a, b)], dtype=object)

    return run(heard, source)
