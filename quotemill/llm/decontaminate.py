"""Benchmark decontamination by pigeonhole edit matching.

An item of m normalised characters may differ from a passage by k = m * share edits. It is split into k + 1 pieces; k edits
leave one of them untouched, so every passage that matches holds a piece exactly, about where the item has it. One
Aho-Corasick automaton finds all pieces of a block of items in a document; each hit is verified around its diagonal with
Myers' bit-parallel edit distance. Items are taken in blocks of a fixed number of characters, each block's pieces are
broadcast, so what is broadcast stays small however many items there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from ._shared import columns, per_batch, tune, without

#: Edits for each normalised character of an item.
SHARE = 0.07
#: Normalised characters of the items in one block.
BLOCK_CHARS = 4_000_000

# fixed values: what stands between words
_BETWEEN = "\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\xbf\\u2000-\\u206f\\u3000-\\u303f"
_WORD = re.compile(f"[^{_BETWEEN}]+")
_WIDE = re.compile("[\\x80-\\xbf\\u2000-\\u206f\\u3000-\\u303f]")
_ASCII = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))


def normalised(text: str) -> str:
    """Lower-cased words with one space between them."""
    text = text.lower()
    if not text.isascii() and _WIDE.search(text):
        text = _WIDE.sub(" ", text)
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(_ASCII).split()).decode("utf-8", "surrogatepass")


def edits_allowed(m: int, share: float = SHARE) -> int:
    return int(m * share)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of an item, with their places."""
    m = len(item)
    cut = [m * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:]) if a < b]


def myers(pattern: str, text: str, k: int) -> tuple[int, int]:
    """The least edit distance of `pattern` to any stretch of `text` and the first end of one; (k + 1, -1) if over k."""
    m = len(pattern)
    mask, high = (1 << m) - 1, 1 << m - 1
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    up, down, score, best, end = mask, 0, m, k + 1, -1
    for j, c in enumerate(text):
        eq = where.get(c, 0)
        x = eq | down
        diagonal = (((eq & up) + up) ^ up) | eq
        rise, fall = down | (~(diagonal | up) & mask), up & diagonal
        if rise & high:
            score += 1
        elif fall & high:
            score -= 1
        rise, fall = rise << 1 & mask, fall << 1 & mask
        up, down = fall | (~(x | rise) & mask), rise & x
        if score < best:
            best, end = score, j + 1
    return best, end


def locate(item: str, text: str, around: int, k: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the closest stretch of `text` whose start is within k of `around`."""
    if around >= 0 and text.startswith(item, around):
        return 0, around, around + len(item)
    low, high = max(0, around - k), min(len(text), around + len(item) + 2 * k)
    distance, end = myers(item, text[low:high], k)
    if end < 0:
        return None
    back = text[low : low + end][::-1]
    _, length = myers(item[::-1], back, distance)
    return distance, low + end - length, low + end


_held: list = [None, None]  # a worker's last block and its automaton


def _automaton(block: tuple):
    if _held[0] is not block:
        _held[:] = block, _built(block)
    return _held[1]


def _built(block: tuple):
    import ahocorasick

    found: dict[str, list] = {}
    for number, (_, item, k) in enumerate(block):
        for at, piece in pieces(item, k):
            found.setdefault(piece, []).append((number, at))
    machine = ahocorasick.Automaton()
    for piece, places in found.items():
        machine.add_word(piece, (len(piece), places))
    machine.make_automaton()
    return machine


def matches(text: str, block: tuple) -> Iterator[tuple[int, int, int, int]]:
    """(item_id, distance, start, end) in a normalised text; of matches of an item that overlap, the first found."""
    taken: dict[int, list] = {}
    missed: set = set()
    for last, (length, places) in _automaton(block).iter(text):
        for number, at in places:
            around = last + 1 - length - at
            item_id, item, k = block[number]
            if (number, around) in missed or any(s - k <= around < e for s, e in taken.get(number, ())):
                continue
            found = locate(item, text, around, k)
            whole = found and (found[1] == 0 or text[found[1] - 1] == " " or len(item) >= 20) and (found[2] == len(text) or text[found[2]] == " " or len(item) >= 20)
            if not whole:
                missed.add((number, around))
            elif not any(s < found[2] and found[1] < e for s, e in taken.setdefault(number, [])):
                taken[number].append(found[1:])
                yield item_id, *found


def _blocks(benchmark: DataFrame, share: float) -> Iterator[tuple]:
    """Items in blocks: (item_id, normalised text, edits). The driver holds one block at a time."""
    block, held = [], 0
    for row in benchmark.orderBy("item_id", "text").toLocalIterator():
        item = normalised(row.text)
        if not item:
            continue
        block.append((row.item_id, item, edits_allowed(len(item), share)))
        held += len(item)
        if held >= BLOCK_CHARS:
            yield tuple(block)
            block, held = [], 0
    if block:
        yield tuple(block)


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, distance (edits between normalised texts), start, end (code points of the document) for every
    passage of docs(doc_id, text) that is within an item's edits of the item of benchmark(item_id, text).

    Normalising lower-cases, and takes what isn't a letter or digit for one space. Null and empty texts and items, and items
    without letters and digits, match nothing; items under 20 characters (of which those of 15 and more may have one edit)
    match whole words only. Null ids stay null,
    repeated documents and items each have their rows; empty tables give an empty one; other columns play no part.
    """
    spark = tune(docs.sparkSession)
    docs = columns(docs, doc_id="long", text="string").where("text is not null and text <> ''")
    benchmark = columns(benchmark, item_id="long", text="string").where("text is not null and text <> ''")
    kind = "doc_id long, item_id long, distance int, start long, end long"
    out = None
    for block in _blocks(benchmark, share):
        sent = spark.sparkContext.broadcast(block)

        def work(batches, sent=sent):
            for batch in batches:
                out: dict[str, list] = {c: [] for c in ("doc_id", "item_id", "distance", "start", "end")}
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    plain = normalised(text)
                    words = None
                    for item_id, distance, start, end in matches(plain, sent.value):
                        words = words or [m.span() for m in _WORD.finditer(text)]
                        first, last = plain.count(" ", 0, start), plain.count(" ", 0, end)
                        span = words[min(first, len(words) - 1)][0], words[min(last, len(words) - 1)][1]
                        for c, x in zip(out, (doc_id, item_id, distance, *span)):
                            out[c].append(x)
                yield out

        found = per_batch(docs, work, kind)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], kind) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of docs, all columns, that hold no passage of the benchmark; rows without doc_id stay."""
    return without(docs, leaks(docs, benchmark, share).select("doc_id"))
