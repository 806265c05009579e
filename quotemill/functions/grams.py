"""Trigrams of words as numbers, in their order, and the best stretch of them for a query (C-4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bits of one character in a trigram's number: three fit exactly.
_CHAR = 21


def grams(key: str) -> np.ndarray:
    """Trigrams of each word with two spaces before and one behind it, in their order, repeats included: exact 63-bit numbers."""
    words = key.split()
    if not words:
        return np.empty(0, np.int64)
    x = np.frombuffer("".join(f"  {w} " for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = (x[:-2] << 2 * _CHAR) | (x[1:-1] << _CHAR) | x[2:]
    ends = np.cumsum([len(w) + 3 for w in words])
    inside = np.ones(len(codes) + 2, bool)
    inside[ends - 1] = inside[ends - 2] = False  # what starts there runs into the next word
    return codes[inside[: len(codes)]]


#: Beginnings that are bounded together, those of one table, and numbers of a table at most.
_GROUP, _BLOCK, _TOGETHER = 8, 256, 1 << 20


def last_places(have: np.ndarray) -> np.ndarray:
    """Where each trigram of a row stood last before, one added; 0 for the first of its kind."""
    order = np.argsort(have, kind="stable")
    same = have[order][1:] == have[order][:-1]
    out = np.zeros(len(have), int)
    out[order[1:][same]] = order[:-1][same] + 1
    return out


def best_extent(wanted: np.ndarray, have: np.ndarray, least: float = 0.0, last: np.ndarray | None = None) -> float:
    """Shared kinds of trigrams over all kinds of a query and a stretch of `have`, for the best stretch; 0 if that is under `least`.

    The best stretch begins and ends at wanted trigrams, and one that reaches `least` has no more kinds than the query's by `least`,
    so beginnings side by side need a short part of the row. In their table of beginnings and ends a trigram is a new kind of the
    stretches that begin after its last place (`last`, if known) and end behind it: a rectangle, so sums along rows and columns give the shared and the
    other kinds of every stretch. Beginnings side by side share at most what the first of them does, beside at least the other
    kinds of the last: groups that can't reach `least`, or the best so far, aren't counted one by one.
    """
    kinds = np.unique(wanted)
    hit = np.isin(have, kinds)
    at = np.flatnonzero(hit)
    n, h = len(kinds), len(at)
    if not h:
        return 0.0
    last = last_places(have) if last is None else last
    place = np.cumsum(hit) - hit  # a wanted trigram's own number, another one's next
    behind = place + hit
    first_row = np.append(place, h)[last]
    most, best = n / least + 1e-9 if least else np.inf, 0.0
    block = max(_GROUP, min(_BLOCK, _TOGETHER // h // _GROUP * _GROUP))
    for low in range(0, h, block):
        high = min(low + block, h)
        begin = at[high - 1]
        many = np.cumsum(last[begin:] <= begin)
        end = begin + int(np.searchsorted(many, most, "right"))
        part = np.arange(at[low], end)
        part = part[place[part] < h]
        mine = hit[part]
        ours, others = part[mine], part[~mine]
        width = int(place[part[-1]]) - low + 1

        def counts(rows: np.ndarray, of: np.ndarray) -> np.ndarray:
            table = np.zeros((len(rows) + 1, width), np.int32)
            np.add.at(table, (np.searchsorted(rows, first_row[of]), place[of] - low), 1)
            np.add.at(table, (np.searchsorted(rows, behind[of]), place[of] - low), -1)
            return table[:-1].cumsum(axis=0, dtype=np.int32).cumsum(axis=1, dtype=np.int32)

        first = np.arange(low, high, _GROUP)
        bound = (counts(first, ours) / (n + counts(np.minimum(first + _GROUP, high) - 1, others))).max(axis=1)
        some = first[bound >= max(best, least)]
        rows = (some[:, None] + np.arange(_GROUP)).ravel()
        rows = rows[rows < high]
        if len(rows):
            best = max(best, float((counts(rows, ours) / (n + counts(rows, others))).max()))
    return best if best >= least else 0.0


def word_similarity(query: str, text: str) -> float:
    """C-4: 0 for a query without words."""
    return best_extent(grams(query), grams(text))


def windows(row: np.ndarray, kinds: int) -> list[np.ndarray]:
    """Stretches such that every stretch of at most `kinds` different trigrams lies in one of them.

    The row is cut wherever the next trigram would be the (kinds + 1)th different one; two pieces side by side are a window. A
    stretch over three pieces would hold a whole piece and the trigram behind it, one kind too many.
    """
    cuts, seen = [0], set()
    for i, g in enumerate(row.tolist()):
        if g not in seen and len(seen) == kinds:
            cuts.append(i)
            seen = set()
        seen.add(g)
    ends = [*cuts[2:], len(row)]
    return [row[a:b] for a, b in zip(cuts, ends)] if len(row) else []


# ---- runs of words as numbers ---------------------------------------------------------------------------------------

#: A byte's weight by its place is this odd number's power; bytes of keys that are gone through together, about.
_WEIGHT, _BYTES = 0x9E3779B97F4A7C15, 1 << 20
_WEIGHT_AGAIN = 0xD1B54A32D192ED03
_BACK, _BACK_AGAIN = (pow(w, -1, 1 << 64) for w in (_WEIGHT, _WEIGHT_AGAIN))


def run_codes(keys: pa.Array, width: int, inner: bool = False, again: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Some keys at a time (place of the first, rows behind it, numbers, bytes) of every run of `width` words between single spaces; `inner`: without the
    first and the last word of a key. Equal runs have equal numbers; `again`: by other weights. Nulls have none."""
    raw = keys.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    data = np.frombuffer(raw.buffers()[2], np.uint8) if len(raw) and raw.buffers()[2] is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(raw):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + _BYTES, "right")) - 1)
        x, cut = data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        some = np.flatnonzero(np.diff(cut))
        spaces = np.flatnonzero(x == 32)
        begin = np.sort(np.concatenate([cut[some], spaces + 1]))
        end = np.sort(np.concatenate([cut[some + 1], spaces]))
        words = np.searchsorted(spaces, cut[some + 1]) - np.searchsorted(spaces, cut[some]) + 1
        row, first = np.repeat(some, words), np.cumsum(words) - words
        place = np.arange(len(row)) - np.repeat(first, words)
        edge = 1 if inner else 0
        run = np.flatnonzero((place >= edge) & (place + width + edge <= np.repeat(words, words)))
        a, b = begin[run], end[run + width - 1]
        weight, back = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(x), w, np.uint64)])) for w in ((_WEIGHT_AGAIN, _BACK_AGAIN) if again else (_WEIGHT, _BACK)))
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum((x + np.uint64(1)) * weight[:-1], out=sums[1:])
        code = ((sums[b] - sums[a]) * back[a]).astype(np.int64)  # as if the run stood first
        yield at, row[run], code, b - a
        at = to


# ---- bounds of the best stretch for many queries -------------------------------------------------------------------

#: Trigrams of a block: for all queries, and for those that are left; blocks of a stretch, until two blocks become one; numbers of a table.
COARSE, FINE = 16, 8
_REACH, _TABLE = 64, 1 << 22
#: Blocks, times queries, whose stretches are looked at together.
_SIDE_BY_SIDE = 1 << 13
#: What rounding of four-byte numbers may take from a bound.
HAIR = 1e-6


class Queries:
    """Queries side by side, their trigrams as bits: bounds of their best stretches (C-4) in a text."""

    def __init__(self, asked: list[np.ndarray]):
        self.n = np.array([len(a) for a in asked], np.float32)
        self.kinds = np.unique(np.concatenate(asked))
        self.bits = [np.zeros((len(self.kinds) + 1, len(asked)), np.uint64) for _ in range(-(-int(self.n.max()) // 64))]
        for q, a in enumerate(asked):
            bit = np.arange(len(a))
            for w, table in enumerate(self.bits):
                mine = bit // 64 == w
                table[np.searchsorted(self.kinds, a[mine]), q] = np.uint64(1) << (bit[mine] % 64).astype(np.uint64)

    def places(self, row: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.kinds, row), len(self.kinds) - 1)
        return np.where(self.kinds[at] == row, at, len(self.kinds))  # the last one is of no query

    def bounds(self, places: np.ndarray, last: np.ndarray, size: int, some: np.ndarray, least: np.ndarray, spans: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For the queries `some` the best stretch's similarity is at most `upper` (where that is under the query's `least`, so is the best) and at
        least `lower`. places, last: of a row's trigrams. `spans` takes (place in some, begin, end) of parts that hold all stretches of `least`.

        The row is cut into blocks. A stretch from block i to block j shares at most what these blocks show of the query (bits joined by or), beside at
        least the other kinds of the blocks between; blocks i to j themselves are a stretch. Where stretches of many blocks have few kinds (lines
        that come again) two blocks become one.
        """
        upper, lower = np.zeros(len(some), np.float32), np.zeros(len(some), np.float32)
        together = max(1, _TABLE // max(1, len(places) // size))
        for at in range(0, len(some), together):
            part = slice(at, at + together)
            upper[part], lower[part] = self._bounds(places, last, size, some[part], least[part], spans, at)
        return upper, lower

    def _bounds(self, places, last, size, some, least, spans, offset):
        n, total = self.n[some], len(places)
        room = (n / least - n + 1e-2).astype(np.float32)  # other kinds of a stretch that reaches `least`
        blocks = -(-total // size)
        cut = np.full(blocks * size, len(self.kinds))
        cut[:total] = places
        new = np.full(blocks * size, total + 1)
        new[:total] = last
        cut, new = cut.reshape(blocks, size), new.reshape(blocks, size)
        shown = []
        for table in self.bits:
            table = table if len(some) == table.shape[1] else table[:, some]
            bits = table[cut[:, 0]]
            for c in range(1, size):
                bits |= table[cut[:, c]]
            shown.append(bits)
        upper, lower, first = np.zeros(len(some), np.float32), np.zeros(len(some), np.float32), 1
        while True:
            more, together = False, max(32, _SIDE_BY_SIDE // len(some))
            for low in range(0, blocks, together):
                high = min(low + together, blocks)
                best = np.zeros((high - low, len(some)), np.float32) if spans is not None else None
                d = self._from_blocks(shown, new, low, high, size, first, n, room, upper, None if size == COARSE else lower, best)
                more |= d == _REACH
                if best is not None:
                    spans += [(offset + int(q), int(low + i) * size, min(int(low + i + d) * size, total)) for i, q in np.argwhere(best >= least - HAIR)]
            if not more:
                return upper, lower
            if blocks % 2:
                shown = [np.concatenate([bits, np.zeros_like(bits[:1])]) for bits in shown]
                new = np.concatenate([new, np.full_like(new[:1], total + 1)])
            shown = [bits[::2] | bits[1::2] for bits in shown]
            blocks, size, first = len(shown[0]), size * 2, _REACH // 2
            new = new.reshape(blocks, size)


    @staticmethod
    def _from_blocks(shown, new, low, high, size, first, n, room, upper, lower, best) -> int:
        """The stretches of `first` blocks or more that begin in the blocks low to high: how many blocks had to be looked at."""
        blocks, end = len(new), min(high + 1, len(new))  # the block behind begins the inner stretches of the last one
        joined, begin = [bits[low:end].copy() for bits in shown], np.arange(low, end)[:, None] * size
        kinds, known = np.zeros(end - low, np.float32), {}
        for d in range(1, _REACH + 1):
            rows = min(end, blocks - d + 1) - low
            if rows <= 0:
                return d - 1
            for w, bits in enumerate(shown):
                joined[w] = joined[w][:rows]
                joined[w] |= bits[low + d - 1 : low + d - 1 + rows]
            kinds = kinds[:rows] + (new[low + d - 1 : low + d - 1 + rows] <= begin[:rows]).sum(axis=1, dtype=np.float32)
            shared = np.bitwise_count(joined[0]).astype(np.float32)
            for bits in joined[1:]:
                shared += np.bitwise_count(bits)
            known[d] = shared, kinds
            mine = min(rows, high - low)
            if d >= 3:
                inner, of = known.pop(d - 2)
                others = of[1 : mine + 1, None] - inner[1 : mine + 1]
                left = (others <= room).any()
                others += n
                bound = shared[:mine] / others
            else:
                left, bound = True, shared[:mine] / n
            if d >= first:
                np.maximum(upper, bound.max(axis=0), out=upper)
                if best is not None:
                    np.maximum(best[:mine], bound, out=best[:mine])
                if lower is not None:
                    np.maximum(lower, (shared / (kinds[:, None] - shared + n)).max(axis=0), out=lower)
            if not left:
                return d
        return _REACH


def candidates(asked: Queries, row: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of queries, lower, upper) of the queries whose best stretch of a row may reach their `least`."""
    places, last = asked.places(row), last_places(row)
    here = places[last == 0]
    whole = sum(np.bitwise_count(np.bitwise_or.reduce(table[here], axis=0)).astype(np.float32) for table in asked.bits) / asked.n
    some, lower, upper = np.flatnonzero(whole >= least - HAIR), whole[:0], whole[:0]  # what the whole row doesn't show no stretch does
    for size in (COARSE, FINE) if len(some) else ():
        upper, lower = asked.bounds(places, last, size, some, least[some])
        good = upper >= least[some] - HAIR
        some, upper, lower = some[good], upper[good], lower[good]
        if not len(some):
            break
    return some, lower, upper


def best_extents(asked: list[np.ndarray], row: np.ndarray, least: np.ndarray) -> list[float]:
    """best_extent() of each query in a row, 0 where that is under the query's `least`: looked for in the parts that may hold it."""
    out, spans = [0.0] * len(asked), []
    queries = Queries(asked)
    queries.bounds(queries.places(row), last_places(row), FINE, np.arange(len(asked)), least, spans)
    joined: list[list[int]] = []
    for q, begin, end in sorted(spans):
        if joined and joined[-1][0] == q and begin <= joined[-1][2]:
            joined[-1][2] = max(joined[-1][2], end)
        else:
            joined.append([q, begin, end])
    for q, begin, end in joined:
        out[q] = max(out[q], best_extent(asked[q], row[begin:end], max(float(least[q]) - HAIR, out[q])))
    return out


# ---- keys at a small Indel distance --------------------------------------------------------------------------------

#: Bits of a word of a row of common lengths (one is left for what is carried), words at most, pairs that are worked out together.
_BITS, _MOST_WORDS, _PAIRS = 63, 8, 1 << 14
#: From so many characters on keys are met on grams of four.
_LONG = 64


def _points(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and code points of keys one behind another."""
    return np.array([len(k) for k in keys], np.int64), np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _shown(keys: list[str], width: int, dim: int) -> np.ndarray:
    """A row for each key: 1 at the places of its grams, hashed into `dim`, a power of two."""
    n, x = _points(keys)
    at, row = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n), np.repeat(np.arange(len(keys)), n)
    some = np.flatnonzero(at + width <= n[row])
    codes = np.zeros(len(some), np.uint64)
    for i in range(width):
        codes = (codes + x[some + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    out = np.zeros((len(keys), dim), np.float32)
    out[row[some], (codes >> np.uint64(65 - dim.bit_length())).astype(np.int64)] = 1
    return out


def common_lengths(a: list[str], b: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of a[i] and b[j] for arrays of places: the rows of all tables, in words of 63 bits,
    go on by a character of b at a time."""
    n, x = _points(a)
    m, y = _points(b)
    letters = np.unique(x)
    words = -(-int(n.max()) // _BITS)
    masks = np.zeros((len(a), len(letters) + 1, words), np.uint64)  # the last letter is one that a hasn't
    row = np.repeat(np.arange(len(a)), n)
    at = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
    np.bitwise_or.at(masks, (row, np.searchsorted(letters, x), at // _BITS), np.uint64(1) << (at % _BITS).astype(np.uint64))
    codes = np.full((len(b), int(m.max())), len(letters), np.int64)
    place = np.minimum(np.searchsorted(letters, y), len(letters) - 1)
    codes[np.repeat(np.arange(len(b)), m), np.arange(len(y)) - np.repeat(np.cumsum(m) - m, m)] = np.where(letters[place] == y, place, len(letters))
    full = np.uint64((1 << _BITS) - 1)
    ones = [np.where(n >= (w + 1) * _BITS, full, (np.uint64(1) << np.clip(n - w * _BITS, 0, _BITS - 1).astype(np.uint64)) - np.uint64(1)) for w in range(words)]
    v = [o[i] for o in ones]
    for step in range(int(m[j].max())):
        hits = masks[i, codes[j, step]]
        carry = np.uint64(0)
        for w in range(words):
            hit = v[w] & hits[:, w]
            total = v[w] + hit + carry
            carry = total >> np.uint64(_BITS)
            v[w] = ((total & full) | (v[w] ^ hit))
    left = sum(np.bitwise_count(v[w] & ones[w][i]).astype(np.int64) for w in range(words))
    return n[i] - left


class Stretches:
    """Common lengths of keys with stretches of their own length in texts, many side by side."""

    def __init__(self, keys: list[str], texts: list[str]):
        self.n, x = _points(keys)
        lengths, y = _points(texts)
        self.start = np.cumsum(lengths) - lengths
        letters = np.unique(x)
        place = np.minimum(np.searchsorted(letters, y), len(letters) - 1)
        self.codes = np.where(letters[place] == y, place, len(letters)) * len(keys)  # the last letter is one that no key has
        row = np.repeat(np.arange(len(keys)), self.n)
        at = np.arange(len(x)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        words = -(-int(self.n.max()) // _BITS)
        self.masks = np.zeros((words, (len(letters) + 1) * len(keys)), np.uint64)
        np.bitwise_or.at(self.masks, (at // _BITS, np.searchsorted(letters, x) * len(keys) + row), np.uint64(1) << (at % _BITS).astype(np.uint64))
        one, full = np.uint64(1), np.uint64((1 << _BITS) - 1)
        self.ones = [np.where(self.n >= (w + 1) * _BITS, full, (one << np.clip(self.n - w * _BITS, 0, _BITS - 1).astype(np.uint64)) - one) for w in range(words)]

    def common(self, key: list[int], text: list[int], at: list[int]) -> list[int]:
        """For places of keys and texts, and where in the text a stretch begins."""
        key, begin = np.array(key), self.start[np.array(text)] + np.array(at)
        order = np.argsort(-self.n[key], kind="stable")
        out = np.empty(len(key), np.int64)
        for low in range(0, len(order), _PAIRS // 2):
            part = order[low : low + _PAIRS // 2]
            out[part] = self._common(key[part], begin[part])
        return out.tolist()

    def _common(self, key: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """As common(), of keys that come the longest first."""
        n = self.n[key]
        words, full, bits = -(-int(n[0]) // _BITS), np.uint64((1 << _BITS) - 1), np.uint64(_BITS)
        v = [self.ones[w][key] for w in range(words)]
        many = np.searchsorted(-n, -np.arange(int(n[0])), "left")  # keys longer than a step come first
        for step in range(int(n[0])):
            now = int(many[step])
            index = self.codes[begin[:now] + step] + key[:now]
            carry = None
            for w in range(words):
                row = v[w][:now]
                hit = row & self.masks[w].take(index)
                total = row + hit if carry is None else row + hit + carry
                carry = total >> bits
                v[w][:now] = (total & full) | (row ^ hit)
        left = sum(np.bitwise_count(v[w] & self.ones[w][key]).astype(np.int64) for w in range(words))
        return n - left


def near_pairs(keys: list[str], seeds: list[str], least: int):
    """(keys, seeds, ratios) of the pairs at an Indel ratio of `least` or more, some at a time.

    Of keys of m and n characters at that ratio d = (100 - least) / 100 * (m + n) characters go or come at most. One that goes from the seed
    breaks three of its trigrams, one that comes breaks two (four and three of longer keys' wider grams): the others, at least, are
    shared. Pairs are counted by a product of matrices, of grams hashed into places: a place isn't shared only if a gram there is broken.
    """
    keys, seeds = sorted(keys, key=len), sorted(seeds, key=len)
    n = np.array([len(s) for s in seeds])
    dim = 1 << min(max(int(n[-1] * 8).bit_length(), 9), 14)
    width = 4 if n[0] >= _LONG else 3
    given = _shown(seeds, width, dim)
    kinds = given.sum(axis=1)
    lengths = np.array([len(k) for k in keys])
    together = max(1, (1 << 21) // dim)
    out, longest = (100 - least) / 100, (200 - least) / least
    for start in range(0, len(keys), together):
        part, m = keys[start : start + together], lengths[start : start + together]
        low, high = np.searchsorted(n, m[0] / longest - 1e-9), np.searchsorted(n, m[-1] * longest + 1e-9, "right")
        if low == high:
            continue
        total, more = m[:, None] + n[None, low:high], n[None, low:high] - m[:, None]
        d = np.floor(out * total + 1e-9).astype(np.int64)
        d -= (d - more) & 1  # as many go and come as the lengths differ by, and twice as many as are replaced
        shared = _shown(part, width, dim) @ given[low:high].T
        j, i = np.nonzero((np.abs(more) <= d) & (shared >= kinds[None, low:high] - width * (d + more) / 2 - (width - 1) * (d - more) / 2))
        i = i + low
        for at in range(0, len(i), _PAIRS):
            yield _verified(part, seeds, i[at : at + _PAIRS], j[at : at + _PAIRS], least)


def _verified(keys: list[str], seeds: list[str], i: np.ndarray, j: np.ndarray, least: int) -> tuple[list, list, list]:
    of, i = np.unique(i, return_inverse=True)
    a = [seeds[k] for k in of]
    by, j = np.unique(j, return_inverse=True)
    b = [keys[k] for k in by]
    n, m = np.array([len(k) for k in a]), np.array([len(k) for k in b])
    if n.max() <= _BITS * _MOST_WORDS:
        common = common_lengths(a, b, i, j)
    else:
        from .similarity import common_length

        common = np.array([common_length(a[x], b[y]) for x, y in zip(i, j)])
    ratio = 200.0 * common / (n[i] + m[j])
    good = np.flatnonzero(ratio >= least)
    return [b[y] for y in j[good]], [a[x] for x in i[good]], ratio[good].tolist()
