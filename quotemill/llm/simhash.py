"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has 64 bits; two link when they differ in three at most. Each distinct fingerprint emits variants of itself, and
two that link meet at a variant of both: itself (no bit differs), one flipped bit (`x` with one bit is `y`, or both with one bit
each), or, for three bits, one bit flipped in one and two in the other. Two of any three bits lie in the same half of the word,
so variants with two flipped bits are only needed within a half; and of two fingerprints at an odd distance exactly one has an
even number of ones, so only those with an even number emit them. That is 1,057 variants of half the fingerprints and 65 of the
others, and no pair within the radius is missed.

Variants are dealt out by a linear hash (XOR of a table's entries), so the part of a variant is the part of its fingerprint XOR
the part of the flipped bits: a fingerprint is sent once to each part that one of its variants falls in, and its variants are
made there, a bounded number in each part. At a variant all fingerprints that reached it by one bit at most lie within the
radius of every other one there, so the links of one of them to the others stand for all: a group never becomes pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import columns, materialize, per_batch, to_arrow, tune
from .jaccard_join import components

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Variants that a part holds, about.
PART = 4_000_000
#: Fingerprints that travel in one row, at most.
TOGETHER = 1 << 16
#: Bytes of a text that are cut into words at once.
_BLOCK = 1 << 20
_SPACES = (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")

_ONE = np.uint64(1) << np.arange(64, dtype=np.uint64)
_PAIRS = [(i, j) for low in (0, 32) for i in range(low, low + 32) for j in range(i + 1, low + 32)]
#: Flipped bits of the variants: none and one (all fingerprints), two of one half (those with an even number of ones).
NEAR = np.concatenate((np.zeros(1, np.uint64), _ONE))
FAR = np.array([(1 << i) | (1 << j) for i, j in _PAIRS], np.uint64)
#: Ones in each bit of a byte.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_TABLE = np.zeros((8, 256), np.uint64)
for _byte in range(8):
    for _bit, _row in enumerate(np.random.default_rng(64 + _byte).integers(0, 1 << 32, 8, dtype=np.uint64)):
        _TABLE[_byte] ^= np.where(_BITS[:, _bit] == 1, _row, np.uint64(0))


def _blocks(data: bytes):
    """The text in pieces of about `_BLOCK` bytes, cut between words."""
    at = 0
    while at < len(data):
        end = min(at + _BLOCK, len(data))
        if end < len(data):
            cuts = [c for s in _SPACES if (c := data.rfind(s, at, end)) > at] or [c for s in _SPACES if (c := data.find(s, end)) > 0]
            end = (max(cuts) if cuts and max(cuts) < end else min(cuts, default=len(data))) + 1
        yield data[at:end]
        at = end


def shingle_hashes(text: str | None, size: int = SHINGLE):
    """Arrays of the XXH64 of a text's shingles, repeats included; fewer words than `size`: one, of all of them; none: nothing."""
    words: list[bytes] = []
    some = False
    for block in _blocks((text or "").encode("utf-8", "surrogatepass").lower()):
        words += block.split()
        if len(words) >= size:
            some = True
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
            yield np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - size + 1)
            words = words[len(words) - size + 1 :]
    if words and not some:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; 0 for a text without words."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, size):
        n += len(h)
        by_byte = h.astype("<u8").view(np.uint8).reshape(-1, 8)
        if len(h) < 512:
            ones += np.unpackbits(by_byte, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        else:
            ones += np.concatenate([np.bincount(by_byte[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(_ONE[2 * ones > n].sum(dtype=np.uint64)) if n else 0


def home(x: np.ndarray, bits: int) -> np.ndarray:
    """The part, of 2**bits, that x falls in: home(x ^ y) is home(x) ^ home(y)."""
    if not bits:
        return np.zeros(len(x), np.int64)
    by_byte = np.ascontiguousarray(x).astype("<u8").view(np.uint8).reshape(-1, 8)
    out = _TABLE[0][by_byte[:, 0]]
    for k in range(1, 8):
        out = out ^ _TABLE[k][by_byte[:, k]]
    return (out >> np.uint64(32 - bits)).astype(np.int64)


def even(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x) % 2 == 0


def variants(prints: np.ndarray, part: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct fingerprints, the variants that fall in a part, the place of each one's fingerprint, and whether two bits were flipped."""
    there = home(prints, bits) ^ part
    order = np.argsort(there, kind="stable")
    edge = np.flatnonzero(np.diff(there[order], prepend=-1))
    masks = {two: (m, home(m, bits)) for two, m in ((False, NEAR), (True, FAR))}
    found: list[tuple] = []
    for a, b in zip(edge, np.append(edge[1:], len(order))):
        of = there[order[a]]
        for two, (m, at) in masks.items():
            mine = order[a:b]
            mine = mine[even(prints[mine])] if two else mine
            flips = m[at == of]
            if len(mine) and len(flips):
                found.append(((prints[mine][:, None] ^ flips).ravel(), np.repeat(mine, len(flips)), np.full(len(mine) * len(flips), two)))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found))


def meetings(prints: np.ndarray, part: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links, as places in `prints`, that the variants of one part show; they join what meets there, each is verified."""
    shown, of, two = variants(prints, part, bits)
    order = np.argsort(shown)
    shown = shown[order]
    same = shown[1:] == shown[:-1]
    use = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(shown) else np.empty(0, bool)
    shown, order = shown[use], order[use]
    of, two = of[order], two[order]
    order = np.lexsort((of, two, shown))  # those of one flipped bit at most come first
    shown, of, two = shown[order], of[order], two[order]
    first = np.flatnonzero(np.diff(shown, prepend=~shown[:1])) if len(shown) else np.empty(0, np.int64)
    centre = np.repeat(first, np.diff(np.append(first, len(shown))))
    a, b = of[centre], of
    a, b = (x[(a != b) & ~two[centre]] for x in (a, b))
    pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1)
    near = np.bitwise_count(prints[pairs[0]] ^ prints[pairs[1]]) <= RADIUS
    return pairs[0][near], pairs[1][near]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n places a place that it is joined to by the links, the same for all that are joined."""
    up = list(range(n))

    def top(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return np.array([top(x) for x in range(n)], np.int64)


def links(prints: DataFrame, part: int = PART) -> DataFrame:
    """(a, b) that join the fingerprints of prints(fp), distinct 64-bit numbers, into the components of links at `RADIUS` bits or fewer.

    Each part's links are reduced to a forest before they leave it: as many rows as fingerprints came, at most.
    """
    n = prints.count()
    bits = max(0, int(n * (len(NEAR) + len(FAR) / 2) / part)).bit_length()

    def dealt(batches):
        for batch in batches:
            yield {"fp": batch.column("fp"), "home": home(batch.column("fp").to_numpy().view(np.uint64), bits)}

    def sent(batches):
        targets = [np.unique(home(m, bits)) for m in (NEAR, np.concatenate((NEAR, FAR)))]
        held: list[np.ndarray] = []

        def flush():
            out: dict[str, list] = {"part": [], "prints": []}
            prints = np.concatenate(held)
            held.clear()
            at = home(prints, bits)
            for one in np.unique(at):
                mine = prints[at == one]
                twos = even(mine)
                some, every = (set((t ^ one).tolist()) for t in targets)
                for to in every:
                    go = mine if to in some else mine[twos]
                    if len(go):
                        out["part"].append(int(to))
                        out["prints"].append(go.tobytes())
            return out

        for batch in batches:
            held.append(batch.column("fp").to_numpy().view(np.uint64))
            if sum(map(len, held)) >= TOGETHER:
                yield flush()
        if held:
            yield flush()

    kind = to_arrow("a long, b long")

    def meet(table: pa.Table) -> pa.Table:
        prints = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("prints").to_pylist()])
        at = forest(*meetings(prints, table.column("part")[0].as_py(), bits), len(prints))
        joined = np.flatnonzero(at != np.arange(len(prints)))
        return pa.table([pa.array(prints[at[joined]].view(np.int64)), pa.array(prints[joined].view(np.int64))], schema=kind)

    homes = per_batch(prints.select("fp"), dealt, "fp long, home long").repartition("home").sortWithinPartitions("home")
    return per_batch(homes, sent, "part long, prints binary").groupBy("part").applyInArrow(meet, "a long, b long")


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed number) of every row of docs(doc_id, text)."""

    def work(batches):
        for batch in batches:
            prints = np.fromiter((fingerprint(t, size) for t in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
            yield {"doc_id": batch.column("doc_id"), "fp": prints.view(np.int64)}

    return per_batch(columns(docs, doc_id="long", text="string"), work, "doc_id long, fp long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of docs(doc_id, text).

    component_id is the smallest doc_id reachable by links of fingerprints at three bits or fewer, itself included. Null and
    empty texts and texts without words have the fingerprint zero, which links like any other. Rows that share a doc_id are
    one node: they have its component. A row without doc_id takes no part in links and has no component (null). An empty
    table gives an empty one; other columns play no part.
    """
    tune(docs.sparkSession)
    found = materialize(fingerprints(docs, size))
    known = found.where("doc_id is not null")
    prints = materialize(known.groupBy("fp").agg(F.min("doc_id").alias("least")))
    # a doc_id with several texts joins their fingerprints
    several = known.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("high")).where("a <> high").select("doc_id", "a")
    within = known.join(several, "doc_id").where("fp <> a").select("a", F.col("fp").alias("b"))
    label = components(links(prints).unionByName(within)).withColumnRenamed("node", "fp")
    labelled = materialize(prints.join(label, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    of = labelled.join(least, "component").select("fp", "component_id")
    # the table of fingerprints has one row for each; a fingerprint that very many documents have is split by AQE
    return found.join(of, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )
