"""N-gram Jaccard join by parity sketches.

A document's set is its distinct word shingles. Each shingle toggles one bit of a sparse sketch (XOR), so the Hamming
distance of two sketches never exceeds the sets' symmetric difference. A pair at Jaccard 0.75 or more of sizes a and b
differs in at most d = (a + b) // 7 shingles, hence in at most d of the sketches' 64-bit pieces: of any d + 1 pieces that
one document shows, in one order common to all documents, one is met in the other document (pigeonhole). Documents meet
within a size band only; those just above a band's lower end show pieces in the band below as well. Pieces that many
documents hold come last in that order, which a table of 2**22 counters over all documents tells (broadcast, of one size
whatever the input), so that a passage shared by a third of the documents doesn't make them meet.

Documents with more shingles of their own than a link allows are set aside before. The documents that meet at a piece are compared with the smallest among them only; then, where a piece's documents aren't
one component yet, across those components, by their leaders first. So no link is lost and a group of copies needs a number of comparisons in
proportion to its size. A comparison looks at dense parity sketches first and then counts the shingles of whole texts.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import chain, columns, lists, materialize, mix, per_batch, signed, small, tune, without, word_hashes

SHINGLE = 5
#: Similarity, in hundredths.
LEAST = 75
CELLS = 1 << 22
_CHUNKS = 64
#: Shingles that a task gathers before it sends them; about as many come together in a group.
SENT_KEYS = 1_000_000
#: Documents whose dense sketches meet another block's at once.
BLOCK = 32
_SEVERAL = np.uint32(0xFFFFFFFF)
#: Bits that stand for a shingle within its part of the hash range (a part has about SENT_KEYS shingles).
_LOW_BITS = 27


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle; no words, none."""
    words = word_hashes(text)
    if not len(words):
        return words
    n = min(size, len(words))
    return np.unique(chain([words[i : len(words) - n + 1 + i] for i in range(n)]))


def _fold(found: np.ndarray, log_pieces: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and XOR-ed words of the pieces that any of the sorted hashes falls in; zero words are left out."""
    piece = found >> np.uint64(64 - log_pieces)
    start = np.flatnonzero(np.diff(piece, prepend=~piece[:1]))
    word = np.bitwise_xor.reduceat(np.uint64(1) << (found & np.uint64(63)), start)
    some = word != 0
    return piece[start][some], word[some]


def scopes(n: int) -> list[int]:
    """Size bands in which a set of n shingles shows pieces: 0 for 1..15, 1 for 16..255, 2 for 256..4095, ..."""
    own = (n.bit_length() - 1) // 4
    return [own, own - 1] if own and n * LEAST <= 100 * 16**own else [own]


def piece_keys(found: np.ndarray, scope: int) -> np.ndarray:
    """One 64-bit key for each piece of the sketch in a size band that isn't zero."""
    piece, word = _fold(found, 42 if scope < 2 else min(42, 4 * scope + 10))
    return chain([piece + np.uint64(scope + 1 << 48), mix(word)])


def differ_at_most(n: int, least: int = LEAST) -> int:
    """The most shingles in which a set of n and one linked to it, of the largest size that can be, differ."""
    return (n + n * 100 // least) * (100 - least) // (100 + least)


def dense_sketch(found: np.ndarray) -> bytes:
    """Parity sketch of about four bits a shingle, 2 KB at most; a shorter sketch is a longer one folded."""
    log = min(14, max(6, len(found).bit_length() + 2))
    out = np.zeros(1 << log - 6, np.uint64)
    if len(found):
        piece, word = _fold(found, log - 6) if log > 6 else (np.zeros(1, np.int64), np.bitwise_xor.reduce(np.uint64(1) << (found & np.uint64(63)), keepdims=True))
        out[piece.astype(np.int64)] = word
    return out.tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Of two dense sketches, at the shorter one's length."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(len(y), -1), axis=1) ^ y).sum())


def hammings(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """hamming() of every sketch of one block with every one of another."""

    def by_length(block):
        lengths = np.array([len(x) for x in block])
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            yield at, np.frombuffer(b"".join(block[i] for i in at), np.uint64).reshape(len(at), -1)

    out = np.empty((len(a), len(b)), np.int64)
    for i, x in by_length(a):
        for j, y in by_length(b):
            n = min(x.shape[1], y.shape[1])
            x_n, y_n = (np.bitwise_xor.reduce(z.reshape(len(z), n, -1), axis=2) for z in (x, y))
            out[np.ix_(i, j)] = np.bitwise_count(x_n[:, None] ^ y_n[None]).sum(axis=2, dtype=np.int64)
    return out


def least_distances(n_a: np.ndarray, a: list[bytes], n_b: np.ndarray, b: list[bytes]) -> np.ndarray:
    """1 - Jaccard of every pair of two blocks is this much at least, by the sizes and dense sketches of the sets."""
    both = n_a[:, None] + n_b[None]
    differ = np.maximum(hammings(a, b), np.abs(n_a[:, None] - n_b[None]))
    return 2 * differ / np.maximum(both + differ, 1)


def _common(texts: DataFrame, size: int) -> np.ndarray:
    """For each counter, how often its pieces occur over all documents, against the mean: 0, or the logarithm from 2 on."""

    def count(batches):
        seen = np.zeros(CELLS, np.uint32)
        for batch in batches:
            keys = []
            for text in batch.column("text").to_pylist():
                found = shingles(text, size)
                keys += [piece_keys(found, s) for s in (scopes(len(found)) if len(found) else ())]
            if keys:
                cells, times = np.unique((np.concatenate(keys) & np.uint64(CELLS - 1)).astype(np.uint32), return_counts=True)
                seen[cells] += times.astype(np.uint32)
        parts = seen.reshape(_CHUNKS, -1)
        some = [i for i in range(_CHUNKS) if parts[i].any()]
        yield {"chunk": some, "counts": [zlib.compress(parts[i].tobytes(), 1) for i in some]}

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, part in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                part = np.frombuffer(zlib.decompress(part), np.uint32)
                total[chunk] = total[chunk] + part if chunk in total else part.astype(np.uint64)
        yield {"chunk": list(total), "counts": [x.tobytes() for x in total.values()]}

    kind = "chunk long, counts binary"
    summed = per_batch(per_batch(texts, count, kind).repartition(_CHUNKS, "chunk"), add, kind)
    out = np.zeros((_CHUNKS, CELLS // _CHUNKS), np.uint64)
    for row in summed.toLocalIterator():  # 64 rows of 512 KB
        out[row.chunk] = np.frombuffer(row.counts, np.uint64)
    out = out.ravel()
    mean = max(1.0, float(out.sum()) / CELLS)
    return np.floor(np.log2(np.maximum(out / (2 * mean), 1))).astype(np.uint8)


def _sketches(texts: DataFrame, size: int) -> DataFrame:
    """node, n, dense sketch, and the pieces that the document shows."""
    common = texts.sparkSession.sparkContext.broadcast(_common(texts, size))

    def work(batches):
        level = common.value
        for batch in batches:
            n, dense, shown = [], [], []
            for text in batch.column("text").to_pylist():
                found = shingles(text, size)
                n.append(len(found))
                dense.append(dense_sketch(found))
                parts = []
                for scope in scopes(len(found)) if len(found) else ():
                    keys = piece_keys(found, scope)
                    keys = keys[np.lexsort((keys, level[(keys & np.uint64(CELLS - 1)).astype(np.int64)]))]
                    parts.append(keys[: differ_at_most(len(found)) + 1])
                shown.append(signed(np.concatenate(parts)) if parts else np.empty(0, np.int64))
            yield {"node": batch.column("node"), "n": n, "sketch": dense, "pieces": lists(shown, np.int64)}

    return per_batch(texts, work, "node long, n long, sketch binary, pieces array<long>")


def spare(n, own):
    """Of a linked pair, the sum of this is never under 0: all shingles that only one of them has are in the difference."""
    return (100 - LEAST) * n - (100 + LEAST) * own


def _meetings(shown: DataFrame) -> DataFrame:
    """For each piece that several documents show: (first = its smallest document, node), whether that pair can link by sizes
    and own shingles, and whether there are over two.

    One shuffle by piece; each task then streams over its sorted rows and holds one row at a time.
    """

    def work(batches):
        key = first = None
        many = 0
        held = None  # the piece's second document, until a third one comes
        for batch in batches:
            out: dict[str, list] = {"piece": [], "first": [], "node": [], "n": [], "own": [], "can": [], "many": []}

            def put(row, many):
                can = 100 * min(row[1], first[1]) >= LEAST * max(row[1], first[1]) and spare(*row[1:]) + spare(*first[1:]) >= 0
                for name, x in zip(out, (key, first[0], *row, can, many)):
                    out[name].append(x)

            keys = batch.column("piece").to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(keys[1:] == keys[:-1])
            use = np.zeros(len(keys), bool)  # rows beside one of the same piece, and the ends of the batch
            use[edge] = use[edge + 1] = True
            use[:1] = use[-1:] = True
            at = np.flatnonzero(use)
            rows = zip(*(batch.column(c).to_numpy(zero_copy_only=False)[at].tolist() for c in ("node", "n", "own")))
            for k, row in zip(keys[at].tolist(), rows):
                if k != key:
                    if held:
                        put(held, False)
                    key, first, held, many = k, row, None, 1
                elif row[0] != (held or first)[0]:
                    many += 1
                    if many == 2:
                        held = row
                    else:
                        if held:
                            put(first, True)
                            put(held, True)
                        held = None
                        put(row, True)
            yield out
        if held:
            out = {name: [] for name in out}
            put(held, False)
            yield out

    rows = shown.select("node", F.col("n").cast("int").alias("n"), F.col("own").cast("int").alias("own"), F.explode("pieces").alias("piece"))
    dealt = rows.repartition("piece").sortWithinPartitions("piece", "node")
    return per_batch(dealt, work, "piece long, first long, node long, n int, own int, can boolean, many boolean")


def _verified(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, size: int, least: int = LEAST) -> DataFrame:
    """Of distinct pairs (a, b), those at a similarity of `least` hundredths or more, with their distance (1 - Jaccard):
    by dense sketches first, then by whole sets."""

    def near(batches):
        for batch in batches:
            x = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            keep = [
                100 * min(m, n) >= least * max(m, n) and hamming(p, q) <= (m + n) * (100 - least) // (100 + least)
                for m, n, p, q in zip(x["n_a"], x["n_b"], x["sketch_a"], x["sketch_b"])
            ]
            yield {c: [v for v, k in zip(x[c], keep) if k] for c in ("a", "b")}

    def same(batches):
        last: tuple = (None, None)
        for batch in batches:
            out: dict[str, list] = {"a": [], "b": [], "distance": []}
            rows = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")))
            for a, b, text_a, text_b in rows:
                if last[0] != text_a:
                    last = (text_a, shingles(text_a, size))
                one, two = last[1], shingles(text_b, size)
                both = len(np.intersect1d(one, two, assume_unique=True))
                every = len(one) + len(two) - both
                if both and 100 * both >= least * every:
                    for name, x in zip(out, (a, b, 1 - both / every)):
                        out[name].append(x)
            yield out

    def beside(pairs, table, *names):
        for side in ("a", "b"):
            pairs = pairs.join(table.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in names)), side)
        return pairs

    close = materialize(per_batch(beside(pairs, sketches, "n", "sketch"), near, "a long, b long"))
    ids = close.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = materialize(texts.join(small(ids), "node", "left_semi"))
    found = per_batch(beside(close, texts, "text"), same, "a long, b long, distance double")
    return found.groupBy("a", "b").agg(F.min("distance").alias("distance"))


def _across(met: DataFrame, links: DataFrame, done: DataFrame, sketches: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Links between the components that show one piece, without comparing all their documents.

    1 - Jaccard is a metric. Each document stands near one that it links to, its leader, or is its own; a leader's reach is
    the largest distance to its followers. Where two leaders are further apart than 0.25 and both reaches, by their dense
    sketches, their followers don't link; only the rest is compared document by document. Two documents whose own shingles
    rule a link out (`spare`) never meet here. Leaders meet in blocks of sketches, so that a piece makes rows in proportion
    to its blocks and only pairs that the sketches leave become rows.
    """
    led = links.groupBy("b").agg(F.min(F.struct("a", "distance")).alias("to")).select(F.col("b").alias("node"), F.col("to.a").alias("leader"), F.col("to.distance").alias("radius"))
    linked = materialize(components(links).join(led, "node", "left"))
    spared = F.lit(100 - LEAST) * F.col("n") - F.lit(100 + LEAST) * F.col("own")
    of = met.where("many").select("piece", "node", "n", "own").join(small(linked, 32), "node", "left")
    of = of.select("piece", "node", "n", spared.alias("spare"), F.coalesce("component", "node").alias("component"), F.coalesce("leader", "node").alias("leader"), F.coalesce("radius", F.lit(0.0)).alias("radius"))
    open_ = of.groupBy("piece").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("piece")
    left = materialize(of.join(open_, "piece"))
    members = left.select("leader", "node", "n", "spare", "component", "radius").distinct()
    leads = members.groupBy("leader").agg(F.max("spare").alias("spare"), F.max("radius").alias("reach")).join(sketches.select(F.col("node").alias("leader"), "n"), "leader")
    # of pieces that the same leaders show, one is enough
    shown = left.select("piece", "leader", "component").distinct()
    same = shown.groupBy("piece").agg(F.bit_xor(F.xxhash64("leader")).alias("one"), F.bit_xor(F.xxhash64("leader", F.lit(1))).alias("two"), F.count(F.lit(1)).alias("n"))
    groups = materialize(shown.join(same.groupBy("one", "two", "n").agg(F.min("piece").alias("piece")).select("piece"), "piece").join(small(leads, 32), "leader"))
    # own shingles leave room only beside one of the piece whose spare makes up for it
    top = groups.groupBy("piece").agg(F.max("spare").alias("top"), F.count(F.lit(1)).alias("shown"))
    groups = materialize(groups.join(top, "piece").where("spare + top >= 0"))
    apart = _in_blocks(groups.where(f"shown > {BLOCK}"), sketches).unionByName(_one_by_one(groups.where(f"shown <= {BLOCK}"), sketches))
    apart = materialize(apart.groupBy("a", "b").agg(F.min("distance").alias("distance")))
    more = _followers(apart, members, sketches)
    return _verified(materialize(more.join(done, ["a", "b"], "left_anti")), sketches, texts, size)


def _in_blocks(groups: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b, distance) of leaders that meet at a piece that many show."""
    groups = groups.join(sketches.select(F.col("node").alias("leader"), "sketch"), "leader")
    return _near(groups, groups.where("spare >= 0"), "piece", ("leader", "component", "spare", "reach", "n", "sketch"), within=True)


def _one_by_one(groups: DataFrame, sketches: DataFrame) -> DataFrame:
    """The same of leaders at pieces that few show: `BLOCK` partners of each at most. Sizes are looked at before sketches."""
    least = LEAST / 100 - 1e-9
    one, two = (groups.select("piece", *(F.col(c).alias(f"{c}{i}") for c in ("leader", "component", "spare", "reach", "n"))) for i in ("", "2"))
    can = "spare >= 0 and component <> component2 and spare + spare2 >= 0 and (spare2 < 0 or leader < leader2)"
    alike = F.least("n", "n2") >= F.greatest("n", "n2") * (F.lit(least) - F.col("reach") - F.col("reach2"))
    pairs = one.join(two, "piece").where(can).where(alike).select(F.least("leader", "leader2").alias("a"), F.greatest("leader", "leader2").alias("b"), (F.col("reach") + F.col("reach2")).alias("reach"))
    pairs = pairs.groupBy("a", "b").agg(F.max("reach").alias("reach"))
    for side in ("a", "b"):
        pairs = pairs.join(sketches.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)
    link = 1 - LEAST / 100 + 1e-9

    def work(batches):
        for batch in batches:
            x = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            differ = np.array([max(hamming(p, q), abs(m - n)) for p, q, m, n in zip(x["sketch_a"], x["sketch_b"], x["n_a"], x["n_b"])], np.float64)
            both = np.array(x["n_a"], np.float64) + np.array(x["n_b"], np.float64)
            distance = 2 * differ / np.maximum(both + differ, 1)
            keep = np.flatnonzero(distance <= link + np.array(x["reach"], np.float64))
            yield {"a": np.array(x["a"], np.int64)[keep], "b": np.array(x["b"], np.int64)[keep], "distance": distance[keep]}

    return per_batch(pairs, work, "a long, b long, distance double")


def _near(many: DataFrame, few: DataFrame, key: str, fields: tuple[str, ...], within: bool = False) -> DataFrame:
    """(a, b, distance) of rows of `many` and `few` that meet at a key and that may have a link between what they lead.

    `fields` are, in this order: id, component, spare, reach (how far what it leads is from it), size, dense sketch. Both sides
    come in blocks of about `BLOCK` rows. A key with many blocks is dealt out over several tasks; the few side's blocks go to
    each of them. distance is a lower bound. `within`: `few` are the rows of `many` with a spare of 0 or more, so that a pair
    of two such rows comes twice and is taken once.
    """

    def packs(rows):
        blocks = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
        dealt = rows.join(blocks, key).groupBy(key, "blocks", F.pmod(F.xxhash64(fields[0]), F.col("blocks")).alias("block"))
        return dealt.agg(F.collect_list(F.struct(*fields)).alias("pack"))

    salts = F.ceil(F.col("blocks") / BLOCK)
    one = packs(many).select(key, F.pmod("block", salts).alias("salt"), F.col("pack").alias("one"))
    wide = many.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")).select(key, F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    two = packs(few).select(key, F.col("pack").alias("two")).join(wide, key)
    met = one.join(two, [key, "salt"]).select("one", "two")
    link = 1 - LEAST / 100 + 1e-9

    def read(pack):
        node, component, spared, reach, n, sketch = pack.values.flatten()
        return (*(x.to_numpy(zero_copy_only=False) for x in (node, component, spared, reach, n)), sketch.to_pylist())

    def work(batches):
        for batch in batches:
            out: dict[str, list] = {"a": [], "b": [], "distance": []}
            for x, y in zip(batch.column("one"), batch.column("two")):
                (node, component, spared, reach, n, sketch), (node2, component2, spared2, reach2, n2, sketch2) = read(x), read(y)
                can = (component[:, None] != component2) & (spared[:, None] + spared2 >= 0) & (node[:, None] != node2)
                if within:
                    can &= (spared[:, None] < 0) | (node[:, None] < node2)
                rows, cols = np.flatnonzero(can.any(axis=1)), np.flatnonzero(can.any(axis=0))
                if not len(rows):
                    continue
                far = least_distances(n[rows], [sketch[i] for i in rows], n2[cols], [sketch2[j] for j in cols])
                some = np.nonzero(can[np.ix_(rows, cols)] & (far <= link + reach[rows][:, None] + reach2[cols]))
                p, q = node[rows[some[0]]], node2[cols[some[1]]]
                for name, z in zip(out, (np.minimum(p, q), np.maximum(p, q), far[some])):
                    out[name].append(z)
            yield {name: np.concatenate(z) if z else [] for name, z in out.items()}

    return per_batch(met, work, "a long, b long, distance double")


def _followers(apart: DataFrame, members: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs of followers of two leaders that the leaders' distance and the dense sketches don't rule out.

    The followers of all leaders that stand near one with more followers meet that one's in blocks (`_near`), so a group of
    thousands beside hundreds of outsiders makes rows in proportion to the two numbers' sum, not their product.
    """
    sized = members.join(sketches.select("node", "sketch"), "node")
    count = members.groupBy("leader").agg(F.count(F.lit(1)).alias("count"))
    for side in ("a", "b"):
        apart = apart.join(count.select(F.col("leader").alias(side), F.col("count").alias(f"count_{side}")), side)
    larger = F.struct("count_a", "a") > F.struct(F.col("count_b").alias("count_a"), F.col("b").alias("a"))
    ways = apart.select(F.when(larger, F.col("a")).otherwise(F.col("b")).alias("large"), F.when(larger, F.col("b")).otherwise(F.col("a")).alias("leader"), "distance")
    # two followers link only where the leaders' distance is at most 0.25 and both radii
    reach = members.groupBy("leader").agg(F.max("radius").alias("most"))
    few = ways.join(sized, "leader").join(reach.select(F.col("leader").alias("large"), "most"), "large").where(f"distance - radius - most <= {1 - LEAST / 100 + 1e-9}")
    few = few.groupBy("large", "node").agg(*(F.first(c).alias(c) for c in ("component", "spare", "n", "sketch")))
    fields = ("node", "component", "spare", "reach", "n", "sketch")
    many = sized.withColumnRenamed("leader", "large").join(few.select("large").distinct(), "large")
    either = lambda rows: rows.withColumn("reach", F.lit(0.0))
    return _near(either(many), either(few), "large", fields).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component = smallest node that it reaches) for the nodes of edges (a, b) but the smallest of each component, which
    have no row of their own; alternating stars, all in Spark.

    Each round halves the depth of what is left at least; every round's edges are written to the shared folder.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        e = materialize(small.where("u <> v").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    labels = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels.groupBy("node").agg(F.min("component").alias("component"))


def _packed(x: np.ndarray) -> bytes:
    """32-bit numbers byte by byte, all lowest bytes first, so that the high ones shrink to nothing."""
    return zlib.compress(x.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()


def _alive(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, own (shingles that no other row has), alive for every row: can it link at all? In a link at 0.75 at most a quarter of a set is missing from the
    other one, so a document with more shingles than that which no other row has is out.

    Tasks send each shingle once for about a million of theirs: with its document's number, or as one that several of
    their documents have. A group for each part of the hash range then finds those sent once in all, and a group for each
    sending adds them up by document. The 27 bits that stand for a shingle within its part make about one in a hundred look
    shared; that lets documents pass, never drops them.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, total // 6 // SENT_KEYS)
    kind = "part long, sending long, first binary, second binary"

    def send(batches):
        here, number = TaskContext.get().partitionId(), 0
        ids: list = []
        sets: list = []
        held = 0

        def flush():
            nonlocal number, held
            sending = here << 32 | number
            sizes = np.array([len(x) for x in sets], np.int64)
            number, held = number + 1, 0
            rows = [(-1 - sending % parts, sending, pickle.dumps(list(ids)), sizes.tobytes())]
            if sizes.any():
                keys, doc = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
                order = np.argsort(keys, kind="stable")
                keys, doc = keys[order], doc[order]
                first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                alone = np.diff(np.append(first, len(keys))) == 1
                keys, doc = keys[first], np.where(alone, doc[first], _SEVERAL)
                part = (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
                edge = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
                low = (mix(keys) >> np.uint64(64 - _LOW_BITS)).astype(np.uint32)
                for i in range(parts):
                    if edge[i] < edge[i + 1]:
                        x, d = low[edge[i] : edge[i + 1]], doc[edge[i] : edge[i + 1]]
                        order = np.argsort(x, kind="stable")
                        rows.append((i, sending, _packed(np.diff(x[order], prepend=np.uint32(0))), _packed(d[order] + np.uint32(1))))  # several: 0
            ids.clear()
            sets.clear()
            return dict(zip(("part", "sending", "first", "second"), map(list, zip(*rows))))

        for batch in batches:
            ids += batch.column("doc_id").to_pylist()
            sets += (found := [shingles(t, size) for t in batch.column("text").to_pylist()])
            held += sum(map(len, found))
            if held >= SENT_KEYS:
                yield flush()
        if ids:
            yield flush()

    def once(table):
        part = table.column("part")[0].as_py()
        if part < 0:
            return table.select(["sending", "first", "second"])
        sendings = table.column("sending").to_pylist()
        keys = [np.cumsum(_unpacked(x), dtype=np.uint32) for x in table.column("first").to_pylist()]
        docs = np.concatenate([_unpacked(x) for x in table.column("second").to_pylist()])
        of = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        same = every[order][1:] == every[order][:-1]
        alone = np.ones(len(every), bool)
        alone[order[1:][same]] = alone[order[:-1][same]] = False
        alone &= docs > 0
        out = _by_sending(docs[alone].astype(np.int64) - 1, of[alone], len(keys))
        return pa.table({"sending": pa.array(sendings, pa.int64()), "first": pa.array([None] * len(keys), pa.binary()), "second": pa.array(out, pa.binary())})

    def add(table):
        ids, sizes, alone = [], np.empty(0, np.int64), []
        for first, second in zip(table.column("first").to_pylist(), table.column("second").to_pylist()):
            if first is not None:
                ids, sizes = pickle.loads(first), np.frombuffer(second, np.int64)
            else:
                alone.append(np.frombuffer(second, np.uint32))
        unique = np.zeros(len(ids), np.int64)
        for x in alone:
            unique[: len(x)] += x
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n": pa.array(sizes), "own": pa.array(unique), "alive": pa.array((sizes > 0) & (100 * unique <= (100 - LEAST) * sizes))})

    sent = per_batch(docs, send, kind)
    found = sent.groupBy("part").applyInArrow(once, "sending long, first binary, second binary")
    return found.groupBy("sending").applyInArrow(add, "doc_id long, n long, own long, alive boolean")


def _by_sending(doc: np.ndarray, of: np.ndarray, n: int) -> list[bytes]:
    order = np.argsort(of, kind="stable")
    cut = np.searchsorted(of[order], np.arange(1, n))
    return [np.bincount(x).astype(np.uint32).tobytes() for x in np.split(doc[order], cut)]


def jaccard_components(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs(doc_id, text), linking at Jaccard 0.75 or more.

    component_id is the smallest doc_id reachable by links, itself included. Null and empty texts and texts without words
    have no shingles and no links. Rows that share a doc_id are one node: they have its component. A row without doc_id
    has no component (null). An empty table gives an empty one; other columns play no part.
    """
    tune(docs.sparkSession)
    docs = columns(docs, doc_id="long", text="string")
    sized = materialize(_alive(docs, size))
    ids = sized.where("alive and doc_id is not null").select("doc_id").distinct()
    known = materialize(docs.join(small(ids), "doc_id", "left_semi").where("text is not null").withColumn("digest", F.md5("text")))
    # exact copies: one node for each text, the smallest doc_id that holds it
    first = known.groupBy("digest").agg(F.min("doc_id").alias("node"))
    nodes = materialize(known.select("doc_id", "digest").distinct().join(first, "digest"))
    keepers = nodes.where("doc_id = node").select("doc_id", "digest")
    texts = materialize(known.join(keepers, ["doc_id", "digest"]).select(F.col("doc_id").alias("node"), "text").dropDuplicates())
    # without the copies and those set aside, more documents stand alone
    again = _alive(texts.withColumnRenamed("node", "doc_id"), size).where("alive").groupBy("doc_id").agg(F.min("own").alias("own"))
    again = materialize(again.withColumnRenamed("doc_id", "node"))
    sketches = materialize(_sketches(texts.join(again, "node", "left_semi"), size).join(again, "node"))
    met = materialize(_meetings(sketches.where("n > 0")))
    pairs = materialize(met.where("can and first <> node").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct())
    links = materialize(_verified(pairs, sketches, texts, size))
    copies = nodes.where("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    links = links.unionByName(_across(met, links, pairs, sketches, texts, size)).select("a", "b")
    label = components(links.unionByName(copies)).withColumnRenamed("node", "doc_id")
    return sized.join(label, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The rows of docs, all columns, that stay: of each component the document with the smallest doc_id.

    Of rows that share a doc_id the one with the smallest text stays (nulls first); rows without doc_id all stay.
    """
    found = materialize(jaccard_components(docs, size))
    rows = without(docs, found.where("component_id <> doc_id").select("doc_id"))
    again = materialize(found.where("component_id = doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    if again.isEmpty():
        return rows
    order = Window.partitionBy("doc_id").orderBy("text")
    first = docs.join(small(again), "doc_id", "left_semi").withColumn("_order", F.row_number().over(order)).where("_order = 1")
    return without(rows, again).unionByName(first.select(*docs.columns))


ORACLE_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS shingles FROM d),
n AS MATERIALIZED (SELECT doc_id, len(shingles)::BIGINT AS n_shingles FROM s),
x AS MATERIALIZED (SELECT doc_id, unnest(list_transform(shingles, lambda t: hash(t))) AS shingle FROM s),
p AS (SELECT a.doc_id AS one, b.doc_id AS other, count(*) AS common FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT one, other FROM p JOIN n a ON a.doc_id = one JOIN n b ON b.doc_id = other WHERE 100 * common >= 75 * (a.n_shingles + b.n_shingles - common)),
r AS (SELECT doc_id, doc_id AS reached FROM n UNION SELECT r.doc_id, l.other FROM r JOIN l ON l.one = r.reached)
SELECT n.doc_id, n.n_shingles, min(r.reached) AS component_id FROM n JOIN r ON n.doc_id = r.doc_id GROUP BY ALL
"""
