import itertools
import random
import re

import numpy as np
import xxhash

from quotemill.llm import simhash


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(prints, radius=3):
    """Smallest member of each one's component, by every pair."""
    up = {p: p for p in prints}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= radius:
            low, high = sorted((top(a), top(b)))
            up[high] = low
    return {p: top(p) for p in prints}


def ball(rnd, n):
    """Centres with others a few flipped bits away, and chains."""
    out = set()
    while len(out) < n:
        x = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 2, 6])):
            out.add(x)
            for b in rnd.sample(range(64), rnd.choice([1, 2, 3, 4, 5])):
                x ^= 1 << b
    return sorted(out)


def test_fingerprints_against_plain_python():
    rnd = random.Random(5)
    words = ["Ab", "c", "É", "ß🙂", "word", "longer-word", " x"]
    texts = [None, "", " \n", "One", "one TWO", "a\tb\x0bc  d"] + [" ".join(rnd.choice(words) for _ in range(n)) for n in (3, 4, 50, 700)]
    assert [simhash.fingerprint(t) for t in texts] == [plain(t) for t in texts]


def test_long_texts_are_cut_between_words(monkeypatch):
    rnd = random.Random(6)
    text = " ".join("w" * rnd.randrange(1, 30) + str(rnd.randrange(40)) for _ in range(900))
    want = plain(text)
    for block in (7, 64, 1000):
        monkeypatch.setattr(simhash, "_BLOCK", block)
        assert simhash.fingerprint(text) == want and simhash.fingerprint("  " + text + "\n\n") == want


def test_parts_are_linear():
    x, y = np.random.default_rng(2).integers(0, 1 << 63, (2, 500), dtype=np.uint64)
    assert (simhash.home(x ^ y, 9) == simhash.home(x, 9) ^ simhash.home(y, 9)).all() and len(set(simhash.home(x, 3).tolist())) == 8


def test_every_pair_within_the_radius_meets():
    rnd = random.Random(7)
    prints = ball(rnd, 300)
    x = np.array(prints, np.uint64)
    for bits in (0, 3):
        met = set()
        shown = {}
        for part in range(1 << bits):
            v, of, two = simhash.variants(x, part, bits)
            assert (simhash.home(v, bits) == part).all()
            for a, b, t in zip(v.tolist(), of.tolist(), two.tolist()):
                shown.setdefault(a, []).append((b, t))
        for there in shown.values():
            met |= {tuple(sorted((a, b))) for (a, s), (b, t) in itertools.combinations(there, 2) if not (s and t)}
        want = {(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= 3}
        assert want == met


def test_components_against_every_pair(spark):
    prints = ball(random.Random(8), 400)
    want = grouped(prints)
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    for part in (simhash.PART, 20_000):  # one part, and many
        edges = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(df, part).collect()]
        up = {p: p for p in prints}

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            low, high = sorted((top(a), top(b)))
            up[high] = low
        assert {p: top(p) for p in prints} == want


def test_documents_against_every_pair(spark):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for _ in range(40):
        base = [rnd.choice(words) for _ in range(rnd.choice([2, 5, 40, 300]))]
        for _ in range(rnd.choice([1, 2, 5])):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 2])):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            rows.append((len(rows) * 5 + 3, " ".join(w)))
    rows += [(1, None), (9001, ""), (9002, " \n"), (None, "a b"), (9003, rows[0][1]), (9003, rows[9][1]), (9003, rows[9][1]), (9004, "ONE"), (9005, "one")]
    known = [(i, plain(t)) for i, t in rows if i is not None]
    top = grouped(sorted({p for _, p in known}))
    least: dict = {}
    joined = {top[p]: top[p] for _, p in known}  # 9003 joins what its two texts are in
    both = sorted({top[p] for i, p in known if i == 9003})
    joined = {k: both[0] if k in both else k for k in joined}
    for i, p in known:
        k = joined[top[p]]
        least[k] = min(i, least.get(k, i))
    want = sorted((i, f"{p:016x}", least[joined[top[p]]]) for i, p in known)
    df = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id long, component_id string")
    got = [tuple(r) for r in simhash.near_duplicates(df).collect()]
    assert sorted(r for r in got if r[0] is not None) == want
    assert [r for r in got if r[0] is None] == [(None, f"{plain('a b'):016x}", None)]


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
