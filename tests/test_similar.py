import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quotemill.functions import grams as G
from quotemill.functions import similarity as S
from quotemill.operators import similar as Y


def plain_similarity(query, text):
    """By definition: every stretch of the text's trigrams."""
    cut = lambda s: [f"  {w} "[i : i + 3] for w in s.split() for i in range(len(w) + 1)]
    wanted, have, best = set(cut(query)), cut(text), 0.0
    for a in range(len(have)):
        for b in range(a + 1, len(have) + 1):
            kinds = set(have[a:b])
            best = max(best, len(kinds & wanted) / len(kinds | wanted))
    return best


def keys(rnd, n, words=("ab", "abc", "bca", "é", "cab", "🙂a", "aa", "baab"), longest=9):
    return [" ".join(rnd.choice(words) for _ in range(rnd.randrange(longest))) for _ in range(n)]


def test_word_similarity_is_the_best_stretch():
    rnd = random.Random(1)
    for a, b in zip(keys(rnd, 200, longest=5), keys(rnd, 200)):
        assert G.word_similarity(a, b) == pytest.approx(plain_similarity(a, b))
    assert G.word_similarity("", "a") == 0 and G.word_similarity("a", "") == 0 and G.word_similarity("ab", "x ab y") == 1


def test_windows_hold_every_short_stretch():
    rnd = random.Random(2)
    for _ in range(100):
        row = G.grams(" ".join(keys(rnd, 3)))
        for kinds in (1, 2, 5, 9):
            spans, at = [], 0
            for w in G.windows(row, kinds):
                at = next(i for i in range(at, len(row) + 1) if (row[i : i + len(w)] == w).all())
                spans.append((at, at + len(w)))
            for a in range(len(row)):
                for b in range(a + 1, len(row) + 1):
                    if len(set(row[a:b].tolist())) <= kinds:
                        assert any(x <= a and b <= y for x, y in spans)


@pytest.mark.parametrize("least", [0.35, 0.6])
def test_word_similar_against_every_pair(spark, least):
    rnd = random.Random(3)
    texts = keys(rnd, 60, longest=30)
    probes = keys(rnd, 40, longest=6) + [t[: len(t) // 2] for t in texts[:20]]
    found = Y.word_similar(spark.createDataFrame(list(enumerate(probes)), "probe_id int, probe string"), spark.createDataFrame(list(enumerate(texts)), "class_id int, key string"), least)
    want = {(i, j): s for i, p in enumerate(probes) for j, t in enumerate(texts) if (s := plain_similarity(p, t)) >= least - 1e-12 and p}
    got = {(r.probe_id, r.class_id): r.similarity for r in found.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_top_similar_takes_equal_keys_by_id(spark):
    records = [(i, "one two three") for i in (9, 4, 7, 4, None)] + [(1, "one two four"), (2, None), (3, "")]
    found = Y.top_similar(spark.createDataFrame([(0, "two three"), (1, "")], "probe_id int, probe string"), spark.createDataFrame(records, "record_id int, key string"), 0.3, 3)
    assert [(r.record_id, r.similarity, r.rank) for r in found.orderBy("rank").collect()] == [(4, 1.0, 1), (7, 1.0, 2), (9, 1.0, 3)]


def edited(rnd, text):
    out = list(text)
    for _ in range(rnd.randrange(1 + len(text) // 8)):
        at = rnd.randrange(len(out) + 1)
        kind = rnd.choice("iids")
        if kind == "i" or not out:
            out.insert(at, rnd.choice("abc é"))
        elif kind == "d":
            del out[min(at, len(out) - 1)]
        else:
            out[min(at, len(out) - 1)] = rnd.choice("abc é")
    return "".join(out)


@pytest.mark.parametrize("least", [90, 75])
def test_near_equal_against_every_pair(spark, least):
    rnd = random.Random(4)
    seed = ["a", "ab", "abc", "abcdé", "", None] + ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randrange(1, 90))) for _ in range(60)]
    inputs = [edited(rnd, rnd.choice(seed) or "x") for _ in range(150)] + ["a", "b", "", None]
    df = lambda rows: spark.createDataFrame([(k, 1) for k in rows], "key string, n int")
    got = {(r.input_key, r.seed_key): r.ratio for r in Y.near_equal(df(inputs), df(seed), least).collect()}
    want = {(a, b): S.ratio(a, b) for a in set(inputs) for b in set(seed) if a and b and S.ratio(a, b) >= least}
    assert got == want
    left = sorted(r.key or "-" for r in Y.unseen(df(inputs), df(seed), least).collect())
    assert left == sorted(k or "-" for k in inputs if not any(a == k for a, _ in want))


def test_near_pairs_of_all_lengths_with_few_verified():
    rnd = random.Random(5)
    seeds = list({"".join(rnd.choice("abcdefgh 🙂") for _ in range(n)) for n in [*range(1, 12), 62, 63, 64, 126, 127, 300, 503, 506, 900] for _ in range(3)})
    inputs = list({edited(rnd, rnd.choice(seeds)) for _ in range(400)} - {""})
    for least in (90, 75):
        got = {(a, b): r for found in G.near_pairs(inputs, seeds, least) for a, b, r in zip(*found)}
        assert got == {(a, b): S.ratio(a, b) for a in inputs for b in seeds if S.ratio(a, b) >= least}
    asked = []
    others = ["".join(rnd.choice("ijklmnop ") for _ in range(80)) for _ in range(300)]
    kept, G._verified = G._verified, lambda keys, seeds, i, j, least: asked.append(len(i)) or ([], [], [])
    try:
        list(G.near_pairs(others, [s for s in seeds if len(s) > 11], 90))
    finally:
        G._verified = kept
    assert sum(asked) == 0


def test_empty(spark):
    none = spark.createDataFrame([], "key string")
    some = spark.createDataFrame([("abc",)], "key string")
    assert Y.near_equal(none, some).count() == 0 and Y.unseen(some, none).count() == 1
    assert Y.word_similar(some.select(F.lit(1).alias("probe_id"), F.col("key").alias("probe")), none.select(F.lit(1).alias("class_id"), "key"), 0.5).count() == 0


def test_run_codes_are_one_number_for_equal_runs(monkeypatch):
    rnd = random.Random(6)
    keys = [None, "", "a", " b", "ab ", "é 🙂 c"] + [" ".join(rnd.choice(["ab", "b", "é", "cab", "zz"]) for _ in range(rnd.randrange(9))) for _ in range(300)]
    for together in (1 << 20, 50, 1):
        monkeypatch.setattr(G, "_BYTES", together)
        for width, inner in ((1, False), (3, False), (3, True)):
            got = [x for at, row, code, size in G.run_codes(pa.array(keys, pa.string()), width, inner) for x in zip((at + row).tolist(), code.tolist(), size.tolist())]
            words = [(i, k.split(" ")[1:-1] if inner else k.split(" ")) for i, k in enumerate(keys) if k]
            want = [(i, " ".join(w[j : j + width])) for i, w in words for j in range(len(w) - width + 1)]
            assert [(i, n) for i, _, n in got] == [(i, len(run.encode())) for i, run in want]
            assert len({(run, code) for (_, run), (_, code, _) in zip(want, got)}) == len({run for _, run in want}) == len({code for _, code, _ in got})


def test_bounds_hold_the_best_stretch_and_lose_none():
    rnd = random.Random(7)
    texts = keys(rnd, 30, longest=60) + [" ".join(["ab abc bca é"] * 200 + ["baab"] + ["cab aa"] * 150)]  # lines that come again: blocks become larger
    probes = [np.unique(G.grams(p)) for p in keys(rnd, 25, longest=12) + ["ab baab cab"] if p]
    asked = G.Queries(probes)
    for text in filter(None, texts):
        row = G.grams(text)
        want = np.array([G.best_extent(p, row) for p in probes])
        for size in (4, 16):
            upper, lower = asked.bounds(asked.places(row), G.last_places(row), size, np.arange(len(probes)), np.full(len(probes), 1e-3))
            assert (lower <= want + 1e-6).all() and (want <= upper + 1e-6).all()
        least = np.array([rnd.choice([0.2, 0.5, w]) for w in want]).clip(0.05)
        some = G.candidates(asked, row, least)[0]
        assert set(np.flatnonzero(want >= least)) <= set(some.tolist())
        assert [x for x in G.best_extents(probes, row, least)] == [w if w >= x - G.HAIR else 0.0 for w, x in zip(want, least)]


def test_top_similar_against_every_pair(spark, monkeypatch):
    monkeypatch.setattr(Y, "KEYS_TOGETHER", 200)
    monkeypatch.setattr(Y, "PROBES_TOGETHER", 8)
    rnd = random.Random(8)
    texts = keys(rnd, 80, longest=40)
    probes = keys(rnd, 20, longest=6) + [" ".join(f"{rnd.choice('abc')}{i}xy" for i in range(30))]
    df = lambda rows, names: spark.createDataFrame(list(enumerate(rows)), names)
    got = {(r.probe_id, r.rank): (r.record_id, r.similarity) for r in Y.top_similar(df(probes, "probe_id int, probe string"), df(texts, "record_id int, key string"), 0.35, 3).collect()}
    want = {}
    for i, p in enumerate(probes):
        best = sorted((-G.word_similarity(p, t), j) for j, t in enumerate(texts) if p and G.word_similarity(p, t) >= 0.35)[:3]
        want |= {(i, rank): (j, -s) for rank, (s, j) in enumerate(best, 1)}
    assert got == want
