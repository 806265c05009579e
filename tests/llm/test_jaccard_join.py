import itertools
import random
import re

import duckdb
import numpy as np

from quotemill.llm import jaccard_join as jj


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def made():
    """Groups of near copies, some with a passage that many documents share, exact copies, and odd rows."""
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    passage = " ".join(rnd.choice(words) for _ in range(60))
    rows = []
    for _ in range(60):
        base = [rnd.choice(words) for _ in range(rnd.choice([3, 4, 5, 6, 8, 12, 20, 40, 150, 300]))]
        for _ in range(rnd.choice([1, 1, 2, 5, 12])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 5])):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            rows.append((len(rows) * 3, (passage + " ") * (rnd.random() < 0.2) + " ".join(w)))
    return rows + [(9001, None), (9002, ""), (9003, "  \n"), (None, "a b"), (9004, rows[0][1]), (9004, rows[0][1]), (9005, "One"), (9006, "one")]


def test_components_against_every_pair(spark):
    rows = made()
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            low, high = sorted((find(i), find(j)))
            parent[high] = low
    want = sorted((i, len(s), find(i)) for i, s in sets)
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, component_id int")
    got = jj.jaccard_components(df).collect()
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == want
    assert [tuple(r) for r in got if r.doc_id is None] == [(None, 1, None)]


def test_empty(spark):
    assert jj.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketches_never_exceed_the_difference():
    rnd = np.random.default_rng(1)
    for n in (1, 5, 60, 700, 9000):
        a = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[: max(1, n * 9 // 10)], rnd.integers(0, 1 << 63, n // 10, dtype=np.uint64))))
        differ = len(np.setxor1d(a, b))
        assert jj.hamming(jj.dense_sketch(a), jj.dense_sketch(b)) <= differ
        for scope in set(jj.scopes(len(a))) & set(jj.scopes(len(b))):
            x, y = jj.piece_keys(a, scope), jj.piece_keys(b, scope)
            assert len(np.setdiff1d(x, y)) <= differ


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (5, 5)]
    got = {r.node: r.component for r in jj.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {n: c for n, c in got.items() if n <= 40} == {n: 0 for n in range(1, 41)} and got[102] == 100


def test_components_against_sql(spark):
    seen = {}
    for i, t in made():
        if i is not None:
            seen.setdefault(i, t)
    df = spark.createDataFrame(list(seen.items()), "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jj.jaccard_components(df).collect())
    assert sorted(con.sql(jj.ORACLE_SQL).fetchall()) == got
