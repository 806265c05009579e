import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from quotemill.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def grow(level):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def beside(levels, at):
    """(is on the left, digest) of the siblings on the way up; None where there is none."""
    for level in levels[:-1]:
        other = at ^ 1
        yield (other < at, level[other]) if other < len(level) else None
        at //= 2


def wanted(rows):
    trees = {}
    for lang in {r[2] for r in rows}:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: ((r[0] is not None, r[0] or 0), leaf(r)))
        trees[lang] = mine, grow([leaf(r) for r in mine])
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    top = grow([trees[x][1][-1][0] for x in langs])
    root = top[-1][0]
    for i, lang in enumerate(langs):
        mine, levels = trees[lang]
        for at, r in enumerate(mine):
            path = [*beside(levels, at), *beside(top, i)]
            hit = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = leaf((*r[:3], r[3] + 1, r[4])) if hit else leaf(r)
            for step in path:
                h = H(h) if step is None else H(step[1], h) if step[0] else H(h, step[1])
            yield r[0], leaf(r), levels[-1][0], root, H(*(s[1] for s in path if s)), h, h == root


def made(n, langs=("en", "de", "é", "")):
    rnd = random.Random(n)
    rows = [(i, rnd.choice(["a", None, "s t"]), rnd.choice(langs), rnd.choice([None, 0, 9, 2**63 - 1]), rnd.choice([None, "", "x", "é🙂\x00 y" * 9])) for i in rnd.sample(range(-50, 10**9), n)]
    return rows + [(5, "a", None, 1, "t"), (5, "a", None, 1, "t"), (5, "b", None, 1, "t"), (None, None, None, None, None), (None, "q", "lone", 3, "z" * 70_000)]


def text_free(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("height", [1, 3, 10])
def test_against_plain_python(spark, monkeypatch, height):
    monkeypatch.setattr(manifest, "HEIGHT", height)
    rows = made(150)
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", root int")
    assert text_free(tuple(r) for r in manifest.proved(df).collect()) == text_free(wanted(rows))


def test_against_sql(spark):
    rows = [(i, s, g, min(n or 0, 99) if n is not None else None, t and t.replace("\x00", "")) for i, s, g, n, t in made(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    assert text_free(con.sql(manifest.ORACLE_SQL).fetchall()) == text_free(tuple(r) for r in manifest.proved(df).collect())


@pytest.mark.parametrize("rows", [[], [(7, "s", "en", 1, "x")], [(7, "s", None, 1, "x"), (8, "s", "en", None, "x")]])
def test_few_rows(spark, rows):
    got = [tuple(r) for r in manifest.proved(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert text_free(got) == text_free(wanted(rows) if rows else [])


def test_addresses_are_aligned_subtrees():
    def laid(height, nodes):
        """The order by definition: upper half, then each lower subtree, recursively. nodes: levels of labels."""
        if height == 1:
            return list(nodes[0])
        upper = height // 2
        out = laid(upper, nodes[:upper])
        for s in range(1 << upper):
            out += laid(height - upper, [level[s << d : s + 1 << d] for d, level in enumerate(nodes[upper:])])
        return out

    for height in range(1, 9):
        want = laid(height, [[(d, i) for i in range(1 << d)] for d in range(height)])
        for d in range(height):
            at = manifest.address(height, d, np.arange(1 << d))
            assert [want[x] for x in at] == [(d, i) for i in range(1 << d)]


def test_stored_siblings():
    for n in (1, 2, 5, 8):
        leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
        levels = grow([x.hex() for x in leaves])
        for climb in (len(levels) - 1, len(levels) + 1):
            grown = manifest.grown(leaves, climb)
            tree = manifest.Subtree(grown, n, climb)
            paths = list(zip(*tree.siblings())) or [()] * n
            assert {manifest.folded(x.hex(), p) for x, p in zip(leaves, paths)} == {grown[: manifest.DIGEST].hex()}
            assert all(manifest.path_read(manifest.path_bytes(p)) == list(p) for p in paths)
