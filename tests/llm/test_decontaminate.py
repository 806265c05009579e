import random

from quotemill.llm import decontaminate as dc


def distance(item, text):
    """Least edit distance of item to any stretch of text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        before, row = row, [i]
        for j, b in enumerate(text, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (a != b)))
    return min(row)


def test_myers_equals_the_table():
    rnd = random.Random(2)
    for _ in range(600):
        item = "".join(rnd.choice("abc ") for _ in range(rnd.randrange(1, 90)))
        text = "".join(rnd.choice("abc ") for _ in range(rnd.randrange(0, 120)))
        k = rnd.randrange(0, 30)
        best, end = dc.myers(item, text, k)
        want = distance(item, text)
        assert (best == want and distance(item, text[:end]) == want) if want <= k else best == k + 1


def test_against_brute_force(spark):
    rnd = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "zeta", "eta"]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, say(rnd.choice([8, 20, 40]))) for i in range(12)] + [(50, None), (51, " .,"), (52, "Zeta!"), (0, say(25))]
    docs = []
    for d in range(120):
        text = list(say(rnd.randrange(5, 60)))
        if d % 3 == 0:
            passage = list(rnd.choice(items[:12])[1])
            for _ in range(rnd.randrange(0, len(passage) // 8)):
                at = rnd.randrange(len(passage))
                passage[at : at + 1] = rnd.choice([[], ["x"], [passage[at], "q"]])
            text += list(". ") + passage + list(" " + say(5))
        docs.append((d, "".join(text).title() if d % 2 else "".join(text)))
    docs += [(500, None), (501, ""), (None, items[0][1])]
    want = set()
    for d, text in docs:
        plain = dc.normalised(text or "")
        for i, item in items:
            item = dc.normalised(item or "")
            k = dc.edits_allowed(len(item))
            if item and len(item) >= 20 and distance(item, plain) <= k:
                want.add((d, i))
            elif item and len(item) < 20 and f" {item} " in f" {plain} ":
                want.add((d, i))
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = dc.leaks(df, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    exact = [r for r in got if r.distance == 0 and r.item_id in range(1, 12)]
    assert exact and all(dc.normalised(dict(docs)[r.doc_id][r.start : r.end]) == dc.normalised(dict(items)[r.item_id]) for r in exact)
    kept = dc.without_leaks(df, benchmark)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs if d is None or not any(d == x for x, _ in want)}


def test_blocks_and_empty(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_CHARS", 1)
    docs = spark.createDataFrame([(1, "abc def ghi jkl mno pqr"), (2, "other things here")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "abc def ghi jkl mno pqr"), (2, "other things here")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.distance) for r in dc.leaks(docs, items).collect()) == [(1, 1, 0), (2, 2, 0)]
    assert dc.leaks(docs, items.limit(0)).count() == 0 and dc.leaks(docs.limit(0), items).count() == 0
