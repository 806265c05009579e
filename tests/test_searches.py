"""Wordings side by side, notes that answer, nearest vectors in cells."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from quotemill.functions import similarity as S
from quotemill.functions import wording as W
from quotemill.operators import evaluate as E
from quotemill.operators import matching as M
from quotemill.operators import report as R
from quotemill.operators import retrieval
from quotemill.operators import rulings as RU


def test_runs_rebuild_both_sides():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rnd.choice(["One", "two,", "three", "Two", "«four»", " ", "  ", "\n"]) + rnd.choice(["", " "]) for _ in range(rnd.randrange(12))) for _ in range(2))
        left, right = W.compared(a, b, trim=False)
        assert "".join(r["t"] for r in left) == a.strip() and "".join(r["t"] for r in right) == b.strip()
        assert all(x["k"] != y["k"] for side in (left, right) for x, y in zip(side, side[1:]))
        kept = [[W.word_key(w) for r in side if r["k"] == "eq" for w in r["t"].split()] for side in (left, right)]
        assert kept[0] == kept[1]


@pytest.mark.parametrize("text, source, left, right", [
    ("the best of you", "The best, of us", [("the best of ", "eq"), ("you", "del")], [("The best, of ", "eq"), ("us", "ins")]),
    ("seek knowledge", "he said to them all: seek knowledge from the cradle", [("seek knowledge", "eq")], [("… ", "eq"), (" seek knowledge ", "eq"), (" …", "eq")]),
    ("قَالَ نعم", "قال نعم", [("قَالَ نعم", "eq")], [("قال نعم", "eq")]),
    ("", "word", [], [("word", "ins")]),
])
def test_compared(text, source, left, right):
    got = W.compared(text, source)
    assert [[(r["t"], r["k"]) for r in side] for side in got] == [left, right]


@pytest.mark.parametrize("heard, source, want", [
    ("لو لا ان اشق", "لولا أن أشق على أمتي", "لولا ان اشق"),
    ("شفاع يوم القيامه", "شفاعة يوم القيامة", "شفاعة يوم القيامه"),
    ("صلى شفاعت يصل", "صلى شفاعت يصلي", "صلى شفاعت يصلي"),
    ("حبل من ليف", "حبل من ليث", None),  # another word stays
    ("some thing was said twice", "something was said", "something was said twice"),
    ("", "x", None),
])
def test_snapped(heard, source, want):
    assert W.snapped(heard, source) == want


def test_snapping_puts_nothing_in():
    rnd = random.Random(2)
    for _ in range(300):
        source = [rnd.choice(["الكتاب", "كتاب", "امرئ", "يصلي", "شفاعه", "علم", "نور"]) for _ in range(8)]
        heard = " ".join(rnd.choice([w, w, w[1:], w[:-1], w[:2] + " " + w[2:], "غيره", ""]) for w in source)
        out = W.snapped(heard, " ".join(source))
        if out is not None:
            assert W.skeleton([W.word_key(w) for w in out.split()]) == W.skeleton([W.word_key(w) for w in W.shown_words(heard)])


def test_cards(spark):
    rows = [("he fought a holy war in it", 'Narrated Umar: I heard him saying, "He fought a war in it for long"', 1), ("same words are here", "same words are here", 2), ("x", "", 3), (None, "words that are approved", 4)]
    cards = R.translation_cards(spark.createDataFrame(rows, "user_text string, text_en string, id int"), [("both in", r"\bin\b", r"\bin\b")], [("jihad", ["holy war"])])
    got = {r.id: r for r in cards.collect()}
    assert got.keys() == {1, 2} and got[1].approved_text == "He fought a war in it for long" and got[1].issues == ["both in", "jihad"] and got[1].needs_fix
    assert not got[2].needs_fix and [(r.t, r.k) for r in got[2].user_runs] == [("same words are here", "eq")]


def test_notes_against_every_pair(spark):
    rnd = random.Random(3)
    words = ["ruling", "source", "privacy", "voice", "share", "ai", "grade"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    notes = [(i, [text(4), text(7), ""], [rnd.choice(words)]) for i in range(12)] + [(20, [], ["share"]), (21, None, None), (None, ["x"], [])]
    questions = [(i, text(rnd.randrange(1, 6))) for i in range(30)] + [(40, None), (41, ""), (None, "share")]
    got = sorted(tuple(r) for r in retrieval.answering(spark.createDataFrame(questions, "question_id long, key string"), spark.createDataFrame(notes, "note_id long, texts array<string>, keywords array<string>")).collect())
    want = []
    for q, key in questions:
        if q is None or not key:
            continue
        scores = []
        for n, texts, keywords in notes:
            if n is not None and texts:
                boost = 0.3 if any(len(k) >= 3 and k in key for k in keywords) else 0
                scores.append((-round(max(float(retrieval.embedded(t) @ retrieval.embedded(key)) for t in texts) + boost, 6), n))
        want += [(q, n, -s, i) for i, (s, n) in enumerate(sorted(scores)[:2], 1) if -s >= 0.4]
    assert got == sorted(want)


@pytest.mark.parametrize("cells, together", [(1, 1024), (7, 16)])
def test_nearest_against_every_pair(spark, monkeypatch, cells, together):
    monkeypatch.setattr(M, "TOGETHER", together)
    rnd = np.random.default_rng(4)
    x = np.concatenate((rnd.normal(size=(150, 6)), np.tile(rnd.normal(size=6), (60, 1)) + rnd.normal(scale=0.01, size=(60, 6))))  # a hot cell
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, [0.0] * 6), (901, None), (None, [1.0] * 6), (902, x[3].tolist())]
    df = spark.createDataFrame(rows, "row_id long, vector array<double>")
    queries = df.where("row_id % 9 = 0 or row_id is null").withColumnRenamed("row_id", "query_id")
    got = sorted((r.query_id, r["rank"], r.row_id, r.cosine) for r in M.nearest(queries, df, 5, cells).collect())
    real = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if i is not None and v and any(v)}
    want = []
    for q in (i for i in real if i % 9 == 0):
        best = sorted((-round(float(real[q] @ v), 6), i) for i, v in real.items())[:5]
        want += [(q, n, i, -c) for n, (c, i) in enumerate(best, 1)]
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)] and all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, sorted(want)))
    assert M.nearest(queries, df.limit(0), 5, cells).count() == 0


def test_searches_against_every_pair(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(14)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    sayings = [(i, text(rnd.randrange(1, 14))) for i in range(25)] + [(90, None), (91, ""), (92, "unheard words")]
    cards = [(i, text(rnd.randrange(1, 40)), rnd.choice(["حديث صحيح", "موضوع", ""])) for i in range(60)] + [(90, None, ""), (91, "", "")]
    cards += [(100 + i, f"{text(3)} {k} {text(3)}", "حديث صحيح") for i, (_, k) in enumerate(sayings[:9])]
    s, c = spark.createDataFrame(sayings, "saying int, key string"), spark.createDataFrame(cards, "card_id int, key string, grade string")
    want = {}
    for i, k in sayings:
        for j, t, _ in cards:
            w = (k or "").split()
            forms = [w[:10]] + ([[w[0], w[-1]]] if len(w) >= 3 else [])
            if k and t and any(set(f) <= set(t.split()) for f in forms):
                want[i, j] = S.partial_ratio(k, t)
    got = {(r.saying, r.card_id): r.similarity for r in RU.found_cards(s, c).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    sound = {j for j, _, g in cards if g == "حديث صحيح"}
    free = {i for i, _ in sayings if not any(a == i and b in sound and x >= 80 for (a, b), x in want.items())}
    assert {r.saying for r in RU.unblocked_by_search(s, c).collect()} == free and not free & set(range(9))


@pytest.mark.parametrize("word", ["شفاعة", "صلى", "knowledge", "abc", "كتاب"])
def test_typos_are_one_slip(spark, word):
    rows = spark.createDataFrame([(i, word) for i in range(40)], "k long, w string")
    got = {r[0] for r in rows.select(E.typo(F.col("k"), F.col("w"))).collect()}
    if len(word) < 4 and word != "صلى":
        assert got == {word}
        return
    form = word.replace("ة", "ه") if "ة" in word else word.replace("ى", "ي") if "ى" in word else word[:-1]
    dropped = {word[:i] + word[i + 1 :] for i in range(1, len(word) - 1)}
    swapped = {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(1, len(word) - 1)}
    assert got <= {form} | dropped | swapped | ({word} if len(word) < 4 else set()) and (len(word) < 4 or form in got)
