import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotemill.llm import language_id, quality, toxicity


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    return read("documents"), read("labels")


def test_language_held_out(spark, tables):
    docs, _ = tables
    got = language_id.identify_held_out(docs).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.count() == docs.count()
    held = got.where("held_out").collect()
    right = np.mean([r.lang == r.lang_pred for r in held])
    assert right > 0.97, right
    assert np.mean([r.rejected for r in held]) < 0.01


def test_language_edges(spark, tables):
    docs, _ = tables
    model = language_id.fit(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (None, "der die und das ist nicht"), (4, "ж" * 400), (5, "the of and " * 200_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.identify(odd.withColumn("score", F.lit(1)), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[None].lang_pred == "de" and got[5].lang_pred == "en"
    assert got[4].rejected and got[1].rejected and not got[5].rejected
    none = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(odd, none).collect()} == {"und"}
    assert language_id.identify(odd.limit(0), model).count() == 0


def plain_grams(text):
    """Hashed letter trigrams one by one, as a dictionary."""
    low = "".join(c if ord(c) >= 0x250 or c.isalpha() else " " for c in (text or "").lower().replace("ς", "σ"))
    low = re.sub(" +", " ", f" {low} ") if text else ""
    out = {}
    for a, b, c in zip(low, low[1:], low[2:]):
        h = (ord(a) * 0x9E3779B1 & 0xFFFFFFFF) ^ (ord(b) * 0x85EBCA6B & 0xFFFFFFFF) ^ (ord(c) * 0xC2B2AE35 & 0xFFFFFFFF)
        h ^= h >> 15
        place = (h * 0x2C1B3C6D & 0xFFFFFFFF) >> 20
        out[place] = out.get(place, 0) + 1
    return out


@pytest.mark.parametrize("block", [1 << 20, 64, 7, 2, 1])
def test_gram_counts_by_plain_dictionaries_whatever_the_blocks(monkeypatch, block):
    monkeypatch.setattr(language_id, "_BLOCK", block)
    for text in ("Größe, the naïve  café: déjà vu. " * 9, "ΟΔΟΣ  Σ1ας--İx", "a", " ", "", "ab", "...", None, "x" * 130 + "   " + "y" * 70):
        counts = language_id.gram_counts(text)
        assert {i: int(n) for i, n in enumerate(counts) if n} == plain_grams(text), text


def test_language_by_plain_dictionaries(spark):
    words = {"en": "the and of with house river they were", "de": "der und nicht mit haus fluss sie waren"}
    rows = [(i, " ".join(words[lang].split()[(i + k) % 8] for k in range(6)), lang) for i in range(40) for lang in [("en", "de")[i % 2]]]
    docs = spark.createDataFrame([*rows, rows[0], (50, None, "en"), (51, "no language", None)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    learnt = [t for _, t, _ in [*rows, rows[0]]]
    seen = {}
    for t in learnt:
        for g in plain_grams(t):
            seen[g] = seen.get(g, 0) + 1
    idf = lambda g: math.log((len(learnt) + 1) / (seen.get(g, 0) + 1))
    assert np.allclose(model.idf, [idf(g) for g in range(language_id.DIMS)], atol=1e-5)
    assert sorted(set(model.languages)) == ["de", "en"] and np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-4)
    for r in language_id.identify(docs, model).join(docs, "doc_id").collect():
        weights = {g: math.log1p(n) * idf(g) for g, n in plain_grams(r.text).items()}
        size = math.sqrt(sum(w * w for w in weights.values()))
        cosines = [sum(w * float(c[g]) for g, w in weights.items()) / size if size else 0.0 for c in model.centroids]
        best = max(range(len(cosines)), key=lambda i: (cosines[i], -i))
        if r.text is None:
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert abs(r.score - min(1, max(0, cosines[best]))) < 1e-4
            assert r.lang_pred == model.languages[best] or max(c for c, l in zip(cosines, model.languages) if l == r.lang_pred) > cosines[best] - 1e-4
            assert r.rejected == (r.score < min(f for c, f in zip(cosines, model.floors) if c > cosines[best] - 1e-4))


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    y = np.array(y, bool)
    return (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet") for name in ("documents", "labels"))
    got = toxicity.score_held_out(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert auc([r.score for r in got], [r.toxic for r in got]) > 0.95
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.97


def test_toxicity_grammar():
    lexicon = toxicity.Lexicon({"idiot": 3.0}, {"scum": 2.0})
    mark = lambda text: dict(zip(toxicity.MARKS, np.expm1(toxicity.marks(text, lexicon)).round(6)))
    assert mark("you are an Idiot.")["aimed"] == 3 and mark("an idiot")["plain"] == 3 and mark("scummy thing")["plain"] == 2
    assert mark("not an idiot")["negated"] == 3 and mark("she said idiot things. fine")["reported"] == 3
    assert mark("I will kill you")["threat"] == 1 and mark("never kill them")["threat"] == 0 and mark("kill time")["threat"] == 0
    assert not any(mark("a fine day, you see").values()) and not any(mark("").values())


def test_toxicity_verbs_by_stem_and_ending_and_clitics():
    lexicon = toxicity.Lexicon({"idiot": 3.0}, {})
    mark = lambda text: dict(zip(toxicity.MARKS, np.expm1(toxicity.marks(text, lexicon)).round(6)))
    for text in ("I am killing you", "he kills them", "they shot her", "I'll burn your", "ich töte dich", "er schlägt euch", "sie verletzten ihn", "je vais te frapper, toi", "ils tuent vous", "te mataré", "voy a matarte", "golpeándolos", "they've been beaten"):
        assert mark(text)["threat"] == 1, text
    for text in ("I'm not killing you", "he isn't hurting them", "je n'ai pas frappé", "her mate hires you", "here he is", "hier ist er", "he said kill them", "you hold the killer whale", "un mat, ils"):
        assert not mark(text)["threat"], text
    assert mark("you're an idiot")["aimed"] == mark("you’re an idiot")["aimed"] == mark("t'es idiot")["aimed"] == mark("he's an idiot")["aimed"] == 3
    assert mark("it isn't idiot talk")["negated"] == 3 and mark("l'idiot")["plain"] == 3
    assert toxicity.words_of("qu'il n'est d'j'x don't o'clock y'all's") == ["qu'", "il", "n'", "est", "d'", "j'", "x", "do", "n't", "o'", "clock", "y'", "all", "'s"]
    every = [stem + ("" if e == "-" else e) for lang, groups in toxicity.STEMS.items() for g, ends in zip(groups.split("|"), toxicity.ENDINGS[lang].split("|")) for stem in g.split() for e in ends.split()]
    assert all((w in toxicity.THREATS) == (w not in toxicity.NOT_THREATS) for w in every)
    assert not any(w + "x" in toxicity.THREATS for w in every)


def test_toxicity_words_at_other_signs():
    lexicon = toxicity.Lexicon({"idiot": 3.0, "moron": 2.0}, {"scum": 2.0})
    whole = lambda text: np.log1p(sum(np.array(list(m.values())) for c in toxicity._CLAUSE.split(text) if (m := toxicity.clause_marks(toxicity._WORD.findall(c), lexicon))))
    for text in ("you-idiot", "you *idiot*", "well,moron", "<b>idiot</b>", "#idiot", "you/moron", "—idiot", "¡idiot!", "scummy***", "i will kill*** you"):
        assert any(toxicity.marks(text, lexicon)), text
        assert np.allclose(toxicity.marks(text, lexicon), whole(text)), text


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (1, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    got = toxicity.score_held_out(docs, labels).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_held_out(docs.limit(0), labels.limit(0)).count() == 0


def test_quality_shapes_see_whole_words():
    places = lambda word: set(quality.features(word)[0][1:].tolist())  # noqa: E731  (all but the hashed word)
    assert places("a" * 40 + "1B-") != places("a" * 43)


def test_quality_held_out(spark, tables):
    docs, labels = tables
    got = quality.grade_held_out(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert auc([r.tail for r in got], [r.quality for r in got]) > 0.9
    assert np.mean([r.keep == (r.quality == 1) for r in got]) > 0.85


def ordinal_loss(w, t, x, y):
    at_most = lambda k, z: 0.0 if k < 0 else 1.0 if k >= len(t) else 1 / (1 + math.exp(z - t[k]))
    total = 0.0
    for (places, values), k in zip(x, y):
        z = sum(w[p] * v for p, v in zip(places, values))
        total -= math.log(max(1e-12, at_most(k, z) - at_most(k - 1, z)))
    return total / len(y)


def test_quality_reaches_the_least_loss_of_a_plain_search():
    rnd = np.random.default_rng(2)
    x = [(np.array([0, 1]), rnd.normal(size=2).round(2)) for _ in range(80)]
    z = np.array([1.5 * v[0] - v[1] for _, v in x]) + rnd.logistic(size=80)
    y = (z > -0.7).astype(int) + (z > 1.1)
    w, t = quality.cumulative_link(x, y, 3, rounds=200)
    assert t[0] < t[1] and not w[2:].any()
    best, step = [0.0, 0.0, -0.5, 0.5], 0.5
    loss = ordinal_loss(best[:2], best[2:], x, y)
    while step > 1e-3:  # one number at a time, up or down
        moved = False
        for i in range(4):
            for way in (step, -step):
                tried = [v + way * (i == j) for j, v in enumerate(best)]
                if tried[2] < tried[3] and (new := ordinal_loss(tried[:2], tried[2:], x, y)) < loss - 1e-9:
                    best, loss, moved = tried, new, True
        step /= 1 if moved else 2
    assert ordinal_loss(w, t, x, y) < loss + 0.003
    assert np.allclose([*w[:2], *t], best, atol=0.15)


def test_quality_reads_grades_off_the_thresholds():
    model = quality.Model(np.zeros(quality.DIMS), np.array([-1.0, 0.5]), [0, 2, 5])
    upto = [1 / (1 + math.exp(1.0)), 1 / (1 + math.exp(-0.5))]
    each = [upto[0], upto[1] - upto[0], 1 - upto[1]]
    for text in ("some words", "", None):
        assert np.allclose(model.read(text, 2), (2 * each[1] + 5 * each[2], each[1] + each[2]))
        assert np.allclose(model.read(text, None), (2 * each[1] + 5 * each[2], each[2]))


def test_quality_orders_several_grades(spark):
    text = {0: "bad bad bad", 1: "so so text", 2: "a good text", 3: "very fine prose"}
    docs = spark.createDataFrame([(i, text[i % 4] + f" w{i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 4) for i in range(400)] + [(None, 1), (7, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert model.grades == [0, 1, 2, 3] and (np.diff(model.thresholds) > 0).all()
    got = quality.grade(docs, model, least=2).join(labels, "doc_id").where("quality is not null").collect()
    means = [np.mean([r.expected_grade for r in got if r.quality == g]) for g in range(4)]
    assert means == sorted(means) and means[3] - means[0] > 2
    assert np.mean([r.keep == (r.quality >= 2) for r in got]) > 0.95
    none = quality.grade(docs.limit(3), quality.fit(docs, labels.limit(0))).collect()
    assert len(none) == 3 and none[0].keep is None
    assert quality.grade(spark.createDataFrame([(None, None)], "doc_id long, text string"), model).first().tail is not None


def test_composed_machines_read_as_a_plain_look_around_every_place():
    import random

    from quotemill.llm import toxicity

    lexicon = toxicity.Lexicon({"idiot": 2.0, "moron": 1.5}, {"scum": 1.0})
    vocabulary = ["idiot", "moron", "scummy", "you", "he", "not", "never", "said", "kill", "hurt", "a", "b", "c", "d"]
    rnd = random.Random(5)
    for _ in range(3000):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randrange(16))]
        want = dict.fromkeys(toxicity.MARKS, 0.0)
        for i, w in enumerate(words):
            negated, reported = any(x in toxicity.NEGATIONS for x in words[max(0, i - 3) : i]), any(x in toxicity.REPORTS for x in words[:i])
            aimed = any(x in toxicity.TARGETS for x in words[max(0, i - 6) : i] + words[i + 1 : i + 7])
            if weight := lexicon.insult(w):
                want["reported" if reported else "negated" if negated else "aimed" if aimed else "plain"] += weight
            elif w in toxicity.THREATS and aimed and not negated and not reported:
                want["threat"] += 1.0
        want["clauses"] = float(any(want.values()))
        got = toxicity.clause_marks(words, lexicon)
        assert got == want or got is None and not want["clauses"]
