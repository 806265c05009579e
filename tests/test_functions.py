"""Keys, rules and similarities on small cases with known results; Arabic cases are inline, as no table holds any."""

import random

import pytest
from pyspark.sql import functions as F

from quotemill.functions import similarity as S
from quotemill.functions import spans as P
from quotemill.functions import text as X
from quotemill.operators import evaluate as E
from quotemill.operators import maintain as K
from quotemill.operators import matching as M
from quotemill.streaming import state as T


def column(spark, make, *values, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    return [r[0] for r in spark.createDataFrame(rows, f"i int, c {kind}").orderBy("i").select(make(F.col("c"))).collect()]


def test_keys(spark):
    assert column(spark, X.strip_marks, "إِنَّمَا", None) == ["إنما", None]
    assert column(spark, X.arabic_key, "إِنَّمَا الأَعْمَالُ بِالنِّيَّاتِ،", "٢٠٢٤ صلاة", "") == ["انما الاعمال بالنيات", "2024 صلاه", ""]
    assert column(spark, X.latin_key, "The “Best” of you—don’t!", "ﬁne  ＡＢ") == ["the best of you don't", "fine ab"]
    assert column(spark, X.matching_key_ar, "قال رسول الله ﷺ: «إنما الأعمال بالنيات» رواه البخاري", "حديث شريف: الدين النصيحة والخير") == ["انما الاعمال بالنيات", "الدين النصيحه والخير"]
    assert column(spark, X.arabic_digits, "105") == ["١٠٥"]
    assert column(spark, X.display_number, "8.02", "8", "8.10") == ["8b", "8", "8a"]
    assert column(spark, X.page_number, "3/125", "7") == ["125", "7"]
    assert column(spark, X.clean_translation, "12. In the name<sup foot_note=1>1</sup> of") == ["In the name of"]
    assert column(spark, X.reflow, "a wrap-\nped line\nnext\n\n\nsecond") == ["a wrapped line next\n\nsecond"]


def test_languages(spark):
    assert column(spark, X.script, "قال hi", "hello world", "", "123") == ["ar", "en", "ar", "ar"]
    assert column(spark, X.script_or_null, "123", "abc") == [None, "en"]
    got = column(spark, X.script_language, "إنما الأعمال بالنيات", "Actions are by intentions and the people", "les actions ne sont que par les intentions", "یہ کتاب اچھی ہے", "Muhammad صلى الله عليه وسلم said this to me")
    assert got == ["ar", "en", "other", "other", "en"]


def test_windows_and_probes(spark):
    long = " ".join(f"w{i}" for i in range(40))
    (found,) = column(spark, X.windows, long)
    assert [w.split()[0] for w in found] == ["w0", "w10", "w20"] and all(len(w.split()) == 16 for w in found)
    assert column(spark, X.windows, "a b", "") == [["a b"], []]
    (found,) = column(spark, X.probes, long)
    assert [p.split()[0] for p in found] == ["w0", "w13", "w26"]
    assert column(spark, X.content_words, "the best of you are those") == [["best", "you", "those"]]


def test_rules(spark):
    assert column(spark, X.ruling_family, "حسن صحيح", "ضعيف جدا", "لا أصل له", "آية", "شاذ", None) == ["sahih", "daif", "mawdu", "ayah", "other", "other"]
    assert column(spark, X.unreliable, "موضوع", "صحيح") == [True, False]
    assert column(spark, lambda c: X.asks_for_text(X.arabic_key(c), X.latin_key(c)), "Write me a hadith about trees", "اكتب لي حديثا", "the best of deeds") == [True, True, False]
    assert column(spark, lambda c: X.asks_for_ruling(X.arabic_key(c), X.latin_key(c)), "Is it halal to eat this?", "هل يجوز لي", "actions are by intentions") == [True, True, False]
    assert column(spark, lambda c: X.attributed(c, X.latin_key(c)), "The Prophet said: seek", "قال رسول الله كذا", "a plain line") == [True, True, False]
    assert column(spark, P.strip_attribution_col, 'The Prophet (pbuh) said: "Seek knowledge"', None) == ["Seek knowledge", None]
    assert column(spark, lambda c: X.cross_reference(c, ["بمثله", "نحوه"]), "بمثله", "نحوه بمثله", "بمثله قال", "") == [True, True, False, False]
    assert column(spark, lambda c: X.unsupported_host(c, ["x.com"]), "https://x.com/a", "https://m.x.com/a", "https://ax.com/", "ftp:") == [True, True, False, True]
    assert column(spark, X.strip_tags, "<p>a &amp; b</p><script>x</script> c") == ["a & b c"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = list(row)
        for j, y in enumerate(b, 1):
            row[j] = before[j - 1] + 1 if x == y else max(before[j], row[j - 1])
    return row[-1]


def test_similarities():
    rnd = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rnd.choice("ab c") for _ in range(rnd.randrange(12))) for _ in range(2))
        assert S.common_length(a, b) == lcs(a, b)
        if a and len(a) <= len(b):
            best = max(S.ratio(a, b[max(0, i) : min(len(b), i + len(a))]) for i in range(1 - len(a), len(b)))
            assert abs(S.partial_ratio(a, b) - best) < 1e-9 or a in b
    assert S.token_set_ratio("a b c", "c b a d") == 100 and S.token_set_ratio("", "a") == 0
    assert S.word_similarity("word", "two words") > 0.7 and S.word_similarity("abc", "xyz") == 0
    assert S.lexical("seek knowledge from the cradle", "he said seek knowledge from the cradle to the grave", "en") == 100
    assert S.lexical("purple elephants", "actions are by intentions", "en") < 50
    assert S.short_miss("خير الامور اوسطها", "وشر الامور محدثاتها") and not S.short_miss("a b c", "x", "en")
    assert S.word_error_rate("a b c d", "a x c") == 0.5
    assert S.word_diff("a b c", "a x c d") == [{"t": "a", "k": "eq"}, {"t": "b", "k": "del"}, {"t": "x", "k": "ins"}, {"t": "c", "k": "eq"}, {"t": "d", "k": "ins"}]


def test_stages(spark):
    cases = [(True, 0.0, 50.0, 0.0, 60), (False, 0.7, 75.0, 0.1, 70), (False, 0.6, 50.0, 0.85, 40), (False, 0.1, 10.0, 0.9, 80)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, e boolean, t double, l double, c double, s int").orderBy("i")
    got = df.select(S.stage(F.col("e"), F.col("t"), F.col("l"), F.col("c"), F.col("s"), F.lit(False), "ar").alias("x")).collect()
    assert [tuple(r.x) for r in got] == [("exact", 90), ("trigram", 75), ("semantic", 50), ("none", 49)]
    assert [r[0] for r in spark.createDataFrame([(95,), (75,), (50,), (3,)], "c int").select(S.state(F.col("c"))).collect()] == ["verified", "partial", "uncertain", "abstain"]
    assert spark.range(1).select(S.confidence(F.lit(2.5), F.lit(2.5), "en")).first()[0] == 2


def test_contained_against_every_pair(spark):
    rnd = random.Random(5)
    words = ["aa", "bb", "cc", "longerword", "dd"]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 30)))) for i in range(80)]
    items = []
    for i in range(60):
        text = docs[i][1]
        a = rnd.randrange(max(1, len(text) - 20))
        items.append((i, text[a : a + rnd.randrange(15, 40)].strip()))
    items += [(100, "averyveryverylongword"), (101, "ongerword longer"), (102, "short")]
    items += [(103, "veryverylongwordy aa"), (104, "x averyveryverylongw"), (105, "rdword longerwo"), (106, "a longerwordlonge")]
    docs += [(900, "x averyveryverylongwordy"), (901, "averyveryverylongwordy aab longerwordlonger"), (902, "cc longerword longerword")]
    got = {tuple(r) for r in M.contained(spark.createDataFrame(docs, "input_id long, key string"), spark.createDataFrame(items, "record_id long, key string")).collect()}
    assert got == {(d, i) for d, t in docs for i, k in items if len(k) >= 15 and k in t}


def test_verify_is_the_same_in_any_order(spark):
    corpus = spark.createDataFrame([(1, "Actions are judged by intentions, and each man has what he intended"), (2, "None of you believes until he loves for his brother what he loves for himself")], "record_id long, text string")
    inputs = [(1, "ACTIONS are judged by intentions and each man has what he intended!"), (2, "none of you believes until he loves for his brother"), (3, "purple elephants dance"), (4, None)]
    a = M.verify(spark.createDataFrame(inputs, "input_id long, text string"), corpus).collect()
    b = M.verify(spark.createDataFrame(inputs[::-1], "input_id long, text string").repartition(3), corpus.repartition(2)).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    first = {r.input_id: (r.record_id, r.state) for r in a if r.rank == 1}
    assert first[1] == (1, "verified") and first[2][0] == 2 and 3 not in first


def test_maintenance(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (None, "c", "x")], "k int, v string, kind string")
    new = spark.createDataFrame([(2, "B", "y", 1), (2, "BB", "y", 2), (3, "d", "y", 1), (None, "C", "y", 1)], "k int, v string, kind string, batch int")
    got = sorted(tuple(r) for r in K.upsert(t, new, ["k"], ["batch"], ("kind",)).na.fill(0).collect())
    assert got == [(0, "C", "x"), (1, "a", "x"), (2, "BB", "x"), (3, "d", "y")]
    items = spark.createDataFrame([("a", 1), ("b", 2)], "key string, position long")
    assert sorted(tuple(r) for r in K.append(items, spark.createDataFrame([("c",), ("a",), ("c",)], "key string"), "key", "key").collect()) == [("a", 1), ("b", 2), ("c", 3)]
    grades = spark.createDataFrame([(1, [("g", None)])], "id int, grades array<struct<grade:string,url:string>>")
    assert K.overlay_grades(grades, spark.createDataFrame([(1, "u")], "id int, url string"), ["id"]).first().grades[0].url == "u"


def test_rulings(spark):
    cards = spark.createDataFrame([("s", "A", "b1", "g1", 2, 0), ("s", "B", "b2", "g2", 1, 1), ("s", "B", "b2", "g3", 1, 2), ("s", "C", "b3", "g4", 9, 3), ("s", "D", "b4", "g5", 9, 4)], "saying string, scholar string, book string, grade string, rank int, position int")
    assert [g.grade for g in E.top_grades(cards, "saying").first().grades] == ["g2", "g1", "g4"]


def test_limiter_in_batch_and_as_a_stream(spark, tmp_path):
    rows = [(i, u, f"2024-01-01 00:00:{s:02d}") for i, (u, s) in enumerate([(1, 0), (1, 1), (1, 2), (1, 10), (1, 11), (2, 0), (2, 30)])]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    want = {0: True, 1: True, 2: False, 3: True, 4: True, 5: True, 6: True}
    assert {r.event_id: r.admitted for r in T.admit(df, 2, 10).collect()} == want
    skipped = {r.event_id: r.skipped for r in T.cooldown(df, "user_id", F.col("event_id") == 0, 5).collect()}
    assert skipped == {0: False, 1: True, 2: True, 3: False, 4: False, 5: False, 6: False}


def test_windows_of_a_stream_equal_the_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(1).write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    q = T.windowed_counts(stream).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination(120)
    key = lambda rows: sorted((str(r.start), r.event_type, r.n) for r in rows)
    assert key(spark.table("daily").collect()) == key(T.windowed_counts(events).collect())


@pytest.mark.parametrize("batches", [1])
def test_watch(spark, tmp_path, batches):
    corpus = spark.createDataFrame([(1, "Actions are judged by intentions, and each man has what he intended")], "record_id long, text string")
    spark.createDataFrame([(7, "he said actions are judged by intentions and each man has what he intended indeed")], "input_id long, text string").write.parquet(f"{tmp_path}/in")
    q = T.watch(spark.readStream.schema("input_id long, text string").parquet(f"{tmp_path}/in"), corpus, f"{tmp_path}/out", f"{tmp_path}/c")
    q.awaitTermination(180)
    assert [(r.input_id, r.record_id, r.state) for r in spark.read.parquet(f"{tmp_path}/out/*").collect()] == [(7, 1, "verified")]


def test_latin_keys_of_whole_texts_and_of_sentences(spark):
    rnd = __import__("random").Random(6)
    texts = ["".join(rnd.choice("aZ9 '’‘`´é,.!?\n\t\x0b\u00a0İ") for _ in range(rnd.randrange(60))) for _ in range(200)] + ["", "  a  ", "a , b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), "[’‘`´]", "'"), r"[^a-z0-9'\s]", " "), r"\s+", " "))
    sentences = F.transform(X.latin_sentence_keys(F.col("t")), lambda k: F.trim(k))
    rows = df.select(X.latin_key(F.col("t"), False), plain(F.col("t")), sentences, F.transform(F.split("t", r"[.!?\n]+"), lambda p: plain(p))).collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in rows)
