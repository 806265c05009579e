"""Pages and report texts on small cases."""

import json

from pyspark.sql import functions as F

from quotemill.functions import pages as G
from quotemill.operators import report as R


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_leaf_blocks_and_main_text(spark):
    html = (
        "<head><style>p{}</style></head><nav><p>menu menu menu menu menu</p></nav><div>loose text of a box <p>first paragraph of the page<p>second one, left open"
        "</div><ul><li>an item that is long enough</li><li>short</li></ul><div>Someone said: a third &amp; last one</div>"
    )
    empty = '<meta name="description" content="what the page is about"><p>tiny</p>'
    got = values(spark, [(html,), (empty,), (None,), ("",)], "h string", G.leaf_blocks(F.col("h")), G.main_text(F.col("h")))
    assert got[0][0] == ["first paragraph of the page", "second one, left open", "an item that is long enough", "Someone said: a third & last one"]
    assert got[0][1].split("\n")[0] == "Someone said: a third & last one" and len(got[0][1].split("\n")) == 4
    assert got[1] == ([], "what the page is about") and got[2] == ([], "") and got[3] == ([], "")


def test_picked_quote(spark):
    filler = "This is a sentence of no weight at all, but long enough to be the longest in the whole of the text by far. " * 3
    rows = [(filler + "He said. " + "Then the quotation follows here.",), ("One. Two.",), (None,), ("",), (filler + "قال رسول الله إنما الأعمال بالنيات وإنما لكل امرئ ما نوى.",)]
    got = [r[0] for r in values(spark, rows, "t string", G.pick_quote(F.col("t")))]
    assert got == ["He said. Then the quotation follows here.", "One. Two.", None, "", "قال رسول الله إنما الأعمال بالنيات وإنما لكل امرئ ما نوى."]


def test_sites_terms_and_definitions(spark):
    both = '<div class="arabic_x">نص</div><div class="big english_x">the text</div>'
    got = values(spark, [(both,), ('<div class="arabic_x">نص</div>',), ("<p>none</p>",), (None,)], "h string", *[G.site_texts(F.col("h"), "arabic_x", "english_x", k) for k in ("en", "ar")])
    assert [tuple(x and tuple(x) for x in r) for r in got] == [(("the text", "the text\nنص"), ("نص", "نص\nthe text")), (("نص", "نص"),) * 2, (None, None), (None, None)]
    links = '<a href="/dictionary/1">كلمة</a><a href="/dictionary/2">word</a><a href="/other">غير</a>'
    assert values(spark, [(links,)], "h string", G.anchor_terms(F.col("h"), "/dictionary/")) == [(["كلمة"],)]
    body = "x المادة الأساسية : قصير انظر : y التعريف لغة : " + "كلام طويل يكفي لأن يكون تعريفا كاملا تعريفات أخرى z"
    assert values(spark, [(body,), (None,), ("",)], "t string", G.definition_from(F.col("t")))[0][0] == "كلام طويل يكفي لأن يكون تعريفا كاملا"


def test_briefs_and_replies(spark):
    rows = [("verified", "sound", "A", "Book", "7"), ("partial", "sound", None, "Book", ""), ("unreliable", "weak", "B", "Book", "3"), ("verified", None, None, "Book", "1"), ("uncertain", "sound", "A", "B", "1"), ("abstain",) + (None,) * 4]
    brief = R.template_brief(*map(F.col, ("s", "g", "r", "b", "n")), "en")
    got = [r[0] for r in values(spark, rows, "s string, g string, r string, b string, n string", brief)]
    assert got[0].startswith("Found in Book, number 7 with the ruling sound (A);") and "in Book in slightly other words, with the ruling sound;" in got[1]
    assert got[2].startswith("Recorded in Book, number 3 with the ruling weak (B);") and got[3:] == [R.BRIEFS["en"][k] for k in ("", "uncertain", "abstain")]
    cols = "s string, b string, n string, k int"
    replies = values(spark, [("verified", "brief", None, 2), ("verified", "brief", "note", 2), ("abstain", "brief", "note", 2)], cols, R.compose_reply(*map(F.col, "sbnk")))
    end = " The full report has the details."
    assert [r[0] for r in replies] == ["Verified. brief The same text has 2 other places." + end, "Verified. note" + end, "Abstain. brief" + end]
    assert values(spark, [("t", []), ("t", ["p"]), (" ", [])], "t string, p array<string>", R.accept_or_template(F.col("t"), F.col("p"), F.lit("T"))) == [("t",), ("T",), ("T",)]
    assert values(spark, [("verified", "x"), ("verified", None), ("uncertain", "x")], "s string, m string", R.extended_allowed(F.col("s"), F.col("m"))) == [(True,), (False,), (False,)]


def test_lists_of_candidates(spark):
    cands = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "input_id int, record_id int, rank int")
    others = spark.createDataFrame([(1, 11, 1), (1, 12, 2), (1, 12, 5), (1, 13, 3), (2, 20, 1)], "input_id int, record_id int, rank int")
    got = {tuple(r) for r in R.append_other_matches(cands, others, 3).collect()}
    assert got == {(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 20, 1)}
    ranked = spark.createDataFrame([(1, 10, 4, 70), (1, 11, 2, 50), (2, 12, 1, None)], "input_id int, record_id int, rank int, confidence int")
    assert {(r.record_id, r["rank"], r.accepted) for r in R.display_rank(ranked, 60).collect()} == {(11, 1, False), (10, 2, False), (12, 1, False)}
    assert values(spark, [("\n the first \nهذه فقرة عربية",), (None,), ("",)], "b string", R.paragraph_in(F.col("b"), "ar"), R.paragraph_in(F.col("b"), "en")) == [("هذه فقرة عربية", "the first"), ("", ""), ("", "")]
    request = spark.createDataFrame([(1, 2, "t", None, "ع"), (1, 1, "t", "e" * 900, "ع")], "input_id int, rank int, text string, text_en string, text_ar string")
    sent = json.loads(R.match_requests(request).first().request)
    assert [(c["rank"], len(c["text_en"]), c.get("text_ar")) for c in sent["candidates"]] == [(1, 700, None), (2, 0, "ع")]
    focus = values(spark, [("x" * 300, "x", "text", ""), ("short", "x", "text", None), ("short", "x", "link", "page")], "t string, f string, v string, e string", R.focus_context(*map(F.col, "tfve")))
    assert [tuple(r[0]) for r in focus] == [("x", "x" * 300), ("short", ""), ("x", "page")]


def test_cards_and_explanations(spark):
    body = "<b>الراوي :</b> فلان بن فلان | <b>المحدث :</b> عالم | <b>المصدر :</b> كتاب <b>الصفحة أو الرقم :</b> 1/25 | <b>خلاصة حكم المحدث :</b> [إسناده صحيح] | <b>التخريج :</b> أخرجه غيره"
    page = f'<h1>x</h1><div class="border-bottom py-4 a"><h5>3 - نص الحديث</h5>{body}<a xplain="77">y</a></div><div class="border-bottom py-4"><h5>بلا حكم</h5></div>'
    got = values(spark, [(page,), (None,), ("",)], "h string", G.cards(F.col("h")))
    assert [tuple(c) for c in got[0][0]] == [("نص الحديث", "[إسناده صحيح]", "فلان بن فلان", "عالم", "كتاب", "1/25", "أخرجه غيره y", "77")] and got[1:] == [([],), ([],)]
    one = values(spark, [(f"<p>نص الحديث</p>{body} <b>شرح الحديث :</b> كلام طويل",), (None,)], "h string", G.explanation(F.col("h")))
    assert tuple(one[0][0]) == ("نص الحديث", "إسناده صحيح", "فلان بن فلان", "عالم", "كتاب", "1/25", "أخرجه غيره", "كلام طويل") and set(one[1][0]) == {""}


def test_sections(spark):
    long = "كلام في المعنى " * 20
    page = f"<title>موقع - سورة كذا - الآيات (3 - 7)</title><nav>المعنى الإجمالي</nav><p>المعنى الإجمالي: {long}[12] يُنظر: ((تفسير فلان))(1/2). بقية</p><footer>تابعنا هنا</footer>"
    got = [tuple(r[0]) for r in values(spark, [(page,), ("<title>الآية (9)</title>تابعنا",), (None,)], "h string", G.section(F.col("h"), "موقع -"))]
    assert got[0] == ("سورة كذا - الآيات (3 - 7)", 3, 7, f"المعنى الإجمالي: {long}بقية".strip())
    assert got[1][:3] == ("الآية (9)", 9, 9) and got[2] == ("", None, None, "")


def test_sentences_keep_their_first_digits(spark):
    long = "1" + "x" * 200 + " " + "y" * 150 + "1"
    rows = [(f"Short one. {long}", ), (f"One. \u00a0{long}\u3000\nTwo.",)]
    assert [r[0] for r in values(spark, rows, "t string", G.pick_quote(F.col("t")))] == [long, long]


def test_first_paragraph_without_letters(spark):
    rows = [("\u00a0\n 12:34 \nwords of a text",), ("هذه فقرة\nwords",), (None,)]
    assert values(spark, rows, "b string", R.paragraph_in(F.col("b"), None)) == [("12:34",), ("هذه فقرة",), ("",)]
