"""More registered queries: rulings and their cards, lookups, spans; with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import spans as P
from ..functions import text as X
from ..operators import lookup as L
from ..operators import rulings as R
from .queries import DOCS, KEY, keyed, query, table

# fixed values: rulings that the labelled documents stand for, one for each remainder
RULINGS = ("حديث صحيح", "إسناده ضعيف", "ليس له إسناد ثابت", "رجاله رجال الصحيح", "حسن", "موضوع", "غريب", "معناه صحيح لكن لا يثبت", "رجاله ثقات وهو جيد")
_RULING = "CASE doc_id % 9 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(RULINGS)) + " END"
_CLASS = f"""CASE WHEN regexp_matches(grade, '{R.WEAK}') OR regexp_matches(grade, '{R.NEGATED}') THEN 'weak'
WHEN regexp_matches(regexp_replace(grade, '{R.NEUTRAL}', ' ', 'g'), '{R.STRONG}') THEN 'strong' ELSE 'neutral' END"""
#: Documents as cards of what (source, doc_id modulo 400) names: their rulings, scholars, books, places and similarities.
_CARD_SQL = f"""c0 AS (SELECT source || '-' || (doc_id % 400) AS saying, doc_id, {_RULING} AS grade, lang AS scholar, source AS book, n_chars || '/' || (doc_id % 3) AS number,
 doc_id AS position, (n_chars * 7 + doc_id) % 101 AS similarity, doc_id % 2 = 0 AS authentic_search FROM documents), c AS (SELECT *, {_CLASS} AS class FROM c0)"""


def _cards(spark, sf_dir):
    grade = F.element_at(F.array(*map(F.lit, RULINGS)), (F.col("doc_id") % 9 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select(
        F.concat_ws("-", "source", F.col("doc_id") % 400).alias("saying"), "doc_id", grade.alias("grade"), F.col("lang").alias("scholar"), F.col("source").alias("book"),
        F.concat_ws("/", "n_chars", F.col("doc_id") % 3).alias("number"), F.col("doc_id").alias("position"), ((F.col("n_chars") * 7 + F.col("doc_id")) % 101).alias("similarity"), (F.col("doc_id") % 2 == 0).alias("authentic_search"),
    )
    return rows.withColumn("class", R.grade_class(F.col("grade")))


@query(f"WITH {_CARD_SQL} SELECT grade, class, count(*) AS n FROM c GROUP BY ALL")
def ruling_classes(spark, sf_dir):
    """P-7."""
    return _cards(spark, sf_dir).groupBy("grade", "class").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_CARD_SQL}, n AS (SELECT saying, count(*) FILTER (similarity >= 85) AS n, count(*) FILTER (similarity >= 85 AND class = 'weak') AS weak, count(*) FILTER (similarity >= 85 AND class = 'strong') AS strong FROM c GROUP BY 1)
SELECT saying, weak, strong, CASE WHEN n = 0 THEN 'no_entry' WHEN strong > 0 AND weak = 0 THEN 'authentic' WHEN weak > 0 AND strong = 0 THEN 'weak_or_fabricated' ELSE 'mixed' END AS label FROM n""")
def label_sayings(spark, sf_dir):
    """A-3."""
    return R.label_saying(_cards(spark, sf_dir), "saying")


_DECIDED = """n AS (SELECT saying, count(*) FILTER (similarity >= 85) AS n, count(*) FILTER (similarity >= 85 AND class = 'weak') AS weak, count(*) FILTER (similarity >= 70 AND class = 'strong') AS strong FROM c GROUP BY 1),
d AS (SELECT saying, weak, CASE WHEN n = 0 THEN 'no close entry' WHEN strong > 0 THEN 'an authentic ruling is near' WHEN weak = 0 THEN 'no weak ruling' ELSE 'weak' END AS reason FROM n)"""


@query(f"WITH {_CARD_SQL}, {_DECIDED} SELECT *, CASE reason WHEN 'weak' THEN 'add' ELSE 'skip' END AS decision FROM d")
def curation_decisions(spark, sf_dir):
    """A-4."""
    return R.decide(_cards(spark, sf_dir), "saying")


@query(f"""WITH {_CARD_SQL} SELECT DISTINCT saying FROM c WHERE saying NOT IN (SELECT saying FROM c WHERE similarity >= 80 AND (class = 'strong' OR (authentic_search AND class <> 'weak')))""")
def unblocked_sayings(spark, sf_dir):
    """J-15."""
    cards = _cards(spark, sf_dir)
    return R.unblocked(cards.select("saying").distinct(), cards, "saying")


@query(f"""WITH {_CARD_SQL}, {_DECIDED}, q AS (SELECT saying, string_agg(grade, ' | ' ORDER BY position) AS rulings FROM (SELECT *, row_number() OVER (PARTITION BY saying ORDER BY position) AS i FROM c WHERE similarity >= 85) WHERE i <= 3 GROUP BY 1)
SELECT saying, CASE reason WHEN 'weak' THEN 'add' ELSE 'skip' END AS decision, reason, coalesce(rulings, '') AS rulings FROM d LEFT JOIN q USING (saying)""")
def review_sheet(spark, sf_dir):
    """K-10."""
    cards = _cards(spark, sf_dir)
    return R.review_sheet(cards.select("saying").distinct(), cards, "saying")


@query(f"""WITH {_CARD_SQL}, t AS (SELECT doc_id, {KEY} AS text_key FROM documents WHERE text IS NOT NULL), r AS (SELECT c.doc_id, row_number() OVER (PARTITION BY saying, scholar, book, trim(string_split(number, '/')[-1]), text_key ORDER BY position) AS i FROM c JOIN t USING (doc_id)) SELECT doc_id FROM r WHERE i = 1""")
def deduped_cards(spark, sf_dir):
    """D-2."""
    cards = _cards(spark, sf_dir).join(keyed(table(spark, sf_dir, "documents"), "doc_id", "doc_id").withColumnRenamed("key", "text_key"), "doc_id")
    return R.dedupe_cards(cards, "saying", "text_key").select("doc_id")


_RANKED = """r0 AS (SELECT *, scholar = 'en' AS same_book, number LIKE '%/1' AS same_number, max((similarity >= 70)::INT) OVER (PARTITION BY saying) AS near, row_number() OVER (PARTITION BY saying ORDER BY position) AS i FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY saying ORDER BY (same_book AND same_number) DESC, same_book DESC, similarity DESC, position) AS rank FROM r0 WHERE CASE WHEN near = 1 THEN similarity >= 70 ELSE i <= 3 END)"""


def _ranked(spark, sf_dir):
    cards = _cards(spark, sf_dir).withColumn("same_book", F.col("scholar") == "en").withColumn("same_number", F.col("number").like("%/1"))
    return R.rank_rulings(cards, "saying")


@query(f"WITH {_CARD_SQL}, {_RANKED} SELECT saying, doc_id, rank FROM r WHERE rank <= 4")
def ranked_rulings(spark, sf_dir):
    """D-8, J-11: four rulings of each saying, a top-k report."""
    return _ranked(spark, sf_dir).select("saying", "doc_id", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_CARD_SQL}, {_RANKED} SELECT saying, arg_min(grade, rank) AS explanation FROM r WHERE rank <= 4 AND class <> 'weak' GROUP BY 1")
def first_explanations(spark, sf_dir):
    """J-12 with the rulings that aren't weak for explanations."""
    return R.first_explanation(_ranked(spark, sf_dir).withColumn("explanation", F.when(F.col("class") != "weak", F.col("grade"))), "saying")


_GRADES_EN = ("Sahih", "  hasan SAHIH ", "Da'if - Isnaad Hasan", "Mawdu, Munkar", "Hasan", "unknown", "")


def _put_into_arabic(c: str) -> str:
    for en, ar in R.GRADES_AR:
        c = f"regexp_replace({c}, '{en.replace(chr(39), chr(39) * 2)}', '{ar}', 'gi')"
    return c


@query(
    "WITH g AS (SELECT CASE doc_id % 7 "
    + " ".join(f"WHEN {i} THEN '{g.replace(chr(39), chr(39) * 2)}'" for i, g in enumerate(_GRADES_EN))
    + " END AS grade FROM documents) SELECT grade, CASE lower(trim(grade)) "
    + " ".join(f"WHEN '{en.lower().replace(chr(39), chr(39) * 2)}' THEN '{ar}'" for en, ar in R.GRADES_AR)
    + f" ELSE {_put_into_arabic('trim(grade)')} END AS grade_ar, count(*) AS n FROM g GROUP BY ALL"
)
def arabic_grades(spark, sf_dir):
    """N-19."""
    d = table(spark, sf_dir, "documents").select(F.element_at(F.array(*map(F.lit, _GRADES_EN)), (F.col("doc_id") % 7 + 1).cast("int")).alias("grade"))
    return d.groupBy("grade", R.grade_to_ar(F.col("grade")).alias("grade_ar")).agg(F.count(F.lit(1)).alias("n"))


_SPEECH = """t AS (SELECT user_id, count(*) / 2.0 AS duration, CASE WHEN user_id % 11 = 0 THEN 'Thanks for watching' WHEN user_id % 13 = 0 THEN ' ' ELSE 'spoken words' END AS text, CASE WHEN user_id % 5 = 0 THEN 'French' WHEN user_id % 2 = 0 THEN 'Arabic' ELSE ' english' END AS language FROM events GROUP BY 1),
s AS (SELECT user_id, abs(value) / 20 AS "end", -(event_id % 23) / 12.0 AS lp, (event_id % 10) / 10.0 AS np, 1 + (user_id * 7 + event_id % 3) % 17 / 10.0 AS cr FROM events),
h AS (SELECT user_id, sum(lp * greatest(0.01, "end")) / sum(greatest(0.01, "end")) AS sure, max(cr) AS cr FROM s WHERE np <= 0.6 GROUP BY 1)"""


@query(f"""WITH {_SPEECH}, v AS (SELECT t.*, sure, cr, CASE lower(trim(language)) WHEN 'arabic' THEN 'ar' WHEN 'english' THEN 'en' END AS lang FROM t LEFT JOIN h USING (user_id))
SELECT user_id, CASE WHEN duration > 60 THEN 'too_long' WHEN trim(text) = '' OR duration < 1 OR sure IS NULL OR text ILIKE '%thanks for watching%' THEN 'no_speech' WHEN lang IS NULL THEN 'language' WHEN sure < -1 OR cr > 2.4 THEN 'unclear' ELSE 'accepted' END AS verdict,
lang, round(duration, 1) AS seconds, round_even(100 * exp(sure), 0)::INT AS confidence FROM v""")
def assess_transcripts(spark, sf_dir):
    """A-8, P-21 with events for speech segments and their users for recordings."""
    e = table(spark, sf_dir, "events")
    u, n = F.col("user_id"), F.col("event_id")
    text = F.when(u % 11 == 0, "Thanks for watching").when(u % 13 == 0, " ").otherwise("spoken words")
    language = F.when(u % 5 == 0, "French").when(u % 2 == 0, "Arabic").otherwise(" english")
    t = e.groupBy("user_id").agg((F.count(F.lit(1)) / 2.0).alias("duration")).select("user_id", "duration", text.alias("text"), language.alias("language"))
    s = e.select("user_id", F.lit(0.0).alias("start"), (F.abs("value") / 20).alias("end"), (-(n % 23) / 12.0).alias("avg_logprob"), ((n % 10) / 10.0).alias("no_speech_prob"), (1 + (u * 7 + n % 3) % 17 / 10.0).alias("compression_ratio"))
    return R.assess(t, s, "user_id")


_LINES = "lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS line FROM lineitem)"


def _lines(spark, sf_dir):
    """Lines numbered within their orders (stored numbers repeat)."""
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").withColumn("line", F.row_number().over(place).cast("long"))


# ---- lookups -------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'nation ' || c_nationkey END AS nation FROM (SELECT *, c_nationkey AS k FROM customer) LEFT JOIN nation ON n_nationkey = k")
def translated_names(spark, sf_dir):
    """J-22: names that the dimension knows are put in, others pass through."""
    names = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("nation "), "n_nationkey").alias("name"), F.col("n_name").alias("other"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("nation "), "c_nationkey").alias("nation"))
    return L.with_names(rows, names, "nation")


@query("SELECT d.doc_id, coalesce(l.quality::VARCHAR, '') AS text_en FROM documents d LEFT JOIN labels l USING (doc_id)")
def translations_beside(spark, sf_dir):
    """J-13 with labels for translations."""
    return L.with_translation(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("text_en")), "doc_id")


@query("SELECT doc_id FROM documents WHERE length(trim(coalesce(text, ''))) > 0 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def new_terms(spark, sf_dir):
    """J-19: texts without a label."""
    return L.new_terms(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("meaning")), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'quran' ELSE 'hadith' END AS kind, text, 'explained: ' || text AS explanation FROM documents)
SELECT doc_id AS record_id, md5(CASE WHEN kind = 'quran' THEN CASE WHEN length(text) > 200 AND doc_id % 2 = 0 THEN text END ELSE CASE WHEN length(explanation) > 150 THEN explanation END END) AS grounding FROM s""")
def groundings(spark, sf_dir):
    """J-23 with every second document for a verse's section."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), "text")
    records = d.select("record_id", F.when(F.col("record_id") % 3 == 0, "quran").otherwise("hadith").alias("kind"))
    found = L.grounding(records, d.where("record_id % 2 = 0").select("record_id", F.col("text").alias("section_text")), d.select("record_id", F.concat(F.lit("explained: "), "text").alias("explanation")))
    return found.withColumn("grounding", F.md5("grounding"))


@query("""SELECT o_orderkey AS input_id, list_contains([o_custkey % 5, o_custkey % 7], o_orderkey % 6) AS same, list_contains([o_custkey % 5, o_custkey % 7], o_orderkey % 6) OR list_has_any([o_custkey % 5, o_custkey % 7], [o_orderkey % 11, 6]) AS same_record FROM orders""")
def expected_records(spark, sf_dir):
    """J-17 with orders for answers."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("input_id"), F.array(F.col("o_custkey") % 5, F.col("o_custkey") % 7).alias("expected"), (F.col("o_orderkey") % 6).alias("got"), F.array(F.col("o_orderkey") % 11, F.lit(6).cast("long")).alias("narrations"))
    return L.expected_found(rows).select("input_id", "same", "same_record")


@query("SELECT doc_id, lang, source FROM documents WHERE source IN ('src0', 'src3', 'src5')")
def of_kinds(spark, sf_dir):
    """P-13."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("source").alias("kind"))
    return L.of_kinds(rows, ["src0", "src3", "src5"]).drop("kind")


@query("WITH " + _LINES + """, m AS (SELECT l_orderkey AS input_id, line AS span_id, CASE WHEN l_partkey % 4 > 0 THEN l_suppkey % 3 END AS record_id, CAST(l_quantity AS DOUBLE) * 2 AS confidence, l_partkey AS p FROM lines),
r AS (SELECT *, row_number() OVER (PARTITION BY input_id, record_id IS NOT NULL AND confidence >= 50, CASE WHEN record_id IS NOT NULL AND confidence >= 50 THEN record_id ELSE span_id END ORDER BY confidence DESC, span_id) AS i FROM m)
SELECT input_id, span_id FROM r WHERE i = 1""")
def spans_by_record(spark, sf_dir):
    """D-5 with the lines of orders for spans."""
    record = F.when(F.col("l_partkey") % 4 > 0, F.col("l_suppkey") % 3)
    m = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("input_id"), F.col("line").alias("span_id"), record.alias("record_id"), (F.col("l_quantity").cast("double") * 2).alias("confidence"), F.col("line").alias("position"))
    return L.one_span_per_record(m).select("input_id", "span_id")


@query("WITH " + _LINES + """, s AS (SELECT l_orderkey AS input_id, line AS span_id, CAST(l_quantity AS DOUBLE) AS confidence, l_partkey % 2 = 0 AS is_marked FROM lines), w AS (SELECT o_orderkey AS input_id, (o_custkey % 50)::DOUBLE AS whole FROM orders WHERE o_orderkey % 5 > 0),
b AS (SELECT input_id, {'span_id': span_id, 'confidence': confidence, 'is_marked': is_marked} AS b FROM (SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY confidence DESC, span_id) AS i FROM s) WHERE i = 1)
SELECT input_id, CASE WHEN win THEN b.span_id END AS span_id, CASE WHEN win THEN b.confidence ELSE whole END AS confidence FROM (SELECT input_id, b, whole, b IS NOT NULL AND (whole IS NULL OR (b.is_marked AND b.confidence >= whole) OR b.confidence >= whole + 10) AS win FROM b FULL JOIN w USING (input_id))""")
def best_spans(spark, sf_dir):
    """D-4 with the lines of orders for spans and orders for whole texts."""
    s = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("input_id"), F.col("line").alias("span_id"), F.col("line").alias("position"), F.col("l_quantity").cast("double").alias("confidence"), (F.col("l_partkey") % 2 == 0).alias("is_marked"))
    w = table(spark, sf_dir, "orders").where("o_orderkey % 5 > 0").select(F.col("o_orderkey").alias("input_id"), (F.col("o_custkey") % 50).cast("double").alias("confidence"))
    return L.best_quote(s, w)


_CANDS = _LINES + """, c AS (SELECT l_orderkey AS input_id, line AS record_id, line AS rank, CASE WHEN l_partkey % 3 = 0 THEN 'quran' ELSE 'hadith' END AS kind, CASE WHEN l_suppkey % 4 = 0 THEN 'exact' ELSE 'trigram' END AS stage,
 (40 + l_partkey % 60)::INT AS confidence, (50 + l_suppkey % 50)::DOUBLE AS semantic, (20 + l_partkey % 70)::DOUBLE AS lexical, l_partkey % 2 = 0 AS meaning_only FROM lines),
a AS (SELECT o_orderkey AS input_id, n, (o_custkey + n) % 3 = 0 AS same, CASE WHEN o_custkey % 2 = 0 THEN 'anthropic/x' ELSE 'local/y' END AS model FROM orders, (VALUES (1), (2), (3)) v(n))"""


@query(f"""WITH {_CANDS}, e AS (SELECT *, rank <= 3 AND stage <> 'exact' AND confidence < 90 AND semantic >= 60 AND lexical >= 25 AS can FROM c),
k AS (SELECT *, CASE WHEN can THEN sum(can::INT) OVER (PARTITION BY input_id ORDER BY rank) END AS n FROM e),
j AS (SELECT k.*, CASE WHEN same AND NOT (model LIKE 'anthropic/%' AND kind <> 'quran') THEN NULL ELSE same END AS same FROM k LEFT JOIN a USING (input_id, n)),
f AS (SELECT *, coalesce(same, false) AS confirmed, coalesce(NOT same AND confidence >= 75, false) AS rejected FROM j),
l AS (SELECT *, CASE WHEN confirmed THEN greatest(confidence, 75) WHEN rejected THEN least(confidence, 60) ELSE confidence END AS lifted FROM f),
o AS (SELECT input_id, record_id, rank AS old, CASE WHEN meaning_only AND NOT confirmed AND lifted >= 75 THEN 74 ELSE lifted END AS confidence, confirmed, rejected FROM l)
SELECT input_id, record_id, (row_number() OVER (PARTITION BY input_id ORDER BY confidence DESC, confirmed DESC, old))::INT AS rank, confidence, confirmed, rejected FROM o""")
def answered_candidates(spark, sf_dir):
    """C-13, C-14 with the lines of orders for candidates and orders for model answers."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    c = _lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("input_id"), F.col("line").alias("record_id"), F.col("line").alias("rank"), F.when(p % 3 == 0, "quran").otherwise("hadith").alias("kind"), F.when(s % 4 == 0, "exact").otherwise("trigram").alias("stage"),
        (40 + p % 60).cast("int").alias("confidence"), (50 + s % 50).cast("double").alias("semantic"), (20 + p % 70).cast("double").alias("lexical"), (p % 2 == 0).alias("meaning_only"),
    )
    o = table(spark, sf_dir, "orders").withColumn("n", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    a = o.select(F.col("o_orderkey").alias("input_id"), F.col("n").cast("long").alias("n"), ((F.col("o_custkey") + F.col("n")) % 3 == 0).alias("same"), F.when(F.col("o_custkey") % 2 == 0, "anthropic/x").otherwise("local/y").alias("model"))
    return R.apply_answers(c, a)


@query("""SELECT count(*) FILTER (list_contains(string_split(CASE WHEN event_id % 2 = 0 THEN 'no_speech|unclear' ELSE 'language' END, '|'), CASE event_id % 3 WHEN 0 THEN 'unclear' WHEN 1 THEN 'language' END)) AS refused, count(*) AS total FROM events""")
def refusal_outcomes(spark, sf_dir):
    """A-15."""
    n = F.col("event_id")
    return R.refusals(table(spark, sf_dir, "events").select(F.when(n % 2 == 0, "no_speech|unclear").otherwise("language").alias("expect_error"), F.when(n % 3 == 0, "unclear").when(n % 3 == 1, "language").alias("got")))


@query("""SELECT o_orderpriority AS priority, count(*) AS n, count(*) FILTER (o_custkey % 4 < 2 AND (o_orderkey % 5 = o_custkey % 5 OR list_contains([o_custkey % 3, o_custkey % 2], o_orderkey % 5))) AS hits FROM orders GROUP BY 1""")
def paste_hits(spark, sf_dir):
    """A-10."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    states = F.element_at(F.array(*map(F.lit, ("verified", "partial", "uncertain", "abstain"))), (c % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", (k % 5).alias("expected"), states.alias("state"), (c % 5).alias("got"), F.array(c % 3, c % 2).alias("others"))
    return R.paste_hits(rows).groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"))


@query("SELECT p_partkey, side FROM part, (VALUES ('before'), ('after')) v(side) WHERE p_partkey % 10 = 0")
def changed_rows(spark, sf_dir):
    """A-14: every tenth part renamed."""
    before = table(spark, sf_dir, "part")
    after = before.withColumn("p_name", F.when(F.col("p_partkey") % 10 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")))
    return R.unchanged(before, after, ["p_partkey"])


# ---- texts ---------------------------------------------------------------------------------------------------------

_LAT, _ANY = "[A-Za-z]", "[؀-ۿ]"


@query(r"""SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda t: regexp_replace(t, '[^\pL\pN\pM_]', '', 'g')), lambda w: regexp_matches(w, '^[A-Za-z]{3,}$|^[\x{0600}-\x{065F}\x{066A}-\x{06EF}\x{06FA}-\x{06FF}]{3,}$'))) AS words FROM documents WHERE text IS NOT NULL""")
def word_scores(spark, sf_dir):
    """C-21, words."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", P.word_score(F.col("text")).cast("long").alias("words"))


@query(r"""WITH s AS (SELECT doc_id, text, len(regexp_extract_all(text, '[\x{0600}-\x{06FF}]')) AS ar, len(regexp_extract_all(text, '[A-Za-z]')) AS la, length(text) - length(replace(text, '|', '')) AS bars, length(text) - length(replace(text, '·', '')) AS dots FROM documents WHERE text IS NOT NULL)
SELECT doc_id, round(CASE WHEN ar + la = 0 THEN 0 ELSE least(length(text), 600) * CASE WHEN regexp_matches(text, 'قال|رسول|النبي|said|narrated') THEN 2 ELSE 1 END * (1 + ar / greatest(ar + la, 1)) * CASE WHEN bars > 3 OR dots > 3 THEN 0.5 ELSE 1 END END, 6) AS score FROM s""")
def block_scores(spark, sf_dir):
    """C-21, blocks."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.round(P.block_score(F.col("text")), 6).alias("score"))


@query(r"""WITH s AS (SELECT doc_id, text, len(regexp_extract_all(text, '\pL')) AS n, len(regexp_extract_all(text, '[A-Za-z]')) AS own FROM documents) SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN true ELSE n > 0 AND own >= 0.6 * n END AS latin FROM s""")
def script_matches(spark, sf_dir):
    """N-25."""
    return table(spark, sf_dir, "documents").select("doc_id", P.script_matches(F.col("text"), "[A-Za-z]").alias("latin"))


@query(r"""SELECT doc_id, left(text, 220) AS short, CASE WHEN lang = 'en' THEN '' WHEN doc_id % 2 = 0 THEN 'باب ' || doc_id WHEN doc_id % 5 > 0 THEN 'الكتاب رقم ' || translate((doc_id % 5)::VARCHAR, '0123456789', '٠١٢٣٤٥٦٧٨٩') ELSE '' END AS chapter FROM documents""")
def shown_fields(spark, sf_dir):
    """N-21, N-27."""
    i = F.col("doc_id")
    chapter = L.chapter_label(F.when(F.col("lang") == "en", "seed").otherwise(""), F.when(i % 2 == 0, F.concat(F.lit("باب "), i)).otherwise("Chapter"), F.when(i % 5 > 0, (i % 5).cast("string")).otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", L.shortened(F.col("text"), 220).alias("short"), chapter.alias("chapter"))


@query(f"""WITH {DOCS} SELECT m.doc_id, CASE WHEN route IN ('verify', 'question') AND (text = '' OR contains(msg, text)) THEN route WHEN route = 'report' AND (text = '' OR contains(msg, text)) THEN CASE WHEN doc_id % 4 = 2 THEN 'report' ELSE 'tool' END END AS route
FROM (SELECT input_id AS doc_id, key AS msg, CASE input_id % 4 WHEN 0 THEN 'verify' WHEN 1 THEN 'other' WHEN 2 THEN 'report' ELSE 'question' END AS route, CASE WHEN input_id % 3 = 0 THEN '' ELSE substr(key, 5, 20) || CASE WHEN input_id % 5 = 0 THEN '#' ELSE '' END END AS text FROM d) m""")
def guarded_routes(spark, sf_dir):
    """P-24 with documents for messages and parts of them for a model's payload."""
    i = F.col("doc_id")
    m = keyed(table(spark, sf_dir, "documents"), "doc_id", "doc_id")
    route = F.element_at(F.array(*map(F.lit, ("verify", "other", "report", "question"))), (i % 4 + 1).cast("int"))
    text = F.when(i % 3 == 0, "").otherwise(F.concat(F.substring("key", 5, 20), F.when(i % 5 == 0, "#").otherwise("")))
    return m.select("doc_id", L.guarded_route(route, text, F.col("key"), i % 4 == 2, ["verify", "question", "report", "tool"]).alias("route"))


@query()
def quoted_spans(spark, sf_dir):
    """X-1, P-8..P-10: the spans of every document that may be quotations, and whether they are marked as one. Regular expressions with
    look-behind aren't DuckDB's; tests hold it against cases worked out by hand."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(P.marked_candidates_col(F.col("text"))).alias("position", "s"))
    return d.select("doc_id", "position", "s.span", "s.marked")


@query()
def english_keys(spark, sf_dir):
    """N-12, N-13 (not a verse): the key of what a text quotes."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", X.latin_key(P.quoted_part_col(F.col("text"))).alias("key"))


@query()
def cleaned_lines(spark, sf_dir):
    """N-23, P-17: what is left of every page's text, line by line."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", "<[^>]+>", "\n").alias("text"))
    return pages.select("page_id", F.length(P.clean_lines(F.col("text"))).alias("chars"))


@query(f"""WITH t AS (SELECT CASE WHEN doc_id % 4 = 0 THEN 'ﷺ' WHEN doc_id % 4 = 1 THEN 'صلى الله عليه وسلم ' || text ELSE text END AS text FROM documents), p AS (SELECT regexp_replace(text, '{X.HONORIFICS_SHOWN}', ' ', 'g') AS text FROM t),
n AS (SELECT len(regexp_extract_all(text, '[ء-يٱ-ۓ]')) AS ar, len(regexp_extract_all(text, '[A-Za-z]')) AS la FROM p WHERE text IS NOT NULL) SELECT CASE WHEN ar + la > 0 THEN CASE WHEN ar >= 0.6 * la THEN 'ar' ELSE 'en' END END AS script, count(*) AS n FROM n GROUP BY 1""")
def scripts_shown(spark, sf_dir):
    """N-26, with honorifics put before every fourth text and alone in another fourth."""
    i = F.col("doc_id") % 4
    text = F.when(i == 0, "ﷺ").when(i == 1, F.concat(F.lit("صلى الله عليه وسلم "), "text")).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "documents").select(text.alias("text")).where("text is not null")
    return rows.groupBy(X.script_or_null(F.col("text")).alias("script")).agg(F.count(F.lit(1)).alias("n"))
