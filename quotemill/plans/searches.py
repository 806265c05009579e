"""Queries by similarity: sayings that a seed has already, hybrid retrieval, spellings, comparisons of wordings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import similarity as S
from ..functions import spans as P
from ..functions import text as X
from ..functions import wording as W
from ..operators import lookup as L
from ..operators import matching as M
from ..operators import report as R
from ..operators import rulings as RU
from ..operators import similar as Y
from ..operators import verdict as V
from ..operators.work import work_table
from .queries import DOCS, GLOSSARY, ITEMS, KEY, keyed, query, table

# ---- J-14: sayings that the seed has already -----------------------------------------------------------------------


def _sayings_sql(name: str, of: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT {KEY} AS key, min(id) AS first_id FROM (SELECT {of}_id AS id, unnest(regexp_split_to_array(text, '[.!?\\n]+')) AS text FROM {'documents' if of == 'doc' else 'benchmark'}) GROUP BY 1 HAVING key <> '')"


def _sayings(df, id_: str):
    """key and first_id of the different sentences of texts."""
    pieces = df.select(F.col(id_).alias("id"), F.explode(X.latin_sentence_keys(F.col("text"))).alias("piece"))
    return pieces.select("id", F.trim("piece").alias("key")).where("key <> ''").groupBy("key").agg(F.min("id").alias("first_id"))


#: Characters in common in their order, row by row; SQL has edit distances, but none without substitutions.
_COMMON = """list_last(list_reduce(list_prepend(list_transform(range(0, length(s.key) + 1), lambda j: 0::BIGINT), list_transform(string_split(i.key, ''), lambda c: [ord(c)::BIGINT])),
  lambda line, c: list_reduce(list_prepend([0::BIGINT], list_transform(range(1, length(s.key) + 1), lambda j: [j])),
    lambda done, j: list_append(done, greatest(line[j[1] + 1], done[-1], line[j[1]] + (ord(substr(s.key, j[1]::INT, 1)) = c[1])::BIGINT)))))"""
_SEEN = f"""{_sayings_sql("i", "doc")}, {_sayings_sql("s", "item")},
m AS MATERIALIZED (SELECT i.key AS input_key, s.key AS seed_key, 200.0::DOUBLE * {_COMMON} / (length(i.key) + length(s.key)) AS ratio FROM i JOIN s
  ON 10 * abs(length(i.key) - length(s.key)) <= length(i.key) + length(s.key) AND 10 * levenshtein(i.key, s.key) <= length(i.key) + length(s.key))"""


@query(f"WITH {_SEEN} SELECT input_key, seed_key, ratio FROM m WHERE ratio >= 90")
def seed_matches(spark, sf_dir):
    """J-14, C-1: sentences of documents that are at a ratio of 90 or more to a sentence of a source passage."""
    return Y.near_equal(_sayings(table(spark, sf_dir, "documents"), "doc_id"), _sayings(table(spark, sf_dir, "benchmark"), "item_id"))


@query(f"WITH {_SEEN} SELECT key, first_id FROM i WHERE key NOT IN (SELECT input_key FROM m WHERE ratio >= 90)")
def unseen_sayings(spark, sf_dir):
    """J-14: the sentences of documents that no source passage has already, each with the first document that holds it."""
    return Y.unseen(_sayings(table(spark, sf_dir, "documents"), "doc_id"), _sayings(table(spark, sf_dir, "benchmark"), "item_id"))


# ---- J-18: notes that answer ---------------------------------------------------------------------------------------

def _vectors_sql(name: str, of: str) -> str:
    return f"""{name}_c AS MATERIALIZED (SELECT id, part, string_split(rpad(t, greatest(length(t), 3)::INT, ' '), '') AS c FROM {of}),
{name}_g AS MATERIALIZED (SELECT id, part, g, count(*) AS n FROM (SELECT id, part, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS g FROM {name}_c) GROUP BY ALL),
{name}_p AS MATERIALIZED (SELECT g, ('0x' || substr(md5(g), 1, 8))::BIGINT % 384 AS place FROM (SELECT DISTINCT g FROM {name}_g)),
{name} AS MATERIALIZED (SELECT id, part, place, n / sqrt(sum(n * n) OVER (PARTITION BY id, part)) AS w FROM (SELECT id, part, place, sum(n) AS n FROM {name}_g JOIN {name}_p USING (g) GROUP BY ALL))"""


@query(f"""WITH {DOCS}, q AS (SELECT input_id AS id, 0 AS part, key AS t FROM d WHERE key <> ''),
n AS (SELECT item_id AS id, {KEY} AS key, string_split(text, chr(10)) AS lines FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT id, unnest([0, 1, 2]) AS part, unnest([key, lines[1], lines[-1]]) AS text FROM n),
k AS (SELECT id, part, {KEY} AS t FROM s), {_vectors_sql("a", "q")}, {_vectors_sql("b", "k")},
c AS (SELECT question_id, note_id, max(cosine) AS cosine FROM (SELECT a.id AS question_id, b.id AS note_id, b.part, sum(a.w * b.w) AS cosine FROM a JOIN b USING (place) GROUP BY ALL) GROUP BY ALL),
w AS (SELECT id AS note_id, list_filter(list_distinct(string_split(key, ' ')), lambda w: length(w) >= 12) AS words FROM n),
r AS (SELECT question_id, c.note_id, round(cosine + CASE WHEN len(list_filter(words, lambda w: contains(q.t, w))) > 0 THEN 0.30 ELSE 0 END, 6) AS score FROM c JOIN w USING (note_id) JOIN q ON q.id = question_id),
o AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, note_id)::INT AS rank FROM r)
SELECT question_id, note_id, score, rank FROM o WHERE rank <= 2 AND score >= 0.40""")
def answering_notes(spark, sf_dir):
    """J-18: documents as questions, source passages as notes: a passage, its first and its last line, long words as keywords."""
    from ..operators import retrieval

    d = keyed(table(spark, sf_dir, "documents"), "doc_id", "question_id")
    n = table(spark, sf_dir, "benchmark").where("text is not null").withColumn("lines", F.split("text", "\n"))
    key = lambda c: X.latin_key(c, False)
    words = F.filter(F.array_distinct(F.split(key(F.col("text")), " ")), lambda w: F.length(w) >= 12)
    notes = n.select(F.col("item_id").alias("note_id"), F.array(key(F.col("text")), key(F.get("lines", 0)), key(F.element_at("lines", -1))).alias("texts"), words.alias("keywords"))
    return retrieval.answering(d, notes)


# ---- C-18, R-6, C-20: wordings side by side ------------------------------------------------------------------------


@query(f"""WITH {DOCS}, {ITEMS} SELECT d.input_id AS doc_id, b.record_id AS item_id, trim(i.text, ' ' || chr(9) || chr(10)) AS text, 0::BIGINT AS changed
FROM d JOIN b ON length(b.key) >= 15 AND contains(d.key, b.key) JOIN benchmark i ON i.item_id = b.record_id""")
def compared_passages(spark, sf_dir):
    """C-18: source passages beside the documents that hold them; the text's runs put together, and how many differ."""
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    pairs = M.contained(keyed(d, "doc_id", "input_id"), keyed(b, "item_id", "record_id"))
    rows = pairs.join(d.select(F.col("doc_id").alias("input_id"), F.col("text").alias("source")), "input_id").join(b.select(F.col("item_id").alias("record_id"), "text"), "record_id")
    runs = W.compared_col(F.col("text"), F.col("source"))
    shown = F.array_join(F.transform(runs["text_runs"], lambda r: r["t"]), "")
    changed = F.size(F.filter(runs["text_runs"], lambda r: r["k"] != "eq")).cast("long")
    return rows.select(F.col("input_id").alias("doc_id"), F.col("record_id").alias("item_id"), shown.alias("text"), changed.alias("changed"))


#: fixed values: meaning rules of the cards (name, pattern on the user's text, pattern on the approved one)
CARD_RULES = (("of or the", r"\bof\b", r"\bthe\b"), ("in both", r"\bin\b", r"\bin\b"))
_AVOIDED = "list_filter([" + ", ".join(f"CASE WHEN len(list_filter({[p for p in avoid.split(';')]}, lambda p: contains(' ' || input_key || ' ', ' ' || p || ' '))) > 0 AND len(list_filter({[p for p in avoid.split(';')]}, lambda p: contains(' ' || input_key || ' ', ' ' || p || ' ') AND contains(array_to_string(named, ' '), p))) = 0 THEN '{term}' END" for term, avoid in GLOSSARY) + "], lambda x: x IS NOT NULL)"


@query(f"WITH {_SEEN}, n AS (SELECT input_key, seed_key, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(input_key, '{a}') AND regexp_matches(seed_key, '{b}') THEN '{n}' END" for n, a, b in CARD_RULES) + rf"""], lambda x: x IS NOT NULL) AS named FROM m WHERE ratio >= 90)
SELECT input_key, seed_key, array_to_string(list_concat(named, {_AVOIDED}), ';') AS issues, len(named) + len({_AVOIDED}) > 0 OR input_key <> seed_key AS needs_fix FROM n""")
def translation_cards(spark, sf_dir):
    """R-6 (C-18, J-8, J-9): sentences of documents beside the source passages' sentences that they nearly are."""
    pairs = Y.near_equal(_sayings(table(spark, sf_dir, "documents"), "doc_id"), _sayings(table(spark, sf_dir, "benchmark"), "item_id"))
    cards = R.translation_cards(pairs.withColumn("user_text", F.col("input_key")).withColumn("text_en", F.col("seed_key")), list(CARD_RULES), [(t, a.split(";")) for t, a in GLOSSARY])
    return cards.select("input_key", "seed_key", F.array_join("issues", ";").alias("issues"), "needs_fix")


@query()
def snapped_passages(spark, sf_dir):
    """C-20: source passages as a transcript would have them (every fifth word run into the next one), spelled again as in the
    passage that their first words find at a confidence of 80 or more."""
    b = table(spark, sf_dir, "benchmark").where("text is not null")
    words = F.split(F.regexp_replace("text", r"\s+", " "), " ")
    heard = b.select(F.col("item_id").alias("input_id"), F.array_join(F.transform(words, lambda w, i: F.concat(w, F.when(i % 5 == 4, "").otherwise(" "))), "").alias("heard"))
    inputs, corpus = keyed(heard.withColumnRenamed("heard", "text"), "input_id", "input_id"), keyed(b, "item_id", "record_id")
    found = M.gram_candidates(inputs, corpus, k=1).select("input_id", "record_id", F.lit(None).cast("boolean").alias("exact"), F.col("similarity").alias("trigram"), F.lit(None).cast("double").alias("cosine"))
    found = L.fill_semantic(found, M.hashed_vectors(corpus, "record_id", "key"), M.hashed_vectors(inputs, "input_id", "key"))
    sure = M.scored(found, inputs, corpus).where("confidence >= 80").select("input_id", "record_id")
    rows = heard.join(sure, "input_id").join(b.select(F.col("item_id").alias("record_id"), F.col("text").alias("source")), "record_id")
    return rows.select("input_id", "record_id", "heard", W.snapped_col(F.col("heard"), F.col("source")).alias("spelled"))


# ---- gates, guards, readings ---------------------------------------------------------------------------------------

#: fixed values: words of the query's rulings, sound and weak
_SOUND, _WEAK = ("the", "las", "der", "les"), ("of", "que", "und", "des")
_W = r"list_distinct(list_transform(regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{M}}\p{{N}}_''’]+'), lambda w: trim(w, '''’')))"
_IN = "len(list_intersect({}, {})) > 0"


@query(f"""WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
w AS (SELECT *, {_W.format("text")} AS said, {_W.format("before")} AS recorded, CASE WHEN before IS NULL THEN 'abstain' ELSE 'verified' END AS state FROM c),
k AS (SELECT *, {_IN.format("recorded", list(_WEAK))} AS is_weak, {_IN.format("recorded", list(_SOUND))} AS sound, {_IN.format("said", list(_WEAK))} AS says_weak, {_IN.format("said", list(_SOUND))} AS says_sound FROM w)
SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN sound AND NOT is_weak AND says_weak THEN 'contradicts a sound ruling' END, CASE WHEN is_weak AND says_sound THEN 'contradicts a weak ruling' END,
 CASE WHEN state = 'abstain' AND (says_weak OR says_sound) THEN 'grades without a verdict' END,
 CASE WHEN len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9]+'), lambda n: NOT list_contains(regexp_extract_all(coalesce(before, ''), '[0-9]+'), n))) > 0 THEN 'numbers without a source' END], lambda x: x IS NOT NULL), ';') AS problems FROM k""")
def checked_briefs(spark, sf_dir):
    """P-19, P-20: each turn as a brief on the one before it; a first turn as one without a verdict."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", before.alias("before"))
    state = F.when(F.col("before").isNull(), "abstain").otherwise("verified")
    problems = V.brief_problems(F.col("text"), F.col("before"), state, F.col("before"), _SOUND, _WEAK)
    return c.select("conv_id", "turn", F.array_join(problems, ";").alias("problems"))


@query(f"""WITH i AS (SELECT item_id, text, {KEY} AS key FROM benchmark), o AS (SELECT item_id, array_to_string(string_split(text, chr(10))[2:], chr(10)) AS text FROM benchmark), s AS (SELECT item_id, text, {KEY} AS key FROM o)
SELECT item_id, CASE WHEN i.key = s.key OR 200.0::DOUBLE * {_COMMON} / greatest(1, length(i.key) + length(s.key)) >= 85 THEN md5(trim(s.text)) ELSE md5('') END AS cleaned FROM i JOIN s USING (item_id)""")
def guarded_cleanings(spark, sf_dir):
    """R-10: source passages without their first line as cleaned texts; those that drifted too far are turned away."""
    b = table(spark, sf_dir, "benchmark")
    lines = F.split("text", "\n")
    cleaned = F.array_join(F.slice(lines, 2, F.size(lines)), "\n")
    kept = V.cleaned_or_empty(cleaned, X.latin_key(cleaned, False), X.latin_key(F.col("text"), False))
    return b.select("item_id", F.md5(kept).alias("cleaned"))


_CLOSED = ("example.org", "social.test")


@query(r"""WITH u AS (SELECT page_id, i, CASE i WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^https?://', '') WHEN 2 THEN 'ftp' || regexp_replace(url, '^https?', '') WHEN 3 THEN replace(url, '/', ' ') ELSE 'mailto:' || url END AS url FROM pages, (SELECT unnest(range(5)) AS i)),
w AS (SELECT *, regexp_matches(url, '(?i)^https?://') AS web, CASE WHEN regexp_matches(url, '(?i)^https?://') THEN url ELSE 'https://' || url END AS whole FROM u)
SELECT page_id, i::INT AS i, CASE WHEN NOT web AND regexp_matches(url, '(?i)^([a-z][a-z0-9+.-]*://|(javascript|mailto|data|file|tel|sms):)') THEN 'scheme' WHEN NOT regexp_matches(whole, '(?i)^https?://[^/\s]+(:[0-9]+)?(/|$)') OR contains(whole, ' ') THEN 'invalid'
WHEN regexp_matches(lower(regexp_extract(whole, '(?i)^https?://([^/:?#]+)', 1)), '(^|\.)(example\.org|social\.test)$') THEN 'login' ELSE 'valid' END AS link FROM w""")
def checked_links(spark, sf_dir):
    """P-16: the pages' links as they are, without their scheme, and in three forms that aren't links of the web."""
    url = F.col("url")
    forms = F.array(url, F.regexp_replace(url, "^https?://", ""), F.concat(F.lit("ftp"), F.regexp_replace(url, "^https?", "")), F.replace(url, F.lit("/"), F.lit(" ")), F.concat(F.lit("mailto:"), url))
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(forms).alias("i", "url"))
    return rows.select("page_id", "i", X.link_check(F.col("url"), list(_CLOSED)).alias("link"))


@query()
def language_gates(spark, sf_dir):
    """P-11, N-7: documents at the gate of the English interface, by the language that their text shows."""
    d = table(spark, sf_dir, "documents").withColumn("gate", X.input_gate(F.col("text"), F.lit("en")))
    return d.groupBy("gate", "lang").agg(F.count(F.lit(1)).alias("n"))


_READ = r"len(list_filter(list_transform(regexp_split_to_array(t, '\s+'), lambda w: regexp_replace(w, '[^\p{L}\p{N}\p{M}_]', '', 'g')), lambda w: regexp_matches(w, '^[A-Za-z]{3,}$')))"


@query(f"""WITH r AS (SELECT conv_id, turn, 0 AS variant, 'mixed' AS reading, text AS t FROM conversations WHERE text IS NOT NULL UNION ALL SELECT conv_id, turn, 1, 'mixed', strip_accents(text) FROM conversations WHERE text IS NOT NULL
 UNION ALL SELECT conv_id, turn, 0, 'single', strip_accents(text) FROM conversations WHERE text IS NOT NULL),
p AS (SELECT *, CASE reading WHEN 'single' THEN floor(10 * {_READ} / 1.3)::BIGINT ELSE 10 * {_READ} + CASE variant WHEN 0 THEN 1 ELSE 0 END END AS points FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY points DESC, variant, reading) AS i FROM p) SELECT conv_id, turn, variant::INT AS variant, reading, points FROM o WHERE i = 1""")
def best_readings(spark, sf_dir):
    """D-14, C-21: messages read as they are, and without accents in two ways."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    plain = F.translate("text", "áàâäãéèêëíìîïóòôöõúùûüçñÁÀÂÄÃÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÇÑ", "aaaaaeeeeiiiiooooouuuucnAAAAAEEEEIIIIOOOOOUUUUCN")
    forms = F.array(*(F.struct(F.lit(v).alias("variant"), F.lit(k).alias("reading"), t.alias("text")) for v, k, t in ((0, "mixed", F.col("text")), (1, "mixed", plain), (0, "single", plain))))
    rows = c.select(F.struct("conv_id", "turn").alias("image_id"), F.explode(forms).alias("f")).select("image_id", "f.*")
    return L.best_reading(rows).select("image_id.conv_id", "image_id.turn", "variant", "reading", "points")


@query("""SELECT c.conv_id, c.turn, CASE WHEN d.doc_id IS NOT NULL THEN to_json(struct_pack(lang := d.lang, n_chars := d.n_chars))::VARCHAR END AS facts
FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id WHERE c.role = 'user'""")
def facts_of_questions(spark, sf_dir):
    """J-21: users' turns with the facts of the document that their conversation is about."""
    q = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("doc_id"), "turn")
    return V.facts_beside(q, table(spark, sf_dir, "documents"), "doc_id", ["lang", "n_chars"]).select(F.col("doc_id").alias("conv_id"), "turn", "facts")


# ---- J-11, J-15: rulings found by searches -------------------------------------------------------------------------


def _graded(spark, sf_dir):
    """Labelled documents as cards: toxic ones are called fabricated, good ones sound, the others nothing."""
    label = F.when(F.col("toxic") == 1, "حديث موضوع").when(F.col("quality") == 1, "حديث صحيح").otherwise("")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    cards = keyed(table(spark, sf_dir, "documents"), "doc_id", "doc_id").join(labels, "doc_id", "left")
    return cards.select(F.col("doc_id").alias("card_id"), "key", F.coalesce(label, F.lit("")).alias("grade"))


def _items(spark, sf_dir):
    return keyed(table(spark, sf_dir, "benchmark"), "item_id", "saying")


@query(f"""WITH {DOCS}, {ITEMS}, w AS (SELECT record_id AS saying, string_split(key, ' ') AS w FROM b WHERE key <> ''),
q AS (SELECT saying, w[1:10] AS words FROM w UNION SELECT saying, [w[1], w[-1]] FROM w WHERE len(w) >= 3), h AS (SELECT input_id AS card_id, list_distinct(string_split(key, ' ')) AS has FROM d WHERE key <> '')
SELECT DISTINCT saying, card_id FROM q JOIN h ON list_has_all(has, words)""")
def searched_cards(spark, sf_dir):
    """J-11's search: documents that have the first ten words of a source passage, or its first and its last one."""
    return RU.found_cards(_items(spark, sf_dir), _graded(spark, sf_dir)).select("saying", "card_id")


@query()
def searched_rulings(spark, sf_dir):
    """J-11, D-8, C-2: the four most relevant rulings of each source passage, by searches and the similarity of texts."""
    return RU.ranked_by_search(_items(spark, sf_dir), _graded(spark, sf_dir).where("grade <> ''")).select("saying", "card_id", "grade", F.round("similarity", 6).alias("similarity"), "rank")


@query()
def unblocked_passages(spark, sf_dir):
    """J-15, C-2: the source passages that no document with a sound ruling blocks."""
    return RU.unblocked_by_search(_items(spark, sf_dir), _graded(spark, sf_dir)).select("saying")


# ---- N-13, R-1, R-4, R-8 in Arabic ---------------------------------------------------------------------------------


@query(rf"""WITH v AS (SELECT conv_id, turn, regexp_replace(regexp_replace((turn + 1) || '. ' || replace(text, ', ', ' (') || ')', '^\s*\d+\.\s*', ''), '\([^)]*\)|\[[^\]]*\]', ' ', 'g') AS text FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, {KEY} AS key FROM v""")
def verse_keys(spark, sf_dir):
    """N-13 for verses: messages with their turn as a verse's number, and brackets from their commas on."""
    text = F.concat((F.col("turn") + 1).cast("string"), F.lit(". "), F.replace("text", F.lit(", "), F.lit(" (")), F.lit(")"))
    c = table(spark, sf_dir, "conversations").where("text is not null")
    return c.select("conv_id", "turn", X.latin_key(P.verse_key_text(text), False).alias("key"))


def _quote(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _reason_sql(lang: str) -> str:
    texts = V.REASONS[lang]
    return "replace(replace(CASE state " + " ".join(f"WHEN '{k}' THEN {_quote(texts[k])}" for k in ("verified", "partial", "uncertain", "unreliable", "referral")) + f" ELSE {_quote(texts[''])} END, '{{where}}', item), '{{conf}}', confidence::VARCHAR)"


_LABELS_AR = "CASE state " + " ".join(f"WHEN '{k}' THEN {_quote(v)}" for k, v in R.REPLIES["ar"]["labels"].items()) + " END"


@query(f"""WITH {DOCS}, {ITEMS}, c AS (SELECT d.input_id AS doc_id, 'item ' || b.record_id AS item, (100 * length(b.key) // length(d.key))::INT AS confidence, count(*) OVER (PARTITION BY b.record_id) - 1 AS others FROM d JOIN b ON length(b.key) >= 15 AND contains(d.key, b.key)),
s AS (SELECT *, CASE WHEN confidence >= 90 THEN 'verified' WHEN confidence >= 75 THEN 'partial' WHEN confidence >= 50 THEN 'uncertain' ELSE 'abstain' END AS state FROM c)
SELECT doc_id, item, {_reason_sql("en")} AS reason_en, {_reason_sql("ar")} AS reason_ar,
 concat_ws(' ', {_LABELS_AR} || '.', {_reason_sql("ar")}, CASE WHEN state IN ('verified', 'partial', 'unreliable') AND others > 0 THEN replace({_quote(R.REPLIES["ar"]["more"])}, '%d', others::VARCHAR) END, {_quote(R.REPLIES["ar"]["end"])}) AS reply_ar FROM s""")
def bilingual_reports(spark, sf_dir):
    """R-1, R-8, C-12 in both languages: documents with the source passages that they hold; confidence is the passage's share of the document."""
    d, b = work_table(keyed(table(spark, sf_dir, "documents"), "doc_id", "input_id")), work_table(keyed(table(spark, sf_dir, "benchmark"), "item_id", "record_id"))
    size = lambda df, id_, name: df.select(id_, F.length("key").alias(name))
    rows = M.contained(d, b, written=True).join(size(d, "input_id", "n"), "input_id").join(size(b, "record_id", "m"), "record_id")
    rows = rows.withColumn("confidence", F.floor(100 * F.col("m") / F.col("n")).cast("int")).withColumn("state", S.state(F.col("confidence")))
    rows = rows.withColumn("others", F.count(F.lit(1)).over(Window.partitionBy("record_id")) - 1).withColumn("item", F.concat(F.lit("item "), F.col("record_id").cast("string")))
    why = {lang: V.reason(F.col("state"), F.col("confidence"), F.col("item"), lang) for lang in ("en", "ar")}
    reply = R.compose_reply(F.col("state"), why["ar"], F.lit(None).cast("string"), F.col("others"), "ar")
    return rows.select(F.col("input_id").alias("doc_id"), "item", why["en"].alias("reason_en"), why["ar"].alias("reason_ar"), reply.alias("reply_ar"))
