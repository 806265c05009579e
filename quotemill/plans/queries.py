"""The registered queries of the quotation engine: each over its whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import routing as Z
from ..functions import similarity as S
from ..functions import text as X
from ..operators import evaluate as E
from ..operators import maintain as K
from ..operators import matching as M
from ..streaming import state as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: fixed values: English words of the whole-word terms that notes are kept for, with phrases to avoid
GLOSSARY = (("the", "of the;in the"), ("and", "for the"), ("thing", "with the;on the"), ("for", "and the"), ("with", "to the"))


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(df: DataFrame, id_: str, to: str) -> DataFrame:
    """Ids and Latin keys of stored texts (their compatibility forms are folded when they are stored)."""
    return df.where("text is not null").select(F.col(id_).alias(to), X.latin_key(F.col("text"), False).alias("key"))


KEY = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[’‘`´]', '''', 'g'), '[^a-z0-9''\s]', ' ', 'g'), '\s+', ' ', 'g'))"
DOCS = f"d AS (SELECT doc_id AS input_id, {KEY} AS key FROM documents WHERE text IS NOT NULL)"
ITEMS = f"b AS (SELECT item_id AS record_id, {KEY} AS key FROM benchmark WHERE text IS NOT NULL)"
WORDS = "list_filter(string_split(key, ' '), lambda w: w <> '')"


def sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# ---- matching ------------------------------------------------------------------------------------------------------


@query(f"""WITH {DOCS}, {ITEMS} SELECT DISTINCT d.input_id AS doc_id, b.record_id AS item_id, 'exact' AS stage, 100 AS confidence, 'verified' AS state
FROM d JOIN b ON length(b.key) >= 15 AND contains(d.key, b.key)""")
def verify_contained(spark, sf_dir):
    """J-2, C-12: the flagship. Every document against every source passage."""
    hits = M.contained(keyed(table(spark, sf_dir, "documents"), "doc_id", "input_id"), keyed(table(spark, sf_dir, "benchmark"), "item_id", "record_id"))
    return hits.select(F.col("input_id").alias("doc_id"), F.col("record_id").alias("item_id"), F.lit("exact").alias("stage"), F.lit(100).alias("confidence"), S.state(F.lit(100)).alias("state"))


@query()
def verify_cascade(spark, sf_dir):
    """J-1..J-3, J-5, A-2, C-5..C-12, C-15, D-1, D-3: passages looked for in the texts of pages, five ranked candidates each."""
    return M.verify(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("input_id"), "text"), table(spark, sf_dir, "pages").select(F.col("page_id").alias("record_id"), X.strip_tags(F.col("html")).alias("text")))


@query(f"""WITH {DOCS}, k AS (SELECT input_id, upper(key) || '  ' AS text FROM d), u AS (SELECT input_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS key FROM k)
SELECT u.input_id AS doc_id, b.record_id FROM u JOIN (SELECT input_id AS record_id, key FROM d WHERE input_id % 3 = 0) b USING (key) WHERE key <> ''""")
def match_equal(spark, sf_dir):
    """J-1: every document in capitals against every third one as it is."""
    d = keyed(table(spark, sf_dir, "documents"), "doc_id", "input_id")
    loud = d.select("input_id", X.latin_key(F.concat(F.upper("key"), F.lit("  ")), False).alias("key"))
    return M.exact(loud, d.where("input_id % 3 = 0").withColumnRenamed("input_id", "record_id")).select(F.col("input_id").alias("doc_id"), "record_id")


@query(f"WITH {DOCS}, g AS (SELECT key, count(*) AS n, min(input_id) AS first_id FROM d WHERE key <> '' GROUP BY key HAVING count(*) > 1) SELECT input_id AS doc_id, n, first_id FROM d JOIN g USING (key)")
def equivalents(spark, sf_dir):
    """J-7: documents whose keys are equal, with the first of them."""
    d = keyed(table(spark, sf_dir, "documents"), "doc_id", "doc_id").where("key <> ''").select("doc_id", F.sha2("key", 256).alias("key"))
    g = d.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")
    return d.join(g, "key").select("doc_id", "n", "first_id")


def _grams_sql(words: str) -> str:
    """The trigrams of words, each with two spaces before and one behind it, in their order."""
    return f"flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i::INT, 3))))"


@query(f"""WITH {ITEMS}, p AS (SELECT record_id AS input_id, list_distinct({_grams_sql(f"list_slice({WORDS}, 1, 12)")}) AS wanted FROM b WHERE key <> ''),
r AS (SELECT record_id, {_grams_sql(WORDS)} AS row FROM b WHERE key <> ''),
g AS MATERIALIZED (SELECT record_id, unnest(range(1, len(row) + 1))::INT AS pos, unnest(row) AS gram FROM r),
o AS MATERIALIZED (SELECT *, coalesce(lag(pos) OVER (PARTITION BY record_id, gram ORDER BY pos), 0) AS earlier FROM g),
h AS MATERIALIZED (SELECT input_id, record_id, pos, earlier, list_contains(wanted, gram)::INT AS hit, len(wanted) AS n FROM p JOIN o ON true),
e AS (SELECT a.input_id, a.record_id, a.pos AS start, a.n, sum(b.hit) OVER w AS shared, sum(1 - b.hit) OVER w AS other
      FROM h a JOIN h b ON a.input_id = b.input_id AND a.record_id = b.record_id AND b.pos >= a.pos AND b.earlier < a.pos WHERE a.hit = 1 WINDOW w AS (PARTITION BY a.input_id, a.record_id, a.pos ORDER BY b.pos)),
s AS (SELECT input_id, record_id, max(shared::DOUBLE / (n + other)::DOUBLE) AS similarity FROM e GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY similarity DESC, record_id) AS rank FROM s WHERE similarity >= 0.35)
SELECT input_id, record_id, similarity, rank::INT AS rank FROM k WHERE rank <= 25""")
def gram_candidates(spark, sf_dir):
    """J-3, C-4 among the source passages."""
    b = keyed(table(spark, sf_dir, "benchmark"), "item_id", "record_id")
    return M.gram_candidates(b.withColumnRenamed("record_id", "input_id"), b)


@query("""WITH s AS (SELECT q.vec_id AS query_id, r.vec_id AS row_id, round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) AS cosine FROM embeddings q JOIN embeddings r ON q.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, row_id) AS rank FROM s) SELECT query_id, row_id, cosine, rank::INT AS rank FROM k WHERE rank <= 25""")
def nearest_vectors(spark, sf_dir):
    """J-4, D-9: the 25 nearest of every hundredth vector among all."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"))
    return M.nearest(rows.where("row_id % 100 = 0").withColumnRenamed("row_id", "query_id"), rows)


_SEM = "greatest(0.0, least(100.0, (cosine - 0.25) / 0.65 * 100.0))"


@query(f"""WITH s AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT arg_min(embedding, vec_id) FROM embeddings)::DOUBLE[]), 6) AS cosine FROM embeddings),
t AS (SELECT vec_id, cosine, round({_SEM}, 6) AS semantic, round_even(0.5 * 80 + 0.5 * round({_SEM}, 6), 0)::INT AS confidence FROM s)
SELECT *, CASE WHEN confidence >= 90 THEN 'verified' WHEN confidence >= 75 THEN 'partial' WHEN confidence >= 50 THEN 'uncertain' ELSE 'abstain' END AS state FROM t""")
def confidence_of_vectors(spark, sf_dir):
    """C-6, C-7, C-12, C-16: every vector against the first one, at a wording score of 80."""
    e = table(spark, sf_dir, "embeddings")
    first = e.orderBy("vec_id").limit(1).select("embedding").first()
    query_ = F.array(*map(F.lit, first[0] if first else [0.0])).cast("array<double>")
    cosine = F.round(S.dot(S.unit(F.col("embedding").cast("array<double>")), S.unit(query_)), 6)
    rows = e.select("vec_id", cosine.alias("cosine")).withColumn("semantic", F.round(S.semantic(F.col("cosine"), "en"), 6))
    rows = rows.withColumn("confidence", S.confidence(F.lit(80.0), F.col("semantic"), "en"))
    return rows.withColumn("state", S.state(F.col("confidence")))


@query()
def narrations_of_documents(spark, sf_dir):
    """J-6, D-7: documents that carry another document's text, ten each."""
    d = keyed(table(spark, sf_dir, "documents"), "doc_id", "record_id")
    return M.narrations(d)


# ---- keys, windows, languages --------------------------------------------------------------------------------------


@query(f"""WITH {DOCS}, w AS (SELECT input_id AS doc_id, {WORDS} AS w FROM d), n AS (SELECT *, len(w) AS n FROM w),
p AS (SELECT doc_id, w, unnest(range(0, least(3, ceil(greatest(n - 16, 0) / 10.0)::INT + 1))) AS pos FROM n WHERE n > 0)
SELECT doc_id, pos::INT AS pos, array_to_string(w[pos * 10 + 1 : pos * 10 + 16], ' ') AS window_text FROM p""")
def word_windows(spark, sf_dir):
    """N-14."""
    d = keyed(table(spark, sf_dir, "documents"), "doc_id", "doc_id")
    return d.select("doc_id", F.posexplode(X.windows(F.col("key"))).alias("pos", "window_text"))


@query(f"WITH {DOCS} SELECT input_id AS doc_id, len(list_filter(string_split(key, ' '), lambda w: length(w) >= 3 AND w NOT IN ({sql_list(X.STOP_EN)})))::INT AS n_content FROM d")
def content_word_counts(spark, sf_dir):
    """N-15."""
    return keyed(table(spark, sf_dir, "documents"), "doc_id", "doc_id").select("doc_id", F.size(X.content_words(F.col("key"))).alias("n_content"))


@query(f"""WITH {ITEMS}, w AS (SELECT record_id, {WORDS} AS w FROM b), n AS (SELECT *, len(w) AS n, greatest(0, len(w) // 2 - 7) AS m FROM w),
p AS (SELECT record_id, CASE WHEN n <= 14 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[1:14], ' '), array_to_string(w[m + 1 : m + 14], ' '), array_to_string(w[n - 13 : n], ' ')] END AS p FROM n)
SELECT DISTINCT record_id AS item_id, unnest(p) AS probe FROM p""")
def item_probes(spark, sf_dir):
    """N-16."""
    return keyed(table(spark, sf_dir, "benchmark"), "item_id", "item_id").select("item_id", F.explode(X.probes(F.col("key"))).alias("probe"))


@query(r"SELECT CASE WHEN length(regexp_replace(text, '[^؀-ۿ]', '', 'g')) >= 0.6 * length(regexp_replace(text, '[^A-Za-z]', '', 'g')) THEN 'ar' ELSE 'en' END AS script, lang, count(*) AS n FROM documents GROUP BY ALL")
def scripts(spark, sf_dir):
    """N-6 by stored language."""
    return table(spark, sf_dir, "documents").groupBy(X.script(F.col("text")).alias("script"), "lang").agg(F.count(F.lit(1)).alias("n"))


@query()
def script_languages(spark, sf_dir):
    """N-7 by stored language."""
    return table(spark, sf_dir, "documents").groupBy(X.text_language(F.col("text")).alias("language"), "lang").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {ITEMS}, g AS (SELECT record_id, unnest(list_transform(range(1, length(rpad(key, greatest(length(key), 3)::INT, ' ')) - 1), lambda i: ('0x' || substr(md5(substr(rpad(key, greatest(length(key), 3)::INT, ' '), i::INT, 3)), 1, 8))::BIGINT % 384)) AS d FROM b),
c AS (SELECT record_id, d, count(*) AS n FROM g GROUP BY ALL) SELECT record_id AS item_id, d::INT AS place, round(n / sqrt(sum(n * n) OVER (PARTITION BY record_id)), 6) AS weight FROM c""")
def hashed_embeddings(spark, sf_dir):
    """C-15, C-16 of the source passages."""
    e = S.hash_embedding(keyed(table(spark, sf_dir, "benchmark"), "item_id", "item_id"), "item_id", "key")
    return e.withColumn("weight", F.round("weight", 6))


# ---- pages, messages, inputs ---------------------------------------------------------------------------------------


@query(r"SELECT lower(regexp_extract(url, '(?i)^https?://([^/:?#]+)', 1)) AS host, count(*) AS n FROM pages GROUP BY ALL")
def page_hosts(spark, sf_dir):
    """P-16's key: pages by host."""
    return table(spark, sf_dir, "pages").groupBy(X.host_of(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT page_id, length(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>|<[^>]+>', ' ', 'g'),
'&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')))::INT AS n_text FROM pages""")
def page_texts(spark, sf_dir):
    """X-9: length of the text of a page."""
    return table(spark, sf_dir, "pages").select("page_id", F.length(X.strip_tags(F.col("html"))).alias("n_text"))


_GATE = "CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN length(text) > 2000 THEN 'too long' WHEN lang <> 'en' THEN 'language' ELSE 'valid' END"


@query(f"SELECT {_GATE} AS gate, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL")
def input_gates(spark, sf_dir):
    """P-11: why inputs are turned away."""
    gate = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty").when(F.length("text") > 2000, "too long").when(F.col("lang") != "en", "language").otherwise("valid")
    return table(spark, sf_dir, "documents").groupBy(gate.alias("gate")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query()
def message_routes(spark, sf_dir):
    """P-18, X-10: messages after the first of a conversation have an open report."""
    c = table(spark, sf_dir, "conversations").withColumn("payload", Z.payload_of(F.col("text")))
    return c.groupBy(Z.route(F.col("text"), F.col("payload"), F.col("turn") > 0).alias("route"), "role").agg(F.count(F.lit(1)).alias("n"))


_TERMS = "(VALUES " + ", ".join(f"('{t}', '{a}')" for t, a in GLOSSARY) + ") g(term, avoid)"


@query(f"""WITH {DOCS}, s AS (SELECT input_id, ' ' || key || ' ' AS key FROM d), n AS (SELECT term, contains(s.key, ' ' || term || ' ') AS hit, len(list_filter(string_split(avoid, ';'), lambda a: contains(s.key, ' ' || a || ' '))) AS high
FROM s, {_TERMS}) SELECT term, CASE WHEN high > 0 THEN 'high' ELSE 'low' END AS severity, count(*) AS n FROM n WHERE hit OR high > 0 GROUP BY ALL""")
def glossary_notes(spark, sf_dir):
    """J-8, D-17: texts with a glossary's term (low) or with a phrase to avoid for it, with the term or without (high)."""
    d = keyed(table(spark, sf_dir, "documents"), "doc_id", "doc_id")
    return d.select(F.explode(M.glossary_notes(F.col("key"), [(t, a.split(";")) for t, a in GLOSSARY])).alias("x")).groupBy("x.term", "x.severity").agg(F.count(F.lit(1)).alias("n"))


# ---- aggregates and evaluation -------------------------------------------------------------------------------------


@query("SELECT lang AS kind, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'glossary', 5")
def corpus_counts(spark, sf_dir):
    """A-1: rows by kind and the glossary's."""
    d = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return d.unionByName(spark.range(1).select(F.lit("glossary").alias("kind"), F.lit(len(GLOSSARY)).cast("long").alias("n")))


_OUT = """SELECT d.lang AS "group", l.quality = 1 AS ok, l.toxic = 1 AS wrong, d.n_chars::DOUBLE AS ms FROM documents d JOIN labels l USING (doc_id)"""


def _outcomes(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("lang").alias("group"), (F.col("quality") == 1).alias("ok"), (F.col("toxic") == 1).alias("wrong"), F.col("n_chars").cast("double").alias("ms"))


@query(f'SELECT "group", count(*) AS n, avg(ok::INT) AS accuracy, count(*) FILTER (wrong) AS wrong, median(ms) AS median_ms FROM ({_OUT}) GROUP BY ROLLUP ("group")')
def group_metrics(spark, sf_dir):
    """A-5, A-6."""
    return E.group_metrics(_outcomes(spark, sf_dir))


@query("""SELECT l.quality::VARCHAR AS label, count(*) FILTER (d.n_chars < 500) AS short, count(*) FILTER (d.n_chars BETWEEN 500 AND 4999) AS middle, count(*) FILTER (d.n_chars >= 5000) AS long
FROM documents d JOIN labels l USING (doc_id) GROUP BY 1""")
def outcome_matrix(spark, sf_dir):
    """A-7."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    outcome = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 5000, "middle").otherwise("long")
    return E.outcome_matrix(rows.select(F.col("quality").cast("string").alias("label"), outcome.alias("outcome")), ["short", "middle", "long"])


@query("""WITH s AS (SELECT doc_id, md5(doc_id::VARCHAR || source) AS digest FROM documents ORDER BY digest, doc_id LIMIT 60) SELECT doc_id, digest FROM s ORDER BY digest OFFSET 30""")
def hashed_sample(spark, sf_dir):
    """D-13: rows 30..60 by hash, a sampling operator."""
    return E.hash_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), ["doc_id", "source"], 30, 30).select("doc_id", "digest")


@query(r"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '\S+')) BETWEEN 50 AND 200 AND length(text) BETWEEN 300 AND 1500 AND text ILIKE 'the%'")
def filtered_sample(spark, sf_dir):
    """P-22."""
    n = F.size(F.regexp_extract_all("text", F.lit(r"\S+"), 0))
    return table(spark, sf_dir, "documents").where(n.between(50, 200) & F.length("text").between(300, 1500) & F.col("text").ilike("the%")).select("doc_id")


def _pick(salt: str, n: str) -> str:
    return f"(('0x' || substr(md5(record_id::VARCHAR || '{salt}'), 1, 8))::BIGINT % ({n}))::INT"


def _typo(word: str, salt: str) -> str:
    at, how = _pick(f"at{salt}", f"greatest(length({word}) - 2, 1)"), _pick(f"how{salt}", "3")
    return f"""CASE WHEN length({word}) < 4 THEN {word} WHEN {how} = 0 THEN substr({word}, 1, {at} + 1) || substr({word}, {at} + 3)
 WHEN {how} = 1 THEN substr({word}, 1, {at} + 1) || substr({word}, {at} + 3, 1) || substr({word}, {at} + 2, 1) || substr({word}, {at} + 4) ELSE left({word}, length({word}) - 1) END"""


def _in_one_word(text: str, salt: str, change: str) -> str:
    words = f"string_split({text}, ' ')"
    return f"array_to_string(list_transform({words}, lambda x, j: CASE WHEN j = {_pick(f'word{salt}', f'len({words})')} + 1 THEN {change} ELSE x END), ' ')"


def _variant(text: str) -> str:
    once = _in_one_word(text, "1", _typo("x", "1"))
    return f"CASE {_pick('typos', '2')} WHEN 0 THEN {once} ELSE {_in_one_word('(' + once + ')', '2', _typo('x', '2'))} END"


def _wrapped(text: str) -> str:
    return f"CASE {_pick('wrapper', '4')} " + " ".join(f"WHEN {i} THEN {sql_list([a])} || {text} || {sql_list([b])}" for i, (a, b) in enumerate(E.WRAPPERS)) + " END"


def _misquote(text: str) -> str:
    return _in_one_word(text, "", f"CASE WHEN length(x) >= 4 THEN {_typo('x', '')} ELSE x || 'ا' END")


@query(f"""WITH {ITEMS}, v AS (SELECT *, {_variant("key")} AS typed FROM b WHERE key <> '')
SELECT record_id, 'exact' AS "group", key AS text, 'verified' AS expect FROM v UNION ALL SELECT record_id, 'variant', {_wrapped("typed")}, 'partial' FROM v UNION ALL SELECT record_id, 'misquote', {_misquote("key")}, 'partial' FROM v""")
def labelled_set(spark, sf_dir):
    """G-1..G-3 over the source passages."""
    return E.labelled(keyed(table(spark, sf_dir, "benchmark"), "item_id", "record_id"))


def _labelled_sources(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    of = lambda label: keyed(docs.join(labels.where(label).select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id", "record_id")
    turns = table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    items = keyed(table(spark, sf_dir, "benchmark"), "item_id", "record_id")
    return {
        "sahih_exact": items, "sahih_variant": items, "fabricated_or_weak": of("toxic = 1"), "ayah_exact": of("quality = 1"), "ayah_misquoted": of("quality = 1"),
        "invented": keyed(turns.where("role = 'assistant'"), "id", "record_id"), "fatwa": keyed(turns.where("role = 'user'"), "id", "record_id"),
    }


_SOURCES_SQL = f"""{DOCS}, {ITEMS}, toxic AS (SELECT input_id AS record_id, key FROM d WHERE input_id IN (SELECT doc_id FROM labels WHERE toxic = 1)), good AS (SELECT input_id AS record_id, key FROM d WHERE input_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
turns AS (SELECT conv_id * 1000 + turn AS record_id, role, {KEY} AS key FROM conversations WHERE text IS NOT NULL)"""


def _group_sql(group: str, rows: str, text: str) -> str:
    form, states, named = E.GROUPS[group]
    ids = "array_to_string(list_sort(list(record_id) OVER (PARTITION BY key)), ',')" if named else "NULL"
    return f"""SELECT '{group}' AS "group", record_id, md5({text}) AS text, '{",".join(states)}' AS states, {ids} AS records FROM ({rows}) WHERE key <> ''"""


@query(f"WITH {_SOURCES_SQL} " + " UNION ALL ".join((
    _group_sql("sahih_exact", "SELECT * FROM b", "key"), _group_sql("sahih_variant", f"SELECT *, {_variant('key')} AS typed FROM b", _wrapped("typed")), _group_sql("fabricated_or_weak", "SELECT * FROM toxic", "key"),
    _group_sql("ayah_exact", "SELECT * FROM good", "key"), _group_sql("ayah_misquoted", f"SELECT *, {_misquote('key')} AS typed FROM good", "typed"),
    _group_sql("invented", "SELECT * FROM turns WHERE role = 'assistant'", "key"), _group_sql("fatwa", "SELECT * FROM turns WHERE role = 'user'", "key"),
)))
def seven_groups(spark, sf_dir):
    """G-4: source passages, labelled documents and turns as the seven groups, with the records that are right."""
    rows = E.build_labelled(_labelled_sources(spark, sf_dir))
    return rows.select("group", "record_id", F.md5("text").alias("text"), F.array_join("expect_state", ",").alias("states"), F.array_join(F.col("expect_record").cast("array<string>"), ",").alias("records"))


@query(f"""WITH {ITEMS}, a AS (SELECT 'ar' || record_id AS item, 'ar' AS lang, key AS text, record_id::VARCHAR AS records, NULL AS expect_error FROM b WHERE key <> '' ORDER BY record_id LIMIT 20),
e AS (SELECT 'en' || item_id AS item, 'en' AS lang, CASE WHEN starts_with(lower(text), 'narrated') AND contains(text, ':') THEN trim(regexp_replace(text, '^[^:]*:', '')) ELSE text END AS text, item_id::VARCHAR AS records, NULL AS expect_error
 FROM benchmark WHERE length(text) BETWEEN 60 AND 260 ORDER BY md5('voice' || item_id), item_id LIMIT 10)
SELECT * FROM a UNION ALL SELECT * FROM e UNION ALL SELECT 'neg_' || column0, NULL, NULL, NULL, column1 FROM (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, b in E.REFUSED) + """) v(column0, column1)""")
def voice_labels(spark, sf_dir):
    """G-5: a voice set of the source passages."""
    b = table(spark, sf_dir, "benchmark")
    rows = E.voice_labels(E.build_labelled({"sahih_exact": keyed(b, "item_id", "record_id")}), b.select(F.col("item_id").alias("record_id"), F.col("text").alias("text_en")))
    return rows.select("item", "lang", "text", F.array_join(F.col("expect_record").cast("array<string>"), ",").alias("records"), "expect_error")


@query()
def word_errors(spark, sf_dir):
    """A-9, C-19: word error rates of the labelled set's forms against their records, by group."""
    b = keyed(table(spark, sf_dir, "benchmark"), "item_id", "record_id")
    rows = E.labelled(b).join(b, "record_id").withColumn("wer", S.word_error_rate_col(F.col("key"), F.col("text")))
    return rows.groupBy("group").agg(F.median("wer").alias("median"), F.avg("wer").alias("mean"), F.count_if(F.col("wer") == 0).alias("perfect"))


# ---- table maintenance ---------------------------------------------------------------------------------------------

_NEW = "SELECT c_custkey, c_name || '*' AS c_name, c_nationkey, c_acctbal + 1 AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey + 1000000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 5 = 0"


@query(f"WITH n AS ({_NEW}) SELECT * FROM n UNION ALL SELECT * FROM customer c WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.c_custkey = c.c_custkey)")
def upsert_customers(spark, sf_dir):
    """K-1: a third of the customers changed, a fifth new ones."""
    c = table(spark, sf_dir, "customer")
    changed = c.where("c_custkey % 3 = 0").withColumn("c_name", F.concat("c_name", F.lit("*"))).withColumn("c_acctbal", F.col("c_acctbal") + 1)
    new = c.where("c_custkey % 5 = 0").withColumn("c_custkey", F.col("c_custkey") + 1_000_000_000)
    return K.upsert(c, changed.unionByName(new), ["c_custkey"])


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey, 1, 0.0 FROM orders WHERE o_orderkey % 7 = 0")
def replaced_lines(spark, sf_dir):
    """K-2: the lines of every seventh order give way to one new line."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    changed = table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return K.replace_children(lines, "l_orderkey", changed, changed.select("l_orderkey", F.lit(1).alias("l_linenumber"), F.lit(0.0).alias("l_quantity")))


@query("SELECT p_partkey, replace(lower(p_type), 'a', '') AS new_key FROM part WHERE replace(lower(p_type), 'a', '') IS DISTINCT FROM lower(p_type)")
def changed_part_keys(spark, sf_dir):
    """K-3: only the rows whose recomputed key differs."""
    return K.changed_keys(table(spark, sf_dir, "part").withColumn("p_type", F.lower("p_type")), "p_type", F.replace("p_type", F.lit("a"), F.lit(""))).select("p_partkey", "new_key")


@query("""WITH o AS (SELECT p_partkey, p_size FROM part), n AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part)
SELECT *, 'left' AS side FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM n) UNION ALL SELECT *, 'right' FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM o)""")
def key_parity(spark, sf_dir):
    """U-7."""
    o = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return K.parity(o, o.withColumn("p_size", F.when(F.col("p_partkey") % 10 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))))


@query("SELECT c.c_custkey, coalesce(n.n_name, c.c_mktsegment) AS c_mktsegment FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey AND n.n_regionkey < 3")
def enriched_customers(spark, sf_dir):
    """K-8: found values replace old ones, unmatched rows keep theirs."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    found = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("c_mktsegment"))
    return K.enrich(c, found, "c_nationkey", ["c_mktsegment"]).select("c_custkey", "c_mktsegment")


@query("SELECT DISTINCT o_custkey AS c_custkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS hit FROM orders")
def memo_lookup(spark, sf_dir):
    """K-6: which of the asked keys the cache holds."""
    hits, misses = K.memo(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), table(spark, sf_dir, "customer").where("c_acctbal > 0"), "c_custkey")
    return hits.select("c_custkey", F.lit(True).alias("hit")).unionByName(misses.withColumn("hit", F.lit(False)))


@query("""WITH b AS (SELECT n_nationkey AS band, n_nationkey * 2 AS low, n_nationkey * 2 + 2 AS high FROM nation) SELECT band, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN b ON l_quantity >= low AND l_quantity < high GROUP BY band""")
def quantity_bands(spark, sf_dir):
    """J-10: a range join made equal by exploding the small side's ranges."""
    bands = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("band"), F.explode(F.sequence(F.col("n_nationkey") * 2, F.col("n_nationkey") * 2 + 1)).alias("q"))
    rows = table(spark, sf_dir, "lineitem").select(F.floor("l_quantity").cast("int").alias("q"), "l_extendedprice")
    return rows.join(bands, "q").groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


# ---- time ----------------------------------------------------------------------------------------------------------


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n_recent FROM events")
def requests_in_window(spark, sf_dir):
    """The metric beside T-1, an hour back."""
    return T.requests_in_window(table(spark, sf_dir, "events"), 3600)


_ORDERED_EVENTS = "e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)"


@query(f"""WITH RECURSIVE {_ORDERED_EVENTS}, r AS (SELECT user_id, event_id, ts, i, TRUE AS admitted, [ts] AS recent FROM e WHERE i = 1
UNION ALL SELECT user_id, event_id, ts, i, len(live) < 2, CASE WHEN len(live) < 2 THEN list_append(live, ts) ELSE live END
FROM (SELECT e.user_id, e.event_id, e.ts, e.i, list_filter(r.recent, lambda t: e.ts - t < INTERVAL 3600 SECOND) AS live FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1))
SELECT user_id, event_id, ts, admitted FROM r""")
def admitted_requests(spark, sf_dir):
    """T-1: at most two admitted an hour."""
    return T.admit(table(spark, sf_dir, "events"), 2, 3600)


@query(f"""WITH RECURSIVE {_ORDERED_EVENTS}, r AS (SELECT user_id, event_id, i, FALSE AS skipped, CASE WHEN value > 90 THEN ts + INTERVAL 6 HOUR END AS until FROM e WHERE i = 1
UNION ALL SELECT e.user_id, e.event_id, e.i, coalesce(e.ts < r.until, FALSE), CASE WHEN e.value > 90 AND NOT coalesce(e.ts < r.until, FALSE) THEN e.ts + INTERVAL 6 HOUR ELSE r.until END
FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT event_id, user_id::VARCHAR AS key, skipped FROM r""")
def cooled_down_calls(spark, sf_dir):
    """T-6: a value over 90 fails and pauses the user for six hours."""
    return T.cooldown(table(spark, sf_dir, "events"), "user_id", F.coalesce(F.col("value") > 90, F.lit(False)), 6 * 3600)


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) SELECT user_id, event_id, rank::INT AS rank FROM o WHERE rank <= 50""")
def recent_history(spark, sf_dir):
    """D-12: the newest fifty of each user, a top-k report."""
    return T.recent(table(spark, sf_dir, "events"), "user_id", "event_id", "ts").select("user_id", "event_id", "rank")


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 14 DAY GROUP BY 1")
def retained_events(spark, sf_dir):
    """T-4: fourteen days back from the last event."""
    e = table(spark, sf_dir, "events")
    return T.retain(e, "ts", F.lit(e.agg(F.max("ts")).first()[0])).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def daily_states(spark, sf_dir):
    """T-8."""
    return T.windowed_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts > coalesce(lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE, ts - INTERVAL 1 DAY) THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def user_sessions(spark, sf_dir):
    """T-8: sessions with half an hour's gap."""
    return T.sessions(table(spark, sf_dir, "events"))
