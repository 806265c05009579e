"""Joins that look something up for a record, spans chosen for an input, and gates on a model's answers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import similarity as S
from ..functions import text as X
from ..functions.spans import word_score

# fixed values: how much an unmarked fragment must beat the whole text by; the least confidence of a match; most spans; texts so long are cut
SPAN_MARGIN, MATCHED, MOST_SPANS, SHORT_TEXT = 10, 50, 8, 220


def with_names(rows: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """J-22: `column` in the names' language where names(name, other) knows it, else as it is. A name that comes twice takes the smallest."""
    known = names.groupBy("name").agg(F.min("other").alias("_other"))
    return rows.join(known, rows[column] == known["name"], "left").withColumn(column, F.coalesce("_other", column)).select(*rows.columns)


def with_translation(rows: DataFrame, translations: DataFrame, key: str) -> DataFrame:
    """J-13: translations(key, text_en) beside rows, empty where there is none."""
    return rows.join(translations.select(key, "text_en"), key, "left").withColumn("text_en", F.coalesce("text_en", F.lit("")))


def new_terms(found: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    """J-19: found terms with a meaning that the seed doesn't hold."""
    return found.where(F.trim(F.coalesce("meaning", F.lit(""))) != "").join(seed.select(key).distinct(), key, "left_anti")


def title_key(c: Column) -> Column:
    """J-20: a title without diacritics and a leading article; hamza stays."""
    return F.regexp_replace(F.trim(X.strip_marks(c)), "^ال", "")


def by_title(terms: DataFrame, pages: DataFrame, most: int = 25) -> DataFrame:
    """J-20: terms(term) with the url of the first of the first `most` pages(title, url, position) of the same title key."""
    first = pages.where(F.col("position") < most).groupBy(title_key(F.col("title")).alias("_k")).agg(F.min_by("url", "position").alias("url"))
    return terms.withColumn("_k", title_key(F.col("term"))).join(first, "_k", "left").drop("_k")


def expected_found(outcomes: DataFrame) -> DataFrame:
    """J-17 over (expected array, got, narrations array): the very record, or one of its parallels."""
    same = F.coalesce(F.array_contains("expected", F.col("got")), F.lit(False))
    return outcomes.withColumn("same", same).withColumn("same_record", same | F.coalesce(F.arrays_overlap("expected", "narrations"), F.lit(False)))


def grounding(records: DataFrame, sections: DataFrame, explanations: DataFrame) -> DataFrame:
    """J-23: a verse takes the text of its section if that is over 200 characters, another record its explanation if over 150, else null.
    sections(record_id, section_text), explanations(record_id, explanation): one row each."""
    rows = records.join(sections, "record_id", "left").join(explanations, "record_id", "left")
    verse = F.when(F.length("section_text") > 200, F.col("section_text"))
    other = F.when(F.length("explanation") > 150, F.col("explanation"))
    return rows.select("record_id", F.when(F.col("kind") == "quran", verse).otherwise(other).alias("grounding"))


def of_kinds(rows: DataFrame, kinds: list[str] | None) -> DataFrame:
    """P-13: rows of these kinds; no list lets all pass."""
    return rows if kinds is None else rows.where(F.col("kind").isin(kinds))


def best_window(hits: DataFrame) -> DataFrame:
    """A-2: a record's nearest window of (input_id, record_id, cosine)."""
    return hits.groupBy("input_id", "record_id").agg(F.max("cosine").alias("cosine"))


def fill_semantic(cands: DataFrame, windows: DataFrame, inputs: DataFrame) -> DataFrame:
    """C-11: candidates(input_id, record_id, cosine) that came without a cosine take their record's best window's; windows(record_id,
    vector) and inputs(input_id, vector) are of length one."""
    missing = cands.where("cosine is null").select("input_id", "record_id").distinct()
    rows = missing.join(windows.select("record_id", F.col("vector").alias("_w")), "record_id").join(inputs.select("input_id", F.col("vector").alias("_v")), "input_id")
    found = best_window(rows.select("input_id", "record_id", S.dot(F.col("_w"), F.col("_v")).alias("cosine"))).withColumnRenamed("cosine", "_late")
    return cands.join(found, ["input_id", "record_id"], "left").withColumn("cosine", F.coalesce("cosine", "_late")).drop("_late")


def meaning_only(cands: DataFrame) -> Column:
    """C-10: an English candidate whose wording alone stays under the least of a partial match rests on meaning."""
    return (F.col("stage") != "exact") & (F.col("lexical") < 75)


def english_probes(inputs: DataFrame, quoted: Column) -> DataFrame:
    """C-10: (input_id, probe): the text's key and, if it has four words or more and differs, the key of what it quotes."""
    whole, part = X.latin_key(F.col("text")), X.latin_key(quoted)
    rows = inputs.select("input_id", whole.alias("a"), part.alias("b"))
    second = F.when((F.size(X.words(F.col("b"))) >= 4) & (F.col("a") != F.col("b")), F.array("a", "b")).otherwise(F.array("a"))
    return rows.where("a <> ''").select("input_id", F.explode(second).alias("probe"))


def needs_extraction(text: Column, via: Column, spans: Column) -> Column:
    """P-23: links, pictures, texts over 220 characters, and those that hold a span shorter than nine tenths of them."""
    inner = F.exists(spans, lambda s: F.length(s) < 0.9 * F.length(text))
    return (F.length(text) > SHORT_TEXT) | (via != "text") | F.coalesce(inner, F.lit(False))


def same_span_col(a: Column, b: Column) -> Column:
    """C-17 over keys: a ratio of 85 or more, or one within the other if both have 15 characters or more; empty keys are never the same."""

    @F.pandas_udf("boolean")
    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        def same(x, y):
            return bool(x and y) and (S.ratio(x, y) >= 85 or (min(len(x), len(y)) >= 15 and (x in y or y in x)))

        return pd.Series([same(x, y) for x, y in zip(xs, ys)])

    return run(a, b)


def merge_spans(spans: DataFrame) -> DataFrame:
    """D-6 over (input_id, span_id, origin, position, key): the model's spans first, but the words behind a chain of narrators before
    them, then those of the rules; a span that is the same as one before it goes. Where the model gave any, eight stay.

    An input has a bounded number of spans (what X-1 and the model give), so they meet each other within it.
    """
    place = F.when(F.col("origin") == "chain", 0).when(F.col("origin") == "model", 1).otherwise(2)
    rows = spans.withColumn("_p", F.struct(place.alias("p"), "position", "span_id"))
    one, two = (rows.select("input_id", *(F.col(c).alias(f"{c}{i}") for c in ("span_id", "key", "_p", "origin"))) for i in (1, 2))
    again = one.join(two, "input_id").where("_p2 < _p1 and origin1 <> 'model'").where(same_span_col(F.col("key1"), F.col("key2")))
    # a chain's words go if the model has them too
    chain = one.join(two, "input_id").where("origin1 = 'chain' and origin2 = 'model'").where(same_span_col(F.col("key1"), F.col("key2")))
    gone = again.unionByName(chain).select("input_id", F.col("span_id1").alias("span_id")).distinct()
    order = Window.partitionBy("input_id").orderBy("_p")
    any_model = F.max((F.col("origin") == "model").cast("int")).over(Window.partitionBy("input_id"))
    left = rows.withColumn("_m", any_model).join(gone, ["input_id", "span_id"], "left_anti").withColumn("rank", F.row_number().over(order))
    return left.where((F.col("_m") == 0) | (F.col("rank") <= MOST_SPANS)).select("input_id", "span_id", "origin", "rank")


def best_quote(spans: DataFrame, wholes: DataFrame) -> DataFrame:
    """D-4: (input_id, span_id, confidence): the span that stands for an input; spans(input_id, span_id, position, confidence, is_marked),
    wholes(input_id, confidence) of short typed texts. A marked span must match as well as the whole text, another one better by ten;
    else the whole text stays (span_id null). Inputs without a whole text take their best span."""
    best = spans.groupBy("input_id").agg(F.min_by(F.struct("span_id", "confidence", "is_marked"), F.struct(-F.col("confidence"), "position")).alias("b"))
    rows = best.join(wholes.select("input_id", F.col("confidence").alias("whole")), "input_id", "full")
    wins = F.col("whole").isNull() | (F.col("b.is_marked") & (F.col("b.confidence") >= F.col("whole"))) | (F.col("b.confidence") >= F.col("whole") + SPAN_MARGIN)
    wins = F.coalesce(wins, F.lit(False)) & F.col("b").isNotNull()
    return rows.select("input_id", F.when(wins, F.col("b.span_id")).alias("span_id"), F.when(wins, F.col("b.confidence")).otherwise(F.col("whole")).alias("confidence"))


def one_span_per_record(matches: DataFrame) -> DataFrame:
    """D-5 over (input_id, span_id, record_id, confidence, position): of the spans that matched a record (50 or more) the best; all others stay."""
    matched = F.col("record_id").isNotNull() & (F.col("confidence") >= MATCHED)
    key = F.when(matched, F.struct(F.lit(1).alias("m"), F.col("record_id").cast("string").alias("id"))).otherwise(F.struct(F.lit(0).alias("m"), F.col("span_id").cast("string").alias("id")))
    first = Window.partitionBy("input_id", key).orderBy(F.desc("confidence"), "position")
    return matches.withColumn("_i", F.row_number().over(first)).where("_i = 1").drop("_i")


def grounded(segments: DataFrame, inputs: DataFrame, least: float = 80) -> DataFrame:
    """J-16: proposed segments(input_id, segment) whose words stand in their own input's text, by the best window's ratio."""
    rows = segments.join(inputs.select("input_id", "text"), "input_id")
    return rows.where(S.partial_ratio_col(F.col("segment"), F.col("text")) >= least).drop("text")


def guarded_route(route: Column, text: Column, message: Column, has_report: Column, allowed: list[str]) -> Column:
    """P-24: a model's route counts only if it is one of `allowed` and its text stands in the message; a report without a report is "tool"."""
    taken = route.isin(allowed) & ((F.coalesce(text, F.lit("")) == "") | F.contains(message, text))
    return F.when(taken & (route == "report") & ~has_report, "tool").when(taken, route)


def payload_ok(payload: Column, lang: Column) -> Column:
    """P-25: two words or more in the script of the interface's language."""
    return (F.size(F.filter(F.split(F.coalesce(payload, F.lit("")), r"\s+"), lambda w: w != "")) >= 2) & (X.script(payload) == lang)


def chapter_label(kind: Column, chapter: Column, section: Column) -> Column:
    """N-21: an Arabic chapter title, else the number of the section as a book; rulings gathered by hand have none."""
    numbered = F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit("الكتاب رقم "), X.arabic_digits(section))).otherwise("")
    return F.when(kind == "seed", "").when(chapter.rlike("[؀-ۿ]"), chapter).otherwise(numbered)


def shortened(c: Column, most: int) -> Column:
    """N-27: the first `most` characters."""
    return F.substring(c, 1, most)


def json_lines(rows: DataFrame, path: str) -> None:
    """K-9: one JSON object a line, nulls left out."""
    rows.write.mode("overwrite").json(path)


#: fixed values: points for a word, for the first variant, and by how much a reading in a single script has to win
WORD_POINTS, FIRST_POINTS, SINGLE_MARGIN = 10, 1, 1.3


def best_reading(readings: DataFrame) -> DataFrame:
    """D-14: of the readings of an image (image_id, variant, reading: 'mixed' or 'single', text) the best: ten points a word, one more for the
    first variant; a reading in a single script turns other words into junk and must win clearly. Ties by variant, mixed before single."""
    words = F.coalesce(word_score(F.col("text")), F.lit(0)) * WORD_POINTS
    single = F.floor(words / F.lit(SINGLE_MARGIN))
    points = F.when(F.col("reading") == "single", single).otherwise(words + F.when(F.col("variant") == 0, FIRST_POINTS).otherwise(0))
    best = Window.partitionBy("image_id").orderBy(F.desc("points"), "variant", "reading")
    rows = readings.withColumn("points", points.cast("long"))
    return rows.withColumn("_i", F.row_number().over(best)).where("_i = 1").drop("_i")
