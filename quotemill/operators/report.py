"""What a report says: lists of candidates, its texts by state and language, and what is sent on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.spans import quoted_part_col
from ..functions.text import latin_key, script_language, trimmed
from ..functions.wording import compared_col
from .matching import glossary_notes

#: Wordings by state and language; {where}, {grade} and {by} stand for what is recorded.
BRIEFS = {
    "en": {
        "referral": "This is a personal question; a qualified scholar has to answer it.",
        "abstain": "None of the approved sources has this text, so no verdict is given.",
        "uncertain": "Only the closest text is shown; its ruling isn't one on your text.",
        "": "An approved source has this text; the details are quoted as recorded.",
        "unreliable": "Recorded in {where} with the ruling {grade}{by}; it isn't to be published as established.",
        "partial": "Found in {where} in slightly other words, with the ruling {grade}{by}; publish the source's wording.",
        "verified": "Found in {where} with the ruling {grade}{by}; name the source when publishing.",
    },
    "ar": {
        "referral": "هذا سؤال شخصي يجيب عنه عالم مؤهل.",
        "abstain": "ليس هذا النص في المصادر المعتمدة، فلا حكم عليه.",
        "uncertain": "المعروض أقرب نص فقط، وحكمه ليس حكما على نصك.",
        "": "هذا النص في مصدر معتمد، والتفاصيل منقولة كما هي.",
        "unreliable": "ورد في {where} وحكمه {grade}{by}، فلا ينشر على أنه ثابت.",
        "partial": "ورد في {where} بلفظ قريب وحكمه {grade}{by}، فانشر لفظ المصدر.",
        "verified": "ورد في {where} وحكمه {grade}{by}، فاذكر المصدر عند النشر.",
    },
}
NUMBERED = {"en": ", number ", "ar": " برقم "}


def append_other_matches(cands: DataFrame, others: DataFrame, cap: int = 8) -> DataFrame:
    """D-10: candidates (input_id, record_id, rank) followed by other segments' matches in their order, ids once, up to `cap`
    in all; candidates beyond the cap stay. A list of the report, so the cap is the feature."""
    new = others.join(cands.select("input_id", "record_id"), ["input_id", "record_id"], "left_anti")
    new = new.groupBy("input_id", "record_id").agg(F.min("rank").alias("rank"))
    had = cands.groupBy("input_id").agg(F.max("rank").alias("had"), F.count(F.lit(1)).alias("n"))
    order = F.row_number().over(Window.partitionBy("input_id").orderBy("rank", "record_id"))
    new = new.withColumn("i", order).join(had, "input_id", "left").where(F.col("i") + F.coalesce("n", F.lit(0)) <= cap)
    return cands.select("input_id", "record_id", "rank").unionByName(new.select("input_id", "record_id", (F.col("i") + F.coalesce("had", F.lit(0))).alias("rank")))


def display_rank(cands: DataFrame, threshold: int) -> DataFrame:
    """D-11: rank from 1 by (rank, record_id); only the first can be accepted, from the threshold on."""
    out = cands.withColumn("rank", F.row_number().over(Window.partitionBy("input_id").orderBy("rank", "record_id")))
    return out.withColumn("accepted", (F.col("rank") == 1) & (F.coalesce("confidence", F.lit(0)) >= threshold))


def paragraph_in(body: Column, lang: str | None) -> Column:
    """D-16: the first paragraph in the language ('ar' or not; None: in any), else the first; empty without one."""
    paras = F.filter(F.split(F.coalesce(body, F.lit("")), "\n"), lambda p: trimmed(p) != "")
    if lang is None:
        return F.coalesce(trimmed(F.get(paras, 0)), F.lit(""))
    fit = F.filter(paras, lambda p: (script_language(p) == "ar") == F.lit(lang == "ar"))
    return F.coalesce(trimmed(F.get(fit, 0)), trimmed(F.get(paras, 0)), F.lit(""))


def span_union(*parts: tuple[str, DataFrame]) -> DataFrame:
    """U-2: spans (input_id, position, span) of several origins in one table, in the order of the origins."""
    out = None
    for i, (origin, spans) in enumerate(parts):
        rows = spans.select("input_id", F.lit(i).alias("part"), "position", "span", F.lit(origin).alias("origin"))
        out = rows if out is None else out.unionByName(rows)
    return out


def corpus_union(**parts: DataFrame) -> DataFrame:
    """U-6: records of all kinds in one table; columns that a kind lacks are null."""
    out = None
    for kind, rows in parts.items():
        rows = rows.withColumn("kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def segments_out(matches: DataFrame, state: Column) -> DataFrame:
    """R-3: for each input its segments in order, with 300 characters shown, and the state of those that match a record."""
    row = F.struct("position", F.substring("text", 1, 300).alias("text"), "origin", F.when(F.col("record_id").isNotNull(), state).alias("state"), "record_id")
    return matches.groupBy("input_id").agg(F.sort_array(F.collect_list(row)).alias("segments"))


#: Our own wordings of the note on a verse and of a reply's parts, by language.
VERSE_NOTES = {"en": "A verse of the Qur'an (%s %s), not a saying.", "ar": "آية من القرآن (%s %s) وليست قولًا منقولًا."}
REPLIES = {
    "en": {"more": "The same text has %d other places.", "end": "The full report has the details.",
           "labels": {"verified": "Verified", "partial": "Partial", "uncertain": "Uncertain", "unreliable": "Unreliable", "abstain": "Abstain", "referral": "Referral"}},
    "ar": {"more": "وللنص نفسه %d مواضع أخرى.", "end": "والتفصيل في التقرير الكامل.",
           "labels": {"verified": "ثابت في مصدر", "partial": "ثابت بلفظ قريب", "uncertain": "لم يتأكد", "unreliable": "لا يصح", "abstain": "بلا حكم", "referral": "يُسأل عنه عالم"}},
}


def quran_note(kind: Column, is_attributed: Column, chapter: Column, number: Column, lang: str = "en") -> Column:
    """R-4: a note where a verse is quoted as somebody's saying; null elsewhere."""
    return F.when((kind == "quran") & is_attributed, F.format_string(VERSE_NOTES[lang], chapter, number))


def where(book: Column, number: Column, lang: str) -> Column:
    return F.when(F.coalesce(number, F.lit("")) != "", F.concat(book, F.lit(NUMBERED[lang]), number)).otherwise(book)


def template_brief(state: Column, grade: Column, grader: Column, book: Column, number: Column, lang: str) -> Column:
    """R-7: the fixed explanation of a state, filled with what is recorded; without a ruling or a book a plain one."""
    texts = BRIEFS[lang]
    filled = F.create_map(*[F.lit(x) for k in ("unreliable", "partial", "verified") for x in (k, texts[k])])[state]
    filled = F.coalesce(filled, F.lit(texts["verified"]))
    by = F.when(F.coalesce(grader, F.lit("")) != "", F.concat(F.lit(" ("), grader, F.lit(")"))).otherwise("")
    for name, value in (("{where}", where(book, number, lang)), ("{grade}", grade), ("{by}", by)):
        filled = F.replace(filled, F.lit(name), value)
    out = F.when(state == "referral", texts["referral"]).when(state == "abstain", texts["abstain"]).when(state == "uncertain", texts["uncertain"])
    return out.when((F.coalesce(grade, F.lit("")) == "") | (F.coalesce(book, F.lit("")) == ""), texts[""]).otherwise(filled)


def accept_or_template(text: Column, problems: Column, template: Column) -> Column:
    """R-9: a generated explanation without problems, else the fixed one."""
    return F.when((F.trim(F.coalesce(text, F.lit(""))) != "") & (F.size(problems) == 0), text).otherwise(template)


def compose_reply(state: Column, brief: Column, note: Column, narrations: Column, lang: str = "en") -> Column:
    """R-8: the assistant's reply: state, note of a verse or brief, and other places of a sound text."""
    words = REPLIES[lang]
    label = F.create_map(*[F.lit(x) for pair in words["labels"].items() for x in pair])[state]
    more = F.when(state.isin("verified", "partial", "unreliable") & note.isNull() & (narrations > 0), F.format_string(words["more"], narrations))
    said = F.when(state.isin("abstain", "referral"), brief).otherwise(F.coalesce(note, brief))
    return F.concat_ws(" ", F.concat(label, F.lit(".")), said, more, F.lit(words["end"]))


def focus_context(text: Column, focus: Column, via: Column, extracted: Column) -> Column:
    """R-11: struct (input_text, context): long, linked and pictured inputs are reported by their span, with the whole as context."""
    narrowed = (focus != text) & ((F.length(text) > 220) | (via != "text"))
    own = F.when(F.coalesce(extracted, F.lit("")) != "", extracted)
    return F.struct(F.when(narrowed, focus).otherwise(text).alias("input_text"), F.coalesce(own, F.when(narrowed, text), F.lit("")).alias("context"))


def facts(report: DataFrame) -> DataFrame:
    """R-12: input_id and the facts given to an explainer, as JSON; curated sayings use their ruling's number."""
    number = F.when((F.col("collection") == "seed") & (F.coalesce("ruling_number", F.lit("")) != ""), F.col("ruling_number")).otherwise(F.col("number"))
    return report.select("input_id", F.to_json(F.struct("state", "confidence", "matched_text", "grade", "book", number.alias("number"))).alias("facts"))


def match_requests(cands: DataFrame) -> DataFrame:
    """R-13: one request of an input to an external checker: 1500 characters of it, and of each candidate in rank order 700 of
    the English text, or 500 of the Arabic where there is no English. The lengths are the request's format."""
    english = F.when(F.coalesce("text_en", F.lit("")) != "", F.substring("text_en", 1, 700))
    item = F.struct("rank", F.coalesce(english, F.lit("")).alias("text_en"), F.when(english.isNull(), F.substring("text_ar", 1, 500)).alias("text_ar"))
    out = cands.groupBy("input_id").agg(F.first("text").alias("text"), F.sort_array(F.collect_list(item)).alias("candidates"))
    return out.select("input_id", F.to_json(F.struct(F.substring("text", 1, 1500).alias("user_text"), "candidates")).alias("request"))


def extended_allowed(state: Column, matched: Column) -> Column:
    """R-14: a longer explanation needs a matched text and a state that attributes it."""
    return ~state.isin("abstain", "referral", "uncertain") & (F.coalesce(matched, F.lit("")) != "")


def meaning_issues(text: Column, approved: Column, rules: list[tuple[str, str, str]]) -> Column:
    """J-9: names of the rules (name, pattern on the text, pattern on the approved one) that both texts match."""
    return F.filter(F.array(*[F.when(text.rlike(f"(?i){a}") & approved.rlike(f"(?i){b}"), name) for name, a, b in rules]), lambda x: x.isNotNull())


def translation_cards(pairs: DataFrame, rules: list[tuple[str, str, str]], glossary: list[tuple[str, list[str]]]) -> DataFrame:
    """R-6: pairs(user_text, text_en, ...) with what a card of the translation shows: approved_text (what text_en quotes), user_runs and
    approved_runs (C-18), issues (names of meaning rules, then terms whose phrases to avoid stand in the user's text and in no
    rule's name), needs_fix (an issue, or any word differs). Rows without an approved text or without a user text have no card and go.
    """
    rows = pairs.withColumn("approved_text", quoted_part_col(F.col("text_en"))).where("approved_text <> '' and user_text is not null")
    runs = compared_col(F.col("user_text"), F.col("approved_text"))
    rows = rows.withColumn("_runs", runs).withColumn("_named", meaning_issues(F.col("user_text"), F.col("approved_text"), rules))
    told = F.lower(F.array_join("_named", " "))
    high = F.filter(glossary_notes(latin_key(F.col("user_text")), glossary), lambda n: n["severity"] == "high")
    new = F.filter(high, lambda n: ~F.exists(n["literal"], lambda phrase: F.contains(told, phrase)))
    issues = F.concat("_named", F.transform(new, lambda n: n["term"]))
    differs = lambda side: F.exists(F.col(f"_runs.{side}"), lambda r: r["k"] != "eq")
    rows = rows.withColumn("user_runs", F.col("_runs.text_runs")).withColumn("approved_runs", F.col("_runs.source_runs")).withColumn("issues", issues)
    return rows.withColumn("needs_fix", (F.size("issues") > 0) | differs("text_runs") | differs("source_runs")).drop("_runs", "_named")
