"""From ranked candidates to verdicts: rulings, model answers as an input table, reasons, and what a report shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import ratio_col, state
from ..functions.text import unreliable
from .rulings import apply_answers

VERDICTS = "struct<candidates:array<struct<n:int,same:boolean>>>"


def parse_verdicts(answer: Column) -> Column:
    """X-12: {candidate number: same} of a model's JSON; null if it is malformed or says nothing, of several answers for a number the last holds."""
    found = F.from_json(answer, VERDICTS)["candidates"]
    said = F.filter(found, lambda x: x["n"].isNotNull() & x["same"].isNotNull())
    numbers = F.array_distinct(F.transform(said, lambda x: x["n"]))
    last = F.transform(numbers, lambda n: F.element_at(F.filter(said, lambda x: x["n"] == n), -1)["same"])
    return F.when(F.size(said) > 0, F.map_from_arrays(numbers, last))


#: fixed value: a proposed span has so many characters at least
LEAST_SEGMENT = 8


def parse_segments(answer: Column, most: int = 8) -> Column:
    """X-13: proposed spans of eight characters or more out of the outermost braces; unknown types are 'other'."""
    kind = "struct<segments:array<struct<text:string,type:string>>>"
    found = F.from_json(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), kind)["segments"]
    trimmed = F.transform(found, lambda x: F.struct(F.trim(F.coalesce(x["text"], F.lit(""))).alias("text"), F.lower(x["type"]).alias("type")))
    long_enough = F.filter(trimmed, lambda x: F.length(x["text"]) >= LEAST_SEGMENT)
    known = F.transform(long_enough, lambda x: x.withField("type", F.when(x["type"].isin("hadith", "quran", "saying"), x["type"]).otherwise("other")))
    return F.slice(known, 1, most)


#: fixed value: a cleaned text is at so large a ratio to the text itself
LEAST_CLEANED = 85


def cleaned_or_empty(cleaned: Column, key_of_cleaned: Column, key: Column, least: float = LEAST_CLEANED) -> Column:
    """R-10: a cleaned text whose key is at an Indel ratio of `least` or more to the text's key; one that drifted from it is empty, and so is null."""
    same = F.coalesce(key_of_cleaned == key, F.lit(False))
    near = F.coalesce(ratio_col(F.when(~same, key_of_cleaned), key) >= least, F.lit(False))
    return F.when(same | near, F.trim(cleaned)).otherwise("")


def apply_model_verdicts(cands: DataFrame, answers: DataFrame) -> DataFrame:
    """C-13, C-14 (`rulings.apply_answers`) with answers(input_id, n, same, strong): the candidates with their new ranks,
    confidences and states; n counts the candidates that were asked about."""
    named = answers.select("input_id", "n", "same", F.when(F.col("strong"), "strong/").otherwise("light/").alias("model"))
    new = apply_answers(cands, named, strong="^strong/").select("input_id", "record_id", "rank", "confidence")
    return cands.drop("rank", "confidence").join(new, ["input_id", "record_id"]).withColumn("state", state(F.col("confidence")))


def with_rulings(top: DataFrame, corpus: DataFrame) -> DataFrame:
    """P-14, P-15: the matched record's rulings, first one the headline. A hadith without a ruling is uncertain at most; a weak
    or invented one is unreliable, whatever the match; `match_level` keeps the match's own state."""
    rows = top.join(corpus.select("record_id", "kind", "grades"), "record_id", "left")
    n = F.coalesce(F.size("grades"), F.lit(0))
    matched = F.col("state").isin("verified", "partial")
    new = (
        F.when(matched & (F.col("kind") == "hadith") & (n <= 0), "uncertain")
        .when(matched & unreliable(F.get("grades", F.lit(0))["grade_ar"]), "unreliable")
        .otherwise(F.col("state"))
    )
    return rows.withColumn("match_level", F.col("state")).withColumn("state", new)


#: Our own wordings of why a state is given: {conf} is the confidence, {where} the record.
REASONS = {
    "en": {
        "verified": "The wording agrees with {where} ({conf}).", "partial": "The wording agrees in part with {where} ({conf}).", "uncertain": "Only the closest text is shown, {where} ({conf}).",
        "unreliable": "The ruling recorded for {where} doesn't let it be attributed.", "referral": "A personal question belongs to a qualified person.", "": "No source was found.", "source": "the source",
    },
    "ar": {
        "verified": "اللفظ موافق لما في {where} ({conf}).", "partial": "اللفظ موافق في بعضه لما في {where} ({conf}).", "uncertain": "المعروض أقرب نص فحسب، من {where} ({conf}).",
        "unreliable": "الحكم المنقول في {where} لا يسمح بنسبته.", "referral": "السؤال الشخصي يُسأل عنه أهل العلم.", "": "لم يوجد مصدر.", "source": "المصدر",
    },
}


def reason(state_: Column, conf: Column, record: Column | None = None, lang: str = "en") -> Column:
    """R-1: why a state is given, in English or Arabic, with the record's name where there is one."""
    texts = REASONS[lang]
    named = F.lit(texts["source"]) if record is None else F.coalesce(F.nullif(record, F.lit("")), F.lit(texts["source"]))
    template = F.lit(texts[""])
    for name in ("verified", "partial", "uncertain", "unreliable", "referral"):
        template = F.when(state_ == name, texts[name]).otherwise(template)
    return F.replace(F.replace(template, F.lit("{where}"), named), F.lit("{conf}"), F.coalesce(conf.cast("string"), F.lit("")))


def shown(report: DataFrame) -> DataFrame:
    """R-2, R-5: rulings with their record's link where they have none; nothing attributed when abstaining."""
    hidden = F.col("state").isin("abstain", "referral")
    links = F.transform("grades", lambda g: g.withField("url", F.coalesce(F.nullif(g["url"], F.lit("")), F.col("source_url"))))
    return report.withColumn("grades", F.when(~hidden, links)).withColumn("closest_only", F.col("state") == "uncertain").withColumn("reason", reason(F.col("state"), F.col("confidence")))


def early_exit(language: Column, asks_ruling: Column, asks_text: Column) -> Column:
    """P-12: the state of inputs that end before any search, else null."""
    return F.when(language == "other", "abstain").when(asks_ruling, "referral").when(asks_text, "abstain")


# fixed values: words of sound and of weak rulings, and titles of books that hold such words
SOUND_WORDS = ("صحيح", "حسن", "sahih", "authentic", "hasan")
WEAK_WORDS = ("ضعيف", "موضوع", "منكر", "مكذوب", "باطل", "weak", "daif", "da'if", "fabricated", "mawdu", "forged", "baseless")
BOOK_TITLES = (
    "صحيح البخاري", "صحيح مسلم", "صحيح الجامع", "صحيح ابن حبان", "صحيح ابن خزيمة", "صحيح الترغيب", "صحيح أبي داود", "صحيح الترمذي", "صحيح النسائي", "صحيح ابن ماجه",
    "ضعيف الجامع", "ضعيف أبي داود", "ضعيف الترمذي", "ضعيف النسائي", "ضعيف ابن ماجه", "sahih al-bukhari", "sahih muslim", "sahih bukhari",
)
WORD, ARTICLE = r"[\p{L}\p{M}\p{N}_'’]+", "ال"


def ruling_words(text: Column, titles: tuple[str, ...] = BOOK_TITLES) -> Column:
    """The different words of a text without titles of books; words with an article also without it."""
    low = F.lower(F.coalesce(text, F.lit("")))
    for title in titles:
        low = F.replace(low, F.lit(title), F.lit(" "))
    words = F.transform(F.regexp_extract_all(low, F.lit(WORD), 0), lambda w: F.regexp_replace(w, "^['’]+|['’]+$", ""))
    return F.array_distinct(F.concat(words, F.transform(F.filter(words, lambda w: w.startswith(ARTICLE)), lambda w: F.substr(w, F.lit(len(ARTICLE) + 1)))))


def plain_numbers(text: Column) -> Column:
    """Numbers in a text, Arabic and Persian digits as plain ones."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"), F.lit("[0-9]+"), 0)


def brief_problems(text: Column, ruling: Column, state_: Column, facts: Column, sound=SOUND_WORDS, weak=WEAK_WORDS, titles=BOOK_TITLES) -> Column:
    """P-19, P-20, U-3, U-4: why a generated explanation is turned away: it contradicts the recorded ruling, it grades although no
    verdict is given, it has numbers that the facts (a text or JSON) don't have. None for a text without a fault."""
    said, recorded = ruling_words(text, titles), ruling_words(ruling, titles)
    has = lambda words, many: F.arrays_overlap(words, F.array(*map(F.lit, many)))
    is_weak = has(recorded, weak)
    is_sound = ~is_weak & has(recorded, sound)
    found = F.array(
        F.when(is_sound & has(said, weak), "contradicts a sound ruling"),
        F.when(is_weak & has(said, sound), "contradicts a weak ruling"),
        F.when(state_.isin("abstain", "referral") & (has(said, sound) | has(said, weak)), "grades without a verdict"),
        F.when(F.size(F.array_except(plain_numbers(text), plain_numbers(facts))) > 0, "numbers without a source"),
    )
    return F.filter(found, lambda x: x.isNotNull())


def facts_beside(questions: DataFrame, reports: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """J-21: each question with the facts of the report it is about, as one JSON object without nulls; questions without a report have none."""
    facts = reports.select(key, F.to_json(F.struct(*fields)).alias("facts")).dropDuplicates([key])
    return questions.join(facts, key, "left")
