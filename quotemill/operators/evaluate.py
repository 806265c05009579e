"""Labelled evaluation, curation from conflicting rulings, and labelled-set builders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Ranks of the sketch that brackets a median: about n * 4 / MEDIAN_RANKS rows are looked at one by one.
MEDIAN_RANKS = 10_000


def group_metrics(outcomes: DataFrame, ranks: int = MEDIAN_RANKS) -> DataFrame:
    """A-5, A-6: per group and in total (group null): n, strict accuracy, wrong attributions, median latency.

    The median is exact, of two middle values their mean; null latencies don't count. A sketch (off by n / ranks places at most) tells
    between which values it lies; those under them are counted, and only the different values between them are put in order.
    """
    span = 2.0 / ranks
    bounds = F.percentile_approx("ms", F.array(F.lit(max(0.5 - span, 0.0)), F.lit(min(0.5 + span, 1.0))), ranks)
    rows = outcomes.rollup("group").agg(
        F.grouping_id().alias("_of"), F.count(F.lit(1)).alias("n"), F.avg(F.col("ok").cast("int")).alias("accuracy"), F.count_if("wrong").alias("wrong"), F.count("ms").alias("_n"), bounds.alias("_b")
    )
    counts = outcomes.where("ms is not null").groupBy("group", "ms").agg(F.count(F.lit(1)).alias("_c"))
    every = counts.withColumn("_of", F.lit(0)).unionByName(counts.withColumn("group", F.lit(None).cast(outcomes.schema["group"].dataType)).withColumn("_of", F.lit(1)))
    every = every.groupBy("_of", "group", "ms").agg(F.sum("_c").alias("_c"))
    mine = rows.select(F.col("_of").cast("int").alias("_g"), F.col("group").alias("_group"), "_n", "_b").where("_n > 0")
    held = every.join(mine, (F.col("_of") == F.col("_g")) & F.col("group").eqNullSafe(F.col("_group")))
    # equal values under the bracket become one row
    value = F.when(F.col("ms") >= F.get("_b", F.lit(0)), F.col("ms"))
    held = held.where(F.col("ms") <= F.get("_b", F.lit(1))).groupBy("_g", "_group", "_n", value.alias("ms")).agg(F.sum("_c").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy("_g", "_group").orderBy(F.asc_nulls_first("ms")))
    held = held.withColumn("_upto", upto)
    at = lambda place: F.min(F.when(F.col("_upto") > place, F.col("ms")))
    medians = held.groupBy("_g", "_group").agg(((at(F.floor((F.col("_n") - 1) / 2)) + at(F.floor(F.col("_n") / 2))) / 2).alias("median_ms"))
    out = rows.join(medians, (F.col("_of") == F.col("_g")) & F.col("group").eqNullSafe(F.col("_group")), "left")
    return out.select("group", "n", "accuracy", "wrong", "median_ms")


def outcome_matrix(rows: DataFrame, outcomes: list[str]) -> DataFrame:
    """A-7: labels by outcomes."""
    return rows.groupBy("label").pivot("outcome", outcomes).count().na.fill(0)


def top_grades(cards: DataFrame, key: str, k: int = 3) -> DataFrame:
    """A-12, A-13: the first k rulings of a saying, one for each (scholar, book), preferred scholars first; the first is the headline."""
    once = Window.partitionBy(key, "scholar", "book").orderBy("rank", "position")
    best = Window.partitionBy(key).orderBy("rank", "position")
    rows = cards.withColumn("_i", F.row_number().over(once)).where("_i = 1").withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= k)
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_k", "scholar", "book", "grade"))).alias("g")).select(key, F.transform("g", lambda x: F.struct(x["scholar"].alias("scholar"), x["book"].alias("book"), x["grade"].alias("grade"))).alias("grades"))


def hash_sample(df: DataFrame, columns: list[str], n: int, skip: int = 0) -> DataFrame:
    """D-13: rows skip..skip+n by the MD5 of the columns joined."""
    digest = F.md5(F.concat(*(F.col(c).cast("string") for c in columns)))
    return df.withColumn("digest", digest).orderBy("digest", *columns).limit(skip + n).offset(skip)


def pick(key: Column, salt: str, n: Column) -> Column:
    """A number below n from a key, the same in every run."""
    return (F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(salt))), 1, 8), 16, 10).cast("long") % n).cast("int")


def typo(key: Column, word: Column, salt: str = "") -> Column:
    """G-1: drops or swaps a letter inside a word of four letters or more, or writes it in another form: ta marbuta as ha, alef maqsura as
    ya, else without its last letter."""
    at = pick(key, f"at{salt}", F.length(word) - 2) + 2
    head, a, b = F.substring(word, F.lit(1), at - 1), F.substring(word, at, F.lit(1)), F.substring(word, at + 1, F.lit(1))
    dropped = F.concat(head, F.substring(word, at + 1, F.length(word)))
    swapped = F.concat(head, b, a, F.substring(word, at + 2, F.length(word)))
    form = F.when(F.contains(word, F.lit("ة")), F.replace(word, F.lit("ة"), F.lit("ه"))).when(F.contains(word, F.lit("ى")), F.replace(word, F.lit("ى"), F.lit("ي"))).otherwise(F.substring(word, F.lit(1), F.length(word) - 1))
    how = pick(key, f"how{salt}", F.lit(3))
    return F.when(F.length(word) < 4, word).when(how == 0, dropped).when(how == 1, swapped).otherwise(form)


def _once(c: Column, f) -> Column:
    """f of a column that f looks at several times but that is worked out once."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _in_one_word(key: Column, text: Column, salt: str, change) -> Column:
    # a lambda evaluates what it refers to beside its element anew: the words, their place and the word stand in lambdas of one element each
    def changed(p: Column) -> Column:
        w, at = p["w"], p["at"]
        word = F.transform(F.slice(w, at + 1, F.lit(1)), change)
        return F.array_join(F.concat(F.slice(w, F.lit(1), at), word, F.slice(w, at + 2, F.size(w))), " ")

    return _once(F.split(text, " "), lambda w: _once(F.struct(w.alias("w"), pick(key, f"word{salt}", F.size(w)).alias("at")), changed))


# fixed values: what is written around a quotation
WRAPPERS = (("قال رسول الله ﷺ: «", "»"), ("قال النبي صلى الله عليه وسلم: ", ""), ("«", "» رواه البخاري"), ("", ""))


def variant(key: Column, text: Column) -> Column:
    """G-2: typos in one word or two, in one of the `WRAPPERS`."""
    once = _in_one_word(key, text, "1", lambda w: typo(key, w, "1"))
    twice = _in_one_word(key, once, "2", lambda w: typo(key, w, "2"))
    typed = F.when(pick(key, "typos", F.lit(2)) == 0, once).otherwise(twice)
    wrapper = pick(key, "wrapper", F.lit(len(WRAPPERS)))
    out = typed
    for i, (before, behind) in enumerate(WRAPPERS):
        out = F.when(wrapper == i, F.concat(F.lit(before), typed, F.lit(behind))).otherwise(out)
    return out


def misquote(key: Column, text: Column) -> Column:
    """G-3: a typo in one word; a short word gets a letter more."""
    return _in_one_word(key, text, "", lambda w: F.when(F.length(w) >= 4, typo(key, w)).otherwise(F.concat(w, F.lit("ا"))))


FORMS = {"exact": lambda key, text: text, "variant": variant, "misquote": misquote}


def labelled(corpus: DataFrame) -> DataFrame:
    """Every record of corpus(record_id, key) in the three forms: (record_id, group, text, expect)."""
    key = F.col("record_id")
    forms = [("exact", "verified"), ("variant", "partial"), ("misquote", "partial")]
    rows = F.array(*(F.struct(F.lit(g).alias("group"), FORMS[g](key, F.col("key")).alias("text"), F.lit(e).alias("expect")) for g, e in forms))
    return corpus.where("key <> ''").select("record_id", F.explode(rows).alias("f")).select("record_id", "f.*")


#: The groups of the labelled set: form, states that are right, whether a record is expected.
GROUPS = {
    "sahih_exact": ("exact", ["verified"], True), "sahih_variant": ("variant", ["verified", "partial"], True), "fabricated_or_weak": ("exact", ["unreliable"], True),
    "ayah_exact": ("exact", ["verified"], True), "ayah_misquoted": ("misquote", ["verified", "partial"], True), "invented": ("exact", ["abstain"], False), "fatwa": ("exact", ["referral"], False),
}


def build_labelled(sources: dict[str, DataFrame]) -> DataFrame:
    """G-4: (group, record_id, text, expect_state, expect_record) of the rows of sources(record_id, key) by group. Any record of the same
    source with an equal key is right; rows without key are left out. Samples of sources are the caller's (`hash_sample`)."""
    out = None
    for group, source in sources.items():
        form, states, named = GROUPS[group]
        rows = source.where("key <> ''")
        same = rows.groupBy("key").agg(F.array_sort(F.collect_set("record_id")).alias("expect_record"))
        rows = rows.join(same, "key") if named else rows.withColumn("expect_record", F.lit(None).cast("array<long>"))
        part = rows.select(F.lit(group).alias("group"), F.col("record_id").cast("long").alias("record_id"), FORMS[form](F.col("record_id"), F.col("key")).alias("text"), F.array(*map(F.lit, states)).alias("expect_state"), F.col("expect_record").cast("array<long>").alias("expect_record"))
        out = part if out is None else out.unionByName(part)
    return out


# fixed values: codes that a spoken text without words in a known language is refused with
REFUSED = (("french", "stt_language"), ("silence", "stt_no_speech"), ("noise", "stt_no_speech|stt_unclear|stt_language"))
SPOKEN_EXACT, SPOKEN_EN, LEAST_SPOKEN, MOST_SPOKEN = 20, 10, 60, 260


def voice_labels(labelled_: DataFrame, corpus: DataFrame) -> DataFrame:
    """G-5: what a voice set expects: (item, lang, text, expect_record, expect_error). The first 20 exact texts of a labelled set, ten English texts
    of corpus(record_id, text_en) of 60 to 260 characters by a hash, without who narrated them, and the recordings that are to be
    refused. The numbers are the set's size, as it is read out by voices."""
    exact = labelled_.where("group = 'sahih_exact'").orderBy("record_id").limit(SPOKEN_EXACT)
    en = corpus.where(F.length("text_en").between(LEAST_SPOKEN, MOST_SPOKEN)).withColumn("_d", F.md5(F.concat(F.lit("voice"), F.col("record_id").cast("string")))).orderBy("_d", "record_id").limit(SPOKEN_EN)
    told = F.when(F.lower("text_en").startswith("narrated") & F.contains("text_en", F.lit(":")), F.trim(F.regexp_replace("text_en", r"^[^:]*:", ""))).otherwise(F.col("text_en"))
    none = F.lit(None).cast("array<long>")
    rows = exact.select(F.concat(F.lit("ar"), F.col("record_id")).alias("item"), F.lit("ar").alias("lang"), "text", "expect_record", F.lit(None).cast("string").alias("expect_error"))
    rows = rows.unionByName(en.select(F.concat(F.lit("en"), F.col("record_id")).alias("item"), F.lit("en").alias("lang"), told.alias("text"), F.array(F.col("record_id").cast("long")).alias("expect_record"), F.lit(None).cast("string").alias("expect_error")))
    refused = labelled_.sparkSession.createDataFrame([(f"neg_{name}", code) for name, code in REFUSED], "item string, expect_error string")
    return rows.unionByName(refused.select("item", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("text"), none.alias("expect_record"), "expect_error"))
