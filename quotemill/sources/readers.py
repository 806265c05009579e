"""Source readers with declared schemas: nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import display_number

GRADE = "struct<grader_ar:string,grader_en:string,grade_ar:string,grade_en:string,source_ar:string,source_en:string,number:string,url:string>"
RECORD = f"kind string, collection string, number string, book_ar string, book_en string, chapter_ar string, chapter_en string, text_ar string, text_en string, grades array<{GRADE}>, source_url string, meta map<string,string>"
EDITION = "metadata struct<sections:map<string,string>>, hadiths array<struct<hadithnumber:double,arabicnumber:double,text:string,grades:array<struct<name:string,grade:string>>,reference:struct<book:long,hadith:long>>>"
SEED = "items array<struct<text_ar:string,text_en:string,type_ar:string,type_en:string,grades:array<struct<grader_ar:string,grader_en:string,grade_ar:string,grade_en:string,source_ar:string,source_en:string,number:string,url:string>>>>"
GLOSSARY = "term_ar string, term_en string, meaning_en string, meaning_ar string, avoid string, note_ar string, note_en string, source_url string"
LABELLED = "group string, text string, expect_state array<string>, expect_record array<array<string>>, expect_grade string"


def whole(number) -> F.Column:
    return F.regexp_replace(number.cast("string"), r"\.0$", "")


def read_editions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """S-1, S-2, N-17, N-18: one row per text of each edition file, blank texts left out; a number that a file repeats gets its
    running number as suffix."""
    files = spark.read.schema(EDITION).json(paths, multiLine=True).withColumn("file", F.input_file_name())
    rows = files.select("file", F.col("metadata.sections").alias("sections"), F.posexplode("hadiths").alias("position", "h")).where(F.trim(F.coalesce("h.text", F.lit(""))) != "")
    section = F.coalesce(F.try_element_at("sections", F.col("h.reference.book").cast("string")), F.lit(""))
    rows = rows.select("file", "position", display_number(F.coalesce("h.arabicnumber", "h.hadithnumber")).alias("shown"), whole(F.col("h.hadithnumber")).alias("running"), "h.text", section.alias("chapter"), "h.grades")
    again = F.row_number().over(Window.partitionBy("file", "shown").orderBy("position")) > 1
    return rows.select("file", "position", F.when(again, F.concat_ws("-", "shown", "running")).otherwise(F.col("shown")).alias("number"), "text", "chapter", "grades")


def read_verses(spark: SparkSession, verses: str, chapters: str, translation: str) -> DataFrame:
    """S-3: verses with their chapter's name and a translation, by id and else by verse key, '' where there's none."""
    v = spark.read.schema("id long, verse_key string, text string").json(verses)
    c = spark.read.schema("id long, name_ar string, name_en string").json(chapters)
    t = spark.read.schema("id long, verse_key string, text string").json(translation)
    v = v.withColumn("chapter_id", F.split_part("verse_key", F.lit(":"), F.lit(1)).cast("long"))
    by_id = t.where("id is not null").groupBy("id").agg(F.max("text").alias("by_id"))
    by_key = t.where("verse_key is not null").groupBy("verse_key").agg(F.max("text").alias("by_key"))
    out = v.join(c.withColumnRenamed("id", "chapter_id"), "chapter_id", "left").join(by_id, "id", "left").join(by_key, "verse_key", "left")
    return out.select("id", "verse_key", "text", "name_ar", "name_en", F.coalesce("by_id", "by_key", F.lit("")).alias("text_en"))


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    """S-4: curated sayings numbered from 1, the book of the first ruling for theirs."""
    rows = spark.read.schema(SEED).json(path, multiLine=True).select(F.posexplode("items").alias("position", "x"))
    return rows.select((F.col("position") + 1).cast("string").alias("number"), "x.*").withColumn("book_ar", F.get("grades", F.lit(0))["source_ar"])


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """S-5: phrases to avoid split at semicolons, empties dropped."""
    rows = spark.read.schema(GLOSSARY).csv(path, header=True, multiLine=True, escape='"')
    return rows.withColumn("avoid", F.filter(F.transform(F.split(F.coalesce("avoid", F.lit("")), ";"), lambda w: F.trim(w)), lambda x: x != ""))


def read_candidate_lines(spark: SparkSession, path: str) -> DataFrame:
    """S-6: lines with text that don't begin with #."""
    return spark.read.text(path).select(F.trim("value").alias("saying")).where("saying <> '' and not startswith(saying, '#')")


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """S-7."""
    return spark.read.schema(LABELLED).json(path)


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """S-8: sections of Markdown files that begin with `# `: title, keywords of a `keywords:` line, paragraphs."""
    files = spark.read.text(path, wholetext=True)
    rows = files.select(F.explode(F.split("value", r"(?m)^# ")).alias("s")).where(F.trim("s") != "")
    words = F.filter(F.transform(F.split(F.regexp_extract("s", r"(?mi)^keywords:(.*)$", 1), ","), lambda w: F.lower(F.trim(w))), lambda w: w != "")
    body = F.regexp_replace(F.regexp_replace("s", r"(?mi)^keywords:.*$", ""), r"^[^\n]*\n?", "")
    return rows.select(F.trim(F.regexp_extract("s", r"^([^\n]*)", 1)).alias("title"), words.alias("keywords"), F.filter(F.transform(F.split(body, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "").alias("paragraphs"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """S-10: paginated files of (page, key, text); of a key the last page wins."""
    rows = spark.read.schema("page long, key string, text string").json(path)
    return rows.where("key is not null").groupBy("key").agg(F.max_by("text", "page").alias("text"))


def not_landed(wanted: DataFrame, landed: DataFrame, key: str) -> DataFrame:
    """S-12: what a landing folder doesn't hold yet."""
    return wanted.join(landed.select(key).distinct(), key, "left_anti")


def records(corpus: DataFrame, keys: DataFrame) -> DataFrame:
    """S-11: the records of a table of (collection, number)."""
    return keys.select("collection", "number").distinct().join(corpus, ["collection", "number"])
