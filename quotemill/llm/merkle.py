"""Merkle fingerprints of documents, in DataFrame and SQL functions only.

Sections are what stands between blank lines, paragraphs are lines. A paragraph's digest is the MD5 of its text, a
section's the MD5 of its paragraphs' digests, the root the SHA-256 of the sections' digests: roots are equal when texts
are, and where they differ, unequal sections and then unequal paragraphs lead to the edit. Below the paragraphs, clauses
of 32 characters at most carry short digests, from which the likeness of two fingerprints is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import columns

CLAUSE = r"[^.!?,;|\n]{1,32}[.!?,;|]*|[.!?,;|]+"
#: Documents for each slice of the order by doc_id, and the most slices.
SLICE, MOST_SLICES = 256, 65_536


def tree(text: Column) -> Column:
    """Sections as structs (digest, paragraphs: array of digests)."""

    def section(s):
        paragraphs = F.transform(F.split(s, "\n"), F.md5)
        return F.struct(F.md5(F.concat_ws("", paragraphs)).alias("digest"), paragraphs.alias("paragraphs"))

    return F.transform(F.split(text, "\n\n"), section)


def clauses(text: Column) -> Column:
    """Short digests of the clauses, in their order."""
    return F.transform(F.regexp_extract_all(text, F.lit(CLAUSE), 0), lambda x: F.substring(F.md5(x), 1, 6))


def fingerprint(text: Column) -> Column:
    """root:section(paragraph.paragraph...);section(...):clauses; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return written(tree(text), clauses(text))


def written(sections: Column, leaves: Column) -> Column:
    root = F.sha2(F.concat_ws("", F.transform(sections, lambda s: s["digest"])), 256)
    shown = F.transform(
        sections,
        lambda s: F.concat(F.substring(s["digest"], 1, 8), F.lit("("), F.concat_ws(".", F.transform(s["paragraphs"], lambda p: F.substring(p, 1, 8))), F.lit(")")),
    )
    return F.concat_ws(":", root, F.concat_ws(";", shown), F.concat_ws("", leaves))


def root(print_: Column) -> Column:
    return F.substring_index(print_, ":", 1)


def likeness(a: Column, b: Column) -> Column:
    """Of two arrays of clause digests: shared different ones, twice, by both numbers of different ones; 1 if both are empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def clauses_of(print_: Column) -> Column:
    """The clause digests in a written fingerprint."""
    return F.regexp_extract_all(F.substring_index(print_, ":", -1), F.lit("[0-9a-f]{6}"), 0)


def edits(a: Column, b: Column) -> Column:
    """Where fingerprint a differs from b: structs (section, paragraphs), counted from 0, of the paragraphs that b's section at
    the same place lacks; unlike roots only."""
    split = lambda x: F.split(F.element_at(F.split(x, ":"), 2), ";")
    other = split(b)

    def differing(s, i):
        inside = lambda x: F.split(F.regexp_extract(x, r"\((.*)\)", 1), r"\.")
        there = F.coalesce(F.get(other, i), F.lit("()"))
        kept = F.filter(F.transform(inside(s), lambda p, k: F.when(F.array_contains(inside(there), p), None).otherwise(k)), lambda k: k.isNotNull())
        return F.struct(i.alias("section"), kept.alias("paragraphs"))

    return F.when(root(a) == root(b), F.array().cast("array<struct<section:int,paragraphs:array<int>>>")).otherwise(
        F.filter(F.transform(split(a), differing), lambda e: F.size(e["paragraphs"]) > 0)
    )


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and next_text, the text of the next row by doc_id and text (after the last: the first).

    The order is cut into slices at quantiles of doc_id, at most 65,536 numbers; each slice also gets a copy of the row
    that begins the slice after it. So one shuffle by slice does it, and no task sees more than its slices.
    """
    n = docs.count()
    slices = min(MOST_SLICES, n // SLICE + 1)
    cuts = [] if slices < 2 else docs.agg(F.percentile_approx("doc_id", [i / slices for i in range(1, slices)], max(10_000, 4 * slices))).first()[0]
    cuts = sorted(set(cuts or []))
    step = max(1, int(len(cuts) ** 0.5))
    fine, coarse = F.array(*map(F.lit, cuts)).cast("array<long>"), F.array(*map(F.lit, cuts[::step])).cast("array<long>")
    upto = lambda a: F.size(F.filter(a, lambda c: c <= F.col("doc_id")))
    block = F.greatest(upto(coarse) - 1, F.lit(0)) * step
    sliced = docs.withColumn("slice", block + upto(F.slice(fine, block + 1, F.lit(step))))
    least = {r[0]: r[1] for r in sliced.groupBy("slice").agg(F.min("doc_id")).collect()}  # 65,536 rows at most
    used = sorted(least)
    before = {s: used[i - 1] for i, s in enumerate(used)}
    size = len(cuts) + 1
    firsts = F.array(*(F.lit(least.get(s)).cast("long") for s in range(size)))
    earlier = F.array(*(F.lit(before.get(s)).cast("int") for s in range(size)))
    here = F.struct(F.col("slice"), F.lit(0).alias("copy"))
    there = F.struct(F.get(earlier, F.col("slice")).alias("slice"), F.lit(1).alias("copy"))
    places = F.when(F.col("doc_id") == F.get(firsts, F.col("slice")), F.array(here, there)).otherwise(F.array(here))
    rows = sliced.select("doc_id", "text", F.explode(places).alias("at")).select("doc_id", "text", "at.slice", "at.copy")
    order = Window.partitionBy("slice").orderBy("copy", "doc_id", "text")
    return rows.withColumn("next_text", F.lead("text").over(order)).where("copy = 0").select("doc_id", "text", "next_text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of docs(doc_id, text) and of its edited text.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next document.
    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A null text is empty;
    rows that share a doc_id are ordered by text. Rows without doc_id have no next document: they keep their text and
    near_next is 0. An empty table gives an empty one, other columns play no part.
    """
    docs = columns(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    known, unknown = docs.where("doc_id is not null"), docs.where("doc_id is null")
    rows = with_next(known).unionByName(unknown.withColumn("next_text", F.lit(None).cast("string")))
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    kept = F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half)
    edited = F.when(F.col("next_text").isNull(), F.col("text")).otherwise(F.concat(kept, F.substring("next_text", F.lit(1), half)))
    rows = rows.withColumn("edited", edited)
    rows = rows.select("doc_id", "n_chars", "text", "edited", "next_text", clauses(F.col("text")).alias("c"), clauses(F.col("edited")).alias("c_edited"), clauses(F.col("next_text")).alias("c_next"))
    same = lambda other, near: F.when(F.col("text") == F.col(other), F.lit(1.0)).when(F.col(other).isNull(), F.lit(0.0)).otherwise(near)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        written(tree(F.col("text")), F.col("c")).alias("fingerprint"),
        written(tree(F.col("edited")), F.col("c_edited")).alias("edited_fingerprint"),
        same("edited", likeness(F.col("c"), F.col("c_edited"))).alias("near_edited"),
        same("next_text", likeness(F.col("c"), F.col("c_next"))).alias("near_next"),
    )


def _written_sql(text: str, leaves: str) -> str:
    section = "md5(array_to_string(list_transform(string_split(s, chr(10)), lambda p: md5(p)), ''))"
    shown = f"substr({section}, 1, 8) || '(' || array_to_string(list_transform(string_split(s, chr(10)), lambda p: substr(md5(p), 1, 8)), '.') || ')'"
    parts = f"string_split({text}, chr(10) || chr(10))"
    return f"sha256(array_to_string(list_transform({parts}, lambda s: {section}), '')) || ':' || array_to_string(list_transform({parts}, lambda s: {shown}), ';') || ':' || array_to_string({leaves}, '')"


def _near_sql(text: str, other: str, a: str, b: str) -> str:
    a, b = f"list_distinct({a})", f"list_distinct({b})"
    return f"CASE WHEN {text} = {other} THEN 1.0::DOUBLE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END"


def _clauses_sql(text: str) -> str:
    pattern = CLAUSE.replace("\\n", "' || chr(10) || '")
    return f"list_transform(regexp_extract_all({text}, '{pattern}'), lambda x: substr(md5(x), 1, 6))"


ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, length(text) AS n_chars, coalesce(lead(text) OVER (ORDER BY doc_id, text), first_value(text) OVER (ORDER BY doc_id, text)) AS next_text FROM t),
e AS (SELECT *, substr(text, 1, n_chars - n_chars // 2) || substr(next_text, 1, n_chars // 2) AS edited FROM n),
c AS (SELECT *, {_clauses_sql("text")} AS c, {_clauses_sql("edited")} AS c_edited, {_clauses_sql("next_text")} AS c_next FROM e)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {_written_sql("text", "c")} AS fingerprint,
       {_written_sql("edited", "c_edited")} AS edited_fingerprint,
       {_near_sql("text", "edited", "c", "c_edited")} AS near_edited, {_near_sql("text", "next_text", "c", "c_next")} AS near_next
FROM c
"""
