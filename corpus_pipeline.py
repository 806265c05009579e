"""From raw documents to packed training sequences.

Each stage works on all rows that the one before it kept, and its result is written as Parquet and read again. What a stage
decides takes effect at once: rejected documents, copies and documents with benchmark passages go, personal data is masked.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.llm import decontaminate, jaccard_join, language_id, packing, pii
from quotemill.llm._shared import work_dir


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: learns from all rows with a lang; rows whose text no centroid is near to, or without a letter (null and empty texts
    too), go. Where no row has a lang, only those without a letter go. Repeated rows share their fate; empty tables stay empty."""
    return language_id.identified(docs, language_id.fit(docs))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of documents that link (Jaccard of five-word shingles 0.75 or more) the smallest doc_id stays."""
    return jaccard_join.one_of_each(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents with a passage of the benchmark go. Null and empty texts, rows without doc_id and an empty benchmark
    lose nothing; of rows that share a doc_id all go if one has a passage."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: identifiers give way to their kind in brackets; n_chars follows the text, null for a null one. Rows stay as many."""
    return pii.mask_pii(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: one row for each piece, with its token ids. Null and empty texts are one end token; repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("language", keep_known_languages),
    ("near_copies", keep_one_of_each),
    ("benchmark", drop_benchmark_passages),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]
#: Language ID, edit matching, deobfuscation and tokenizing aren't expressible in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over sf_dir's documents; an empty table gives an empty one. Documents without text have no language and go in the
    first stage; rows that share a doc_id count as copies in the second."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{work_dir(spark)}/quotemill/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
