"""The queries of this subpackage: one for each operator, over its whole table, with its production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import language_id, manifest, quality, structure_repair, toxicity
from .decontaminate import leaks
from .jaccard_join import ORACLE_SQL as JACCARD_SQL
from .jaccard_join import jaccard_components
from .merkle import ORACLE_SQL as MERKLE_SQL
from .merkle import fingerprints
from .ngram_bloom_lm import score_held_out
from .packing import pack
from .pii import find_pii
from .quotation_links import ORACLE_SQL as QUOTATION_SQL
from .quotation_links import ORDERED_SQL, link_quotations, reply_ordered
from .simhash import near_duplicates


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1: every message of conversations with what it quotes and what it replies to (`link_quotations`). Nulls, repeats and empty tables as the operator states."""
    return link_quotations(_table(spark, sf_dir, "conversations"))


def op1_reply_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1: the same messages with branch and position in reply order (`reply_ordered`). Nulls, repeats and empty tables as the operator states."""
    return reply_ordered(link_quotations(_table(spark, sf_dir, "conversations")))


def op2_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2: expected grade and tail probability of every document, learnt from the labels outside the held-out part. Nulls, repeats and empty tables as the operator states."""
    return quality.grade_held_out(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3: the language of every document by its nearest centroid; `und` where none is near or no letter is there. Nulls, repeats and empty tables as the operator states."""
    return language_id.identify_held_out(_table(spark, sf_dir, "documents"))


def op4_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4: log10 probability of every document by a model of words, pairs and triples in a log-frequency Bloom filter. Nulls, repeats and empty tables as the operator states."""
    return score_held_out(_table(spark, sf_dir, "documents"))


def op5_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5: every document's pieces of power-of-two lengths and their sequences. Nulls, repeats and empty tables as the operator states."""
    return pack(_table(spark, sf_dir, "documents"), with_ids=False)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6: every document with its number of shingles and the smallest doc_id that it reaches by links at 0.75. Nulls, repeats and empty tables as the operator states."""
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op7_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7: Merkle roots of every document and of its edited text, and how alike they are. Nulls, repeats and empty tables as the operator states."""
    return fingerprints(_table(spark, sf_dir, "documents"))


def op8_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8: toxicity of every document by the clauses that the grammar matches. Nulls, repeats and empty tables as the operator states."""
    return toxicity.score_held_out(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_benchmark_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9: documents that hold a passage of the benchmark within the error budget. Nulls, repeats and empty tables as the operator states."""
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10: identifiers of every document, plain and disguised, at their source places. Nulls, repeats and empty tables as the operator states."""
    return find_pii(_table(spark, sf_dir, "documents"))


def op11_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 11: every document with its SimHash fingerprint and the smallest doc_id that it reaches by links at three bits. Nulls, repeats and empty tables as the operator states."""
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 12: every conversation's faults after the damage, the cheapest edits that repair its roles, and the repaired text's hash. Nulls, repeats and empty tables as the operator states."""
    return structure_repair.repair(_table(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 13: every document as a leaf of the manifest, with its proof and the root that its tampered leaf leads to. Nulls, repeats and empty tables as the operator states."""
    return manifest.proved(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_quotation_links": QUOTATION_SQL, "op1_reply_ordered": ORDERED_SQL, "op6_ngram_jaccard_join": JACCARD_SQL, "op7_merkle_fingerprints": MERKLE_SQL, "op12_structure_repair": structure_repair.ORACLE_SQL, "op13_merkle_manifest": manifest.ORACLE_SQL}
