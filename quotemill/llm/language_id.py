"""Language identification by the nearest of several centroids per language.

A text is its letter trigrams, hashed into 4,096 places, weighted log(1 + count) * idf and scaled to length one. Document
frequencies come from all training texts. Each language's centroids come from spherical k-means over a bounded sample of
its training texts (about `SAMPLE` of them, in one task per language). A text takes the language of the centroid with the
largest cosine; it is rejected when that cosine is under the centroid's floor, or when it has no letter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bucket_of, columns, per_batch, tune

DIMS = 4096
CENTROIDS = 4
SAMPLE = 1500
ROUNDS = 10
#: A centroid's floor: this share of the cosine that all but 1 in 200 of its sample reach.
SLACK = 0.25
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_BLOCK = 1 << 20
_TABLE = np.array([c if chr(c).isalpha() else 32 for c in range(0x250)], np.uint32)


def gram_counts(text: str | None) -> np.ndarray:
    """Counts of the hashed letter trigrams of a whole text, words with a space at both ends."""
    out = np.zeros(DIMS, np.int64)
    if not text:
        return out
    ends = np.array([32], np.uint32)  # the last two letters or spaces before a block
    for at in range(0, len(text), _BLOCK):
        part = text[at : at + _BLOCK].lower().replace("ς", "σ")
        part += " " if at + _BLOCK >= len(text) else ""
        c = np.concatenate((ends, np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)))
        c = np.where(c < 0x250, _TABLE[np.minimum(c, 0x24F)], c)
        spaces = c == 32
        keep = ~(spaces[:-1] & spaces[1:])  # one space between words
        c = c[np.concatenate((keep, [True]))]
        ends = c[-2:]
        if len(c) < 3:
            continue
        h = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA6B)) ^ (c[2:] * np.uint32(0xC2B2AE35))
        h ^= h >> np.uint32(15)
        out += np.bincount((h * np.uint32(0x2C1B3C6D)) >> np.uint32(20), minlength=DIMS)
    return out


def vectors(texts: list, idf: np.ndarray) -> np.ndarray:
    out = np.empty((len(texts), DIMS), np.float32)
    for i, text in enumerate(texts):
        out[i] = np.log1p(gram_counts(text)) * idf
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _clusters(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far-apart seeds: centroids and their floors."""
    seeds = [x.mean(axis=0)]
    nearest = x @ seeds[0]
    for _ in range(min(k, len(x))):
        seeds.append(x[int(nearest.argmin())])
        nearest = np.maximum(nearest, x @ seeds[-1])
    centroids = np.stack(seeds[1:] if len(seeds) > 1 else seeds)
    for _ in range(ROUNDS):
        of = (x @ centroids.T).argmax(axis=1)
        sums = np.stack([x[of == i].sum(axis=0) if (of == i).any() else centroids[i] for i in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    best = x @ centroids.T
    of, cosine = best.argmax(axis=1), best.max(axis=1)
    overall = np.quantile(cosine, 0.005)
    floors = [np.quantile(cosine[of == i], 0.005) if (of == i).sum() >= 50 else overall for i in range(len(centroids))]
    return centroids, SLACK * np.array(floors)


class Model:
    def __init__(self, languages: list[str], centroids: np.ndarray, floors: np.ndarray, idf: np.ndarray):
        self.languages, self.centroids, self.floors, self.idf = languages, centroids, floors, idf

    def predict(self, texts: list) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejected for each text."""
        named = np.array([bool(t and _LETTER.search(t)) for t in texts], bool)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), ~named
        cosine = vectors(texts, self.idf) @ self.centroids.T
        best = cosine.argmax(axis=1) if len(texts) else np.empty(0, int)
        score = np.clip(cosine[np.arange(len(texts)), best], 0, 1).astype(float)
        rejected = ~named | (score < self.floors[best])
        return [self.languages[i] if ok else UNKNOWN for i, ok in zip(best, named)], np.where(named, score, 0.0), rejected


def fit(docs: DataFrame) -> Model:
    """From the rows of docs(doc_id, text, lang) with a text and a lang; without any, a model that knows no language."""
    tune(docs.sparkSession)
    docs = columns(docs, doc_id="long", text="string", lang="string").where("lang is not null and text is not null")

    def frequencies(batches):
        seen = np.zeros(DIMS, np.int64)
        n = 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen += gram_counts(text) > 0
                n += 1
        yield {"n": [n], "seen": [seen.tobytes()]}

    def add(batches):
        seen = np.zeros(DIMS, np.int64)
        n = 0
        for batch in batches:
            n += sum(batch.column("n").to_pylist())
            for x in batch.column("seen").to_pylist():
                seen += np.frombuffer(x, np.int64)
        yield {"n": [n], "seen": [seen.tobytes()]}

    kind = "n long, seen binary"
    parts = per_batch(per_batch(docs.select("text"), frequencies, kind).repartition(16), add, kind).collect()  # 16 rows of 32 KB
    n, seen = sum(p.n for p in parts), sum((np.frombuffer(p.seen, np.int64) for p in parts), np.zeros(DIMS, np.int64))
    idf = np.log((n + 1) / (seen + 1)).astype(np.float32)
    totals = {r.lang: r["count"] for r in docs.groupBy("lang").count().collect()}  # one row a language
    if not totals:
        return Model([], np.zeros((0, DIMS), np.float32), np.zeros(0), idf)
    share = F.lit(0.0)
    for lang, count in totals.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, SAMPLE / count))).otherwise(share)
    drawn = docs.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1_000_000)) < share * 1_000_000)

    def cluster(table: pa.Table) -> pa.Table:
        x = vectors(table.column("text").to_pylist(), idf)
        x = x[np.linalg.norm(x, axis=1) > 0]
        centroids, floors = _clusters(x, CENTROIDS) if len(x) else (np.zeros((0, DIMS), np.float32), np.zeros(0))
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(centroids), pa.string()), "centroid": pa.array([c.astype(np.float32).tobytes() for c in centroids], pa.binary()), "floor": pa.array(floors, pa.float64())})

    rows = drawn.select("lang", "text").groupBy("lang").applyInArrow(cluster, "lang string, centroid binary, floor double").collect()
    rows.sort(key=lambda r: (r.lang, bytes(r.centroid)))
    matrix = np.stack([np.frombuffer(r.centroid, np.float32) for r in rows]) if rows else np.zeros((0, DIMS), np.float32)
    return Model([r.lang for r in rows], matrix, np.array([r.floor for r in rows]), idf)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row of docs(doc_id, text).

    lang_pred is `und` and score 0 for a null text or one without a letter. rejected says that the nearest centroid is too
    far (or that there's no letter). Of equal cosines the first centroid by language wins. Null ids stay null, repeated
    rows are taken each by themselves, an empty table gives an empty one, other columns play no part.
    """
    tune(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few centroids of 16 KB for each language

    def work(batches):
        for batch in batches:
            language, score, rejected = sent.value.predict(batch.column("text").to_pylist())
            yield {"doc_id": batch.column("doc_id"), "lang_pred": language, "score": score, "rejected": rejected}

    return per_batch(columns(docs, doc_id="long", text="string"), work, "doc_id long, lang_pred string, score double, rejected boolean")


def identify_held_out(docs: DataFrame, modulus: int = 4, held: int = 2) -> DataFrame:
    """Learns from the documents whose crc32(doc_id) mod `modulus` isn't `held` and predicts all."""
    model = fit(docs.where(bucket_of("doc_id", modulus) != held))
    return identify(docs, model).withColumn("held_out", bucket_of("doc_id", modulus) == held)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, that aren't rejected. A model that knows no language rejects only texts without a letter."""
    tune(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        return pd.Series(~sent.value.predict(texts.tolist())[2], index=texts.index)

    return docs.where(known("text")).select(*docs.columns)
