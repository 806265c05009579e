"""Notes that answer a question: vectors of their sections and an index of their keywords, together (J-18)."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMS = 384
#: fixed values: what a keyword in the question adds, the least score, how many notes answer
BOOST, FLOOR, TOP = 0.30, 0.40, 2
#: Notes are a small collection of a site; more than so many are an error, not a silent cut.
MOST_NOTES = 20_000
_LEAST_KEYWORD = 3


@functools.lru_cache(1 << 18)
def _place(gram: str) -> int:
    return int(hashlib.md5(gram.encode()).hexdigest()[:8], 16) % DIMS


#: Places of the ASCII trigrams that a worker has met; -1 for others.
_PLACES = np.full(1 << 21, -1, np.int16)


def embedded(text: str) -> np.ndarray:
    """C-15 of one text."""
    text = text.ljust(3)
    if text.isascii():
        x = np.frombuffer(text.encode(), np.uint8).astype(np.int32)
        codes = (x[:-2] << 14) | (x[1:-1] << 7) | x[2:]
        places = _PLACES[codes]
        if (places < 0).any():
            for code in np.unique(codes[places < 0]).tolist():
                _PLACES[code] = _place(chr(code >> 14) + chr(code >> 7 & 127) + chr(code & 127))
            places = _PLACES[codes]
    else:
        places = [_place(text[i : i + 3]) for i in range(len(text) - 2)]
    out = np.bincount(places, minlength=DIMS).astype(float)
    return out / np.linalg.norm(out)


def answering(questions: DataFrame, notes: DataFrame, floor: float = FLOOR, top: int = TOP) -> DataFrame:
    """J-18: (question_id, note_id, score, rank) of questions(question_id, key) and notes(note_id, texts, keywords: arrays of keys).

    The score is the best cosine of a note's texts, and `BOOST` more if one of its keywords (three characters or more) stands in
    the question. The best `top` at `floor` or more, ties by note_id. Scores are rounded to six places. Questions pass once through tasks that
    hold the notes' vectors and an index of keywords, met from the questions' own pieces of text. Null ids, null and empty keys have no answer.
    """
    import ahocorasick

    spark = questions.sparkSession
    rows = notes.where("note_id is not null").select("note_id", "texts", "keywords").orderBy("note_id").limit(MOST_NOTES + 1).collect()
    if len(rows) > MOST_NOTES:
        raise ValueError(f"over {MOST_NOTES} notes")
    owner = [i for i, r in enumerate(rows) for _ in r.texts or []]
    vectors = np.array([embedded(t or "") for r in rows for t in r.texts or []]).reshape(-1, DIMS)
    keywords: dict[str, set[int]] = {}
    for i, r in enumerate(rows):
        for word in r.keywords or []:
            if word and len(word.strip()) >= _LEAST_KEYWORD:
                keywords.setdefault(word, set()).add(i)
    sent = spark.sparkContext.broadcast((np.array([r.note_id for r in rows], np.int64), np.array(owner, np.int64), vectors, {k: sorted(v) for k, v in keywords.items()}))

    def work(batches):
        ids, owner, vectors, keywords = sent.value
        index = ahocorasick.Automaton()
        for word, of in keywords.items():
            index.add_word(word, of)
        if len(index):
            index.make_automaton()
        for batch in batches:
            names, keys = (batch.column(c).to_pylist() for c in ("question_id", "key"))
            asked = np.array([embedded(k) for k in keys]).reshape(-1, DIMS)
            best = np.full((len(ids), len(keys)), -np.inf)
            np.maximum.at(best, owner, vectors @ asked.T)
            if len(index):
                for q, key in enumerate(keys):
                    best[sorted({i for _, of in index.iter(key) for i in of}), q] += BOOST
            best = np.round(best, 6)
            out = []
            for q, name in enumerate(names):
                order = np.lexsort((ids, -best[:, q]))[:top]
                out += [(name, int(ids[i]), float(best[i, q]), rank) for rank, i in enumerate(order, 1) if best[i, q] >= floor]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.int32()))] if out else [pa.array([], k) for k in (pa.int64(), pa.int64(), pa.float64(), pa.int32())], ["question_id", "note_id", "score", "rank"])

    real = questions.where("question_id is not null and key <> ''").select(F.col("question_id").cast("long").alias("question_id"), "key")
    return real.mapInArrow(work, "question_id long, note_id long, score double, rank int")
