"""Quality grades by ordinal cumulative-link regression.

P(grade <= k) = 1 / (1 + exp(x . w - t_k)): one set of weights over hashed text features for all grades, with ordered
thresholds t_1 < t_2 < ... kept in order by their positive gaps. Features are hashed words, hashed word shapes and marks of
repetition, scaled to length one. The fit takes a bounded sample of labelled rows (about `SAMPLE`) in one task.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bucket_of, columns, per_batch, tune, word_hashes

SAMPLE = 6_000
DIMS = 1 << 14
ROUNDS = 30

_RUNS = re.compile(r"(.)\1+")
_SHAPE = str.maketrans({c: "x" for c in "abcdefghijklmnopqrstuvwxyzäöüßàâçéèêëîïôûùáíóúñ"} | {c: "X" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÀÂÇÉÈÊÁÍÓÚÑ"} | {c: "9" for c in "0123456789"})
_SHAPES_KEPT = 20_000


def _hashed(counts: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    h = word_hashes(" ".join(counts)) % np.uint64(DIMS // 4)
    return h.astype(np.int64), np.array(list(counts.values()), float)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a whole text: three quarters of the places for words, the last for shapes and repetition."""
    h = word_hashes(text)
    if not len(h):
        return np.array([DIMS - 1]), np.array([1.0])
    n = len(h)
    kinds, counts = np.unique(h % np.uint64(DIMS * 3 // 4), return_counts=True)
    x = np.log1p(counts)
    x /= np.linalg.norm(x)
    seen: dict[str, str] = {}
    shapes: dict[str, float] = {}
    for word in text.split():
        shape = seen.get(word)
        if shape is None:
            shape = _RUNS.sub(r"\1", word.translate(_SHAPE))
            if len(seen) < _SHAPES_KEPT:
                seen[word] = shape
        shapes[shape] = shapes.get(shape, 0) + 1
    marks = {f"shape={s}": c / n for s, c in shapes.items()}
    lines = [line for line in text.split("\n") if line.strip()]
    marks["next=same"] = float((h[1:] == h[:-1]).mean()) if n > 1 else 0.0
    marks["words=few"] = 1 - len(np.unique(h)) / n
    marks["lines=repeated"] = 1 - len(set(lines)) / max(1, len(lines))
    marks[f"size={min(12, n.bit_length())}"] = 0.3
    places, values = _hashed(marks)
    values /= max(1.0, np.linalg.norm(values))
    return np.concatenate((kinds.astype(np.int64), DIMS * 3 // 4 + places)), np.concatenate((0.5 * x, values))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Model:
    """Weights, thresholds and the grades that they part."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, grades: list[int]):
        self.weights, self.thresholds, self.grades = weights, thresholds, grades

    def at_most(self, text: str | None) -> np.ndarray:
        """P(grade <= k) for each grade but the last."""
        places, values = features(text)
        return _sigmoid(self.thresholds - float(values @ self.weights[places]))

    def read(self, text: str | None, least: int | None) -> tuple[float, float]:
        """Expected grade and the probability of grade `least` (by default the highest) or more."""
        if not self.grades:
            return float("nan"), float("nan")
        upto = np.append(self.at_most(text), 1.0)
        each = np.diff(upto, prepend=0.0)
        least = self.grades[-1] if least is None else least
        return float(each @ np.array(self.grades, float)), float(sum(p for p, g in zip(each, self.grades) if g >= least))


def cumulative_link(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and k - 1 thresholds by AdaGrad over the rows in one fixed order; y holds places of grades, 0..k-1."""
    share = np.clip(np.cumsum(np.bincount(y, minlength=k))[:-1] / len(y), 0.01, 0.99)
    t = np.log(share / (1 - share))
    first, gaps = t[0], np.log(np.maximum(np.diff(t), 1e-2))
    w, past = np.zeros(DIMS), np.full(DIMS, 1e-3)
    past_t = np.full(k - 1, 1e-2)
    order = np.random.default_rng(11).permutation(len(y))
    for _ in range(rounds):
        for i in order:
            places, values = rows[i]
            t = first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
            score = values @ w[places]
            high = _sigmoid(t[y[i]] - score) if y[i] < k - 1 else 1.0
            low = _sigmoid(t[y[i] - 1] - score) if y[i] > 0 else 0.0
            p = max(high - low, 1e-9)
            d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
            g = values * (d_high - d_low) + 1e-5 * w[places]  # of the loss, by weight
            past[places] += g * g
            w[places] -= 0.3 * g / np.sqrt(past[places])
            g_t = np.zeros(k - 1)
            if y[i] < k - 1:
                g_t[y[i]] -= d_high
            if y[i] > 0:
                g_t[y[i] - 1] += d_low
            g_t = np.concatenate(([g_t.sum()], np.cumsum(g_t[:0:-1])[::-1] * np.exp(gaps)))
            past_t += g_t * g_t
            step = 0.05 * g_t / np.sqrt(past_t)
            first, gaps = first - step[0], gaps - step[1:]
    return w, first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))


def fit(docs: DataFrame, labels: DataFrame, grade: str = "quality") -> Model:
    """From labels(doc_id, `grade`) and the texts of docs; of several grades of a document the lowest holds.

    Labels without id or grade teach nothing; a null text is an empty one. With fewer than two different grades the model
    gives that grade to all texts, with none, nulls.
    """
    tune(docs.sparkSession)
    labels = columns(labels, **{"doc_id": "long", grade: "int"}).dropna().groupBy("doc_id").agg(F.min(grade).alias("grade"))
    total = labels.count()
    drawn = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 1_000_000 * min(1.0, SAMPLE / max(1, total)))
    rows = columns(docs, doc_id="long", text="string").join(F.broadcast(drawn), "doc_id")

    def sparse(batches):
        for batch in batches:
            each = [features(t) for t in batch.column("text").to_pylist()]
            yield {"doc_id": batch.column("doc_id"), "grade": batch.column("grade"), "places": [p.astype(np.int32).tobytes() for p, _ in each], "entries": [v.astype(np.float32).tobytes() for _, v in each]}

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        rows = [(np.frombuffer(p, np.int32).astype(np.int64), np.frombuffer(v, np.float32).astype(float)) for p, v in zip(table.column("places").to_pylist(), table.column("entries").to_pylist())]
        grades = sorted(set(table.column("grade").to_pylist()))
        y = np.searchsorted(grades, table.column("grade").to_pylist())
        w, t = cumulative_link(rows, y, len(grades)) if len(grades) > 1 else (np.zeros(DIMS), np.empty(0))
        return pa.table({"weights": pa.array([w.tobytes()], pa.binary()), "thresholds": pa.array([t.tobytes()], pa.binary()), "grades": pa.array([grades], pa.list_(pa.int32()))})

    table = per_batch(rows, sparse, "doc_id long, grade int, places binary, entries binary")
    found = table.groupBy(F.lit(1).alias("one")).applyInArrow(learn, "weights binary, thresholds binary, grades array<int>").collect()
    if not found:
        return Model(np.zeros(DIMS), np.empty(0), [])
    return Model(np.frombuffer(found[0].weights, float), np.frombuffer(found[0].thresholds, float), list(found[0].grades))


def grade(docs: DataFrame, model: Model, least: int | None = None) -> DataFrame:
    """doc_id, expected_grade, tail (probability of grade `least` or more), keep (tail >= 0.5) for every row of docs(doc_id, text).

    Null and empty texts get the grade of a text without words. Null ids stay null, repeated rows are graded each by
    themselves, an empty table gives an empty one, other columns play no part.
    """
    tune(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 128 KB

    def work(batches):
        for batch in batches:
            each = [sent.value.read(t, least) for t in batch.column("text").to_pylist()]
            yield {"doc_id": batch.column("doc_id"), "expected_grade": [None if np.isnan(e) else e for e, _ in each], "tail": [None if np.isnan(t) else t for _, t in each], "keep": [None if np.isnan(t) else t >= 0.5 for _, t in each]}

    return per_batch(columns(docs, doc_id="long", text="string"), work, "doc_id long, expected_grade double, tail double, keep boolean")


def grade_held_out(docs: DataFrame, labels: DataFrame, modulus: int = 5) -> DataFrame:
    """Learns from the labels whose crc32(doc_id) mod `modulus` isn't 0 and grades all documents."""
    model = fit(docs, labels.where(bucket_of("doc_id", modulus) != 0))
    return grade(docs, model).withColumn("held_out", bucket_of("doc_id", modulus) == 0)
