"""Toxicity by a weighted finite-state pattern grammar.

The lexicon transducer turns the words of a clause into signs (insult with a weight, target, threat, negation, reported speech):
it cuts off clitics and reads verbs of threats by stem and ending.
Small machines, each with its own states, read the signs: negation reaches over the next words, reported speech to the end of
the clause, a target forwards and (over the clause read backwards) to what comes before it. `compose` makes one machine of
them, whose states are tuples of theirs; an accepting machine then turns its outputs into what the clause says: an insult or
threat that is aimed at someone, negated, reported or neither. Scored are matched clauses. The insults are learned: words and
word beginnings of labelled texts (a bounded sample, about `SAMPLE` rows) whose share among toxic texts is many times that among
clean ones. A logistic curve over the marked clauses, fitted on the same rows, gives the score.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bucket_of, columns, materialize, per_batch, tune

SAMPLE = 20_000
#: Most entries of the lexicon, least texts that hold one, and how many times likelier it must be in a toxic text.
ENTRIES, LEAST_TEXTS, LEAST_RATIO = 20_000, 4, 20.0
BEGINNINGS = (4, 5)

# fixed values: words of the closed classes, in English, German, French, Spanish
TARGETS = frozenset("you your yours t' he she him her they them their these those people du dich dir ihr euch sie er ihm ihn tu toi te vous il elle ils elles eux usted ustedes él ella ellos ellas".split())
#: Verbs of threats: stems, each with the endings of its kind.
STEMS = {
    "en": "kill destroy burn|beat shoot hang hurt|stabb|stab hung shot beaten burnt",
    "de": "töt getöt vernicht|verletz|schlag schläg|schlug geschlagen",
    "fr": "tu frapp bless|détrui|détruir",
    "es": "mat golpe|destru her|destruy hier|hir",
}
ENDINGS = {
    "en": "- s ed ing|- s ing|ed ing|- s",
    "de": "e est et en ete etest eten end|e t en te test ten end|e t en st end|- en st",
    "fr": "e es ons ez ent er é és ée ées ais ait aient ant erai eras era erons erez eront|s t sons sez sent sait sant t te ts|e ai as a ons ez ont",
    "es": "o as a amos an ar é aste ó aron aba aban aré arás ará aremos arán ando ado e es en|ir í iste imos ido iré irás irá iremos irán|o es e en ó eron endo a as an|ió ieron iendo",
}
#: Forms that are other words as well.
NOT_THREATS = frozenset("mate mates blesses".split())
#: Spanish pronouns that hang on infinitives and gerunds.
HANGING = ("te", "os", "lo", "la", "le", "los", "las", "les")
NEGATIONS = frozenset("not no never nobody n't n' nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún".split())
REPORTS = frozenset("said says say wrote called calls quoted reported claims sagte sagt schrieb nannte dit disait écrit appelle dijo dice escribió llamó".split())

_CLAUSE = re.compile(r"[.!?;:\n|]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_REACH = {"negated": 3, "aimed": 6}
MARKS = ("plain", "aimed", "negated", "reported", "threat", "clauses")


class Endings:
    """A transducer of verbs, a stem and then an ending of its kind; its finite language is spelled out once, as each word is looked up.
    `hanging`: infinitives and gerunds with a pronoun on them."""

    def __init__(self, stems: dict[str, str], endings: dict[str, str]):
        kinds = [(group.split(), ends.split()) for lang, groups in stems.items() for group, ends in zip(groups.split("|"), endings[lang].split("|"))]
        self.forms = frozenset(stem + ("" if e == "-" else e) for group, ends in kinds for stem in group for e in ends) - NOT_THREATS
        ends = ("ar", "ir", "ando", "iendo", "endo")
        open_ = {w for w in self.forms if w.endswith(ends)}
        self.hanging = frozenset(w + p for v in open_ for w in (v, v.replace("ando", "ándo").replace("endo", "éndo")) for p in HANGING)

    def __contains__(self, word: str) -> bool:
        return word in self.forms


THREATS = Endings(STEMS, ENDINGS)


def words_of(low: str) -> list[str]:
    """Words in lower case, clitics cut off: you 're, is n't, t' es, qu' il."""
    found, out = _WORD.findall(low), []
    if "'" not in low and "’" not in low:
        return found
    for word in found:
        word = word.replace("’", "'")
        if "'" not in word:
            out.append(word)
        elif word.endswith("n't") and len(word) > 3:
            out += [word[:-3], "n't"]
        else:
            head, *rest = word.split("'")
            while rest and len(head) <= 2 and head not in TARGETS:  # an elision: the apostrophe belongs to what stands before it
                out.append(f"{head}'")
                head, *rest = rest
            out += [head, *(f"'{r}" for r in rest)]
    return out


class Lexicon:
    """The first transducer: words to signs."""

    def __init__(self, words: dict[str, float], beginnings: dict[str, float]):
        self.words, self.beginnings = words, beginnings

    def insult(self, word: str) -> float:
        found = self.words.get(word, 0.0)
        for n in BEGINNINGS:
            if len(word) > n:
                found = max(found, self.beginnings.get(word[:n], 0.0))
        return found

    def any_in(self, words: set[str]) -> bool:
        return not words.isdisjoint(self.words) or not words.isdisjoint(THREATS.forms) or not words.isdisjoint(THREATS.hanging) or any(not {w[:n] for w in words}.isdisjoint(self.beginnings) for n in BEGINNINGS)

    def signs(self, words: list[str]) -> list[tuple[str, float]]:
        out = []
        for w in words:
            if weight := self.insult(w):
                out.append(("insult", weight))
            elif w in THREATS.hanging:
                out += [("threat", 1.0), ("target", 0.0)]
            else:
                out.append(("threat", 1.0) if w in THREATS.forms else ("target", 0.0) if w in TARGETS else ("negation", 0.0) if w in NEGATIONS else ("report", 0.0) if w in REPORTS else ("", 0.0))
        return out


SIGNS = ("", "insult", "threat", "target", "negation", "report")


class Machine:
    """A deterministic transducer: next[state][sign] and out[state][sign], before the sign moves the state; state 0 begins."""

    def __init__(self, next_: list[dict[str, int]], out: list[dict[str, tuple]]):
        self.next, self.out = next_, out

    def run(self, signs: list[str]) -> list[tuple]:
        state, found = 0, []
        for sign in signs:
            found.append(self.out[state][sign])
            state = self.next[state][sign]
        return found


def within(sign: str, reach: int | None) -> Machine:
    """Says of each place whether `sign` stood at most `reach` places before it (None: anywhere before)."""
    left = range(2 if reach is None else reach + 1)
    step = lambda n, s: left[-1] if s == sign else n if reach is None else max(0, n - 1)
    return Machine([{s: step(n, s) for s in SIGNS} for n in left], [{s: (n > 0,) for s in SIGNS} for n in left])


def compose(*machines: Machine) -> Machine:
    """One machine that runs all of them over the same signs: its states are the reachable tuples of theirs, its outputs theirs in a row."""
    states: dict[tuple, int] = {(0,) * len(machines): 0}
    next_: list[dict[str, int]] = []
    out: list[dict[str, tuple]] = []
    for state in (todo := [*states]):
        next_.append({})
        out.append({})
        for sign in SIGNS:
            to = tuple(m.next[q][sign] for m, q in zip(machines, state))
            if to not in states:
                states[to] = len(states)
                todo.append(to)
            next_[-1][sign] = states[to]
            out[-1][sign] = sum((m.out[q][sign] for m, q in zip(machines, state)), ())
    return Machine(next_, out)


FORWARDS = compose(within("negation", _REACH["negated"]), within("report", None), within("target", _REACH["aimed"]))
BACKWARDS = within("target", _REACH["aimed"])
#: What an insult says, and a threat, where (negated, reported, aimed) hold; a threat that isn't aimed, or is negated or reported, has no accepting state.
ACCEPTS = {
    ("insult", n, r, a): "reported" if r else "negated" if n else "aimed" if a else "plain" for n in (False, True) for r in (False, True) for a in (False, True)
} | {("threat", False, False, True): "threat"}


def clause_marks(words: list[str], lexicon: Lexicon) -> dict[str, float] | None:
    """The composed transducers over one clause: weights by mark; None if nothing matches."""
    read = lexicon.signs(words)
    signs = [kind for kind, _ in read]
    if "insult" not in signs and "threat" not in signs:
        return None
    out = dict.fromkeys(MARKS, 0.0)
    for (kind, weight), (negated, reported, aimed), (later,) in zip(read, FORWARDS.run(signs), BACKWARDS.run(signs[::-1])[::-1]):
        if mark := ACCEPTS.get((kind, negated, reported, aimed or later)):
            out[mark] += weight
    out["clauses"] = float(any(out.values()))
    return out


def marks(text: str | None, lexicon: Lexicon) -> list[float]:
    """Of a whole text: log(1 + weight) for each mark."""
    low = (text or "").lower()
    total = np.zeros(len(MARKS))
    if lexicon.any_in(set(words_of(low))):  # cut as the clauses' words are
        for clause in _CLAUSE.split(low):
            if found := clause_marks(words_of(clause), lexicon):
                total += list(found.values())
    return np.log1p(total).tolist()


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def score(self, text: str | None) -> float:
        if not self.weights.any():
            return 0.0  # nothing learned speaks for toxicity
        x = float(self.weights[0] + np.dot(self.weights[1:], marks(text, self.lexicon)))
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights, the constant first. A negated or reported match never weighs more than a plain one, and none less than 0."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        keep = ridge * np.r_[0, np.ones(len(w) - 1)]
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + np.diag(keep + 1e-9), x.T @ (y - p) - keep * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    at = {name: i + 1 for i, name in enumerate(MARKS)}
    w[1:] = np.maximum(w[1:], 0)
    w[at["aimed"]] = max(w[at["aimed"]], w[at["plain"]])
    for name in ("negated", "reported"):
        w[at[name]] = min(w[at[name]], w[at["plain"]])
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """From labels(doc_id, toxic) and the texts of docs; a document with several labels counts as toxic if one says so.

    Labels without id or value and texts that are null or empty teach nothing; with none left, or labels of one
    kind only, every score is 0.
    """
    tune(docs.sparkSession)
    labels = columns(labels, doc_id="long", toxic="int").dropna().groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    total = labels.count()
    drawn = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 1_000_000 * min(1.0, SAMPLE / max(1, total)))  # about 16 bytes for each of SAMPLE rows
    rows = columns(docs, doc_id="long", text="string").where("text is not null and text <> ''").join(F.broadcast(drawn), "doc_id")
    rows = materialize(rows.select("text", "toxic").repartition(8))
    sums = rows.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    n, n_toxic = sums[0], sums[1] or 0
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), 0))
    begun = [F.transform(F.filter("words", lambda w, k=k: F.length(w) > k), lambda w, k=k: F.concat(F.lit("^"), F.substring(w, 1, k))) for k in BEGINNINGS]
    entries = rows.select("toxic", words.alias("words")).select("toxic", F.explode(F.array_distinct(F.concat("words", *begun))).alias("entry"))
    counted = entries.groupBy("entry").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("all"))
    ratio = ((F.col("bad") + 0.5) / (n_toxic + 1)) / ((F.col("all") - F.col("bad") + 0.5) / (n - n_toxic + 1))
    found = counted.where(F.col("bad") >= LEAST_TEXTS).withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("ratio"), "entry").limit(ENTRIES).collect()
    weight = {r.entry: float(np.log(r.ratio)) for r in found}
    lexicon = Lexicon({w: x for w, x in weight.items() if w[0] != "^"}, {w[1:]: x for w, x in weight.items() if w[0] == "^"})

    def work(batches):
        for batch in batches:
            each = [marks(t, lexicon) for t in batch.column("text").to_pylist()]
            yield {"toxic": batch.column("toxic"), "x": each}

    table = per_batch(rows, work, "toxic int, x array<double>").collect()  # the sample's rows, six numbers each
    if not table or not 0 < n_toxic < n:
        return Model(lexicon, np.zeros(len(MARKS) + 1))
    return Model(lexicon, _logistic(np.array([r.x for r in table]), np.array([r.toxic for r in table], float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for every row of docs(doc_id, text).

    Null and empty texts have the score of a text that matches nothing. Null ids stay null, repeated rows are scored each by
    themselves, an empty table gives an empty one, other columns play no part.
    """
    tune(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # ENTRIES entries at most

    def work(batches):
        for batch in batches:
            found = [sent.value.score(t) for t in batch.column("text").to_pylist()]
            yield {"doc_id": batch.column("doc_id"), "score": found, "predicted": [int(x >= 0.5) for x in found]}

    return per_batch(columns(docs, doc_id="long", text="string"), work, "doc_id long, score double, predicted int")


def score_held_out(docs: DataFrame, labels: DataFrame, modulus: int = 5) -> DataFrame:
    """Learns from the labels whose crc32(doc_id) mod `modulus` isn't 0 and scores all documents."""
    model = fit(docs, labels.where(bucket_of("doc_id", modulus) != 0))
    return score(docs, model).withColumn("held_out", bucket_of("doc_id", modulus) == 0)
