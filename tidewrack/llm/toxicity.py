"""Toxicity by a weighted finite-state grammar over the words of a clause.

Words get classes: insult (a learned list of words and word beginnings, each with
a weight), threat, target, negation, report. Five small transducers read a clause:
whether it insults, threatens, names a target, whether insult or threat stands in
the scope of a negation, and whether somebody's speech is reported. Their product is
one transition table; its final state is the kind of the clause. A document's score is
a logistic function of how many clauses of each kind it has and of the strongest insult.

Learned from labels: the insult list and the weights of the kinds, on a bounded
sample (``SAMPLE`` rows of each label, in hash order) of labelled rows that are not
held out. A beginning or word is taken if it is far likelier in toxic texts and in so
many of them that chance is no explanation; near-copies of one text count once. A row is held out if crc32 of its doc_id as text
leaves 1 modulo 3.

Only the text enters a score. Null and empty texts have no clauses and get the
score of none. Without usable labels nothing is an insult and every score is 0.
Repeated rows are scored each; a doc_id with several labels counts as toxic if one says so; null doc_id is not held out.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewrack.llm.common import durable
from tidewrack.llm.near_dedup import shingles, signature

#: Toxic and other rows that are learned from; least weight of a pattern, share of toxic rows it needs, letters of a beginning.
SAMPLE, LEAST_WEIGHT, LEAST_SHARE, LETTERS = {1: 2500, 0: 6000}, 3.0, 0.005, (3, 12)
#: Expected number of useless patterns that pass, over some million looked at.
CHANCE = 1e-6
THRESHOLD = 0.7
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
WORDS = {
    THREAT: "kill killing hurt destroy beat shoot stab burn töten umbringen schlagen verletzen tuer tuerai frapper détruire blesser matar matarte golpear destruir herir",
    TARGET: "you your yourself u he she they him her them du dich dir ihr euch sie er tu toi vous te il elle ils elles tú ti usted ustedes él ella ellos",
    NEGATION: "not no never neither nor isn aren wasn don doesn didn won nicht kein keine keinen nie niemals ne pas non jamais aucun nunca ni jamás ningún tampoco",
    REPORT: "said says say told called calls wrote claimed claims quoted sagte sagt sagten nannte schrieb behauptet dit disait appelé écrit affirme dijo dice llamó escribió afirma",
}
KINDS = ("insult", "insult at a target", "negated insult", "reported insult", "threat", "negated threat", "reported threat")
_CLAUSE = re.compile(r"[^.!?;:\n]+")
_WORD = re.compile(r"[^\W_]+")
KEPT_WORDS = 400_000


def _machines() -> list[tuple[list, object]]:
    """States and transition of each transducer; a negation reaches over the next three words."""
    once = lambda cls: ([0, 1], lambda s, c: 1 if c == cls else s)
    hit = (INSULT, THREAT)

    def negation(s: int, c: int) -> int:
        if s == 4 or (s > 0 and c in hit):
            return 4
        return 3 if c == NEGATION else max(0, s - 1)

    return [once(INSULT), once(THREAT), once(TARGET), (list(range(5)), negation), once(REPORT)]


def grammar() -> tuple[np.ndarray, np.ndarray]:
    """Transition table [state, class] of the product, and the kind of each final state (-1: none)."""
    machines = _machines()
    states = list(product(*[m[0] for m in machines]))
    number = {s: k for k, s in enumerate(states)}
    table = np.array([[number[tuple(m[1](x, c) for m, x in zip(machines, s))] for c in range(6)] for s in states])
    kind = []
    for insult, threat, target, negated, reported in states:
        threatens = threat and target
        if not (insult or threatens):
            kind.append(-1)
        elif negated == 4:
            kind.append(2 if insult else 5)
        elif reported:
            kind.append(3 if insult else 6)
        else:
            kind.append((1 if target else 0) if insult else 4)
    return table, np.array(kind)


@dataclass
class Model:
    """Learned insults (word or beginning -> weight) and the coefficients of the kinds."""

    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    coefficients: list[float] = field(default_factory=list)


class Scorer:
    """Features of texts under a model."""

    def __init__(self, model: Model):
        self.model = model
        self.table, self.kind = (x.tolist() for x in grammar())
        self.fixed = {w: c for c, ws in WORDS.items() for w in ws.split()}
        self.longest = max(map(len, model.beginnings), default=0)
        self.kept: dict[str, tuple[int, float]] = {}

    def _class(self, word: str) -> tuple[int, float]:
        found = self.model.words.get(word, 0.0)
        for k in range(LETTERS[0], min(len(word), self.longest) + 1):
            found = max(found, self.model.beginnings.get(word[:k], 0.0))
        return (INSULT, found) if found else (self.fixed.get(word, OTHER), 0.0)

    def features(self, text: str) -> list[float]:
        """log(1 + clauses) of each kind, and the strongest insult."""
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        counts, strongest = [0] * len(KINDS), 0.0
        kept, table = self.kept, self.table
        for clause in _CLAUSE.findall(text.lower()):
            words = _WORD.findall(clause)
            classes = list(map(kept.get, words))
            if None in classes:
                for k, c in enumerate(classes):
                    if c is None:
                        classes[k] = kept[words[k]] = self._class(words[k])
            state, matched = 0, False
            for c, weight in classes:
                if c:
                    if c <= THREAT:
                        matched = True
                        strongest = max(strongest, weight)
                state = table[state][c]
            if matched and self.kind[state] >= 0:
                counts[self.kind[state]] += 1
        return [*np.log1p(counts).tolist(), strongest]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(toxic, text): distinct texts of a bounded sample of labelled rows that are not held out."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic"))
    parts = [usable.where(F.col("toxic") == v).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE[v]) for v in (0, 1)]
    chosen = F.broadcast(parts[0].unionAll(parts[1]))  # no more rows than SAMPLE says, of two numbers
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(text, F.lit("")).alias("text")).join(chosen, "_id").select("toxic", "text")
    return durable(rows.groupBy(F.xxhash64("text").alias("h")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")))


def _patterns(text: str) -> set[str]:
    """Words (marked by a blank) and beginnings of words."""
    words = set(_WORD.findall(text.lower()))
    return {w[:k] for w in words for k in range(LETTERS[0], min(len(w), LETTERS[1]) + 1)} | {w + " " for w in words if len(w) <= 40}


def learn_words(sample: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Words and beginnings with their weights (log likelihood ratio)."""
    totals = {bool(r.toxic): r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = totals.get(True, 0), totals.get(False, 0)
    if not n_toxic or not n_clean:
        return {}, {}
    # So many families that no pattern without bearing on the label is expected to be in toxic texts alone.
    least = max(LEAST_SHARE * n_toxic, -log(CHANCE) / -log(n_toxic / (n_toxic + n_clean)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for p in _patterns(text):
                    found[p][bool(toxic)] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array([v[1] for v in found.values()], pa.int64()), pa.array([v[0] for v in found.values()], pa.int64())], names=["p", "t", "c"])

    weight = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1))
    counted = sample.select("toxic", "text").mapInArrow(count, "p string, t long, c long").groupBy("p").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    candidates = {r.p: r.c for r in counted.where((F.col("t") >= least) & (weight >= LEAST_WEIGHT)).collect()}  # bounded by the sample
    toxic = sample.where("toxic = 1").select("text").orderBy("h").toLocalIterator()
    families, holds = Families(), defaultdict(set)
    for r in toxic:
        family = families.of(r.text)
        for p in _patterns(r.text) & candidates.keys():
            holds[p].add(family)
    seen = {p: len({families.find(f) for f in fs}) for p, fs in holds.items()}
    good = {p: log((n + 0.5) / (families.count() + 1)) - log((candidates[p] + 0.5) / (n_clean + 1)) for p, n in seen.items() if n >= least}
    # A beginning gives way to a longer one, or a word, that stands for nine tenths of it.
    kept = {p: w for p, w in good.items() if w >= LEAST_WEIGHT}
    for p in sorted(kept, key=len, reverse=True):
        if p[-1] != " " and any(q != p and q.startswith(p) and seen[q] >= 0.9 * seen[p] for q in kept):
            del kept[p]
    return {p.rstrip(): w for p, w in kept.items() if p[-1] == " "}, {p: w for p, w in kept.items() if p[-1] != " "}


class Families:
    """Near-copies among the sampled texts, told by equal bands of their MinHash; a family counts once."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.bands: dict[tuple[int, bytes], int] = {}

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def of(self, text: str) -> int:
        new = len(self.parent)
        self.parent.append(new)
        found = shingles(text)
        if len(found):
            sig = signature(found)
            for k in range(0, len(sig), 4):
                other = self.bands.setdefault((k, sig[k:k + 4].tobytes()), new)
                self.parent[self.find(new)] = self.find(other)
        return new

    def count(self) -> int:
        return len({self.find(x) for x in range(len(self.parent))})


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, list[float]]:
    """Logistic regression by Newton steps; coefficients of clause kinds are not negative."""
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        penalty = np.r_[1e-6, np.full(x.shape[1], ridge)]
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
        w += np.clip(step, -3, 3)
        w[1:] = np.maximum(w[1:], 0)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), w[1:].tolist()


def _features(text: Column, model: Model) -> Column:
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model)
        for batch in batches:
            yield pa.array([scorer.features(t) for t in batch.to_pylist()], pa.list_(pa.float64()))

    return run(F.coalesce(text, F.lit("")))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    sample = labelled_sample(docs, labels, doc_id, text)
    words, beginnings = learn_words(sample)
    model = Model(words, beginnings)
    rows = sample.select("toxic", _features(F.col("text"), model).alias("x")).orderBy("h").collect()  # bounded by the sample
    y = np.array([float(r.toxic) for r in rows])
    if not model.words and not model.beginnings or len(set(y.tolist())) < 2:
        return Model()
    model.bias, model.coefficients = fit_weights(np.array([r.x for r in rows]), y)
    return model


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    found = docs.select(F.col(doc_id).alias("doc_id"), _features(F.col(text), model).alias("x"))
    total = F.lit(model.bias)
    for k, c in enumerate(model.coefficients):
        total = total + F.col("x")[k] * F.lit(c)
    value = 1 / (1 + F.exp(-total)) if model.coefficients else F.lit(0.0)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), value.alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
