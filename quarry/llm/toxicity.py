"""Toxicity by weak supervision.

Many voters - lexicon words and word beginnings mined from labelled training
rows, and a few fixed patterns - vote on a document or abstain. A generative
label model treats the votes as class-conditional with a shared covariance:
class means hold the voters' accuracies, the covariance their correlations,
so that voters that fire together count as one. It is fitted by expectation
maximisation with the given label as one more voter of accuracy ``TRUST``. A
linear (logistic) classifier over the votes is trained on the posterior
labels and scores every document.

Voters and model are fitted on a bounded sample of labelled texts: the
``SAMPLE`` ids of each class with the least hash and of their different texts the
``SAMPLE`` of each class with the least hash, one row each however often an id, a
label or a text is repeated. The sample's ids (at most 2 x SAMPLE) are broadcast,
and its vote matrix is collected (2 x SAMPLE x VOTERS bits). Label model and classifier weight a class's sampled rows
so that the classes have the shares they have among all training labels: the
cap doesn't move the prior, and ``THRESHOLD`` means the same on tables of any
size. All documents are scored whole.

Defined cases: null and empty texts get the score of a document on which all
voters abstain; without labelled rows of both classes every score is the
share of toxic rows (0 without any); repeated rows get a row each; rows with a
null label or id teach nothing.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import keyed_texts, slices, stage
from quarry.session import ship_package

SAMPLE = 10_000
VOTERS = 320
TRUST = 0.95
THRESHOLD = 0.3
#: lengths of the word beginnings that are tried as voters; one votes where at
#: least two words and DENSE of all words of a text begin so
PREFIXES = range(3, 9)
DENSE = 0.004
#: likelihood-ratio gain (nats) a term needs: log of some millions of tried terms
GAIN = 14.0
#: shares of a text's words that are lexicon words or beginnings, from which on a density voter fires
DENSITIES = (0.002, 0.005, 0.008, 0.011, 0.015, 0.02, 0.03)
WORD = re.compile(r"[^\W\d_]+")
PATTERNS = {
    "shouting": re.compile(r"!{3,}"),
    "capitals": re.compile(r"\b[A-Z]{4,}\b(?:\W+\b[A-Z]{4,}\b){2}"),
    "masked": re.compile(r"\b\w+[*#@$]{2,}\w*"),
    "stretched": re.compile(r"(\w)\1{4,}"),
}


def terms(text: str) -> list[str]:
    """Words of a text and, marked ``~``, the beginnings many of its words share."""
    words = Counter(WORD.findall(text.lower()))
    least = max(2.0, DENSE * words.total())
    out = list(words)
    for size in PREFIXES:
        begins: Counter = Counter()
        for w, n in words.items():
            if len(w) > size:
                begins[w[:size]] += n
        out += ["~" + p for p, n in begins.items() if n >= least]
    return out


class Voters:
    """The chosen terms, the densities and the fixed patterns, as columns of a vote matrix."""

    def __init__(self, chosen: list[str]):
        self.words = {t: k for k, t in enumerate(chosen) if t[0] != "~"}
        self.begins = {t[1:]: k for k, t in enumerate(chosen) if t[0] == "~"}
        self.short = min(PREFIXES)
        self.gate: dict[str, list[str]] = {}
        for p in self.begins:
            self.gate.setdefault(p[:self.short], []).append(p)
        self.patterns = list(PATTERNS.values())
        self.dense = len(chosen)
        self.size = len(chosen) + len(DENSITIES) + len(self.patterns)

    def votes(self, text: str) -> list[int]:
        """Columns that fire on a text."""
        words = Counter(WORD.findall(text.lower()))
        total = max(1, words.total())
        out = [self.words[w] for w in self.words.keys() & words.keys()]
        begins: Counter = Counter()
        hits = 0
        for w, n in words.items():
            met = [p for p in self.gate.get(w[:self.short], ()) if len(w) > len(p) and w.startswith(p)]
            for p in met:
                begins[p] += n
            if met or w in self.words:
                hits += n
        out += [self.begins[p] for p, n in begins.items() if n >= max(2.0, DENSE * total)]
        out += [self.dense + k for k, share in enumerate(DENSITIES) if hits >= share * total and hits]
        first = self.dense + len(DENSITIES)
        return out + [first + k for k, p in enumerate(self.patterns) if p.search(text)]


def mine_voters(sample: DataFrame, size: int = VOTERS) -> list[str]:
    """The ``size`` terms of (text, toxic) whose document frequency tells most
    for class 1: a likelihood-ratio gain of at least ``GAIN`` and odds of at
    least 8 to 1 over the classes' shares."""
    def run(batches):
        held: Counter = Counter()
        for b in slices(batches):
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                held.update([(t, toxic) for t in terms(text or "")])
            if len(held) > 200_000:
                yield from _rows(held)
        yield from _rows(held)

    def _rows(held):
        if held:
            yield pa.record_batch([pa.array([t for t, _ in held], pa.string()),
                                   pa.array([n if y else 0 for (_, y), n in held.items()], pa.int64()),
                                   pa.array([0 if y else n for (_, y), n in held.items()], pa.int64())],
                                  names=["term", "bad", "good"])
        held.clear()

    total = sample.groupBy("toxic").count().collect()
    n1 = sum(r["count"] for r in total if r["toxic"] == 1)
    n0 = sum(r["count"] for r in total if r["toxic"] == 0)
    if not n1 or not n0:
        return []
    p1, p0 = (F.col("bad") + 0.5) / (n1 + 1), (F.col("good") + 0.5) / (n0 + 1)
    both = (F.col("bad") + F.col("good") + 1) / (n1 + n0 + 2)
    gain = (F.col("bad") * F.log(p1 / both) + F.col("good") * F.log(p0 / both)
            + (n1 - F.col("bad")) * F.log((1 - p1) / (1 - both)) + (n0 - F.col("good")) * F.log((1 - p0) / (1 - both)))
    best = (sample.mapInArrow(run, "term string, bad long, good long")
            .groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
            .where(p1 >= 8 * p0).withColumn("gain", gain).where(F.col("gain") >= GAIN)
            .orderBy(F.desc("gain"), "term").limit(size).collect())
    return [r["term"] for r in best]


def label_model(votes: np.ndarray, label: np.ndarray, rounds: int = 12, weight: np.ndarray | None = None) -> np.ndarray:
    """Posterior of class 1 for each row of a 0/1 vote matrix and a noisy label;
    a row counts ``weight`` times (default: once)."""
    weight = np.ones(len(votes)) if weight is None else weight
    n = weight.sum()
    told = np.where(label == 1, TRUST, 1 - TRUST)
    post = told.copy()
    second = (votes.T * weight) @ votes / n
    for _ in range(rounds):
        w1, w0 = weight @ post, weight @ (1 - post)
        m1 = ((weight * post) @ votes + 0.01) / (w1 + 0.02)
        m0 = ((weight * (1 - post)) @ votes + 0.01) / (w0 + 0.02)
        # shared covariance: what is left of the votes when the class means are gone
        mix = w1 / n
        cov = second - mix * np.outer(m1, m1) - (1 - mix) * np.outer(m0, m0)
        cov += np.diag(0.02 + 0.1 * np.diag(cov).clip(0))
        w = np.linalg.solve(cov, m1 - m0)
        side = votes @ w - (m1 + m0) @ w / 2
        odds = np.clip(side, -8, 8) + np.log(w1 / w0) + np.log(told / (1 - told))
        new = 1 / (1 + np.exp(-odds))
        if np.abs(new - post).max() < 1e-4:
            return new
        post = new
    return post


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 25, weight: np.ndarray | None = None) -> np.ndarray:
    """Logistic weights (bias last) for soft labels, by Newton steps; a row
    counts ``weight`` times (default: once)."""
    weight = np.ones(len(x)) if weight is None else weight
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ x + np.diag(keep),
                               x.T @ (weight * (p - y)) + keep * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    def __init__(self, voters: Voters, weights: np.ndarray):
        self.voters, self.weights = voters, weights

    def score(self, text: str | None) -> float:
        fired = self.voters.votes(text) if text else []
        z = float(self.weights[-1] + self.weights[fired].sum())
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, is_training: Column, sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of the rows of ``labels`` (doc_id, toxic) where
    ``is_training`` (over doc_id) holds and of their texts in ``docs``."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where("doc_id is not null and toxic in (0, 1)").where(is_training).distinct())
    ids = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    picked = ids[0].union(ids[1])  # at most 2 x sample rows of two numbers
    every = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    texts = keyed_texts(docs).withColumn("mark", F.xxhash64("text"))
    marks = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "mark", "toxic").distinct()
    once = [marks.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id", "mark"), "doc_id", "mark").limit(sample) for y in (0, 1)]
    rows = stage(texts.join(F.broadcast(once[0].union(once[1])), ["doc_id", "mark"]).groupBy("doc_id", "mark", "toxic")
                 .agg(F.min("text").alias("text")).select("text", "toxic"), "toxicity-sample")
    chosen = mine_voters(rows)
    voters = Voters(chosen)

    def run(batches):
        for b in slices(batches):
            yield pa.record_batch([b.column("toxic"), pa.array([voters.votes(t or "") for t in b.column("text").to_pylist()],
                                                               pa.list_(pa.int32()))], names=["toxic", "fired"])
    got = rows.mapInArrow(run, "toxic int, fired array<int>").collect()
    label = np.array([r["toxic"] for r in got], float)
    weights = np.zeros(voters.size + 1)
    if len(got) and 0 < label.sum() < len(label):
        order = np.argsort([hash((r["toxic"], tuple(sorted(r["fired"])))) for r in got], kind="stable")
        votes = np.zeros((len(got), voters.size))
        for k, i in enumerate(order):
            votes[k, got[i]["fired"]] = 1
        # labels that a sampled row stands for
        weight = np.where(label[order] == 1, every[1] / label.sum(), every[0] / (len(label) - label.sum()))
        weight *= len(weight) / weight.sum()
        weights = fit_linear(votes, label_model(votes, label[order], weight=weight), weight=weight)
    else:
        share = label.mean() if len(label) else 0.0
        weights[-1] = 30 if share else -30
    return Model(voters, weights)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for b in slices(batches):
            yield pa.record_batch([b.column("doc_id"), pa.array([m.score(t) for t in b.column("text").to_pylist()],
                                                                pa.float64())], names=["doc_id", "score"])
    return keyed_texts(docs).mapInArrow(run, "doc_id long, score double")


def keep_civil(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores below ``threshold``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    ship_package(docs.sparkSession)

    def run(batches):
        m = held.value
        for b in slices(batches):
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            yield b.filter(pa.array([m.score(t) < threshold for t in texts], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
