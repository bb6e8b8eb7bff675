"""Language identification by error-correcting output codes.

Every language gets a codeword; each bit is predicted by a binary classifier
over hashed byte n-grams (the log ratio of the n-gram distributions of the
languages with that bit and of those without). A text's bit margins are
decoded to the codeword of least logistic loss, each bit weighted by how well
it separates the training languages; a runner-up close behind flags the text
as ambiguous.

Training reads every training row: tasks count n-grams per language and one
sum by (language, bin) merges the counts, ``BINS`` numbers per language. The
weights (bins x bits) are all that is broadcast.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
so is every text if there is nothing to learn from. Rows with a null text or
lang teach nothing; repeated rows teach as often as they occur.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import keyed_texts, slices

BINS = 1 << 13
GRAMS = (1, 2, 3, 4)
BLOCK = 1 << 20
#: two codewords whose losses differ by less are told apart by luck
NEAR = 0.5
#: the multiplier that spreads n-grams over the bins, and a step per n-gram length
SPREAD, STEP = np.uint32(2654435761), np.uint32(40503)


def _fold() -> np.ndarray:
    """Byte classes: letters lower-cased, other ASCII as a space, the rest as they are."""
    t = np.arange(256, dtype=np.uint8)
    t[:128] = 32
    for c in range(26):
        t[97 + c] = t[65 + c] = 97 + c
    return t


FOLD = _fold()


def features(text: bytes) -> np.ndarray:
    """Counts of a text's hashed byte n-grams, over ``BINS`` bins."""
    out = np.zeros(BINS, np.float32)
    reach = max(GRAMS) - 1
    for at in range(0, len(text), BLOCK):
        lead = min(reach, at)
        raw = FOLD[np.frombuffer(text, np.uint8, min(BLOCK, len(text) - at) + lead, at - lead)].astype(np.uint32)
        code = np.zeros(len(raw), np.uint32)
        for n in range(1, reach + 2):
            code = raw[n - 1:] | (code[:len(raw) - n + 1] << np.uint32(8)) if n > 1 else raw
            if n in GRAMS and len(code):
                new = code[max(0, lead - n + 1):] if at else code
                h = (new * SPREAD + np.uint32(n) * STEP) * SPREAD >> np.uint32(32 - int(math.log2(BINS)))
                out += np.bincount(h, minlength=BINS).astype(np.float32)
    return out


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """(n, bits) of -1/+1: all splits into two for up to six languages, else the
    best spread of several random codes of about 10 log2 n bits."""
    if n <= 6:
        cols = [[1 if i == 0 or i in pick else -1 for i in range(n)]
                for k in range(n - 1) for pick in combinations(range(1, n), k)]
        return np.array(cols, np.int8).T.reshape(n, -1)
    rng, best, apart = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, math.ceil(10 * math.log2(n))))
        code = code[:, np.abs(code.sum(0)) < n]
        gap = min((code[a] != code[b]).sum() for a, b in combinations(range(n), 2))
        if gap > apart:
            best, apart = code, gap
    return best


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, bin, n) summed over all rows (text, lang)."""
    def run(batches):
        held: dict[str, np.ndarray] = {}

        def flush():
            for lang, v in held.items():
                at = np.flatnonzero(v)
                yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()),
                                       pa.array(v[at].astype(np.float64))], names=["lang", "bin", "n"])
            held.clear()

        for b in slices(batches):
            for text, lang in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("lang").to_pylist()):
                if lang not in held:
                    if len(held) >= 64:
                        yield from flush()
                    held[lang] = np.zeros(BINS)
                held[lang] += features(text)
        yield from flush()
    return (rows.mapInArrow(run, "lang string, bin int, n double")
            .groupBy("lang", "bin").agg(F.sum("n").alias("n")))


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray):
        """``counts`` (languages, bins)."""
        self.langs = langs
        self.code = codewords(len(langs)) if langs else np.zeros((0, 0), np.int8)
        share = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BINS)
        one, zero = self.code == 1, self.code == -1
        bits = self.code.shape[1]
        self.weights = np.zeros((BINS, bits), np.float32)
        self.bit_weight = np.ones(bits)
        for b in range(bits):
            p, q = share[one[:, b]].mean(0), share[zero[:, b]].mean(0)
            self.weights[:, b] = np.log(p / q)
            # mean margin of the languages on their own side: what an average n-gram tells about this bit
            self.bit_weight[b] = max(1e-3, float((share @ self.weights[:, b] * self.code[:, b]).min()))
        if bits:
            self.bit_weight /= self.bit_weight.mean()

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, score, ambiguous) of each row of n-gram counts."""
        n = np.maximum(1.0, counts.sum(1, keepdims=True))
        z = counts @ self.weights / np.sqrt(n)
        loss = np.logaddexp(0, -z[:, None, :] * self.code[None]) @ self.bit_weight
        if loss.shape[1] == 1:
            return np.zeros(len(z), int), np.ones(len(z)), np.zeros(len(z), bool)
        best = loss.argmin(1)
        low = loss.min(1, keepdims=True)
        score = 1 / np.exp(low - loss).sum(1)
        gap = np.partition(loss, 1, axis=1)
        return best, score, gap[:, 1] - gap[:, 0] < NEAR


def train(rows: DataFrame) -> Model:
    """Fit on all rows (text, lang); rows with a null in either teach nothing."""
    got = count_grams(rows.where("text is not null and lang is not null")).toPandas()
    langs = sorted(got["lang"].unique())
    counts = np.zeros((len(langs), BINS))
    counts[[langs.index(x) for x in got["lang"]], got["bin"].to_numpy(int)] = got["n"]
    return Model(langs, counts)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) for every row, from the text alone."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import regex
        letter, m = regex.compile(r"\p{L}"), held.value
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            known = [k for k, t in enumerate(texts) if m.langs and t and letter.search(t)]
            lang, score, near = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            if known:
                best, s, a = m.predict(np.array([features(texts[k].encode()) for k in known]))
                score[known], near[known] = s, a
                for k, i in zip(known, best.tolist()):
                    lang[k] = m.langs[i]
            yield pa.record_batch([b.column("doc_id"), pa.array(lang), pa.array(score), pa.array(near)],
                                  names=["doc_id", "lang_pred", "score", "ambiguous"])
    return keyed_texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def train_and_identify(docs: DataFrame, is_training: Column) -> DataFrame:
    """Learn from the rows of ``docs`` where ``is_training`` holds, predict all."""
    teach = keyed_texts(docs, "lang").where(is_training).select("text", F.col("lang").cast("string").alias("lang"))
    return identify(docs, train(teach))
