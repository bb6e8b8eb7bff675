"""Document likelihood over a lattice of subword segmentations.

A token (a white-space free word, or the end of a document) is generated
either whole, with the discounted share of its count in the training texts,
or piece by piece from an existing subword vocabulary; its probability is the
sum over all these ways:

    p(t) = max(c(t) - d, 0) / N + (d V / N) * sum over segmentations of prod p(piece)

The inner sum is the log-space forward recursion over the word's bytes (with a
leading space). Piece scores start from the vocabulary's ranks (Zipf's law) and
are re-estimated by expectation maximisation over the distinct training words.

How it runs: texts are packed into chunk rows of about ``CHUNK`` bytes and
written once. Each chunk asks for its distinct words, dealt by a word hash into
buckets; a bucket merges the training counts of its words, runs the recursion
once per distinct word, for many words in step, and answers every chunk;
answers meet their chunk again in a join on the chunk number that doesn't
move the texts. So no task holds
more than a bucket's words or a chunk, the vocabulary is never broadcast, and a
frequent word crosses the exchange once per chunk only. What the driver sees is
the expected count of each vocabulary piece.

Defined cases: null and empty texts hold the end token only; without training
texts every token is scored by pieces alone (count 0, base score 0); words
of any length and bytes are scored; repeated rows each count and get a row; a
null doc_id gets a row.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bucketed, buckets_of, keyed_texts, slices, stage

CHUNK = 2 << 20
DISCOUNT = 0.75
ROUNDS = 2
#: words up to this many bytes go in step as rows of a matrix, longer ones one by one, by the same recursions
WIDE = 48
#: words of one length that are scored in step
PART = 5_000
BASE = np.uint64(0x9E3779B97F4A7C15)
LOG10 = math.log(10)


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def load_pieces(path: str | None = None) -> list[bytes]:
    """Pieces of a rank file, by rank: those a word with one leading space can hold."""
    import base64
    with open(path or default_path(), "rb") as f:
        ranks = sorted((int(r), base64.b64decode(p)) for p, r in map(bytes.split, f))
    return [p for _, p in ranks if b" " not in p[1:]]


class Lattice:
    """Forward and backward recursions of words over scored pieces."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.pieces, self.logp = pieces, logp
        self.by_text = {p: k for k, p in enumerate(pieces)}
        key = np.array([self._hash(p) for p in pieces], np.uint64)
        order = np.argsort(key)
        self.keys, self.ids = key[order], order
        self.sizes = sorted({len(p) for p in pieces}, reverse=True)  # the piece lengths that there are
        self.powers = {n: np.uint64(pow(int(BASE), n, 1 << 64)) for n in self.sizes}

    @staticmethod
    def _hash(p: bytes) -> int:
        h = 0
        for c in p:
            h = (h * int(BASE) + c + 1) & ((1 << 64) - 1)
        return h

    def arcs(self, words: np.ndarray) -> list[list[tuple[int, np.ndarray]]]:
        """For rows of bytes of one length: for each end position, (start, piece
        of each row or -1) of the arcs that any row has."""
        n, size = words.shape
        h = np.zeros((size + 1, n), np.uint64)
        for i in range(size):
            h[i + 1] = h[i] * BASE + words[:, i].astype(np.uint64) + np.uint64(1)
        out = []
        for end in range(1, size + 1):
            here = []
            for length in self.sizes:
                if length > end:
                    continue
                at = end - length
                key = h[end] - h[at] * self.powers[length]
                pos = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[pos] == key
                if hit.any():
                    here.append((at, np.where(hit, self.ids[pos], -1)))
            out.append(here)
        return out

    def forward(self, words: np.ndarray, arcs) -> np.ndarray:
        logp = np.append(self.logp, -np.inf)
        alpha = np.full((words.shape[1] + 1, len(words)), -np.inf)
        alpha[0] = 0
        for end, here in enumerate(arcs, 1):
            for at, piece in here:
                np.logaddexp(alpha[end], alpha[at] + logp[piece], out=alpha[end])
        return alpha

    def expected(self, words: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, summed over the rows."""
        arcs = self.arcs(words)
        alpha = self.forward(words, arcs)
        logp = np.append(self.logp, -np.inf)
        beta = np.full_like(alpha, -np.inf)
        beta[-1] = 0
        out = np.zeros(len(self.pieces) + 1)
        for end in range(len(arcs), 0, -1):
            for at, piece in arcs[end - 1]:
                step = logp[piece] + beta[end]
                np.logaddexp(beta[at], step, out=beta[at])
        for end, here in enumerate(arcs, 1):
            for at, piece in here:
                use = np.exp(alpha[at] + logp[piece] + beta[end] - alpha[-1])
                out += np.bincount(np.where(piece < 0, len(self.pieces), piece), use, len(out))
        return out[:-1]

    def _forward_long(self, word: bytes) -> list[float]:
        alpha = [0.0]
        for end in range(1, len(word) + 1):
            terms = [alpha[end - size] + self.logp[k] for size in self.sizes
                     if size <= end and (k := self.by_text.get(word[end - size:end])) is not None]
            top = max(terms)
            alpha.append(top + math.log(sum(math.exp(t - top) for t in terms)))
        return alpha

    def score_long(self, word: bytes) -> float:
        """Log probability of one word, by the same recursion."""
        return self._forward_long(word)[-1]

    def expected_long(self, word: bytes) -> np.ndarray:
        """Expected uses of each piece in one word, by the same recursions."""
        alpha, n = self._forward_long(word), len(word)
        beta = [-math.inf] * n + [0.0]
        out = np.zeros(len(self.pieces))
        for at in range(n - 1, -1, -1):
            arcs = [(k, self.logp[k] + beta[at + size]) for size in self.sizes
                    if size <= n - at and (k := self.by_text.get(word[at:at + size])) is not None]
            top = max(x for _, x in arcs)
            beta[at] = top + math.log(sum(math.exp(x - top) for _, x in arcs))
            for k, x in arcs:
                out[k] += math.exp(alpha[at] + x - alpha[n])
        return out

    @staticmethod
    def _grouped(words: list[bytes]):
        """(positions, byte matrix) of words of one length with their leading space."""
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_size.setdefault(len(w), []).append(k)
        for size, at in by_size.items():
            if size <= WIDE:
                for lo in range(0, len(at), PART):
                    some = at[lo:lo + PART]
                    raw = b"".join([b" " + words[k] for k in some])
                    yield some, np.frombuffer(raw, np.uint8).reshape(len(some), size + 1)
            else:
                for k in at:
                    yield [k], None

    def log_probs(self, words: list[bytes]) -> np.ndarray:
        """Marginal log probability of each word over all its segmentations."""
        out = np.zeros(len(words))
        for at, m in self._grouped(words):
            out[at] = self.score_long(b" " + words[at[0]]) if m is None else self.forward(m, self.arcs(m))[-1]
        return out

    def expectations(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros(len(self.pieces))
        for at, m in self._grouped(words):
            out += self.expected(m) if m is not None else self.expected_long(b" " + words[at[0]])
        return out


def chunked(docs: DataFrame, is_training: Column) -> DataFrame:
    """(chunk, doc_ids, train, texts): rows of about CHUNK bytes of text, written once, bucketed by chunk."""
    def run(batches):
        held, size, n = [], 0, 0
        part = TaskContext.get().partitionId()

        def pack():
            ids, train, texts = zip(*held)
            return pa.record_batch([pa.array([(part << 32) + n], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                                    pa.array([train], pa.list_(pa.bool_())), pa.array([texts], pa.list_(pa.binary()))],
                                   names=["chunk", "doc_ids", "train", "texts"])
        for b in slices(batches):
            rows = zip(b.column("doc_id").to_pylist(), b.column("train").to_pylist(),
                       b.column("text").cast(pa.binary()).to_pylist())
            for i, train, text in rows:
                held.append((i, bool(train), text or b""))
                size += len(text or b"") + 16
                if size >= CHUNK:
                    yield pack()
                    held, size, n = [], 0, n + 1
        if held:
            yield pack()
    rows = keyed_texts(docs).withColumn("train", is_training)
    return bucketed(rows.mapInArrow(run, "chunk long, doc_ids array<long>, train array<boolean>, texts array<binary>"), "chunk")


def by_bucket(words: set[bytes], n: int) -> dict[int, list[bytes]]:
    """Distinct words dealt by their hash, sorted in each bucket."""
    out: dict[int, list[bytes]] = {}
    for w in words:
        out.setdefault(zlib.crc32(w) % n, []).append(w)
    return {k: sorted(v) for k, v in out.items()}


def requests(chunks: DataFrame, buckets: int) -> DataFrame:
    """(chunk, bucket, words, counts): a chunk's distinct words and their training counts."""
    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                chunk, train, texts = (b.column(c)[r].as_py() for c in ("chunk", "train", "texts"))
                seen, other = Counter(), set()
                for t, text in zip(train, texts):
                    (seen if t else other).update(text.lower().split())
                parts = by_bucket(other.union(seen), buckets)
                yield pa.record_batch([pa.array([chunk] * len(parts), pa.int64()), pa.array(list(parts), pa.int32()),
                                       pa.array([b"\n".join(w) for w in parts.values()], pa.binary()),
                                       pa.array([np.array([seen[x] for x in w], np.uint32).tobytes()
                                                 for w in parts.values()], pa.binary())],
                                      names=["chunk", "bucket", "words", "counts"])
    return stage(chunks.select("chunk", "train", "texts").mapInArrow(
        run, "chunk long, bucket int, words binary, counts binary"), "requests")


def _merged(group: pd.DataFrame) -> dict[bytes, int]:
    total: dict[bytes, int] = {}
    for words, counts in zip(group["words"], group["counts"]):
        for w, c in zip(words.split(b"\n"), np.frombuffer(counts, np.uint32).tolist()):
            total[w] = total.get(w, 0) + c
    return total


def vocabulary(asked: DataFrame) -> DataFrame:
    """(bucket, words, n_tokens, n_types): the training words of each bucket."""
    def run(key, group):
        known = {w: c for w, c in _merged(group).items() if c}
        return pd.DataFrame({"bucket": [key[0]], "words": [b"\n".join(known)], "n_tokens": [sum(known.values())],
                             "n_types": [len(known)]})
    return stage(asked.groupBy("bucket").applyInPandas(run, "bucket int, words binary, n_tokens long, n_types long"), "vocab")


def train_pieces(vocab: DataFrame, pieces: list[bytes], ends: int, rounds: int = ROUNDS) -> np.ndarray:
    """Log probability of each piece; ``ends`` ends share the mass with them."""
    logp = -np.log(np.arange(len(pieces)) + 2.0)
    logp -= np.logaddexp.reduce(logp)
    sc = vocab.sparkSession.sparkContext
    for _ in range(rounds):
        held = sc.broadcast((pieces, logp))

        def run(batches):
            lattice, out = Lattice(*held.value), np.zeros(len(pieces))
            for b in batches:
                for words in b.column("words").to_pylist():
                    if words:
                        out += lattice.expectations(words.split(b"\n"))
            at = np.flatnonzero(out)
            yield pa.record_batch([pa.array(at, pa.int32()), pa.array(out[at])], names=["piece", "uses"])
        got = (vocab.where("n_types > 0").select("words").mapInArrow(run, "piece int, uses double")
               .groupBy("piece").agg(F.sum("uses").alias("uses")).collect())  # one row per vocabulary piece at most
        uses = np.full(len(pieces), 1e-3)
        for r in got:
            uses[r["piece"]] += r["uses"]
        logp = np.log(uses) - math.log(uses.sum() + ends)
    return logp


def score_documents(docs: DataFrame, is_training: Column, path: str | None = None, rounds: int = ROUNDS,
                    discount: float = DISCOUNT) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every
    row; counts come from the rows where ``is_training`` holds."""
    spark = docs.sparkSession
    buckets = buckets_of(spark)
    chunks = chunked(docs, is_training)
    asked = requests(chunks, buckets)
    vocab = vocabulary(asked)
    sums = vocab.agg(F.sum("n_tokens").alias("n"), F.sum("n_types").alias("v")).first()
    ends = chunks.select(F.sum(F.size(F.filter("train", lambda t: t)))).first()[0] or 0
    n, v = (sums["n"] or 0) + ends, (sums["v"] or 0) + (ends > 0)
    pieces = load_pieces(path)
    held = spark.sparkContext.broadcast((pieces, train_pieces(vocab, pieces, ends, rounds)))
    back_off = discount * v / n if n else 1.0

    def answer(key, group):
        total = _merged(group)
        words = list(total)
        count = np.array(list(total.values()), np.int64)
        sub = Lattice(*held.value).log_probs(words) + math.log(back_off)
        whole = np.log(np.maximum(count - discount, 1e-300) / max(n, 1))
        score = np.where(count > 0, np.logaddexp(sub, whole), sub) / LOG10
        index = {w: k for k, w in enumerate(words)}
        out = []
        for chunk, asked_words in zip(group["chunk"], group["words"]):
            at = np.array([index[w] for w in asked_words.split(b"\n")])
            out.append((chunk, key[0], count[at].tobytes(), score[at].tobytes()))
        return pd.DataFrame(out, columns=["chunk", "bucket", "counts", "scores"])

    answers = (asked.groupBy("bucket").applyInPandas(answer, "chunk long, bucket int, counts binary, scores binary")
               .groupBy("chunk").agg(F.collect_list(F.struct("bucket", "counts", "scores")).alias("answers")))

    def run(batches):
        unseen = math.log10(n + v + 1)
        end_base = math.log10(ends + 1) - unseen
        end_score = math.log10(max(ends - discount, 1e-3) / n) if n else math.log10(0.5)
        for b in batches:
            for r in range(b.num_rows):
                ids, texts, got = (b.column(c)[r].as_py() for c in ("doc_ids", "texts", "answers"))
                split = [t.lower().split() for t in texts]
                parts = by_bucket({w for words in split for w in words}, buckets)
                index: dict[bytes, int] = {}
                counts, scores = [np.zeros(0, np.int64)], [np.zeros(0)]
                for a in got or []:
                    index.update(zip(parts[a["bucket"]], range(len(index), len(index) + len(parts[a["bucket"]]))))
                    counts.append(np.frombuffer(a["counts"], np.int64))
                    scores.append(np.frombuffer(a["scores"], np.float64))
                count, score = np.concatenate(counts), np.concatenate(scores)
                base = np.log10(count + 1) - unseen
                rows = []
                for words in split:
                    at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
                    rows.append((len(words) + 1, int((count[at] > 0).sum()) + (ends > 0),
                                 float(base[at].sum() + end_base), float(score[at].sum() + end_score)))
                k, known, bases, totals = zip(*rows)
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(k, pa.int64()), pa.array(known, pa.int64()),
                                       pa.array([n] * len(ids), pa.int64()), pa.array(bases, pa.float64()),
                                       pa.array(totals, pa.float64())],
                                      names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return (chunks.select("chunk", "doc_ids", "texts").join(answers, "chunk", "left")
            .select("doc_ids", "texts", "answers")
            .mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
