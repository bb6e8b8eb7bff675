"""BPE encoding and decoding: speculate and verify.

Words are proposed as greedy longest matches over the vocabulary; one
vectorised check then tests every adjacent token pair of all proposals
together, and only words with a pair that merging would never leave side by
side are merged exactly. A sequence of tokens that each encode to themselves
is the BPE encoding exactly when every adjacent pair is: the pair is checked
by undoing its merges from the seam outwards, latest first, and looking for a
merge across the seam that would have come earlier.

The file is that of a word-level BPE with an end-of-word suffix whose ids
follow the merge order (checked on loading). The driver reads it and
broadcasts its text, whose size is that of the vocabulary. Encodings are
memoised per white-space separated piece in a bounded table per worker.

Defined cases: a null or blank text has no tokens and decodes to ''; a text
of any length is processed whole; repeated rows and a null doc_id each get
their row.
"""

from __future__ import annotations

import heapq
import json
import struct
import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import keyed_texts, slices

SUFFIX = "</w>"
NONE = np.iinfo(np.int64).max
#: letters up to which words are merged as rows of a matrix
WIDE = 40
#: pieces remembered by a worker
MEMO = 500_000


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level BPE files."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    """One tokenizer file: encoding, decoding, and its memo."""

    def __init__(self, spec: str):
        import regex
        data = json.loads(spec)
        model = data["model"]
        self.vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.names = {i: s for s, i in (self.vocab | self.special).items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        base = len(self.vocab) - len(merges) - len([s for s in self.special if s in self.vocab])
        size = max(self.names) + 1
        self.left, self.right = np.arange(size), np.arange(size)
        self.merge: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            i = self.vocab[a + b]
            if i != base + rank:
                raise ValueError("token ids don't follow the merge order")
            x, y = self.vocab[a], self.vocab[b]
            self.left[i], self.right[i], self.merge[x, y] = x, y, i
        keys = np.array([x * size + y for x, y in self.merge], np.int64)
        order = np.argsort(keys)
        self.size, self.keys, self.made = size, keys[order], np.array(list(self.merge.values()))[order]
        self.letters = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})
        self.split = regex.compile(data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.odd = regex.compile("[\x1c-\x1f]")
        self.spaces = regex.compile(r"\s+")
        # tokens that merging reproduces from their own letters: what greedy matching may propose
        plain = [s for s in self.vocab if s not in self.special]
        self.own = {s: self.vocab[s] for s, got in zip(plain, self.exact_merges([self.symbols(s) for s in plain]))
                    if got == [self.vocab[s]]}
        self.longest = max(len(s.removesuffix(SUFFIX)) for s in self.own)
        self.reach: dict[str, int] = {}  # longest entry that goes on after these four letters
        for s in self.own:
            if len(s) >= 4 and not s.endswith(SUFFIX):
                self.reach[s[:4]] = max(self.reach.get(s[:4], 4), len(s))
        self.ids_of: dict[str, bytes] = {}
        self.text_of: dict[str, str] = {}

    def symbols(self, token: str) -> list[int]:
        """Ids of the letters of a vocabulary entry."""
        ends = token.endswith(SUFFIX) and len(token) > len(SUFFIX)
        s = token.removesuffix(SUFFIX) if ends else token
        ids = [self.vocab[c] for c in s]
        if ends:
            ids[-1] = self.vocab[s[-1] + SUFFIX]
        return ids

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that merging a and b makes, or NONE."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.made[at], NONE)

    def exact_merges(self, words: list[list[int]]) -> list[list[int]]:
        """Merge each word by rank, leftmost first, until no merge applies:
        words of up to ``WIDE`` letters in step as the rows of a matrix,
        longer ones one by one."""
        out: list = [self.exact_long(w) if len(w) > WIDE else None for w in words]
        short = sorted((k for k, w in enumerate(words) if len(w) <= WIDE), key=lambda k: len(words[k]))
        for at in range(0, len(short), 4096):
            rows = np.array(short[at:at + 4096])
            wide = max(2, len(words[rows[-1]]))
            ids = np.array([words[k] + [-1] * (wide - len(words[k])) for k in rows.tolist()], np.int64)
            made = self.ranks(ids[:, :-1], ids[:, 1:])
            col = np.arange(wide)
            while len(rows):
                j = made.argmin(1)
                best = made[np.arange(len(rows)), j]
                live = best < NONE
                for k, w in zip(rows[~live].tolist(), ids[~live].tolist()):
                    out[k] = [i for i in w if i >= 0]
                rows, ids, made, j, best = rows[live], ids[live], made[live], j[live], best[live]
                if not len(rows):
                    break
                n = np.arange(len(rows))
                shift = np.minimum(col + (col > j[:, None]), wide - 1)
                last = ids[:, -1].copy()
                ids = np.take_along_axis(ids, shift, 1)
                ids[:, -1] = np.where(j == wide - 2, -1, np.where(last >= 0, -1, ids[:, -1]))
                ids[n, j] = best
                made = np.take_along_axis(made, shift[:, :-1].clip(max=wide - 2), 1)
                made[:, -1] = NONE
                before, after = np.maximum(j - 1, 0), np.minimum(j + 1, wide - 1)
                made[n, j.clip(max=wide - 2)] = np.where(j < wide - 1, self.ranks(best, np.where(after > j, ids[n, after], -1)), NONE)
                made[n, before] = np.where(j > 0, self.ranks(ids[n, before], best), made[n, before])
        return out

    def exact_long(self, ids: list[int]) -> list[int]:
        """The same for one long word, with a heap of possible merges."""
        n = len(ids)
        ids, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, k) for k in range(n - 1) if (m := self.merge.get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            m, k = heapq.heappop(heap)
            r = after[k]
            if r >= n or ids[k] < 0 or self.merge.get((ids[k], ids[r])) != m:
                continue
            ids[k], ids[r] = m, -1
            after[k] = after[r]
            if after[r] < n:
                before[after[r]] = k
                if (x := self.merge.get((m, ids[after[r]]))) is not None:
                    heapq.heappush(heap, (x, k))
            if (p := before[k]) >= 0 and (x := self.merge.get((ids[p], m))) is not None:
                heapq.heappush(heap, (x, p))
        return [i for i in ids if i >= 0]

    def propose(self, word: str) -> list[int]:
        """Greedy longest match of a word in byte letters."""
        own, reach, n, at, out = self.own, self.reach, len(word), 0, []
        while at < n:
            if n - at <= self.longest and (i := own.get(word[at:] + SUFFIX)) is not None:
                out.append(i)
                break
            end = min(n - 1, at + self.longest)
            end = min(end, at + reach.get(word[at:at + 4], 3))
            while (i := own.get(word[at:end])) is None:
                end -= 1
            out.append(i)
            at = end
        return out

    def compatible(self, t1: np.ndarray, t2: np.ndarray) -> np.ndarray:
        """For each pair: does merging leave t1 and t2 side by side?"""
        t1, t2 = t1.copy(), t2.copy()
        limit = np.full(len(t1), np.iinfo(np.int64).max)
        good, live = np.zeros(len(t1), bool), np.arange(len(t1))
        while len(live):
            a, b = t1[live], t2[live]
            key = a * self.size + b
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            live = live[~((self.keys[at] == key) & (self.made[at] < limit[live]))]
            a, b = t1[live], t2[live]
            ra, lb = self.right[a], self.left[b]
            whole_a, whole_b = ra == a, lb == b
            undo_a = np.where(a > b, ~whole_a, whole_b & ~whole_a)
            undo_b = ~undo_a & ~whole_b
            limit[live] = np.where(undo_a, a, b + 1)
            t1[live] = np.where(undo_a, ra, a)
            t2[live] = np.where(undo_b, lb, b)
            done = whole_a & whole_b
            good[live[done]] = True
            live = live[~done]
        return good

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Token ids of distinct words given in byte letters."""
        tried = [self.propose(w) for w in words]
        flat = np.array([i for ids in tried for i in ids], np.int64)
        owner = np.repeat(np.arange(len(tried)), [len(ids) for ids in tried])
        seam = np.flatnonzero(owner[1:] == owner[:-1])
        new, back = np.unique(flat[seam] * self.size + flat[seam + 1], return_inverse=True)
        ok = self.compatible(new // self.size, new % self.size)
        failed = np.unique(owner[seam][~ok[back]]).tolist()
        for w, ids in zip(failed, self.exact_merges([self.symbols(words[w] + SUFFIX) for w in failed])):
            tried[w] = ids
        return dict(zip(words, tried))

    def parts(self, piece: str) -> list:
        """A white-space free piece of text as special ids and words in byte letters."""
        out: list = []
        if piece.isascii() and not any(m in piece for m in self.special):
            return self.split.findall(piece.lower()) if piece.isprintable() else self._letters(piece.lower())
        for part in self.marks.split(piece) if self.marks else [piece]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self._letters(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
        return out

    def _letters(self, text: str) -> list[str]:
        return [w.encode().decode("latin-1").translate(self.letters) for w in self.split.findall(text)]

    def pieces(self, text: str) -> list[str]:
        if self.odd.search(text):  # str.split takes these for white space; the tokenizer's pattern doesn't
            return [x for x in self.spaces.split(text) if x]
        return text.split()

    def encode(self, texts: Iterable[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian uint32, decoded) of each text."""
        split = [self.pieces(t) for t in texts]
        if len(self.ids_of) > MEMO:
            self.ids_of.clear()
            self.text_of.clear()
        new: set[str] = set()
        for s in split:
            new.update(set(s).difference(self.ids_of))
        if new:
            parts = {p: self.parts(p) for p in new}
            ids = self.encode_words(list({w for x in parts.values() for w in x if isinstance(w, str)}))
            for p, x in parts.items():
                got = [i for w in x for i in (ids[w] if isinstance(w, str) else (w,))]
                self.ids_of[p] = struct.pack(f"<{len(got)}I", *got)
                self.text_of[p] = " ".join([self.names[i] for i in got])
        return [(b"".join(map(self.ids_of.__getitem__, s)), " ".join(map(self.text_of.__getitem__, s))) for s in split]


_LOADED: dict[int, WordBpe] = {}


def loaded(spec: str) -> WordBpe:
    """The tokenizer of this worker, built once."""
    key = hash(spec)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordBpe(spec)
    return _LOADED[key]


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, token_ids binary: little-endian uint32, decoded string) for every row."""
    with open(path or default_path(), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        bpe = loaded(spec.value)
        for b in slices(batches):
            got = bpe.encode(t or "" for t in b.column("text").to_pylist())
            yield pa.record_batch([b.column("doc_id"), pa.array([x for x, _ in got], pa.binary()),
                                   pa.array([x for _, x in got], pa.string())],
                                  names=["doc_id", "token_ids", "decoded"])
    return keyed_texts(docs).mapInArrow(run, "doc_id long, token_ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``encode_decode``'s rows."""
    return encoded.select("doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
                          F.sha2("token_ids", 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
