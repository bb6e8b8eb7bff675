"""SentencePiece BPE encoding and decoding by backtracking.

A sequence of pieces that merging reproduces from their own letters is the
merge-type encoding of a text exactly when merging leaves every two
neighbours side by side. So the encoding is searched from the left: each
position's longest piece comes from one Aho-Corasick pass over the words
(reversed, so that matches end where pieces start), a neighbour is accepted if
re-merging the two pieces together never merges across their seam, else the
next shorter piece is tried; a position from which nothing goes on is marked in
a bitfield of failed positions and never tried again, so the search is linear
in the word. Merging takes the neighbours whose joined text is the piece of
the highest score, the leftmost of equals.

No piece holds a space mark behind another letter, and characters that occur
in no piece stand alone (both are checked on loading), so texts split into
words at space marks and at those characters; a worker remembers words up to
a bound in bytes. Characters without a piece become their UTF-8 bytes' ids.

The model file is read on the driver and broadcast; its size is that of the
vocabulary. Supported are BPE models without character normalisation,
with byte pieces and a leading space mark; others raise on loading.

Defined cases: a null or empty text has the end id only and decodes to ''; a
blank text keeps its blanks; texts and words of any length are encoded whole;
repeated rows and a null doc_id each get their row; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import gc
import heapq
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import keyed_texts, slices

SPACE = "▁"
#: bytes of words that a worker remembers (half of them from before the last clearing), and of
#: the longest that it does; pairs that it remembers
MEMO_BYTES, MEMO_WORD = 72 << 20, 200
MEMO_PAIRS = 400_000
PACK = [struct.Struct(f"<{n}i").pack for n in range(9)]
#: the model file's piece types
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protocol-buffer message."""
    def varint(at):
        value = shift = 0
        while True:
            byte = message[at]
            value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
            if byte < 128:
                return value, at
    at = 0
    while at < len(message):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if key & 7 == 2 else ({5: 4, 1: 8}[key & 7], at)
            value, at = message[at:at + size], at + size
        yield key >> 3, value


class PieceBpe:
    """One model: encoding, decoding and their memo."""

    def __init__(self, model: bytes):
        import ahocorasick
        self.pieces: list[str] = []
        scores, types, trainer, normalizer = [], [], {}, {}
        for number, value in fields(model):
            if number == 1:
                got = dict(fields(value))
                self.pieces.append(got[1].decode())
                scores.append(struct.unpack("<f", got[2])[0] if 2 in got else 0.0)
                types.append(got.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        if (trainer.get(3) != 2 or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1)
                or not normalizer.get(5, 1) or set(types) - {NORMAL, UNKNOWN, CONTROL, BYTE}):
            raise ValueError("not a plain BPE model with byte pieces")
        self.sizes = list(map(len, self.pieces))
        byte_ids = [i for i, t in enumerate(types) if t == BYTE]
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in byte_ids}
        if len(self.byte_id) != 256:
            raise ValueError("the model has no piece for some bytes")
        self.end = self.pieces.index("</s>")
        self.surface = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for i, t in enumerate(types):
            if t in (CONTROL, UNKNOWN):
                self.surface[i] = b"" if t == CONTROL else " ⁇ ".encode()
        for b, i in self.byte_id.items():
            self.surface[i] = bytes([b])
        self.id_of = {p: i for i, (p, t) in enumerate(zip(self.pieces, types)) if t == NORMAL}
        self.score = {p: scores[i] for p, i in self.id_of.items()}
        letters = {c for p in self.id_of for c in p}
        if letters - self.id_of.keys() or any(SPACE in p.lstrip(SPACE) for p in self.id_of):
            raise ValueError("pieces hold letters without a piece, or space marks behind letters")
        alone = "".join(c for c in "\n\r\t" if c not in letters)
        if "\n" not in alone:
            raise ValueError("a piece holds a line feed")
        self.words = re.compile(f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+|[{alone}]+")
        # what merging reproduces, with the first and last symbol after each of its merges
        self.edges: dict[int, list] = {}
        self.longest = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            got, steps = self.merge(list(p), trace=True)
            if got == [p]:
                self.edges[i] = steps
                if len(p) > 1:
                    self.longest.add_word(p[::-1], i)
        self.longest.make_automaton()
        self.shorter = {i: self._shorter(self.pieces[i]) for i in self.edges}
        self.fits: dict[int, bool] = {}
        self.letter = {p: i for p, i in self.id_of.items() if len(p) == 1}
        self.one = {i: struct.pack("<i", i) for i in self.edges}
        self.joined = np.array(sorted({ord(a) << 21 | ord(b) for p in self.id_of for a, b in zip(p, p[1:])}))
        self.known: dict[str, bytes] = {}
        self.known_parts: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}
        self.held = 0

    def _shorter(self, piece: str) -> int:
        for n in range(len(piece) - 1, 0, -1):
            i = self.id_of.get(piece[:n])
            if i in self.edges or n == 1:
                return i
        return -1

    def merge(self, symbols: list[str], trace: bool = False) -> tuple[list[str], list]:
        """Merge by score until nothing merges; with ``trace`` also (order, first symbol,
        last symbol) after each merge, the state before any at the start."""
        n = len(symbols)
        s, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(a, b):
            if (x := self.score.get(s[a] + s[b])) is not None:
                heapq.heappush(heap, (-x, a, s[a], s[b]))
        for k in range(n - 1):
            offer(k, k + 1)
        steps, first, last = [(None, s[0], s[-1])], 0, n - 1
        while heap:
            order, a, x, y = heapq.heappop(heap)
            b = after[a]
            if s[a] != x or b >= n or s[b] != y:
                continue
            s[a], s[b] = x + y, ""
            after[a] = after[b]
            if after[b] < n:
                before[after[b]] = a
                offer(a, after[b])
            else:
                last = a
            if before[a] >= 0:
                offer(before[a], a)
            if trace:
                steps.append((order, s[first], s[last]))
        return [x for x in s if x], steps

    def fit(self, a: int, b: int) -> bool:
        """Does re-merging a and b together leave them side by side? Their own merges
        interleave by score, the left one's first among equals, until one across the
        seam would come before both."""
        left, right, i, j = self.edges[a], self.edges[b], 0, 0
        none = float("inf")
        ok = True
        while True:
            x = left[i + 1][0] if i + 1 < len(left) else none
            y = right[j + 1][0] if j + 1 < len(right) else none
            seam = self.score.get(left[i][2] + right[j][1])
            if seam is not None and -seam < x and -seam <= y:
                ok = False
                break
            if x is none and y is none:
                break
            if x <= y:
                i += 1
            else:
                j += 1
        if len(self.fits) >= MEMO_PAIRS:
            self.fits.clear()
        self.fits[a * len(self.pieces) + b] = ok
        return ok

    def search(self, n: int, longest: list[int]) -> list[int]:
        """Ids of a word of n letters, given each position's longest piece (-1: no piece)."""
        out: list[int] = []
        failed = bytearray(n + 1)
        size, shorter, fit, fits, wide = self.sizes, self.shorter, self.fit, self.fits, len(self.sizes)
        start = at = 0  # out[start:] are pieces since the last letter without one
        nxt = longest[0] if n else -1
        while at < n:
            if nxt < 0:
                out.append(-1)
                at, start = at + 1, len(out)
                nxt = longest[at] if at < n else -1
                continue
            while nxt >= 0:
                end = at + size[nxt]
                if not failed[end]:
                    if len(out) == start:
                        break
                    good = fits.get(out[-1] * wide + nxt)
                    if good or good is None and fit(out[-1], nxt):
                        break
                nxt = shorter[nxt]
            if nxt >= 0:
                out.append(nxt)
                at = end
                nxt = longest[at] if at < n else -1
            else:
                failed[at] = 1
                nxt = out.pop()
                at -= size[nxt]
        return out

    def parts(self, words: list[str]) -> list[list[str]]:
        """Each word cut where two letters meet that no piece holds side by side."""
        if not words:
            return []
        text = "\n".join(words)
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        pair = code[:-1] << 21 | code[1:]
        at = np.minimum(np.searchsorted(self.joined, pair), len(self.joined) - 1)
        cuts = (np.flatnonzero(self.joined[at] != pair) + 1).tolist()
        out: list[list[str]] = [[]]
        start = 0
        ends = iter(np.cumsum([len(w) + 1 for w in words]).tolist())
        end = next(ends)
        for cut in cuts + [len(text)]:
            if start >= end:
                end = next(ends)
                out.append([])
            if cut < end:
                out[-1].append(text[start:cut])
            start = cut
        return out

    def encode_parts(self, parts: list[str]) -> dict[str, bytes]:
        """Ids (little-endian int32) of each part of a word, all matched in one pass."""
        text = "\n".join(parts)
        best = list(map(self.letter.get, text, repeat(-1)))
        last = -1
        for end, i in self.longest.iter(text[::-1]):  # matches end where pieces start, the longest of each end first
            if end != last:
                best[~end], last = i, end
        out, at, sizes = {}, 0, self.sizes
        for w in parts:
            n = len(w)
            i = best[at]
            if i >= 0 and sizes[i] == n:
                out[w] = self.one[i]
            else:
                ids = self.search(n, best[at:at + n])
                if -1 in ids:
                    ids = self._bytes(w, ids)
                out[w] = np.array(ids, "<i4").tobytes() if len(ids) > 8 else PACK[len(ids)](*ids)
            at += n + 1
        return out

    def _bytes(self, word: str, ids: list[int]) -> list[int]:
        out, at = [], 0
        for i in ids:
            if i < 0:
                out += [self.byte_id[b] for b in word[at].encode()]
                at += 1
            else:
                out.append(i)
                at += len(self.pieces[i])
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: control ids are dropped, byte ids joined, and the first space with them."""
        return b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")

    def split(self, text: str) -> list[str]:
        return self.words.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text as little-endian int32, the end id last."""
        split = [self.split(t) for t in texts]
        if self.held > MEMO_BYTES:  # what was not asked for since the last time goes
            self.old, self.known, self.held = self.known, {}, 0
            self.old_parts, self.known_parts = self.known_parts, {}
        known, known_parts = self.known, self.known_parts
        new: set[str] = set()
        for s in split:
            new.update(set(s).difference(known))
        fresh = {w: self.old[w] for w in new & self.old.keys()}
        words = list(new.difference(fresh))
        cut = dict(zip(words, self.parts(words)))
        asked = {p for x in cut.values() for p in x if p not in known_parts}
        fresh_parts = {p: self.old_parts[p] for p in asked & self.old_parts.keys()}
        fresh_parts |= self.encode_parts(list(asked.difference(fresh_parts)))
        for w, x in cut.items():
            fresh[w] = b"".join([known_parts.get(p) or fresh_parts[p] for p in x]) if len(x) > 1 else known_parts.get(w) or fresh_parts[w]
        end = struct.pack("<i", self.end)
        found = known
        if max(map(len, fresh), default=0) > MEMO_WORD:  # long words serve this batch only
            found = known | fresh
            fresh = {w: x for w, x in fresh.items() if len(w) <= MEMO_WORD}
            fresh_parts = {p: x for p, x in fresh_parts.items() if len(p) <= MEMO_WORD}
        for memo, more in ((known, fresh), (known_parts, fresh_parts)):
            memo.update(more)
            self.held += sum(map(len, more)) * 2 + sum(map(len, more.values())) + 180 * len(more)
        return [b"".join(map(found.__getitem__, s)) + end for s in split]


_LOADED: dict[int, PieceBpe] = {}


def loaded(model: bytes) -> PieceBpe:
    """The model of this worker, built once."""
    key = hash(model)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PieceBpe(model)
        gc.freeze()  # the model's tables stay, so collections needn't look at them
    return _LOADED[key]


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, token_ids array<int>, decoded string) for every row; token_ids end with the end id."""
    with open(path or default_path(), "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        bpe = loaded(model.value)
        for b in slices(batches):
            got = bpe.encode(t or "" for t in b.column("text").to_pylist())
            ends = np.cumsum([0] + [len(x) // 4 for x in got]).astype(np.int32)
            ids = pa.array(np.frombuffer(b"".join(got), np.int32))
            yield pa.record_batch([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), ids),
                                   pa.array([bpe.decode(struct.unpack(f"<{len(x) // 4}i", x)) for x in got], pa.string())],
                                  names=["doc_id", "token_ids", "decoded"])
    return keyed_texts(docs).mapInArrow(run, "doc_id long, token_ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``encode_decode``'s rows."""
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return encoded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
                          F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
