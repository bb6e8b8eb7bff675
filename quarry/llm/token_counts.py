"""Token counts by trie-shared dynamic programming.

Texts are split at white space into pre-tokens. The distinct new pre-tokens of
a slice of documents form a trie, walked depth first as their sorted list with
common-prefix lengths; the unigram forward recursion (best score and piece
count of every prefix) is computed once per trie node, and a pre-token's
terminal node stores its count. Counts are kept in a bounded table per worker
and summed per document.

The vocabulary is an existing one: the pieces of a SentencePiece file, whose
ranks give the scores (piece of rank r: -log(r + 1), Zipf's law). A character
that no piece covers costs one token per UTF-8 byte, at the score of the
last rank each. Of equally good segmentations the one with fewer pieces counts.

Defined cases: null, empty and blank texts have no pre-tokens and no tokens;
pre-tokens of any length are walked whole; repeated rows and a null doc_id get
their rows.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import keyed_texts, slices, text_bytes

MARK = "▁"
MEMO = 300_000


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def load_scores(path: str | None = None) -> dict[str, float]:
    """Score of each ordinary piece of a SentencePiece file, by its rank."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=os.fspath(path or default_path()))
    ordinary = [i for i in range(sp.get_piece_size())
                if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    ranked = sorted(ordinary, key=lambda i: (-sp.get_score(i), i))
    return {sp.id_to_piece(i): -math.log(r + 1) for r, i in enumerate(ranked, 1)}


class TrieCounter:
    """Piece counts of pre-tokens."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.byte_score = -math.log(len(scores) + 2)
        self.nodes = 0

    def count(self, words: Iterable[str]) -> dict[str, int]:
        """Pieces of the best segmentation of each distinct word (with its leading mark)."""
        get, longest, byte = self.scores.get, self.longest, self.byte_score
        out: dict[str, int] = {}
        last = ""
        best, pieces = [0.0], [0]  # of the prefixes of the word before: the path from the root
        for word in sorted(set(words)):
            s = MARK + word
            keep, most = 0, min(len(last), len(s))
            while keep < most and s[keep] == last[keep]:
                keep += 1
            del best[keep + 1:], pieces[keep + 1:]
            self.nodes += len(s) - keep
            for end in range(keep + 1, len(s) + 1):
                n = len(s[end - 1].encode())
                top, count = best[end - 1] + n * byte, pieces[end - 1] + n
                for at in range(max(0, end - longest), end):
                    score = get(s[at:end])
                    if score is not None:
                        total = best[at] + score
                        if total > top or total == top and pieces[at] + 1 < count:
                            top, count = total, pieces[at] + 1
                best.append(top)
                pieces.append(count)
            out[word] = pieces[-1]
            last = s
        return out


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) for every row."""
    held = docs.sparkSession.sparkContext.broadcast(load_scores(path))  # as large as the vocabulary

    def run(batches):
        trie, memo = TrieCounter(held.value), {}
        for b in slices(batches, 1024):
            split = [t.split() for t in text_bytes(b.column("text"))]  # bytes: white space is ASCII's only
            if len(memo) > MEMO:
                memo.clear()
            new = {w for words in split for w in words if w not in memo}
            memo.update((w.encode(), n) for w, n in trie.count(w.decode() for w in new).items())
            yield pa.record_batch([b.column("doc_id"), pa.array([len(w) for w in split], pa.int64()),
                                   pa.array([sum(map(memo.__getitem__, w)) for w in split], pa.int64())],
                                  names=["doc_id", "n_pretokens", "n_tokens"])
    return keyed_texts(docs).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
