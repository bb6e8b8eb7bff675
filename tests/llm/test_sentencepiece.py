"""SentencePiece encoding and decoding against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from edge import awkward, documents

from quarry.llm import sentencepiece_bpe as spb

TEXTS = ["", " ", "   ", "  a", "a  b   c    d", "a\nb\n\n c", " \n ", "\t\tx\r\n", "▁x ▁ ▁▁ a", "a\x00b", "日本語ぷ𝄞 x", "<s> </s> <unk> <0x0A>", "﻿abc", "� x",
         "⁇  ⁇", "ab" * 3000, " " * 3000, "=" * 700 + "-" * 900, "é" * 500, "𝄞" * 300, "don't stop, e.g. f(x){};"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=spb.default_path())


@pytest.fixture(scope="module")
def model():
    with open(spb.default_path(), "rb") as f:
        return spb.PieceBpe(f.read())


def same(model, library, texts):
    for t, got, want in zip(texts, model.encode(texts), library.encode(texts, add_eos=True)):
        ids = np.frombuffer(got, "<i4").tolist()
        assert ids == want, t[:80]
        assert model.decode(ids) == library.decode(want), t[:80]


def test_odd_texts(model, library):
    same(model, library, TEXTS)


def test_random_texts(model, library):
    rng = random.Random(3)
    letters = "abcdeénthing  \n\t▁.,()<>/=_-日本0123456789"
    same(model, library, ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)])
    pieces = list(model.id_of)
    same(model, library, ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 20))) for _ in range(3000)])


def test_small_memo(library, monkeypatch):
    monkeypatch.setattr(spb, "MEMO_BYTES", 2000)
    monkeypatch.setattr(spb, "MEMO_PAIRS", 5)
    monkeypatch.setattr(spb, "MEMO_WORD", 4)
    with open(spb.default_path(), "rb") as f:
        small = spb.PieceBpe(f.read())
    for _ in range(3):
        same(small, library, TEXTS)
    assert all(len(w) <= 4 for w in small.known) and len(small.fits) <= 5


def test_failed_positions_and_compatibility(model):
    """The search goes back where a longest piece doesn't stand beside its neighbour."""
    went_back = 0
    for word in ["▁" + w for w in ("seashore", "unhappiness", "thoured", "lyinging", "eringation", "ndwhst")]:
        want = model.merge(list(word))[0]
        got = [model.pieces[i] for i in np.frombuffer(model.encode_parts([word])[word], "<i4")]
        assert got == want
        greedy, at = [], 0
        while at < len(word):
            piece = max((p for p in (word[at:e] for e in range(at + 1, len(word) + 1)) if p in model.id_of), key=len)
            greedy.append(piece)
            at += len(piece)
        went_back += greedy != want
    assert went_back


def test_other_models_raise():
    piece = lambda p: b"\x0a" + bytes([len(p) + 2]) + b"\x0a" + bytes([len(p)]) + p
    unigram = piece(b"a") + b"\x12\x02\x18\x01"  # model type 1
    with pytest.raises(ValueError):
        spb.PieceBpe(unigram)


def test_query_rows(spark, library):
    rows = awkward()
    out = spb.digests(spb.encode_decode(documents(spark))).collect()
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_eos=True)
        want.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    key = lambda t: tuple(str(x) for x in t)
    assert sorted((tuple(r) for r in out), key=key) == sorted(want, key=key)
    assert spb.digests(spb.encode_decode(documents(spark, []))).collect() == []
