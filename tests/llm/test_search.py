"""Cover-tree search and decontamination against brute force."""

import random
import re

import numpy as np
import pytest
from edge import awkward, documents
from pyspark.sql import functions as F

from quarry.llm import cover_tree, fm_decontam


def brute_top(rows, k):
    vecs = [(i, [int(np.floor(256 * np.float64(np.float32(c)))) for c in v]) for i, v in rows
            if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = set()
    for q, a in vecs:
        if q % 50 == 0:
            best = {}
            for i, b in vecs:
                if i != q:
                    best[i] = max(best.get(i, -1 << 60), sum(x * y for x, y in zip(a, b)))
            for rank, (i, s) in enumerate(sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k], 1):
                out.add((q, rank, i, s))
    return out


@pytest.mark.parametrize("block,leaf", [(8192, 64), (60, 4)])
def test_top_k(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    monkeypatch.setattr(cover_tree, "QUERY_BLOCK", max(3, block // 100))
    monkeypatch.setattr(cover_tree, "LEAF", leaf)
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(6, 8))
    rows = [(i, (centers[i % 6] + 0.1 * rng.normal(size=8)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # ties: one vector many times
    rows += [(500, [0.0] * 8), (550, [1.0, None]), (600, None), (650, [float("nan")] * 8), (700, [float("inf")] * 8), (None, [1.0] * 8),
             (750, [0.5] * 3), (800, []), (50, rows[50][1]), (7, rows[9][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int")
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in cover_tree.top_k(df, F.col("vec_id") % 50 == 0, 5).collect()}
    assert got == brute_top(rows, 5)


def test_top_k_of_little(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert cover_tree.top_k(df, F.col("vec_id") % 50 == 0).collect() == []
    df = spark.createDataFrame([(0, [1.0]), (50, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in cover_tree.top_k(df, F.col("vec_id") % 50 == 0).collect()) == [(0, 1, 50, 256 * 512), (50, 1, 0, 256 * 512)]


def test_bounds_prune_and_hold():
    rng = np.random.default_rng(1)
    x = np.vstack([c + rng.integers(-3, 4, (300, 6)) for c in rng.integers(-300, 300, (8, 6))])
    s = cover_tree.Search(np.arange(100), x[:100], np.arange(len(x)), x, 5)
    assert s.pruned > s.pairs / 4
    for k, i in enumerate(s.q_ids):
        want = np.sort(np.delete(x @ x[i], i))[::-1][:5]
        assert np.array_equal(s.score[k], want)


WORDS = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_contamination(rows, items, size):
    windows = {}
    for i, t in items:
        w = words(t)
        for a in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[a:a + size]), set()).add("null" if i is None else str(i))
    out = []
    for r in rows:
        w, hit, found = words(r[1]), set(), set()
        for key, ids in windows.items():
            for a in range(len(w) - len(key) + 1):
                if tuple(w[a:a + len(key)]) == key:
                    hit.update(range(a, a + len(key)))
                    found |= ids
        out.append((str(r[0]), len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out)


def benchmark_items():
    rng = random.Random(9)
    rows = awkward()
    items = [(i, " ".join(words(rows[13 + i][1])[:rng.randint(3, 20)])) for i in range(8)]
    return items + [(20, None), (21, " ..!"), (None, "one"), (22, "ONE two"), (22, "another text of the same item"), (23, "ÉÑ nothing here")]


@pytest.mark.parametrize("block", [1 << 20, 100])
@pytest.mark.parametrize("size", [13, 4])
def test_contamination(spark, block, size):
    items = benchmark_items()
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n_words int")
    out = fm_decontam.find_contamination(documents(spark), bench, size, block)
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, sorted(r["items"]), r.contaminated) for r in out.collect())
    assert got == brute_contamination(awkward(), items, size)
    for r in out.collect():
        assert sum(s["last"] - s["first"] + 1 for s in r.spans) == r.n_hit
        assert all(a["last"] + 1 < b["first"] for a, b in zip(r.spans, r.spans[1:]))


def test_empty_benchmark_and_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in fm_decontam.find_contamination(documents(spark), none).collect())
    bench = spark.createDataFrame(benchmark_items(), "item_id long, text string")
    assert fm_decontam.find_contamination(documents(spark, []), bench).collect() == []
    kept = fm_decontam.drop_contaminated(documents(spark), bench)
    bad = {x[0] for x in brute_contamination(awkward(), benchmark_items(), 13) if x[4]}
    assert bad and kept.columns == documents(spark).columns
    assert {str(r.doc_id) for r in kept.collect()} == {str(r[0]) for r in awkward()} - bad


def test_index_finds_all_occurrences():
    rng = random.Random(4)
    for _ in range(60):
        top = rng.choice([1, 2, 5, 40])
        runs = [[rng.randint(1, top) for _ in range(rng.randint(1, 30))] for _ in range(rng.randint(1, 8))]
        s = np.array([x for r in runs for x in [*r, 0]])
        index = fm_decontam.FmIndex(s, top)
        window = np.array([runs[0][:rng.randint(1, len(runs[0]))]])
        _, low, high = index.search(window)
        _, at = index.locate(low, high)
        n = window.shape[1]
        assert sorted(at.tolist()) == [k for k in range(len(s) - n + 1) if np.array_equal(s[k:k + n], window[0])]
