"""Top-k search on clustered data: blocks far away are never joined."""

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import cover_tree


def test_most_block_pairs_of_clustered_data_are_dropped_before_the_join(spark):
    r = np.random.default_rng(3)
    centers = r.normal(size=(20, 16))
    centers *= 10 / np.linalg.norm(centers, axis=1)[:, None]
    x = np.concatenate([c + r.normal(scale=0.05, size=(60, 16)) for c in centers])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found, more, blocks = cover_tree.search_passes(docs, F.col("vec_id") % 50 == 0, block=60, query_block=8)
    asked = found.where("cell is not null").agg(F.sum("q_n")).first()[0]
    assert blocks >= 20 and asked < 0.5 * 24 * 20  # (query, cell) pairs left
    v = np.floor(256 * x).astype(np.int64)
    got = {}
    for q, i, s in found.where("query_id is not null").select("query_id", "vec_id", "score").union(more).collect():
        got.setdefault(q, set()).add((-s, i))
    for q in range(0, len(x), 50):
        want = sorted((-int(v[q] @ v[i]), i) for i in range(len(x)) if i != q)[:5]
        assert sorted(got[q])[:5] == want


def brute(v, q, k=5):
    return sorted((-int(v[q] @ v[i]), i) for i in range(len(v)) if i != q)[:k]


def test_blocks_stay_few_and_candidates_unjoined_in_longer_tables(spark):
    x = np.random.default_rng(5).normal(size=(6400, 5))
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found, more, blocks = cover_tree.search_passes(docs, F.col("vec_id") % 400 == 0, block=20, query_block=8)
    assert blocks <= 2 * cover_tree.BLOCKS  # not 6400 / 20 and more
    assert "Join" not in more._jdf.queryExecution().executedPlan().toString()
    v = np.floor(256 * x).astype(np.int64)
    got = {}
    for q, i, s in found.where("query_id is not null").select("query_id", "vec_id", "score").union(more).collect():
        got.setdefault(q, set()).add((-s, i))
    assert sorted(got) == list(range(0, 6400, 400))
    assert all(sorted(got[q])[:5] == brute(v, q) for q in got)


def test_the_driver_gets_pivots_and_not_the_tasks_candidates(spark, monkeypatch):
    x = np.random.default_rng(6).normal(size=(3000, 4))
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(30)
    plans, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or collect(df))
    cover_tree.search_passes(docs, F.col("vec_id") % 50 == 0, block=100, query_block=8)
    assert plans and not any("TakeOrdered" in p for p in plans)


def test_cells_share_blocks_and_large_ones_are_split():
    low, past = cover_tree.into_blocks(np.array([30, 30, 30, 250, 0, 40, 70, 10]), 100)
    assert (low, past) == ([0, 0, 0, 1, 0, 4, 5, 5], [1, 1, 1, 4, 0, 5, 6, 6])


def test_components_beyond_single_precision_and_two_bytes(spark):
    r = np.random.default_rng(7)
    x = [r.normal(size=6) * s for s in (0.1, 3, 200, 1e5) for _ in range(60)]
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    v = np.floor(256 * np.array(x)).astype(np.int64)
    got = sorted(tuple(r) for r in cover_tree.top_k(docs, F.col("vec_id") % 50 == 0).collect())
    assert got == [(q, n, i, -s) for q in range(0, 240, 50) for n, (s, i) in enumerate(brute(v, q), 1)]


def test_empty_vectors_only(spark):
    docs = spark.createDataFrame([(i, []) for i in range(4)] + [(50, None), (None, [1.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in cover_tree.top_k(docs, F.col("vec_id") % 50 == 0, 2).collect())
    assert got == [(0, 1, 1, 0), (0, 2, 2, 0)]


def test_many_equal_vectors_and_trees_in_turn(monkeypatch):
    monkeypatch.setattr(cover_tree, "TILE", 64)
    r = np.random.default_rng(8)
    x = np.concatenate([np.tile(r.integers(-90, 90, 8), (700, 1)), r.integers(-90, 90, (500, 8))])
    ids = r.permutation(len(x))
    trees = [cover_tree.CoverTree(cover_tree._floats(x[a:b]), ids[a:b]) for a, b in ((0, 300), (300, 1200))]
    for s in (cover_tree.Search(ids[650:750], x[650:750], None, None, 5, None, trees), cover_tree.Search(ids[650:750], x[650:750], ids, x, 5)):
        for n, q in enumerate(s.q_ids):
            own = x[np.flatnonzero(ids == q)[0]]
            want = sorted((-int(own @ x[i]), int(ids[i])) for i in range(len(x)) if ids[i] != q)[:5]
            assert [(-int(a), int(b)) for a, b in zip(s.score[n], s.best[n])] == want
