"""Hard negatives against brute force."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import anchor_lists as al

def relabel():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
SCHEMA = "vec_id long, embedding array<double>, label int, rid int, cell string"


def brute(rows):
    use = [(i, [math.floor(256 * c) for c in v], (lab + 1) % 10 if i % 7 == 0 else lab) for i, v, lab in rows
           if None not in (i, v, lab) and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for at, (a, av, al_) in enumerate(use):
        if a % 100:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(av, xv)), x, lab) for k, (x, xv, lab) in enumerate(use) if k != at))
        for ps, p, _ in [s for s in scored if s[2] == al_][:5]:
            fit = [s for s in scored if s[2] != al_ and 30 * -ps <= 100 * -s[0] <= 90 * -ps][:10]
            out += [(a, p, r, x, -ps, -ns) for r, (ns, x, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(i, v, lab, 5, "x") for i, v, lab in rows], SCHEMA)
    out = al.hard_negatives(df, F.col("vec_id") % 100 == 0, relabel())
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


def clustered(n=700):
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(8, 8))
    rows = [(i, (centers[i % 8] + 0.3 * rng.normal(size=8)).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    rows += [(3000 + i, rows[3][1], i % 3) for i in range(150)]  # one vector many times, anchors among them
    rows += [(10_000, [0.0] * 8, 1), (10_100, [1.0, None], 1), (10_200, None, 1), (10_300, [float("nan")] * 8, 2), (10_400, [float("inf")] * 8, 2),
             (None, [1.0] * 8, 1), (10_500, [0.5] * 3, None), (10_600, [0.5] * 3, 2), (10_700, [], 1), (100, rows[100][1], 2), (100, rows[100][1], 2),
             (7, rows[9][1], 1), (10_800, (-centers[0]).tolist(), 77)]
    return rows


@pytest.mark.parametrize("pivots,block,piece", [(64, 2048, 256), (5, 60, 16), (1, 10_000, 7)])
def test_hard_negatives(spark, monkeypatch, pivots, block, piece):
    monkeypatch.setattr(al, "PIVOTS", pivots)
    monkeypatch.setattr(al, "BLOCK", block)
    monkeypatch.setattr(al, "STEP", piece)
    monkeypatch.setattr(al, "SLICE", piece)
    rows = clustered()
    assert mined(spark, rows) == brute(rows)


def test_sql(spark):
    rows = clustered(400)
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding double[], label integer)")
    con.executemany("insert into embeddings values (?, ?, ?)", [list(r) for r in rows])
    assert sorted(con.sql(al.oracle()).fetchall()) == brute(rows)


def test_large_scores(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=3) * 2.0 ** 22).tolist(), i % 3) for i in range(230)]
    assert mined(spark, rows) == brute(rows)
    with pytest.raises(Exception):
        mined(spark, [(0, [2.0 ** 45], 1), (1, [1.0], 1)])


def test_little(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0], 1)]) == []
    assert mined(spark, [(100, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2)]) == [(100, 1, 1, 2, 65536, 32768)]
    assert mined(spark, [(100, [0.0], 1), (1, [1.0], 1), (2, [0.5], 2)]) == [(100, 1, 1, 2, 0, 0)]


def test_walk_ends_early():
    """On clustered data the shared list is certified long before its end."""
    rng = np.random.default_rng(1)
    centers = rng.integers(-300, 300, (20, 16))
    x = np.vstack([c + rng.integers(-9, 10, (100, 16)) for c in centers])
    a = centers[:1] + rng.integers(-9, 10, (30, 16))
    whole = [[(al.NOTHING, -al.NOTHING, al.NOTHING)]] * len(a)
    labels = np.zeros(len(x), np.int64)
    out = list(al.walk(x, np.arange(len(x)), labels, np.arange(len(x)), a, labels[:len(a)], -1 - np.arange(len(a)), whole, centers[0], True, 5))
    for r in range(len(a)):
        got = [(s, i) for q, _, i, s, _ in out if q == r]
        assert got == sorted(((int(s), i) for i, s in enumerate(x @ a[r])), key=lambda t: (-t[0], t[1]))[:5]
    assert max(seen for *_, seen in out) <= len(x) // 2
