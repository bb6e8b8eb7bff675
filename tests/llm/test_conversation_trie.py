"""The conversation trie against a brute-force version."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from quarry.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string, path string, n long"


def brute(rows):
    """Every prefix of every rebuilt conversation, counted one by one."""
    turns = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            r, x = r or "", x or ""
            whole = f"{len(r.encode())}:{r}{x}".encode()
            turns[c].append((t is not None, t or 0, r, hashlib.md5(whole).hexdigest(), x))
    turns = {c: [(r, x) for *_, r, _, x in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = turns.get(base, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    out = []
    for node, convs in members.items():
        below = [m for m in members if m[:len(node)] == node]
        kids = [m for m in below if len(m) == len(node) + 1]
        leaf = [m for m in below if not any(x[:len(m)] == m and len(x) > len(m) for x in below)]
        ends = sorted(c for c in convs if len(rebuilt[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids), len(leaf),
                    sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m),
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def fixture():
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 90), *range(1000, 1013), -3, -5, -7, -1, 10**15 + 1]:
        first = rng.choice(["hello", "hello", "hi é", ""])
        n = rng.choice([0, 1, 2, 3, 6, 12])
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", first if t == 0 else rng.choice(["yes", "no", "ä"])) for t in range(n)]
    rows += [(200, 0, None, None), (200, None, "user", "first"), (200, None, "user", "also first"), (201, 5, "a", "tie"), (201, 5, "a", "tie"), (201, 5, "", "tie")]
    rows += [(300 + i, t, "user", f"same {t}") for i in range(40) for t in range(4)]
    rows += [(None, 0, "user", "nobody's")]
    rows += [(401, t, "user", f"t{t % 7}") for t in range(60)] + [(402, t, "user", f"t{t % 7}") for t in range(60)]
    rng.shuffle(rows)
    return [(*r, "x", 9) for r in rows]


@pytest.mark.parametrize("convs,turns", [(2048, 32768), (7, 40), (1, 2)])
def test_trie(spark, monkeypatch, convs, turns):
    monkeypatch.setattr(ct, "SHARD_CONVS", convs)
    monkeypatch.setattr(ct, "SHARD_TURNS", turns)
    rows = fixture()
    got = ct.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_sql(spark):
    rows = fixture()
    spark_rows = ct.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    conversations = spark.createDataFrame(rows, SCHEMA).toPandas().astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
    con = duckdb.connect()
    con.register("conversations", conversations)
    assert sorted(con.sql(ct.oracle()).fetchall(), key=str) == sorted((tuple(r) for r in spark_rows), key=str)


def test_little(spark):
    assert ct.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert ct.prefix_trie(spark.createDataFrame([(None, 1, "a", "b", "", 1)], SCHEMA)).collect() == []


def test_bits():
    shard = ct.Shard()
    for c, turns in [(3, "ab"), (1, "ab"), (2, "a"), (7, "b"), (9, "")]:
        shard.add(c, [(t.encode(), 1) for t in turns])
    rows = {(r[4], r[1]): (r[5], r[7]) for r in shard.nodes()}
    ids = lambda *x: ct.np.array(x, "<i8").tobytes()
    assert rows == {(1, 0): (5, ids(9)), (1, 1): (3, ids(2)), (1, 2): (2, ids(1, 3)), (7, 1): (1, ids(7))}
