"""Suffix dedup, SimHash near-dedup and line dedup against brute force."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from edge import SCHEMA, awkward, documents

from quarry.llm import components, line_dedup, rlbwt, simhash, suffix_dedup


def brute_windows(strings, places, w):
    first = {}
    for s, p in zip(strings, places):
        for x in range(len(s) - w + 1):
            first[s[x:x + w]] = min(first.get(s[x:x + w], 1 << 62), p + x)
    return [[x for x in range(len(s) - w + 1) if first[s[x:x + w]] < p + x] for s, p in zip(strings, places)]


def test_run_index_matches_brute_force():
    rng = random.Random(3)
    for _ in range(120):
        w, letters = rng.choice([1, 2, 3, 5, 8, 9, 17, 30]), rng.choice([b"\0", b"ab", b"ab\0\xff", bytes(range(256))])
        strings = []
        for _ in range(rng.randint(1, 12)):
            if strings and rng.random() < .5:
                old = rng.choice(strings)
                a = rng.randint(0, len(old))
                strings.append(old[a:a + rng.randint(0, 60)] + bytes(rng.choice(letters) for _ in range(rng.randint(0, 10))))
            else:
                strings.append(bytes(rng.choice(letters) for _ in range(rng.randint(0, 80))))
        places = np.array(rng.sample(range(0, 100_000, 100), len(strings)))
        got = [x.tolist() for x in rlbwt.earlier_windows(strings, places, w)]
        assert got == brute_windows(strings, places.tolist(), w)


def test_run_index_is_run_compressed():
    index = rlbwt.RunIndex([b"abcdefgh" * 40] * 50, 100)
    assert len(index.first) < index.rows / 20


def removed_bytes(rows, w):
    """{(doc_id, text): (n_bytes, n_removed, n_spans, sha256)}; equal rows are one document."""
    import xxhash
    texts = sorted({(-(1 << 63) if r[0] is None else r[0], xxhash.xxh32_intdigest((r[1] or "").encode()), (r[1] or "").encode())
                    for r in rows})
    seen, out = set(), {}
    for i, _, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - w + 1):
            if t[p:p + w] in seen:
                gone[p:p + w] = b"\1" * w
            seen.add(t[p:p + w])
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out[None if i < 0 else i, t] = (len(t), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot,chunks", [(4096, 1000), (1, 1000), (4096, 0)])
@pytest.mark.parametrize("window", [100, 30])
def test_suffix_dedup(spark, monkeypatch, hot, chunks, window):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 6000)
    rows = awkward()
    want = removed_bytes(rows, window)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest())
                 for r in suffix_dedup.find_repeats(documents(spark).repartition(3), window, hot, chunks).collect())
    assert got == sorted((str(r[0]), *want[r[0], (r[1] or "").encode()]) for r in rows)
    assert sum(x[2] for x in got) > 1000


@pytest.mark.parametrize("hot", [4096, 1])
def test_suffix_dedup_of_wide_windows(spark, monkeypatch, hot):
    """Segments of more than 256 windows: their offsets need more than a byte."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", 6000)
    rng = random.Random(8)
    prose = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    base = prose(4000)
    cuts = [(rng.randint(0, 2000), rng.randint(450, 2000)) for _ in range(24)]
    rows = [(i, prose(30) + base[a:a + n] + prose(30), "en", "s", None, 7, "x", 3, "z") for i, (a, n) in enumerate(cuts)]
    want = removed_bytes(rows, 700)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest())
                 for r in suffix_dedup.find_repeats(documents(spark, rows).repartition(3), 700, hot).collect())
    assert got == sorted((r[0], *want[r[0], r[1].encode()]) for r in rows)
    assert sum(x[2] for x in got) > 1000


def test_suffix_dedup_of_nothing(spark):
    assert suffix_dedup.find_repeats(documents(spark, [])).collect() == []


def brute_components(rows, width, bits):
    ids, fps = [r[0] for r in rows], [simhash.fingerprint((r[1] or "").encode(), width) for r in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (fps[a] ^ fps[b]).bit_count() <= bits and group[b] < group[a]:
                    group[a], changed = group[b], True
    least = {}
    for g, i in zip(group, ids):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return sorted((str(i), f"{f:016x}", str(least.get(g))) for i, f, g in zip(ids, fps, group))


def test_fingerprint_by_definition():
    from xxhash import xxh64
    for text in (b"", b" \n", b"One", b"one TWO", b"a b c d a b c", " ".join(map(str, range(3000))).encode()):
        w = text.lower().split()
        s = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        want = sum(1 << k for k in range(64) if 2 * sum(xxh64(x, seed=42).intdigest() >> k & 1 for x in s) > len(s))
        assert simhash.fingerprint(text) == want


def test_fingerprint_in_blocks(monkeypatch):
    text = " ".join(f"w{i * 7919 % 613}" for i in range(5000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash.word_blocks, "__defaults__", (100,))
    assert simhash.fingerprint(text) == whole


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_near_duplicates(spark, bits):
    rows = awkward()
    got = sorted((str(r.doc_id), f"{r.fp & (1 << 64) - 1:016x}", str(r.component_id))
                 for r in simhash.near_duplicates(documents(spark), bits=bits).collect())
    assert got == brute_components(rows, 3, bits)


def test_links_lose_nothing_in_hot_buckets(spark):
    rng = random.Random(1)
    center = rng.getrandbits(64)
    fps = {center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(400)}
    fps |= {rng.getrandbits(64) for _ in range(100)}
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    fps = list(fps)
    want = {frozenset((a, b)) for k, a in enumerate(fps) for b in fps[:k] if (a ^ b).bit_count() <= 2}
    for bucket in (1, 16, 100_000):
        got = [frozenset(x & (1 << 64) - 1 for x in r) for r in simhash.links(df, 2, bucket).collect()]
        assert set(got) == want


def test_pigeonring_prunes():
    chains = simhash.chain_masks(2)
    assert [b for _, b in chains[0]] == [0, 0, 1, 1, 2] and chains[0][-1][0] == (1 << 64) - 1


def test_drop_near_duplicates_keeps_columns(spark):
    out = simhash.drop_near_duplicates(documents(spark))
    assert out.columns == documents(spark).columns
    groups, rows = {}, awkward()
    for r in rows:
        fp = simhash.fingerprint((r[1] or "").encode())
        near = [g for g in groups if any((fp ^ f).bit_count() <= 2 for f in groups[g])]
        merged = {fp}.union(*(groups.pop(g) for g in near))
        groups[min(merged)] = merged
    kept = out.collect()
    found = [simhash.fingerprint((t or "").encode()) for t in {r.text for r in kept}]
    assert sorted(next(g for g, m in groups.items() if f in m) for f in found) == sorted(groups)  # one text of each group
    for r in kept:
        group = next(m for m in groups.values() if simhash.fingerprint((r.text or "").encode()) in m)
        ids = [x[0] for x in rows if x[0] is not None and simhash.fingerprint((x[1] or "").encode()) in group]
        assert r.doc_id == min(ids, default=None)
    assert {r.doc_id for r in kept} >= {None, 1, 6} and not set(range(200, 206)) & {r.doc_id for r in kept}


def test_connected_components(spark):
    path = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 90, 95: 90, 90: 90}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_line_dedup_sql(spark):
    rng = random.Random(2)
    pool = [f"line {i}" for i in range(40)]
    rows = [(i, "\n".join(rng.choice(pool[: 1 + k % 40]) + rng.choice(["", " ", "\r"]) for k in range(rng.randint(1, 12))) if i % 17 else None,
             "en", rng.choice([None, *(f"s{k}" for k in range(9))]), 0, 0, "", 0, "") for i in range(300)]
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [(r[0], r[1], r[3]) for r in rows])
    for sites in (2, 6, 9):
        want = con.execute(line_dedup.oracle(min_sites=sites)).fetchall()
        out = line_dedup.dedup_lines(documents(spark, rows), sites)
        assert sorted(map(str, want)) == sorted(str((r.doc_id, r.text, r.lines_removed)) for r in out.collect())
    assert sum(x[2] for x in want)


def test_line_dedup_near_threshold_is_exact(spark):
    """With every estimate near the threshold, all counts are exact ones."""
    rows = [(i, f"common\nonly {i}", "en", f"s{i % 5}", 0, 0, "", 0, "") for i in range(50)]
    for sites, gone in ((5, 49), (6, 0)):
        out = line_dedup.dedup_lines(documents(spark, rows), sites, margin=0.9)
        assert sum(r.lines_removed for r in out.collect()) == gone


def test_line_dedup_edges(spark):
    rows = awkward()
    out = line_dedup.dedup_lines(documents(spark), 3)
    assert sorted(out.columns) == sorted(SCHEMA.replace(",", "").split()[::2])
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r[0]) for r in rows)
    assert {r.text for r in out.collect() if r.doc_id in (1, 2, 3)} == {None, "", " \n\t \r\n"}
    assert line_dedup.dedup_lines(documents(spark, []), 3).collect() == []


def test_line_dedup_plan_is_native(spark):
    plan = line_dedup.dedup_lines(documents(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
