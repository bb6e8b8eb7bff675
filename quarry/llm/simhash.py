"""SimHash near-dedup with pigeonring filtering.

Fingerprints of shingles are computed per document inside tasks (Arrow in,
one long out). Links are searched among distinct fingerprints only: the 64
bits form a ring of ``2 t + 1`` segments for a budget of t bits, and by the
pigeonring principle two fingerprints within t bits have a start from which
every chain of l consecutive segments differs in at most l t / m bits. The
chains whose budget is below one bit must agree, so they are the join key;
the longer chains are checked on the candidates before the full Hamming
distance.

A key shared by more than ``BUCKET`` distinct fingerprints (a large ball of
near copies) is not searched in one group: its members are dealt anew by the
fingerprint less every choice of t of 16 nibbles, whose groups hold at most
16^t members by construction; no link is lost. Groups meet as bounded lists.

Defined cases: a null or blank text has fingerprint zero and links like any
other; fewer words than the shingle length give one shingle of all words; a
null doc_id gets a row and is ignored by the smallest id of a component (a
component of null ids only has a null id); repeated rows each get a row; rows
that share a doc_id but not the text are different documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import keyed_texts, slices, stage, text_bytes
from quarry.llm.components import connected_components

SHINGLE = 3
MAX_BITS = 2
SEED = 42
#: distinct fingerprints that are compared as one group
BUCKET = 256
BLOCK = 4 << 20
SPACE = re.compile(rb"[ \t-\r]")
#: bits of each byte value, lowest first
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def word_blocks(text: bytes, size: int = BLOCK) -> Iterator[list[bytes]]:
    """Lower-cased words of a text, block by block."""
    at = 0
    while at < len(text):
        end = len(text)
        if at + size < end and (m := SPACE.search(text, at + size)):
            end = m.start()
        yield text[at:end].lower().split()
        at = end


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles."""
    from xxhash import xxh64_intdigest
    ones, total, carry, whole = np.zeros(64, np.int64), 0, [], []
    for block in word_blocks(text):
        words = carry + block
        if len(words) < width:
            carry = whole = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        last = len(words) - width + 1
        h = np.array([xxh64_intdigest(joined[a:b], SEED)
                      for a, b in zip(starts[:last].tolist(), ends[width - 1:].tolist())], np.uint64)
        parts = h.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            ones[8 * k:8 * k + 8] += np.bincount(parts[:, k], minlength=256) @ BYTE_BITS
        total += last
        carry, whole = words[last:], []
    if whole and not total:
        return _majority(whole)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0]) if total else 0


def _majority(words: list[bytes]) -> int:
    from xxhash import xxh64_intdigest
    return xxh64_intdigest(b" ".join(words), SEED)


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, th, fp): the text's xxhash64 and the fingerprint as a signed long."""
    def run(batches):
        for b in slices(batches):
            fp = np.array([fingerprint(t, width) for t in text_bytes(b.column("text"))], np.uint64).view(np.int64)
            yield pa.record_batch([b.column("doc_id"), b.column("th"), pa.array(fp)], names=["doc_id", "th", "fp"])
    return keyed_texts(docs).withColumn("th", F.xxhash64("text")).mapInArrow(run, "doc_id long, th long, fp long")


# ---- links -----------------------------------------------------------------

def ring(bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment of the ring."""
    m = 2 * bits + 1
    edges = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def chain_masks(bits: int) -> list[list[tuple[int, int]]]:
    """For each start, (mask, budget) of its chains of 1, 2, ... segments."""
    seg = [((1 << w) - 1) << a for a, w in ring(bits)]
    m = len(seg)
    out = []
    for i in range(m):
        mask, chain = 0, []
        for n in range(1, m + 1):
            mask |= seg[(i + n - 1) % m]
            chain.append((mask, n * bits // m))
        out.append(chain)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    return fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks]))
                      .alias("i", "key"))


def close_pairs(group: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of equal ``group``; the groups lie together."""
    n, d = len(fp), 1
    first = np.arange(n)
    while True:
        first = first[first + d < n]
        first = first[group[first] == group[first + d]]
        if not len(first):
            return
        yield first, first + d
        d += 1


def _search(groups: DataFrame, bits: int, chains: list | None) -> DataFrame:
    """Links within rows (i, fps): of a ring start i, or of a pair of nibbles left out (chains None)."""
    picks = [sum(15 << (4 * k) for k in c) for c in combinations(range(16), bits)]
    chosen = list(combinations(range(16), bits))

    def run(batches):
        for b in slices(batches, 4096):
            lists = b.column("fps")
            fp = np.asarray(lists.flatten()).view(np.uint64)
            sizes = np.asarray(lists.value_lengths())
            start = np.asarray(b.column("i"))
            group = np.repeat(np.arange(len(sizes)), sizes)
            for p, q in close_pairs(group, fp):
                x, kind = fp[p] ^ fp[q], start[group[p]]
                ok = np.ones(len(x), bool)
                if chains is not None:
                    for n in range(len(chains)):  # chain length n + 1 from the pair's own start
                        mask = np.array([c[n][0] for c in chains], np.uint64)[kind]
                        ok &= np.bitwise_count(x & mask) <= np.array([c[n][1] for c in chains])[kind]
                else:
                    ok &= np.bitwise_count(x) <= bits
                    # each pair once: in the first choice of nibbles that covers its difference
                    home = np.full(len(x), -1)
                    for c in range(len(chosen) - 1, -1, -1):
                        home[(x & ~np.uint64(picks[c])) == 0] = c
                    ok &= home == kind
                if ok.any():
                    yield pa.record_batch([pa.array(fp[p[ok]].view(np.int64)), pa.array(fp[q[ok]].view(np.int64))],
                                          names=["a", "b"])
    return groups.mapInArrow(run, "a long, b long")


def links(fps: DataFrame, bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): all pairs of the distinct fingerprints ``fps`` (fp) within ``bits`` bits."""
    if bits < 1:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("a != b")
    chains = chain_masks(bits)
    agree = max(n for n, (_, budget) in enumerate(chains[0], 1) if budget == 0)
    keyed = _keyed(fps, [c[agree - 1][0] for c in chains])
    sizes = stage(keyed.groupBy("i", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    small = (keyed.join(sizes.where(F.col("n") <= bucket), ["i", "key"])
             .groupBy("i", "key").agg(F.collect_list("fp").alias("fps")).select("i", "fps"))
    hot = keyed.join(sizes.where(F.col("n") > bucket), ["i", "key"], "left_semi").select("fp").distinct()
    full = (1 << 64) - 1
    nibbles = [full & ~sum(15 << (4 * k) for k in c) for c in combinations(range(16), bits)]
    rest = (_keyed(hot, nibbles).groupBy("i", "key").agg(F.collect_list("fp").alias("fps"))
            .where(F.size("fps") > 1).select("i", "fps"))
    return _search(small, bits, chains).union(_search(rest, bits, None))


def near_duplicates(docs: DataFrame, width: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id, th, stays) for every row of ``docs``; component_id is
    the smallest doc_id reachable over links of at most ``bits`` bits. ``stays`` marks one document
    of each component: the smallest doc_id, of these the least text hash."""
    rows = stage(fingerprints(docs, width), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")  # null ids last
    fps = rows.groupBy("fp").agg(F.min(place).alias("first"))
    comps = connected_components(links(fps.select("fp"), bits))
    named = fps.join(comps, fps["fp"] == comps["node"], "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    ids = named.join(least, "component").select("fp", "least")
    return rows.join(ids, "fp").select("doc_id", "fp", F.col("least.doc_id").alias("component_id"), "th",
                                       (place == F.col("least")).alias("stays"))


def drop_near_duplicates(docs: DataFrame, width: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """``docs`` less every document that is not the one of its component that
    stays; rows of equal id and text are one document."""
    gone = near_duplicates(docs, width, bits).where("not stays").select(
        F.col("doc_id").alias("_gone"), F.col("th").alias("_th")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_gone"])
                     & (F.xxhash64(docs["text"].cast("string")) == gone["_th"]), "left_anti")
