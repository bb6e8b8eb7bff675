"""Benchmark decontamination with an FM-index per training shard.

A task packs documents into shards of about ``SHARD`` bytes. A shard's words
become symbols (benchmark words by number, any other word ends a run), runs
shorter than the shortest window can't hold one and are left out, and an
FM-index is built over the rest: suffix order, Burrows-Wheeler transform, a
wavelet matrix for its ranks, and suffix positions sampled at every
``SAMPLE``-th symbol and at each run's start. All benchmark windows are
searched backwards together; the rows found walk to the next sampled position;
the occurrences' spans are merged.

The benchmark is read in blocks of at most ``BLOCK`` bytes of text (one block
unless it is larger), each collected and broadcast in a pass of its own, so
its size is checked, not assumed. A block is held as arrays (about twenty bytes a
window) and the numbers of its distinct words. Documents are never shuffled with one block;
with more, the passes' spans meet in an aggregate by row.

Defined cases: a null text has no words and a null or wordless item no
window; an item of fewer than ``WINDOW`` words is one window; a null item_id
is listed as 'null'; items that repeat an id are one item; repeated documents
each get a row; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import keyed_texts, slices, stage, text_bytes

WINDOW = 13
SHARD = 4 << 20
#: bytes of benchmark text held as phrases at a time
BLOCK = 8 << 20
#: windows searched at a time
WINDOWS = 1 << 18
SAMPLE = 16


def _table() -> bytes:
    """ASCII letters lower-cased, digits and bytes from 128 kept, the rest a space."""
    t = bytearray(b" " * 256)
    t[128:] = bytes(range(128, 256))
    t[48:58] = bytes(range(48, 58))
    t[97:123] = t[65:91] = bytes(range(97, 123))
    return bytes(t)


TABLE = _table()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def window_numbers(flat: np.ndarray, n: int) -> np.ndarray:
    """For each place of ``flat`` that ``n`` symbols follow, a number that two places
    share exactly if their windows are equal: numbers of lengths 1, 2, 4, ... in pairs."""
    def pair(x, length, y):
        y = y[length:]
        key = x[:len(y)] * (int(y.max()) + 1 if len(y) else 1) + y
        return np.unique(key, return_inverse=True)[1].astype(np.int64)

    power, size, out, length = flat.astype(np.int64), 1, None, 0
    while size <= n:
        if n & size:
            out, length = (power, size) if out is None else (pair(out, length, power), length + size)
        if 2 * size <= n:
            power = pair(power, size, power)
        size *= 2
    return out


class Phrases:
    """A block of benchmark items as one array of symbols, and the distinct
    windows in it by length: (length, places of a first copy, and for each window the
    range ``cut`` of ``owner``, which holds item numbers). Arrays only, beside the
    words' numbers and the names of the items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.symbol: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        rows = [np.fromiter((self.symbol.setdefault(w, len(self.symbol) + 1) for w in words_of((text or "").encode())),
                            np.int32) for _, text in items]
        self.flat = np.concatenate([np.zeros(0, np.int32), *rows])
        sizes = np.array([len(r) for r in rows], np.int64)
        del rows
        first = np.cumsum(sizes) - sizes
        self.by_size = []
        for n in np.unique(np.minimum(sizes[sizes > 0], window)).tolist():
            mine = np.flatnonzero(np.minimum(sizes, window) == n)
            count = sizes[mine] - n + 1  # one, of an item shorter than a window
            start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - first[mine], count)
            owner = np.repeat(mine, count).astype(np.int32)
            _, copy, number = np.unique(window_numbers(self.flat, n)[start], return_index=True, return_inverse=True)
            cut = np.append(0, np.cumsum(np.bincount(number, minlength=len(copy))))
            self.by_size.append((n, start[copy], cut, owner[np.argsort(number, kind="stable")]))
        self.shortest = self.by_size[0][0] if self.by_size else 0


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Suffix array of symbols, in which every 0 is an end of its own (earlier
    ones smaller), by prefix doubling over ranks."""
    n = len(s)
    zeros = s == 0
    rank = np.where(zeros, np.cumsum(zeros) - 1, s + int(zeros.sum())).astype(np.int64)
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        key = rank[order]
        new = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        rank[order] = new
        if new[-1] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[:n - step] = rank[step:] + 1
        rank = rank * (n + 1) + after
        order = np.argsort(rank, kind="stable")
        step *= 2


class WaveletMatrix:
    """Rank of a symbol before a position, bit plane by bit plane."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.planes = []
        for bit in range(max(1, top.bit_length()) - 1, -1, -1):
            on = (symbols >> bit) & 1
            ones = np.concatenate(([0], np.cumsum(on, dtype=np.int32))).astype(np.int32)
            self.planes.append((bit, ones, len(symbols) - int(ones[-1])))
            symbols = np.concatenate((symbols[on == 0], symbols[on == 1]))
        self.first = self._descend(np.arange(top + 1), np.zeros(top + 1, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, ones, zeros in self.planes:
            one = ones[at]
            at = np.where((symbol >> bit) & 1, zeros + one, at - one)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._descend(symbol, at) - self.first[symbol]


class FmIndex:
    def __init__(self, s: np.ndarray, top: int):
        """``s``: symbols 1..top in runs that each end with a 0."""
        order = suffix_order(s)
        self.n = len(s)
        self.bwt = s[order - 1]  # the first symbol's neighbour is the last 0
        self.less = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=top + 1))))
        self.tree = WaveletMatrix(self.bwt, top)
        starts = np.concatenate(([True], s[:-1] == 0))
        kept = (np.arange(self.n) % SAMPLE == 0) | starts
        self.sampled = np.where(kept[order], order, -1)

    def back(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.less[symbol] + self.tree.rank(symbol, at)

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, low, high) of the windows that occur."""
        live = np.arange(len(windows))
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.n)
        for k in range(windows.shape[1] - 1, -1, -1):
            c = windows[live, k]
            low, high = self.back(c, low), self.back(c, high)
            some = low < high
            live, low, high = live[some], low[some], high[some]
        return live, low, high

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into low, text position) of every row of the ranges."""
        sizes = high - low
        owner = np.repeat(np.arange(len(low)), sizes)
        row = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[owner]
        out, steps, live = np.zeros(len(row), np.int64), 0, np.arange(len(row))
        while len(live):
            at = self.sampled[row]
            done = at >= 0
            out[live[done]] = at[done] + steps
            live, row = live[~done], row[~done]
            row = self.back(self.bwt[row], row)
            steps += 1
        return owner, out


def find(texts: list[bytes], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """For each text of a shard: its number of words, merged spans of hit
    words (first, one past the last), and the items with a window in it."""
    ids, sizes = [], []
    for text in texts:
        words = words_of(text)
        sizes.append(len(words))
        ids.append(np.fromiter(map(phrases.symbol.get, words, repeat(0)), np.int64, len(words)))
        ids.append(np.zeros(1, np.int64))
    spans: list[list] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    inside = np.diff(np.concatenate(([0], flat > 0, [0])).astype(np.int8))
    a, b = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
    long = b - a >= max(1, phrases.shortest)
    a, b = a[long], b[long]
    if len(a) and phrases.by_size:
        first = np.cumsum([0] + [n + 1 for n in sizes])[:-1]  # of each text in flat
        width = b - a + 1  # with the 0 that ends the run
        start = np.cumsum(width) - width
        place = np.arange(width.sum()) - np.repeat(start - a, width)  # in flat, of each symbol of s
        s = flat[place]
        s[start + width - 1] = 0
        index = FmIndex(s, len(phrases.symbol))
        cover = np.zeros(len(flat) + 1, np.int64)
        for n, start, cut, item in phrases.by_size:
            for lo in range(0, len(start), WINDOWS):
                window, low, high = index.search(phrases.flat[start[lo:lo + WINDOWS, None] + np.arange(n)])
                owner, at = index.locate(low, high)
                at = place[at]
                np.add.at(cover, at, 1)
                np.add.at(cover, at + n, -1)
                text = np.searchsorted(first, at, "right") - 1
                for t, w in np.unique(np.stack((text, lo + window[owner]), 1), axis=0).tolist() if len(at) else []:
                    items[t].update(phrases.names[i] for i in item[cut[w]:cut[w + 1]].tolist())
        hit = np.diff(np.concatenate(([0], np.cumsum(cover[:-1]) > 0, [0])).astype(np.int8))
        for x, y in zip(np.flatnonzero(hit == 1).tolist(), np.flatnonzero(hit == -1).tolist()):
            t = int(np.searchsorted(first, x, "right")) - 1
            spans[t].append((x - int(first[t]), y - int(first[t])))
    return [(n, p, sorted(i)) for n, p, i in zip(sizes, spans, items)]


def _pass(rows: DataFrame, items: list, window: int) -> DataFrame:
    """One pass of a benchmark block over ``rows`` (key columns and text)."""
    phrases = rows.sparkSession.sparkContext.broadcast(Phrases(items, window))
    keys = [c for c in rows.columns if c != "text"]

    def run(batches):
        for b in slices(batches, 1024):
            texts = text_bytes(b.column("text"))
            got, shard, size = [], [], 0
            for t in texts:
                shard.append(t)
                size += len(t)
                if size >= SHARD:
                    got += find(shard, phrases.value)
                    shard, size = [], 0
            got += find(shard, phrases.value)
            yield pa.record_batch(
                [*(b.column(c) for c in keys), pa.array([n for n, _, _ in got], pa.int64()),
                 pa.array([[{"first": x, "last": y - 1} for x, y in p] for _, p, _ in got],
                          pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                 pa.array([i for _, _, i in got], pa.list_(pa.string()))],
                names=[*keys, "n_words", "spans", "items"])
    types = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "text")
    return rows.mapInArrow(run, f"{types}, n_words long, spans array<struct<first:long,last:long>>, items array<string>")


def _union_spans(spans):
    """Spans of several passes, sorted and merged (touching ones too)."""
    def add(done, s):
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["last"] >= s["first"] - 1)
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            last["first"].alias("first"), F.greatest(last["last"], s["last"]).alias("last"))))).otherwise(
            F.concat(done, F.array(s)))
    return F.aggregate(F.array_sort(spans), F.slice(spans, 1, 0), add)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK,
                       keys: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_hit, spans of hit words, items, contaminated, and the
    columns ``keys`` of ``docs``) for every row."""
    texts = benchmark.select(F.coalesce(benchmark["item_id"].cast("string"), F.lit("null")).alias("item"),
                             benchmark["text"].cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    blocks = int(size // block) + 1
    rows = keyed_texts(docs, *keys)
    if blocks == 1:
        out = _pass(rows, [tuple(r) for r in texts.collect()], window)
    else:
        numbered = stage(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
        passes = None
        for k in range(blocks):
            some = texts.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
            part = _pass(numbered, [tuple(r) for r in some.collect()], window)
            passes = part if passes is None else passes.union(part)
        out = (passes.groupBy("row").agg(*[F.any_value(c).alias(c) for c in ("doc_id", *keys, "n_words")],
                                         F.flatten(F.collect_list("spans")).alias("spans"),
                                         F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
               .withColumn("spans", _union_spans(F.col("spans"))).withColumn("items", F.array_sort("items")))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return (out.withColumn("n_hit", hit)
            .select("doc_id", "n_words", "n_hit", "spans", "items",
                    ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), *keys))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` less the contaminated documents (told apart by id and text)."""
    told = docs.select(docs["doc_id"], docs["text"], F.xxhash64(docs["text"].cast("string")).alias("th"))
    bad = (find_contamination(told, benchmark, window, keys=("th",)).where("contaminated")
           .select(F.col("doc_id").alias("_bad"), F.col("th").alias("_th")).distinct())
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["_bad"])
                     & (F.xxhash64(docs["text"].cast("string")) == bad["_th"]), "left_anti")


def oracle(documents: str = "documents", benchmark: str = "benchmark", window: int = WINDOW) -> str:
    """DuckDB SQL for ``doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated``, for tables whose doc_id is unique."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
with d as (select doc_id, {words} as w from {documents}),
i as (select coalesce(cast(item_id as varchar), 'null') as item, {words} as w from {benchmark}),
g as (select distinct item, list_slice(w, p, p + {window - 1}) as win
      from (select item, w, unnest(range(1, greatest(1, len(w) - {window - 1}) + 1)) as p from i where len(w) > 0)),
n as (select distinct len(win) as n from g),
a as (select doc_id, n, p, list_slice(w, p, p + n - 1) as win
      from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from d, n where len(w) >= n)),
h as (select a.doc_id, a.n, a.p, g.item from a join g on a.win = g.win),
c as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from h) group by doc_id),
x as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
      from (select distinct doc_id, item from h) group by doc_id)
select d.doc_id as doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from d left join c on d.doc_id = c.doc_id left join x on d.doc_id = x.doc_id"""
