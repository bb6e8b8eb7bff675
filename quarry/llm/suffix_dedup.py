"""Exact removal of repeated byte strings with a run-length index.

A byte goes when a string of ``window`` bytes that covers it also starts
earlier (smaller doc_id, or earlier in the same document).

1. Texts are packed into chunk rows, written once, bucketed by chunk, so that
   later joins bring small rows to the texts and never move the texts.
2. The windows of a text fall into segments of neighbours with the same
   minimiser (least hash of the ``GRAM``-byte strings in a window): equal windows
   have equal minimisers wherever they stand. Each chunk sends its distinct
   minimisers, by hash bucket, and learns which also occur elsewhere.
3. Of repeated minimisers a chunk sends each different segment once, as hash
   and place (so copies, however many, are one per chunk). A bucket finds the
   first place of every content: an equal segment at any later place is
   removed whole. Minimisers that have several contents ask for the bytes of
   each content's first segment.
4. Those go to a run-compressed Burrows-Wheeler index (``rlbwt``), whole
   minimisers in bounded batches: matching statistics are streamed and the
   windows that match an earlier place over their full length are marked.
   Minimisers in more than ``CHUNKS`` chunks, or with more than ``HOT``
   contents, are dealt anew as single windows, by each window's own hash, so no task
   or group holds one whole.
5. Marks return to their chunks, where spans are merged and cut out.

Rows between the steps are packed: one row for each chunk and bucket, with
arrays as binary columns.

Defined cases: a null or empty text has no bytes; texts shorter than a window
keep all; a null doc_id comes before all others; rows that share a doc_id are
ordered by a 32-bit hash of their text, and rows that share both are the same
document and get the same result; an empty table gives an empty result; a
text of 4 GiB or more is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bucketed, buckets_of, keyed_texts, slices, stage
from quarry.llm.rlbwt import earlier_windows

WINDOW = 100
GRAM = 24
CHUNK = 4 << 20
#: bytes that are hashed at a time: arrays that fit a core's cache
PIECE = 1 << 17
#: chunks that may hold a minimiser, and contents it may have, before it is dealt by windows
CHUNKS, HOT = 1000, 4096
#: bytes of segments indexed at a time, about
BATCH = 1 << 21
MIX = np.uint64(0x9E3779B97F4A7C15)
FIRST_ID = -(1 << 63)
WHOLE = np.uint32(0xFFFFFFFF)


def _pieces(texts: list[bytes], window: int):
    """Groups of (text number, first window, bytes) of about PIECE bytes."""
    group, size = [], 0
    for k, t in enumerate(texts):
        for lo in range(0, len(t) - window + 1, PIECE):
            group.append((k, lo, t[lo:lo + PIECE + window - 1]))
            size += len(group[-1][2])
            if size >= PIECE:
                yield group
                group, size = [], 0
    if group:
        yield group


def segments(texts: list[bytes], window: int = WINDOW):
    """(text, first window, windows, minimiser) of runs of windows with one
    minimiser at one place (the leftmost, if it repeats), so no two windows of a
    run are equal."""
    gram = min(GRAM, window)
    out = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)]
    for group in _pieces(texts, window):
        buf = b"".join([p for _, _, p in group])
        n = len(buf)
        size = np.array([len(p) for _, _, p in group])
        off = np.cumsum(size) - size
        padded = buf + b"\0" * (gram + 8)
        h = np.zeros(n, np.uint64)
        for i in range(0, gram, 8):
            lane = np.ndarray((n,), "<u8", padded, offset=i, strides=(1,))
            h ^= lane if gram - i >= 8 else lane & np.uint64((1 << 8 * (gram - i)) - 1)
            h *= MIX
            h ^= h >> np.uint64(29)
        h *= MIX
        own = h.copy()
        reach, have = window - gram + 1, 1
        while have < reach:  # least hash of ever wider ranges
            step = min(have, reach - have)
            np.minimum(h[:-step], h[step:], out=h[:-step])
            have += step
        begin = np.zeros(n, bool)
        begin[1:] = (h[1:] != h[:-1]) | (own[:-1] == h[:-1])  # the least string changes, or was the window's first
        begin[off] = True
        past = off + size - window + 1  # the first place of each piece that holds no window
        begin[past[past < n]] = True
        at = np.flatnonzero(begin)
        end = np.append(at[1:], n)
        piece = np.searchsorted(off, at, "right") - 1
        fits = at < past[piece]
        at, end, piece = at[fits], end[fits], piece[fits]
        text = np.array([k for k, _, _ in group])[piece]
        low = np.array([lo for _, lo, _ in group])[piece]
        out.append((text, at - off[piece] + low, end - at, h[at]))
    return tuple(np.concatenate(x) for x in zip(*out))


def chunked(docs: DataFrame) -> DataFrame:
    """(chunk, ids, hashes, texts): chunk rows in document order within."""
    def run(batches):
        import xxhash
        held, size, n = [], 0, 0
        part = TaskContext.get().partitionId()

        def pack():
            rows = sorted((FIRST_ID if i is None else i, xxhash.xxh32_intdigest(t), k) for k, (i, t) in enumerate(held))
            return pa.record_batch([pa.array([(part << 32) + n], pa.int64()),
                                    pa.array([[held[k][0] for _, _, k in rows]], pa.list_(pa.int64())),
                                    pa.array([[h for _, h, _ in rows]], pa.list_(pa.int64())),
                                    pa.array([[held[k][1] for _, _, k in rows]], pa.list_(pa.binary()))],
                                   names=["chunk", "ids", "hashes", "texts"])
        for b in slices(batches):
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                if len(t or b"") >> 32:
                    raise ValueError(f"document {i}: a text of 4 GiB or more")
                held.append((i, t or b""))
                size += len(t or b"") + 16
                if size >= CHUNK:
                    yield pack()
                    held, size, n = [], 0, n + 1
        if held:
            yield pack()
    return bucketed(keyed_texts(docs).mapInArrow(
        run, "chunk long, ids array<long>, hashes array<long>, texts array<binary>"), "chunk")


def packed(names: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    """Tuples as a batch; numpy arrays become binary values."""
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.record_batch([pa.array([x.tobytes() if isinstance(x, np.ndarray) else x for x in c], t)
                            for c, t in zip(cols, names.values())], names=list(names))


def deal(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order of ``hashes`` by bucket, and each bucket's range in it."""
    bucket = ((hashes >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return order, [(k, slice(a, z)) for k, (a, z) in enumerate(zip(cut.tolist(), cut[1:].tolist())) if a < z]


def flags(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


def per_chunk(rows: DataFrame, name: str) -> DataFrame:
    """(chunk, name): the packed rows of each chunk as one array, by bucket."""
    fields = [c for c in rows.columns if c != "chunk"]
    return rows.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))


def repeated_minimisers(chunks: DataFrame, window: int, most: int) -> DataFrame:
    """(chunk, bucket, twice, hot): bits of the chunk's distinct minimisers of
    a bucket, sorted: those that occur anywhere else, and those in more than ``most`` chunks."""
    buckets = buckets_of(chunks.sparkSession)
    names = {"chunk": pa.int64(), "bucket": pa.int32(), "hashes": pa.binary(), "again": pa.binary()}

    def ask(batches):
        for b in batches:
            for r in range(b.num_rows):
                h, n = np.unique(segments(b.column("texts")[r].as_py(), window)[3], return_counts=True)
                order, own = deal(h, buckets)
                chunk = b.column("chunk")[r].as_py()
                yield packed(names, [(chunk, k, h[order[at]], np.packbits(n[order[at]] > 1)) for k, at in own])

    def merge(table):
        hashes = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        every, count = np.unique(np.concatenate(hashes), return_counts=True)
        out = []
        for h, again in zip(hashes, table.column("again").to_pylist()):
            n = count[np.searchsorted(every, h)]
            out.append((np.packbits((n > 1) | flags(again, len(h))).tobytes(), np.packbits(n > most).tobytes()))
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"),
                         "twice": pa.array([x for x, _ in out], pa.binary()),
                         "hot": pa.array([x for _, x in out], pa.binary())})

    asked = chunks.select("chunk", "texts").mapInArrow(ask, "chunk long, bucket int, hashes binary, again binary")
    return asked.groupBy("bucket").applyInArrow(merge, "chunk long, bucket int, twice binary, hot binary")


def repeated_segments(chunks: DataFrame, answers: DataFrame, window: int) -> DataFrame:
    """Written once. For bucket >= 0, a chunk's different segments of repeated
    minimisers at their first place in the chunk: minimiser, content hash, doc_id, text hash,
    position, flag hot. For bucket -1, the chunk's layout (text, position, windows, number of the
    segment or WHOLE where the chunk itself holds an earlier one) in ``h``."""
    buckets = buckets_of(chunks.sparkSession)
    names = {"chunk": pa.int64(), "bucket": pa.int32(), "h": pa.binary(), "key": pa.binary(), "d": pa.binary(),
             "th": pa.binary(), "pos": pa.binary(), "hot": pa.binary()}

    def run(batches):
        from xxhash import xxh64_intdigest
        for b in batches:
            for r in range(b.num_rows):
                chunk, ids, hashes, texts, got = (b.column(c)[r].as_py() for c in ("chunk", "ids", "hashes", "texts", "answers"))
                text, pos, n, h = segments(texts, window)
                own = np.unique(h)
                order, parts = deal(own, buckets)
                twice, hot = np.zeros(len(own), bool), np.zeros(len(own), bool)
                bits = {a["bucket"]: a for a in got or []}
                for k, at in parts:
                    twice[order[at]] = flags(bits[k]["twice"], at.stop - at.start)
                    hot[order[at]] = flags(bits[k]["hot"], at.stop - at.start)
                which = np.searchsorted(own, h)
                keep = twice[which]
                text, pos, n, h, hot = text[keep], pos[keep], n[keep], h[keep], hot[which[keep]]
                key = np.array([xxh64_intdigest(texts[t][p:p + m]) for t, p, m in
                                zip(text.tolist(), pos.tolist(), (n + window - 1).tolist())], np.uint64)
                d = np.array([FIRST_ID if i is None else i for i in ids], np.int64)
                th = np.array(hashes, np.uint32)
                # the first of each content: texts and positions are in document order
                sort = np.lexsort((np.arange(len(h)), key, h))
                head = np.ones(len(h), bool)
                head[1:] = (h[sort][1:] != h[sort][:-1]) | (key[sort][1:] != key[sort][:-1])
                first = sort[head]  # of each distinct segment
                order, parts = deal(h[first], buckets)
                first = first[order]
                number = np.empty(len(order), np.int64)
                number[order] = np.arange(len(order))
                seq = np.empty(len(h), np.int64)
                seq[sort] = number[np.cumsum(head) - 1]
                lead = first[seq]
                same = (d[text] == d[text[lead]]) & (th[text] == th[text[lead]]) & (pos == pos[lead])
                layout = np.stack([text, pos, n, np.where(same, seq, int(WHOLE))]).astype(np.uint32)
                rows = [(chunk, -1, layout, None, None, None, None, None)]
                for k, at in parts:
                    f = first[at]
                    rows.append((chunk, k, h[f], key[f], d[text[f]], th[text[f]], pos[f].astype(np.uint32), np.packbits(hot[f])))
                yield packed(names, rows)
    joined = chunks.join(per_chunk(answers, "answers"), "chunk", "left").select("chunk", "ids", "hashes", "texts", "answers")
    return bucketed(joined.mapInArrow(run, "chunk long, bucket int, h binary, key binary, d binary, th binary, pos binary, hot binary"),
                    "chunk")


def first_places(found: DataFrame, hot: int) -> DataFrame:
    """(chunk, bucket, n, later, wanted, single): bits of a chunk's segments of a
    bucket: a later place of a content, the first place of one that has to be
    indexed, one that has to be dealt by windows."""
    def merge(table):
        cols = {c: [np.frombuffer(x, t) for x in table.column(c).to_pylist()]
                for c, t in (("h", np.uint64), ("key", np.uint64), ("d", np.int64), ("th", np.uint32), ("pos", np.uint32))}
        size = np.array([len(x) for x in cols["h"]])
        h, key, d, th, pos = (np.concatenate(x) for x in cols.values())
        shared = np.concatenate([flags(x, n) for x, n in zip(table.column("hot").to_pylist(), size.tolist())])
        sort = np.lexsort((pos, th, d, key, h))
        h, key, d, th, pos = (x[sort] for x in (h, key, d, th, pos))
        change = lambda *xs: np.concatenate(([True], np.any([x[1:] != x[:-1] for x in xs], 0)))
        content, minimiser = change(h, key), change(h)
        lead = np.maximum.accumulate(np.where(content, np.arange(len(h)), 0))
        is_first = (d == d[lead]) & (th == th[lead]) & (pos == pos[lead])
        kinds = np.add.reduceat(content, np.flatnonzero(minimiser))[np.cumsum(minimiser) - 1]
        many = (kinds > hot) | shared[sort]
        # bits go back in the order in which they came
        back = np.empty((3, len(h)), bool)
        back[0, sort] = ~is_first
        back[1, sort] = is_first & (kinds > 1) & ~many
        back[2, sort] = is_first & (kinds > 1) & many
        cut = np.cumsum(size) - size
        bits = [[np.packbits(x[a:a + n]).tobytes() for a, n in zip(cut.tolist(), size.tolist())] for x in back]
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "n": pa.array(size, pa.int32()),
                         **{c: pa.array(x, pa.binary()) for c, x in zip(("later", "wanted", "single"), bits)}})
    return stage(found.where("bucket >= 0").groupBy("bucket").applyInArrow(
        merge, "chunk long, bucket int, n int, later binary, wanted binary, single binary"), "places")


def _replies(replies: list, n: int) -> np.ndarray:
    """(3, n): later, wanted and single of all segments of a chunk, whose buckets follow each other."""
    out = np.zeros((3, n), bool)
    at = 0
    for a in replies:
        for k, c in enumerate(("later", "wanted", "single")):
            out[k, at:at + a["n"]] = flags(a[c], a["n"])
        at += a["n"]
    return out


def offset_type(window: int) -> type:
    """Type of a window's offset in its segment: a segment has at most window - gram + 1 windows."""
    return np.uint8 if window - min(GRAM, window) < 256 else np.uint32


def asked_segments(met: DataFrame, window: int) -> DataFrame:
    """(kind, bucket, chunk, ...): bytes and places of the wanted segments
    (kind 0), hashes and places of the windows of single ones (kind 1)."""
    buckets = buckets_of(met.sparkSession)
    names = {"kind": pa.int32(), "bucket": pa.int32(), "chunk": pa.int64(), "h": pa.binary(), "w": pa.binary(), "seq": pa.binary(),
             "d": pa.binary(), "th": pa.binary(), "pos": pa.binary(), "x": pa.binary(), "bytes": pa.binary()}

    def run(batches):
        from xxhash import xxh3_128_digest
        for b in batches:
            for r in range(b.num_rows):
                chunk, ids, hashes, texts, layout, got = (
                    b.column(c)[r].as_py() for c in ("chunk", "ids", "hashes", "texts", "layout", "replies"))
                text, pos, n, seq = np.frombuffer(layout or b"", np.uint32).reshape(4, -1).astype(np.int64)
                own = np.flatnonzero(seq != int(WHOLE))
                own = own[np.unique(seq[own], return_index=True)[1]]  # one place of each segment, by its number
                _, wanted, single = _replies(got or [], len(own))
                d = np.array([FIRST_ID if i is None else i for i in ids], np.int64)
                th = np.array(hashes, np.uint32)
                for kind, ask in ((0, wanted), (1, single)):
                    at = own[ask]
                    if not len(at):
                        continue
                    raw = [texts[t][p:p + m] for t, p, m in
                           zip(text[at].tolist(), pos[at].tolist(), (n[at] + window - 1).tolist())]
                    x = np.zeros(len(at), offset_type(window))
                    if kind:  # every window by itself
                        x = np.concatenate([np.arange(m, dtype=offset_type(window)) for m in n[at].tolist()])
                        raw = [s[i:i + window] for s, m in zip(raw, n[at].tolist()) for i in range(m)]
                        at = np.repeat(at, n[at])
                        both = np.frombuffer(b"".join(map(xxh3_128_digest, raw)), np.uint64).reshape(-1, 2)
                        h, w = both[:, 0], both[:, 1]
                    else:  # dealt by the minimiser, computed once more from a window of each
                        h = segments([s[:window] for s in raw], window)[3]
                        w = np.array([len(s) for s in raw], np.uint64)
                    order, parts = deal(h, buckets)
                    rows = []
                    for k, part in parts:
                        f = order[part]
                        g = at[f]
                        rows.append((kind, k, chunk, h[f], w[f], seq[g].astype(np.uint32), d[text[g]], th[text[g]],
                                     (pos[g] + x[f]).astype(np.uint32), x[f], None if kind else b"".join([raw[i] for i in f.tolist()])))
                    yield packed(names, rows)
    return met.mapInArrow(run, "kind int, bucket int, chunk long, h binary, w binary, seq binary, d binary, th binary, "
                               "pos binary, x binary, bytes binary")


def marked_windows(asked: DataFrame, window: int) -> DataFrame:
    """(chunk, seq, x): packed numbers of segments and offsets of their windows that start earlier elsewhere."""
    def marks(table):
        read = lambda c, t: [np.frombuffer(x, t) for x in table.column(c).to_pylist()]
        size = [len(x) for x in read("seq", np.uint32)]
        h, w, seq, d, th, pos, x = (np.concatenate(read(c, t)) for c, t in (
            ("h", np.uint64), ("w", np.uint64), ("seq", np.uint32), ("d", np.int64), ("th", np.uint32), ("pos", np.uint32),
            ("x", offset_type(window))))
        owner = np.repeat(np.arange(len(size)), size)
        if table.column("kind")[0].as_py():
            sort = np.lexsort((pos, th, d, w, h))
            same = lambda *xs: np.all([v[sort][1:] == v[sort][:-1] for v in xs], 0)
            head = np.concatenate(([True], ~same(h, w)))
            lead = sort[np.maximum.accumulate(np.where(head, np.arange(len(sort)), 0))]
            later = (d[sort] != d[lead]) | (th[sort] != th[lead]) | (pos[sort] != pos[lead])
            row, off = sort[later], x[sort[later]]
        else:
            blob = table.column("bytes").to_pylist()
            ends = np.cumsum(w.astype(np.int64))
            start = np.cumsum([0] + [len(v) for v in blob])
            joined = memoryview(b"".join(blob))
            assert start[-1] == (ends[-1] if len(ends) else 0)
            docs, doc = np.unique(np.stack([d, th.astype(np.int64)], 1), axis=0, return_inverse=True)
            place = (doc.astype(np.int64) << 32) + pos  # in document order
            sort = np.argsort(h, kind="stable")
            size_of = w.astype(np.int64)[sort]
            # whole minimisers, about BATCH bytes of them at a time
            last = np.concatenate((h[sort][1:] != h[sort][:-1], [True]))
            row, off, lo, held = [], [], 0, 0
            for k in np.flatnonzero(last).tolist():
                held = int(size_of[lo:k + 1].sum())
                if held >= BATCH or k + 1 == len(sort):
                    some = sort[lo:k + 1]
                    found = earlier_windows([bytes(joined[ends[i] - int(w[i]):ends[i]]) for i in some.tolist()], place[some], window)
                    row += [np.repeat(i, len(f)) for i, f in zip(some.tolist(), found)]
                    off += found
                    lo = k + 1
            row, off = np.concatenate(row).astype(np.int64), np.concatenate(off).astype(offset_type(window))
        out = []
        chunk = table.column("chunk").to_pylist()
        order = np.argsort(owner[row], kind="stable")
        row, off = row[order], off[order]
        cut = np.searchsorted(owner[row], np.arange(len(size) + 1))
        for k, (a, z) in enumerate(zip(cut.tolist(), cut[1:].tolist())):
            if a < z:
                out.append((chunk[k], seq[row[a:z]].tobytes(), off[a:z].tobytes()))
        cols = list(zip(*out)) if out else [[], [], []]
        return pa.table({"chunk": pa.array(cols[0], pa.int64()), "seq": pa.array(cols[1], pa.binary()), "x": pa.array(cols[2], pa.binary())})
    return asked.groupBy("kind", "bucket").applyInArrow(marks, "chunk long, seq binary, x binary")


def find_repeats(docs: DataFrame, window: int = WINDOW, hot: int = HOT, most_chunks: int = CHUNKS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept): for every row the
    maximal removed byte runs (first, end) and the remaining bytes."""
    chunks = chunked(docs)
    found = repeated_segments(chunks, repeated_minimisers(chunks, window, most_chunks), window)
    places = per_chunk(first_places(found, hot), "replies")
    layouts = found.where("bucket = -1").select("chunk", F.col("h").alias("layout"))
    met = chunks.join(layouts, "chunk", "left").join(places, "chunk", "left")
    marks = per_chunk(marked_windows(asked_segments(met, window), window), "marks")

    def run(batches):
        names = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(),
                 "spans": pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])), "kept": pa.binary()}
        for b in batches:
            for r in range(b.num_rows):
                ids, texts, layout, got, found = (b.column(c)[r].as_py() for c in ("ids", "texts", "layout", "replies", "marks"))
                size = np.fromiter(map(len, texts), np.int64, len(texts))
                off = np.cumsum(size + 1) - size - 1  # a byte between texts keeps their runs apart
                text, pos, n, seq = np.frombuffer(layout or b"", np.uint32).reshape(4, -1).astype(np.int64)
                place = off[text] + pos
                own = seq != int(WHOLE)
                count = int(seq[own].max()) + 1 if own.any() else 0
                later = np.append(_replies(got or [], count)[0], True)  # the last stands for WHOLE
                gone = later[np.where(own, seq, count)]
                cover = np.zeros(int((size + 1).sum()) + 1, np.int32)
                np.add.at(cover, place[gone], 1)
                np.add.at(cover, place[gone] + n[gone] + window - 1, -1)
                if found:
                    mark = np.concatenate([np.frombuffer(f["seq"], np.uint32) for f in found]).astype(np.int64)
                    x = np.concatenate([np.frombuffer(f["x"], offset_type(window)) for f in found]).astype(np.int64)
                    order = np.argsort(mark, kind="stable")
                    mark, x = mark[order], x[order]
                    rest = np.flatnonzero(own & ~gone)  # the places (of one document) that marks speak of
                    a, z = np.searchsorted(mark, seq[rest]), np.searchsorted(mark, seq[rest], "right")
                    row = np.repeat(np.arange(len(rest)), z - a)
                    nth = np.arange(len(row)) - np.repeat(np.cumsum(z - a) - (z - a), z - a) + a[row]
                    at = place[rest[row]] + x[nth]
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + window, -1)
                change = np.diff(np.concatenate(([0], np.cumsum(cover) > 0, [0])).astype(np.int8))
                a, z = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
                cut = np.searchsorted(a, np.append(off, cover.size)).tolist()
                out = []
                for k, t in enumerate(texts):
                    at, kept, gone_bytes = 0, [], 0
                    runs = list(zip((a[cut[k]:cut[k + 1]] - off[k]).tolist(), (z[cut[k]:cut[k + 1]] - off[k]).tolist()))
                    for first, end in runs:
                        kept.append(t[at:first])
                        at, gone_bytes = end, gone_bytes + end - first
                    kept.append(t[at:])
                    out.append((ids[k], len(t), gone_bytes, len(runs), [{"first": f, "end": e} for f, e in runs], b"".join(kept)))
                for at in range(0, len(out), 1024):
                    yield packed(names, out[at:at + 1024])
    return (met.select("chunk", "ids", "texts", "layout", "replies").join(marks, "chunk", "left")
            .select("ids", "texts", "layout", "replies", "marks")
            .mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, "
                             "spans array<struct<first:long,end:long>>, kept binary"))


def oracle(table: str = "documents", window: int = WINDOW) -> str:
    """DuckDB SQL for ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, for
    tables whose doc_id is unique: every window of every text, as hex digits."""
    return f"""
with t as (select doc_id, hex(encode(coalesce(text, ''))) as x from {table}),
b as (select doc_id, p, substr(x, 2 * p - 1, 2) as byte,
             case when p + {window - 1} <= len(x) // 2 then hash(substr(x, 2 * p - 1, {2 * window})) end as w
      from (select doc_id, x, unnest(range(1, len(x) // 2 + 1)) as p from t)),
f as (select *, w is not null and row_number() over (partition by w order by doc_id, p) > 1 as later from b),
m as (select doc_id, p, byte, coalesce(max(case when later then p end) over (partition by doc_id order by p)
                                       > p - {window}, false) as gone from f),
s as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by p), false) as starts from m),
k as (select doc_id, count(*) as n, count(*) filter (where gone) as r, count(*) filter (where starts) as q,
             string_agg(byte, '' order by p) filter (where not gone) as kept from s group by doc_id)
select t.doc_id as doc_id, cast(coalesce(n, 0) as bigint) as n_bytes, cast(coalesce(r, 0) as bigint) as n_removed,
       cast(coalesce(q, 0) as bigint) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256
from t left join k on t.doc_id = k.doc_id"""
