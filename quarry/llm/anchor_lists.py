"""Hard negatives by lists that the anchors of a cluster share.

Vectors become integers (floor of 256 x); scores are integer inner products.
Every row goes to the nearest (by angle) of ``PIVOTS`` pivots; the anchors of one pivot
are a cluster, and the candidates of one pivot are dealt by hash into blocks of about
``BLOCK`` rows. Where a cluster meets a block, the candidates are put once into the order of

    |x| cos(max(0, t(x) - t_max, t_min - t(x)))

(t: angle to the cluster's pivot; t_min, t_max: those of the cluster's anchors),
which times |a| bounds every member's score. Each member walks that list
until the bound falls under what its results need, which certifies the rest away.

A request is a window of scores with a number of rows. A first walk over one near
block each gives the score that a request surely reaches; the second walk meets every block
of every pivot that the anchor's angle to it leaves room for, and starts from that score.
So the positives are found (rows of the anchor's label, no window), then the negatives
(other labels, a window for each positive), and one window function keeps the first k.

Candidates and anchors meet as plain rows sorted by block, so a task holds
one block of candidates and one slice of anchors. Pivots and their counts
(``PIVOTS`` rows) are all that passes through the driver.

Defined cases: rows with a null id, label or vector, or a null, NaN or infinite
component take no part; vectors of different length are compared as if
the shorter were filled up with zeros (an empty one scores 0); each repeated row is a row of its
own, so a second row with an anchor's id is another anchor and a candidate; ties go to the smaller id;
scores that may pass 2^49 are added up as Python integers; a component of 2^44 or more in size is an
error, as is a score that leaves 64 bits; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import stage
from quarry.session import ship_package

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: per cent of the positive's score that a negative's score lies between
LOW, HIGH = 30, 90
PIVOTS, BLOCK = 64, 2048
#: anchors that walk a list together, and list entries between two looks at the bounds
SLICE, STEP = 256, 256
NOTHING = -(2 ** 63 - 1)
REQUEST = "array<struct<lo: long, hi: long, least: long>>"


def usable_rows(vectors: DataFrame, relabel: Column | None = None) -> DataFrame:
    """(rid, vec_id, label, v) of the rows that take part; rid tells rows apart."""
    x = F.transform(vectors["embedding"], lambda c: c.cast("double") * SCALE)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["label"].cast("long").alias("label"), x.alias("x"), bad.alias("bad"))
    rows = rows.where("vec_id is not null and label is not null and x is not null and not bad")
    whole = F.transform("x", lambda c: F.when(F.abs(c) < float(1 << 52), F.floor(c)).otherwise(F.raise_error(F.lit("a component of 2^44 or more"))))
    return rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id",
                       ("label" if relabel is None else relabel.alias("label")), whole.cast("array<long>").alias("v"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """A list column as rows of a matrix, shorter lists filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out


def _wide(m: np.ndarray, n: int) -> np.ndarray:
    return m if m.shape[1] >= n else np.pad(m, ((0, 0), (0, n - m.shape[1])))


def _norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m.astype(float) ** 2).sum(1))


def _angles(m: np.ndarray, norms: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angle of each row to each pivot; 0 where either has no direction."""
    n = max(m.shape[1], pivots.shape[1])
    size = norms[:, None] * _norms(pivots)
    cos = np.divide(_wide(m, n).astype(float) @ _wide(pivots, n).T.astype(float), size, out=np.ones_like(size), where=size > 0)
    return np.arccos(np.clip(cos, -1, 1))


def walk(x: np.ndarray, ids: np.ndarray, labels: np.ndarray, rids: np.ndarray, a: np.ndarray, a_labels: np.ndarray, a_rids: np.ndarray,
         requests: list[list[tuple[int, int, int]]], pivot: np.ndarray, same: bool, k: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(anchor, request, candidate, score, entries seen by the anchor) of each anchor's first k
    candidates for each of its requests (lowest score, highest score, score surely reached)."""
    n = max(x.shape[1], a.shape[1])
    x, a = _wide(x, n), _wide(a, n)
    xn, an = _norms(x), _norms(a)
    turn, own = _angles(x, xn, pivot[None])[:, 0], _angles(a, an, pivot[None])[:, 0]
    gap = np.maximum(0, np.maximum(turn - own.max(), own.min() - turn))
    bound = xn * np.cos(np.minimum(gap, math.pi))
    order = np.argsort(-bound, kind="stable")  # the list that all members share
    slack = 1e-9 * an * xn.max(initial=0) + 1e-3
    tie = np.empty(len(ids), np.int64)
    tie[np.lexsort((rids, ids))[::-1]] = np.arange(len(ids))  # larger for smaller ids
    bits = len(ids).bit_length()  # low bits of a key: the order of equal scores
    exact = an.max() * xn.max(initial=0) < 2.0 ** min(49, 61 - bits)
    kind = np.int64 if exact else object
    wide = max(map(len, requests))
    never = -NOTHING
    lo, hi, least = (np.array([[r[c] for r in q] + [[never, NOTHING, never][c]] * (wide - len(q)) for q in requests], np.int64) for c in range(3))
    floor = np.maximum(lo, least)
    best = np.full((len(a), wide, k), NOTHING if exact else NOTHING << bits, kind)
    none = best[0, 0, 0]
    seen = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    af, xf = (a.astype(float), x.astype(float)) if exact else (a.astype(object), x.astype(object))
    for at in range(0, len(order), STEP):
        live = live[bound[order[at]] * an[live] + slack[live] >= floor[live].min(1).astype(float)]
        if not len(live):
            break
        part = order[at:at + STEP]
        seen[live] += len(part)
        score = af[live] @ xf[part].T
        score = np.rint(score).astype(np.int64) if exact else score
        open_ = (labels[part] == a_labels[live, None]) == same
        open_ &= rids[part] != a_rids[live, None]
        keys = score * (1 << bits) + tie[part].astype(kind)
        for w in range(wide):
            good = open_ & (score >= floor[live, w, None]) & (score <= hi[live, w, None])
            rows = np.flatnonzero(good.any(1))
            if not len(rows):
                continue
            who = live[rows]
            both = np.concatenate([best[who, w], np.where(good[rows], keys[rows], none)], axis=1)
            best[who, w] = np.sort(both, axis=1)[:, :-k - 1:-1] if not exact else -np.sort(np.partition(-both, k - 1, axis=1)[:, :k], axis=1)
            full = best[who, w, k - 1] > none
            floor[who[full], w] = np.maximum(floor[who[full], w], (best[who[full], w, k - 1] // (1 << bits)).astype(np.int64))
    by_tie = np.argsort(tie)
    for r, w, c in zip(*np.nonzero(best > none)):
        key = int(best[r, w, c])
        yield int(r), int(w), int(by_tie[key % (1 << bits)]), key >> bits, int(seen[r])


_ASKED = "cell int, block int, home int, rid long, vec_id long, label long, v array<long>, requests " + REQUEST
_FOUND = pa.schema([("rid", pa.int64()), ("request", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


class HardNegatives:
    """Rows dealt to pivots and blocks, and the two walks over them."""

    def __init__(self, vectors: DataFrame, is_anchor: Column, relabel: Column | None = None):
        ship_package(vectors.sparkSession)
        rows = usable_rows(vectors, relabel)
        picked = rows.where(F.exists("v", lambda c: c != 0)).orderBy(F.xxhash64("vec_id"), "vec_id", "rid").limit(PIVOTS).select("v").collect()
        wide = max([len(r.v) for r in picked], default=1)
        pivots = self.pivots = np.array([list(r.v) + [0] * (wide - len(r.v)) for r in picked] or [[0]], np.int64)

        def place(batches):
            for b in batches:
                m = _matrix(b.column("v"))
                t = _angles(m, _norms(m), pivots)
                home = t.argmin(1)
                yield pa.record_batch([*b.columns, pa.array(home.astype(np.int32)), pa.array(t[np.arange(len(t)), home]), pa.array(_norms(m))],
                                      names=["rid", "vec_id", "label", "v", "cell", "angle", "norm"])
        self.rows = stage(rows.mapInArrow(place, "rid long, vec_id long, label long, v array<long>, cell int, angle double, norm double"), "placed")
        self.anchors = self.rows.where(is_anchor)
        stats = self.rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("angle"), F.max("norm").alias("norm")).collect()
        self.cells = {r.cell: (max(1, math.ceil(r.n / BLOCK)), r.angle, r.norm) for r in stats}  # at most PIVOTS
        blocks = F.create_map(*[F.lit(x) for c, (n, *_) in self.cells.items() for x in (c, n)]) if self.cells else F.lit(None).cast("map<int,int>")
        self.n_blocks = F.element_at(blocks, F.col("cell"))
        self.dealt = self.rows.select("cell", F.pmod(F.xxhash64("rid"), self.n_blocks).cast("int").alias("block"), F.lit(None).cast("int").alias("home"),
                                      "rid", "vec_id", "label", "v", F.lit(None).cast(REQUEST).alias("requests"))

    def met(self, asked: DataFrame, same: bool, k: int) -> DataFrame:
        """(rid, request, vec_id, score): each block's first k for each anchor laid to it."""
        pivots = self.pivots

        def run(batches):
            held: list[pa.RecordBatch] = []
            at = x = None
            waiting: list = []

            def done():
                if not waiting:
                    return None
                home = waiting[0][0]
                a = _matrix(pa.concat_arrays([w[3] for w in waiting]))
                found = [(waiting[r][1], w, int(x[1][c]), s) for r, w, c, s, _ in walk(
                    *x, a, np.array([w[2] for w in waiting]), np.array([w[1] for w in waiting]), [w[4] for w in waiting], pivots[home], same, k)]
                waiting.clear()
                return pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*found), _FOUND)], schema=_FOUND) if found else None

            for b in batches:
                place = np.array(list(zip(b.column("cell").to_pylist(), b.column("block").to_pylist())))
                home = b.column("home")
                asks = np.array(home.is_valid().to_numpy(zero_copy_only=False))
                turns = np.flatnonzero((place[1:] != place[:-1]).any(1) | (asks[1:] != asks[:-1])) + 1
                for lo, hi in zip([0, *turns], [*turns, len(place)]):
                    part = b.slice(int(lo), int(hi - lo))
                    here = tuple(place[lo])
                    if here != at:
                        if (out := done()) is not None:
                            yield out
                        at, x, held = here, None, []
                    if not asks[lo]:
                        held.append(part)
                        continue
                    if x is None:
                        if not held:
                            continue
                        c = pa.Table.from_batches(held).combine_chunks()
                        x = (_matrix(c.column("v")), *(c.column(n).to_numpy() for n in ("vec_id", "label", "rid")))
                        held = []
                    for k_, (h, rid, label, asked_) in enumerate(zip(*(part.column(n).to_pylist() for n in ("home", "rid", "label", "requests")))):
                        if waiting and (waiting[0][0] != h or len(waiting) >= SLICE):
                            if (out := done()) is not None:
                                yield out
                        waiting.append((h, rid, label, part.column("v").slice(k_, 1), [(q["lo"], q["hi"], q["least"]) for q in asked_]))
            if (out := done()) is not None:
                yield out

        rows = self.dealt.unionByName(asked).repartition("cell", "block").sortWithinPartitions("cell", "block", F.col("home").asc_nulls_first())
        return rows.mapInArrow(run, "rid long, request int, vec_id long, score long")

    @staticmethod
    def first(found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("rid", "request").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def answer(self, asked: DataFrame, same: bool, k: int, name: str) -> DataFrame:
        """(rid, request, rank, vec_id, score) for anchors with a column ``requests`` of (lo, hi)."""
        # one near block each: scores that the requests surely reach
        near = asked.select("cell", F.pmod(F.xxhash64("rid"), self.n_blocks).cast("int").alias("block"), F.col("cell").alias("home"),
                            "rid", "vec_id", "label", "v", F.transform("requests", lambda q: F.struct(
                                q["lo"].alias("lo"), q["hi"].alias("hi"), F.lit(NOTHING).alias("least"))).alias("requests"))
        sure = self.first(self.met(near, same, k), k).where(F.col("rank") == k)
        sure = sure.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("request", "score"))).alias("sure"))
        asked = asked.join(sure, "rid", "left").withColumn("requests", F.transform("requests", lambda q, i: F.struct(
            q["lo"].alias("lo"), q["hi"].alias("hi"), F.coalesce(F.try_element_at("sure", i), F.lit(NOTHING)).alias("least"))))
        needs = F.array_min(F.transform("requests", lambda q: F.greatest(q["lo"], q["least"])))
        pivots, cells = self.pivots, self.cells

        def rooms(batches):
            """The blocks of every pivot whose rows may reach what the anchor needs."""
            for b in batches:
                m, need = _matrix(b.column("v")), b.column("needs").to_numpy()
                norm = _norms(m)
                t = _angles(m, norm, pivots)
                for c, (n, angle, size) in cells.items():
                    reach = norm * size * np.cos(np.minimum(np.maximum(0, t[:, c] - angle), math.pi))
                    who = np.flatnonzero(reach + 1e-9 * norm * size + 1e-3 >= need)
                    if len(who):
                        part = b.select(["cell", "rid", "vec_id", "label", "v", "requests"]).take(pa.array(who))
                        for block in range(n):
                            yield pa.record_batch([pa.array([c] * len(who), pa.int32()), pa.array([block] * len(who), pa.int32()), *part.columns],
                                                  names=["cell", "block", "home", "rid", "vec_id", "label", "v", "requests"])
        far = asked.select("cell", "rid", "vec_id", "label", "v", "requests", needs.alias("needs")).mapInArrow(rooms, _ASKED)
        return stage(self.first(self.met(far, same, k), k), name)

    def mine(self, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
        """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)"""
        whole = F.array(F.struct(F.lit(NOTHING).alias("lo"), F.lit(-NOTHING).alias("hi"), F.lit(NOTHING).alias("least")))
        liked = self.answer(self.anchors.withColumn("requests", whole), True, positives, "positives")
        # 30 p <= 100 n <= 90 p holds for no n if p < 0
        windows = liked.where("score >= 0").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("liked"))
        asked = self.anchors.join(windows, "rid").withColumn("requests", F.transform("liked", lambda p: F.struct(
            F.ceil(p["score"] * F.lit(LOW).cast("decimal(3)") / 100).cast("long").alias("lo"),
            F.floor(p["score"] * F.lit(HIGH).cast("decimal(3)") / 100).cast("long").alias("hi"), F.lit(NOTHING).alias("least"))))
        asked = stage(asked, "windows")
        found = self.answer(asked.drop("liked"), False, negatives, "negatives")
        pairs = asked.select("rid", F.col("vec_id").alias("anchor_id"), F.posexplode("liked").alias("request", "p"))
        return found.join(pairs, ["rid", "request"]).select(
            "anchor_id", F.col("p.vec_id").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
            F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))


def hard_negatives(vectors: DataFrame, is_anchor: Column, relabel: Column | None = None) -> DataFrame:
    """The first ``NEGATIVES`` hard negatives for each anchor (rows where ``is_anchor``, a condition
    on ``vec_id``, holds) and each of its first ``POSITIVES`` positives; ``relabel`` is a label
    computed from ``vec_id`` and ``label``."""
    return HardNegatives(vectors, is_anchor, relabel).mine()


def oracle(table: str = "embeddings") -> str:
    """DuckDB SQL for anchors ``vec_id % 100 = 0``."""
    return f"""
with v as (select row_number() over () as rid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                  list_transform(embedding, lambda c: cast(floor(cast(c as double) * {SCALE}) as bigint)) as v
           from {table} where vec_id is not null and label is not null and embedding is not null
           and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
s as (select a.rid as rid, a.vec_id as anchor_id, x.vec_id as vec_id, a.label = x.label as same,
             cast(coalesce(list_sum(list_transform(list_zip(a.v, x.v), lambda p: coalesce(p[1] * p[2], 0))), 0) as bigint) as score
      from v a join v x on a.vec_id % 100 = 0 and x.rid <> a.rid),
p as (select *, row_number() over (partition by rid order by score desc, vec_id) as place from s where same),
n as (select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
             cast(row_number() over (partition by p.rid, p.place order by s.score desc, s.vec_id) as integer) as rank
      from p join s on s.rid = p.rid and not s.same and p.place <= {POSITIVES}
      and {LOW} * p.score <= 100 * s.score and 100 * s.score <= {HIGH} * p.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= {NEGATIVES}"""
