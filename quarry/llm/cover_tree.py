"""Exact top-k inner products by dual cover-tree search.

Vectors become integers (floor of 256 x); scores are integer inner products.
Points go to the cell of their nearest pivot (at most ``PIVOTS`` of them, chosen
by a hash of the id), packed by cell as they are read. A block of candidates is a few
cells, or a part of one that is larger; a task indexes each of its block's cells in a cover
tree and reads blocks of queries one after the other. A block of queries is first searched
in the block of its own cell, which gives each query a k-th score to beat. A cell whose
centre and covering radius bound its scores below that is dropped for the query before any
vector moves; the queries left travel to the cells' blocks (they are a stated set), each
once a block, and no candidate moves with them. With a tree, node pairs are walked together
and pruned when the bound

    <cq, cx> + rq |cx| + rx |cq| + rq rx

over centres and covering radii lies below the worst k-th score of the query
node's group; the leaf pairs left are scored as matrix products. The per-block top k meet
in one aggregate per query.

The driver gets the pivots, a row per cell and the number of rows, however large the table.

Defined cases: a null vector, one that holds a null, NaN or infinity, and a
null id take no part; an empty vector scores 0 with all; vectors of different length
are compared as if the shorter were filled up with zeros; rows that repeat an
id count once, with their best score, and never as their own candidates;
equal scores go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, stage
from quarry.session import ship_package

K = 5
SCALE = 256
#: points of a cell and queries of a block, about
BLOCK, QUERY_BLOCK = 8192, 1024
#: points of a leaf, at most twice this
LEAF = 64
#: cells, at most
PIVOTS = 256
#: blocks of candidates of a table that isn't small, about; components of a block's vectors, about at most
BLOCKS, BLOCK_COMPONENTS = 64, 1 << 24
#: points placed at a time, points of a pack, candidates of a matrix product
PLACED, PACK, TILE = 32768, 1024, 1024
#: children of a node, at most
KIDS = 64


def _floats(m: np.ndarray) -> np.ndarray:
    """Integer vectors for matrix products: single precision where all norms are below 2^12, so
    that every sum of an inner product is an integer below 2^24 and exact."""
    wide = m.astype(np.float64)
    return wide.astype(np.float32) if not len(m) or np.einsum("ij,ij->i", wide, wide).max() < 1 << 24 else wide


def _squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x, dtype=np.float64)


class CoverTree:
    """Each level's centres lie apart by more than the level's cover radius
    and cover their points within it; the next level halves the radius.

    Points are in the tree's order. Node n has those at ``lo[n]:hi[n]``, which lie within
    ``radius[n]`` of ``center[n]``, their mean cut to integers, and the nodes ``kids[n]`` below it."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        self.order, self._given, self._squares = np.arange(len(points)), points, _squares(points)
        nodes: list = []
        self._build(0, len(points), math.inf, nodes)
        self.points, self.ids = points[self.order], ids[self.order]
        del self._given, self._squares
        lo, hi, center, radius, kids = zip(*nodes)
        self.kids = [np.array(k, np.intp) for k in kids]
        self.lo, self.hi, self.center, self.radius = np.array(lo), np.array(hi), np.array(center, np.float64), np.array(radius)
        self.norm = np.sqrt(_squares(self.center))
        self.is_leaf = np.array([not k for k in kids])
        leaves = np.flatnonzero(self.is_leaf)
        self.leaves = leaves[np.argsort(self.lo[leaves], kind="stable")]

    def _build(self, lo: int, hi: int, cover: float, nodes: list) -> int:
        ids = self.order[lo:hi]
        x, own = self._given[ids], self._squares[ids]

        def distances(c) -> np.ndarray:
            """Squared; all terms are integers."""
            return np.maximum(own - 2.0 * (x @ c).astype(np.float64) + float(_squares(c[None, :])[0]), 0)
        center = np.trunc(x.sum(0, dtype=np.float64) / max(1, len(x))).astype(x.dtype)
        # a hair wider than computed, so that rounding can't prune a tie
        radius = math.sqrt(float(distances(center).max(initial=0))) * (1 + 1e-9) + 1e-7 * math.sqrt(float(own.max(initial=0))) + 1e-6
        n = len(nodes)
        nodes.append((lo, hi, center, radius, kids := []))
        if hi - lo <= 2 * LEAF:
            return n
        owner, nearest, kid = np.zeros(len(ids), np.int32), distances(x[0]), 1
        if not nearest.max():
            return n
        while cover * cover >= nearest.max():
            cover = min(cover, 2 * math.sqrt(float(nearest.max()))) / 2
        most = max(2, min(KIDS, len(ids) // LEAF + 1))
        while kid < most:  # greedy: the farthest point left becomes the next centre
            at = int(nearest.argmax())
            if nearest[at] <= cover * cover:
                break
            d = distances(x[at])
            closer = d < nearest
            owner[closer], nearest[closer] = kid, d[closer]
            kid += 1  # beyond ``most``, a level of many far points: the nodes' own radii stay exact
        sort = np.argsort(owner, kind="stable")
        self.order[lo:hi] = ids[sort]
        ends = (lo + np.cumsum(np.bincount(owner, minlength=kid))).tolist()
        del x, own, ids, owner, nearest, sort
        for a, b in zip([lo, *ends], ends):
            if b > a:
                kids.append(self._build(a, b, cover / 2, nodes))
        return n


def _ranges(lo: np.ndarray, hi: np.ndarray) -> slice | np.ndarray:
    """The numbers of ``lo[n]:hi[n]``, ascending ranges, as a slice where they meet."""
    if (lo[1:] == hi[:-1]).all():
        return slice(int(lo[0]), int(hi[-1]))
    return np.concatenate([np.arange(a, b) for a, b in zip(lo.tolist(), hi.tolist())])


class Search:
    """Top k of one query block in the candidates ``x``, or in those of ``trees`` one after the other;
    scores below a query's ``floor`` aren't looked for."""

    def __init__(self, q_ids, q, x_ids, x, k: int, floor=None, trees=None):
        self.k, self.qt = k, CoverTree(_floats(q), np.asarray(q_ids))
        self.q, self.q_ids = self.qt.points, self.qt.ids
        self.score = np.full((len(q), k), -np.inf)
        self.best = np.full((len(q), k), np.iinfo(np.int64).max)
        self.floor = np.full(len(q), -np.inf) if floor is None else floor[self.qt.order]
        self.worst = self.floor.copy()
        self.pairs = self.pruned = 0
        self.room = np.empty(0)
        if len(q):
            for tree in [CoverTree(_floats(x), np.asarray(x_ids))] if trees is None else trees:
                if len(tree.points):
                    self.walk(tree)

    def bounds(self, t: CoverTree) -> np.ndarray:
        """Of each node of the queries' tree with each of the candidates'."""
        a, wide = self.qt, min(self.qt.center.shape[1], t.center.shape[1])
        top = a.center[:, :wide] @ t.center[:, :wide].T
        top += np.outer(a.radius, t.norm) + np.outer(a.norm, t.radius) + np.outer(a.radius, t.radius)
        return top + 1e-9 * np.abs(top) + 1e-6

    def walk(self, t: CoverTree) -> None:
        a, top = self.qt, self.bounds(t)
        for n in a.leaves.tolist():  # queries that have nothing to beat yet meet the leaf that may hold the best
            if np.isinf(self.worst[a.lo[n]:a.hi[n]]).any():
                m = t.leaves[int(top[n, t.leaves].argmax())]
                lo = max(0, min(int(t.lo[m]), len(t.points) - LEAF))
                self.compare(t, slice(int(a.lo[n]), int(a.hi[n])), slice(lo, min(max(int(t.hi[m]), lo + LEAF), lo + TILE)))
        worst = np.array([self.worst[lo:hi].min() for lo, hi in zip(a.lo, a.hi)])
        left = np.zeros(top.shape, bool)
        level = [(0, np.zeros(1, np.intp))]
        while level:  # a node of the queries with nodes of the candidates
            below = []
            for i, js in level:
                self.pairs += len(js)
                may = top[i, js] >= worst[i]
                js = js[may]
                self.pruned += len(may) - len(js)
                end = t.is_leaf[js]
                down = [t.kids[j] for j in js[~end].tolist()]
                if a.is_leaf[i]:
                    left[i, js[end]] = True
                else:
                    down.append(js[end])
                down = np.concatenate(down or [js[:0]])
                if len(down):
                    below += [(kid, down) for kid in ([i] if a.is_leaf[i] else a.kids[i].tolist())]
            level = below
        self.leaf_pairs(t, top, left)

    def leaf_pairs(self, t: CoverTree, top: np.ndarray, left: np.ndarray) -> None:
        """Scores of the leaf pairs ``left``, neighbouring leaves of candidates together, best bounds first."""
        a = self.qt
        lo, hi = a.lo[a.leaves], a.hi[a.leaves]
        top, left = (m[np.ix_(a.leaves, t.leaves)] for m in (top, left))
        x_lo, x_hi = t.lo[t.leaves], t.hi[t.leaves]
        tile = x_lo // TILE
        starts = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
        parts = list(zip(starts.tolist(), [*starts[1:].tolist(), len(tile)]))
        best = np.where(left, top, -np.inf)
        for b, e in sorted(parts, key=lambda p: -best[:, p[0]:p[1]].max()):
            worst = np.minimum.reduceat(self.worst, lo)
            use = left[:, b:e] & (top[:, b:e] >= worst[:, None])
            self.pruned += int(left[:, b:e].sum() - use.sum())
            rows, cols = use.any(1), use.any(0)
            if rows.any():
                asked, found = _ranges(lo[rows], hi[rows]), _ranges(x_lo[b:e][cols], x_hi[b:e][cols])
                whole = isinstance(found, slice)
                first, last = (found.start, found.stop) if whole else (0, len(found))
                for at in range(first, last, 2 * TILE):  # a leaf of equal points may be longer
                    part = slice(at, min(last, at + 2 * TILE))
                    self.compare(t, asked, part if whole else found[part])

    def compare(self, t: CoverTree, rows, cols) -> None:
        """Exact scores of queries and candidates (integers below 2^24 as floats or 2^53 as doubles)."""
        wide = min(self.q.shape[1], t.points.shape[1])
        q, x, worst = self.q[rows, :wide], t.points[cols, :wide], self.worst[rows]
        kind = np.result_type(q, x)
        if len(q) * len(x) > self.room.size or self.room.dtype != kind:
            self.room = np.empty(len(q) * len(x), kind)
        s = np.matmul(q, x.T, out=self.room[:len(q) * len(x)].reshape(len(q), len(x)))
        hit = np.flatnonzero(s.max(1) >= worst)
        if not len(hit):
            return
        s = s[hit]
        r, c = np.nonzero(s >= worst[hit, None])
        row = (np.arange(rows.start, rows.stop) if isinstance(rows, slice) else rows)[hit][r]
        ids, score = t.ids[cols][c], s[r, c].astype(np.float64)
        new = (ids != self.q_ids[row]) & ((score > self.worst[row]) | (ids < self.best[row, -1]))
        self.merge(row[new], ids[new], score[new])

    def merge(self, row, ids, score) -> None:
        """Takes in what was found; a repeated id keeps its best score."""
        if not len(row):
            return
        some = np.unique(row)
        r, c = np.nonzero(np.isfinite(self.score[some]))
        row = np.concatenate([row, some[r]])
        ids = np.concatenate([ids, self.best[some[r], c]])
        score = np.concatenate([score, self.score[some[r], c]])
        order = np.lexsort((-score, ids, row))
        row, ids, score = row[order], ids[order], score[order]
        first = np.r_[True, (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])]
        row, ids, score = row[first], ids[first], score[first]
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        top = rank < self.k
        self.score[row[top], rank[top]], self.best[row[top], rank[top]] = score[top], ids[top]
        self.worst[some] = np.maximum(self.score[some, -1], self.floor[some])


def _vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch (vec_id, x, asked): ids, whether asked, and integer vectors as rows filled up with
    zeros, of the rows that take part."""
    x = batch.column("x")
    lengths = np.where(x.is_null().to_numpy(zero_copy_only=False), 0, x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    flat = x.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # a null is NaN
    at = np.repeat(np.arange(len(x)), lengths)
    bad = x.is_null().to_numpy(zero_copy_only=False) | (np.bincount(at[~np.isfinite(values)], minlength=len(x)) > 0)
    wide = int(lengths[~bad].max(initial=0))
    with np.errstate(invalid="ignore"):
        values = np.floor(values * SCALE)
        whole = np.clip(values, -2.0 ** 63, 2.0 ** 63 - 1024).astype(np.int64)
    whole[values >= 2.0 ** 63] = np.iinfo(np.int64).max
    ids = batch.column("vec_id").to_numpy()
    asked = batch.column("asked").fill_null(False).to_numpy(zero_copy_only=False)
    if (lengths == wide).all() and not bad.any():
        return ids, asked, whole.reshape(len(x), wide)
    m, keep = np.zeros((len(x), wide), np.int64), ~bad
    in_row = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    use = keep[at]
    m[at[use], in_row[use]] = whole[use]
    return ids[keep], asked[keep], m[keep]


def _bytes(m: np.ndarray) -> bytes:
    """Integers in the fewest bytes of 2, 4 and 8 that hold them all."""
    low, high = int(m.min(initial=0)), int(m.max(initial=0))
    kind = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return m.astype(kind).tobytes()


def _open(n: int, dim: int, points: bytes) -> np.ndarray:
    return np.frombuffer(points, {2: np.int16, 4: np.int32}.get(len(points) // max(1, n * dim), np.int64)).reshape(n, dim)


def _stack(matrices: list[np.ndarray]) -> np.ndarray:
    """Rows of them all, filled up with zeros."""
    wide = max(m.shape[1] for m in matrices)
    return np.concatenate([np.pad(m, ((0, 0), (0, wide - m.shape[1]))) if m.shape[1] < wide else m for m in matrices])


PACKED = "kind int, cell int, far double, n int, dim int, ids binary, points binary"


def in_cells(rows: DataFrame, pivots: np.ndarray, pack: int) -> DataFrame:
    """Points packed by the ``cell`` of the nearest pivot, of at most ``pack`` rows, with the largest
    distance to it, rounded up (``kind`` 0); the queries among them likewise (``kind`` 1)."""
    names = [c.split()[0] for c in PACKED.split(", ")]

    def packs(ids, asked, m):
        p = _floats(pivots)
        x = _floats(m)
        wide = min(x.shape[1], p.shape[1])
        d = _squares(p) - 2.0 * (x[:, :wide] @ p[:, :wide].T)
        cell = d.argmin(1)
        own = _squares(x)
        far = np.sqrt(np.maximum(own + d[np.arange(len(x)), cell], 0)) * (1 + 1e-9) + 1e-6 + 1e-7 * np.sqrt(own)
        del d, x
        out = []
        for kind, use in ((0, np.arange(len(ids))), (1, np.flatnonzero(asked))):
            use = use[np.argsort(cell[use], kind="stable")]
            cuts = np.flatnonzero(np.diff(cell[use])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(use)]):
                for lo in range(a, b, pack):
                    at = use[lo:min(b, lo + pack)]
                    out.append((kind, int(cell[at[0]]), float(far[at].max()), len(at), m.shape[1], ids[at].tobytes(), _bytes(m[at])))
        for lo in range(0, len(out), 512):
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out[lo:lo + 512]), TYPES)], names=names)

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(_vectors(b))
            n += len(held[-1][0])
            if n >= PLACED:
                yield from packs(*map(np.concatenate, zip(*((i, a) for i, a, _ in held))), _stack([m for *_, m in held]))
                held, n = [], 0
        if n:
            yield from packs(*map(np.concatenate, zip(*((i, a) for i, a, _ in held))), _stack([m for *_, m in held]))
    return rows.mapInArrow(run, PACKED)


TYPES = [pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
MET = "block int, kind int, cell int, n int, dim int, ids binary, points binary, floors binary"


def searches(batches, k: int, query_block: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, Search]]:
    """(block, query ids, queries, Search) of rows in order of block, ``kind`` and cell: the block's
    candidates, then queries; packs of queries of a cell are searched together."""
    block, packs, trees, waiting, held = None, {}, None, [], 0

    def search():
        nonlocal trees, packs, waiting, held
        if trees is None:
            trees = []
            for cell in sorted(packs):
                ids, points = zip(*packs.pop(cell))
                trees.append(CoverTree(_floats(_stack(points)), np.concatenate(ids)))
        ids, points, floors = zip(*waiting)
        ids, q, waiting, held = np.concatenate(ids), _stack(points), [], 0
        floor = None if floors[0] is None else np.concatenate(floors)
        for at in range(0, len(ids), query_block):
            part = slice(at, at + query_block)
            yield block, ids[part], q[part], Search(ids[part], q[part], None, None, k, None if floor is None else floor[part], trees)

    cell = None
    for b in batches:
        for n in range(b.num_rows):
            r = {c: b.column(c)[n].as_py() for c in b.schema.names}
            if waiting and (r["block"] != block or r["cell"] != cell or held + r["n"] > query_block):
                yield from search()
            if r["block"] != block:
                block, packs, trees = r["block"], {}, None
            ids, points = np.frombuffer(r["ids"], np.int64), _open(r["n"], r["dim"], r["points"])
            if r["kind"] == 0:
                packs.setdefault(r["cell"], []).append((ids, points))
            else:
                waiting.append((ids, points, None if r["floors"] is None else np.frombuffer(r["floors"])))
                cell, held = r["cell"], held + r["n"]
    if waiting:
        yield from search()


def by_block(rows: DataFrame, blocks: int) -> DataFrame:
    """A task for each block, candidates before queries."""
    return rows.repartitionById(max(1, blocks), F.col("block")).sortWithinPartitions("block", "kind", "cell")


FOUND = "query_id long, vec_id long, score long"
ASKED = "home int, q_cell int, q_n int, q_dim int, q_ids binary, q_points binary, floors binary, cells array<int>, asks array<int>, blocks array<int>, masks array<binary>"


def _findings(s: Search) -> list[np.ndarray]:
    at, col = np.nonzero(np.isfinite(s.score))
    return [s.q_ids[at], s.best[at, col], s.score[at, col].astype(np.int64)]


def first_pass(placed: DataFrame, low: list[int], past: list[int], pivots: np.ndarray, radius: np.ndarray, k: int, query_block: int) -> DataFrame:
    """Written once: what each query finds in the block of its own cell, and (``home`` not null) the
    block of queries with their k-th scores so far, the cells where some may find better (``asks`` of
    them), and for the blocks of these which do."""
    names = [c.split()[0] for c in f"{FOUND}, {ASKED}".split(", ")]
    types = [pa.int64()] * 3 + [pa.int32()] * 4 + [pa.binary()] * 3 + [pa.list_(pa.int32())] * 3 + [pa.list_(pa.binary())]

    def run(batches):
        for home, q_ids, q, s in searches(batches, k, query_block):
            cols = _findings(s)
            yield pa.record_batch([*map(pa.array, cols), *(pa.nulls(len(cols[0]), t) for t in types[3:])], names=names)
            floor = np.empty(len(q))
            floor[s.qt.order] = s.score[:, -1]
            x, p = q.astype(np.float64), pivots.astype(np.float64)
            wide = min(x.shape[1], p.shape[1])
            bound = x[:, :wide] @ p[:, :wide].T + np.sqrt(_squares(x))[:, None] * radius
            may = bound + 1e-9 * np.abs(bound) + 1e-6 >= floor[:, None]
            masks: dict[int, np.ndarray] = {}
            cells = np.flatnonzero(may.any(0) & (np.array(past) > np.array(low))).tolist()
            for c in cells:
                for b in range(low[c], past[c]):
                    if b != home:
                        masks[b] = masks[b] | may[:, c] if b in masks else may[:, c]
            row = (None, None, None, home, 0, len(q), q.shape[1], q_ids.tobytes(), _bytes(q), floor.tobytes(), cells,
                   may[:, cells].sum(0).tolist(), list(masks), [np.packbits(m).tobytes() for m in masks.values()])
            yield pa.record_batch([pa.array([v], t) for v, t in zip(row, types)], names=names)
    near = placed.where("kind = 1 or block = low").select(*(c.split()[0] for c in MET.split(", ")))
    return stage(by_block(near, max(past, default=0)).mapInArrow(run, f"{FOUND}, {ASKED}"), "first")


def asking(found: DataFrame) -> DataFrame:
    """The queries left for each block that they ask, with their k-th scores."""
    names = [c.split()[0] for c in MET.split(", ")]
    types = [pa.int32()] * 5 + [pa.binary()] * 3

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                r = {c: batch.column(c)[n].as_py() for c in batch.schema.names}
                ids, q, floor = np.frombuffer(r["q_ids"], np.int64), _open(r["q_n"], r["q_dim"], r["q_points"]), np.frombuffer(r["floors"])
                for b, mask in zip(r["blocks"], r["masks"]):
                    keep = np.unpackbits(np.frombuffer(mask, np.uint8), count=len(ids)).astype(bool)
                    row = (b, 1, r["home"], int(keep.sum()), r["q_dim"], ids[keep].tobytes(), _bytes(q[keep]), floor[keep].tobytes())
                    yield pa.record_batch([pa.array([v], t) for v, t in zip(row, types)], names=names)
    return found.where("home is not null").select("home", "q_n", "q_dim", "q_ids", "q_points", "floors", "blocks", "masks").mapInArrow(run, MET)


def second_pass(found: DataFrame, placed: DataFrame, blocks: int, k: int, query_block: int) -> DataFrame:
    """What the queries left find in the cells left, block by block."""
    def run(batches):
        for _, _, _, s in searches(batches, k, query_block):
            yield pa.record_batch(list(map(pa.array, _findings(s))), names=["query_id", "vec_id", "score"])
    base = placed.where("kind = 0").select(*(c.split()[0] for c in MET.split(", ")))
    return by_block(base.union(asking(found)), blocks).mapInArrow(run, FOUND)


def _some(points: DataFrame, n: int, count: int) -> np.ndarray:
    """Integer vectors of the ``n`` usable rows with the smallest hash of the id."""
    def run(batches):
        for b in batches:
            ids, _, m = _vectors(b)
            yield pa.record_batch([pa.array(ids), pa.array([v.tobytes() for v in m], pa.binary())], names=["vec_id", "v"])
    low = F.lit(min(2 ** 63 - 1, -2 ** 63 + 2 ** 64 * 16 * n // max(1, count)))
    for rows in (points.where(F.xxhash64("vec_id") <= low), points):  # all of them, if too few usable ones are as low
        found = rows.mapInArrow(run, "vec_id long, v binary").orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(n)
        got = [np.frombuffer(r["v"], np.int64)[None, :] for r in stage(found, "pivots").collect()]  # the tasks' candidates meet on an executor
        if len(got) >= n:
            break
    return _stack(got or [np.zeros((1, 0), np.int64)])


def into_blocks(size: np.ndarray, block: int) -> tuple[list[int], list[int]]:
    """The blocks of each cell, from ``low`` to below ``past``: some cells share one of about ``block`` points, a larger
    cell has its own."""
    low, past, blocks, room = [], [], 0, 0
    for n in map(int, size):
        parts = -(-n // block)
        if n > room or parts > 1:
            blocks, room = blocks + parts, block if parts == 1 else 0
        low.append(blocks - max(1, parts) if n else 0)
        past.append(blocks if n else 0)
        room -= n if parts == 1 else 0
    return low, past


def search_passes(vectors: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding",
                  block: int = BLOCK, query_block: int = QUERY_BLOCK) -> tuple[DataFrame, DataFrame, int]:
    """The two passes' findings (the first with a row per block of queries and ``cell`` left to them, for ``q_n``) and
    the number of candidate blocks."""
    spark = vectors.sparkSession
    ship_package(spark)
    bounded_batches(spark)
    x = vectors[embedding]
    if dict(vectors.dtypes)[embedding] not in ("array<float>", "array<double>"):
        x = x.cast("array<double>")
    points = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null")
    count = points.count()
    points = points.where("x is not null").withColumn("asked", is_query)
    pivots = _some(points, min(PIVOTS, max(1, math.ceil(count / block))), count)
    block = max(block, min(count // BLOCKS, BLOCK_COMPONENTS // max(1, pivots.shape[1])))
    placed = stage(in_cells(points, pivots, max(1, min(PACK, block // 8))), "cells")
    size, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for r in placed.where("kind = 0").groupBy("cell").agg(F.sum("n").alias("n"), F.max("far").alias("far")).collect():  # a row for each pivot
        size[r["cell"]], radius[r["cell"]] = r["n"], r["far"]
    low, past = into_blocks(size, block)
    first, end = (F.element_at(F.array(*map(F.lit, x)), F.col("cell") + 1) for x in (low, past))
    dealt = F.when(F.col("kind") == 1, first).otherwise(first + F.pmod(F.xxhash64("ids"), end - first)).cast("int")
    placed = placed.withColumn("low", first).withColumn("block", dealt).withColumn("floors", F.lit(None).cast("binary"))
    found = first_pass(placed, low, past, pivots, radius, k, query_block)
    more = second_pass(found, placed, max(past), k, query_block)
    left = found.where("home is not null").select(F.explode(F.arrays_zip("cells", "asks")).alias("c")).select("c.cells", "c.asks")
    none = F.lit(None)
    both = (found.where("home is null").select("query_id", "vec_id", "score", none.cast("int").alias("cell"), none.cast("int").alias("q_n"))
            .union(left.select(none.cast("long"), none.cast("long"), none.cast("long"), "cells", "asks")))
    return both, more, max(past)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id",
          embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every row where ``is_query`` holds
    (a condition on ``vec_id``), the k best other rows by integer inner product."""
    found, more, _ = search_passes(vectors, is_query, k, vec_id, embedding, BLOCK, QUERY_BLOCK)
    met = found.where("query_id is not null").select("query_id", "vec_id", "score").union(more)
    best = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def oracle(table: str = "embeddings", k: int = K, modulus: int = 50) -> str:
    """DuckDB SQL for the queries ``vec_id % modulus = 0``."""
    return f"""
with v as (select vec_id, list_transform(embedding, lambda c: cast(floor(cast(c as double) * {SCALE}) as bigint)) as v
           from {table} where vec_id is not null and embedding is not null
           and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
s as (select q.vec_id as query_id, x.vec_id as vec_id,
             cast(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) as bigint) as score
      from v q join v x on q.vec_id % {modulus} = 0 and x.vec_id <> q.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= {k}"""
