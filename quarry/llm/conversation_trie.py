"""The prefix trie of conversations, from vertical bitmaps per shard.

Turns are dealt by ranges of the conversation id, so that a shard holds whole
conversations of one stretch of ids, and are reduced to a 128-bit digest of (role, text) and the text's
size before they are dealt. In a shard every (position, turn) has the bitset of
the conversations with that turn there; from the root down, a node's bitset
is intersected with the posting of the turn its lowest conversation has next, which gives a
child, and the rest goes on until no conversation is left. Popcounts are the
members, and the bitset of the conversations of that length gives the end list.

The shards' tries meet by path (a digest of the parent's path and the turn), one narrow row
for each shard and node: members add up, the smallest ids meet, children are counted by parent.
A node's own figures are then laid to the one shard that holds its smallest
member. That shard also holds the whole path to it, so sums over subtrees are
sums within each shard's trie (rows in reverse preorder, one pass) and then over
shards. End lists stay apart as packed ids until they are hashed in ascending order, streaming.

Rebuilding: conversation c starts with the first ``crc32(c) % 9`` turns of
c - c % 5 and goes on with its own turns behind as many; the five lie in one range.

Memory: a shard has at most about ``SHARD_CONVS`` conversations or ``SHARD_TURNS``
turns. A conversation of more turns is a shard of its own whose bitsets have
one bit, so its nodes are written as its turns arrive and nothing is held. An
end list of any length is hashed from blocks of one shard each.

Defined cases: null role or text counts as empty; turns go in order of turn
(null first), then role, then the MD5 of the turn; each repeated row is a turn of its own; rows
with a null conv_id take no part; an empty table gives no nodes, not even the
root; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stage
from quarry.session import ship_package

#: conversations and turns of a shard, about
SHARD_CONVS, SHARD_TURNS = 2048, 32768
GROUP, LENT = 5, 9
#: rows of an Arrow batch that goes out
OUT_ROWS = 8192
ROOT = b"\0" * 16
LOCAL = "shard long, pre long, depth long, path binary, parent binary, conv_id long, n long, size long, ends binary"


def digested_turns(conversations: DataFrame) -> DataFrame:
    """(base, conv_id, turn, role, turn_key, size): turns reduced to a digest and the text's bytes."""
    c = conversations
    rows = c.select(c["conv_id"].cast("long").alias("conv_id"), c["turn"].alias("turn"),
                    F.coalesce(c["role"].cast("string"), F.lit("")).alias("role"),
                    F.coalesce(c["text"].cast("string"), F.lit("")).alias("text")).where("conv_id is not null")
    whole = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    return rows.select((F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), "conv_id", "turn", "role",
                       F.unhex(F.md5(whole.cast("binary"))).alias("turn_key"), F.octet_length("text").cast("long").alias("size"))


class Shard:
    """Conversations of one shard: bitsets by (position, turn) and by length."""

    def __init__(self):
        self.convs: list[tuple[int, list[tuple[bytes, int]]]] = []
        self.turns = 0

    def add(self, conv: int, turns: list[tuple[bytes, int]]) -> None:
        self.convs.append((conv, turns))
        self.turns += len(turns)

    def full(self) -> bool:
        return len(self.convs) >= SHARD_CONVS or self.turns >= SHARD_TURNS

    def nodes(self) -> Iterator[tuple]:
        """(pre, depth, path, parent, smallest conv_id, members, last text's bytes, ends) in preorder."""
        convs = sorted(self.convs, key=lambda c: c[0])
        ids = [c for c, _ in convs]
        postings: dict[tuple[int, bytes], int] = {}
        ended: dict[int, int] = {}
        for k, (_, turns) in enumerate(convs):
            bit = 1 << k
            for at, (key, _) in enumerate(turns):
                postings[at, key] = postings.get((at, key), 0) | bit
            ended[len(turns)] = ended.get(len(turns), 0) | bit
        todo = [(0, ROOT, None, (1 << len(convs)) - 1, 0)]
        pre = 0
        while todo:
            depth, path, parent, members, size = todo.pop()
            ends = members & ended.get(depth, 0)
            low = (members & -members).bit_length() - 1
            yield pre, depth, path, parent, ids[low], members.bit_count(), size, packed(ids, ends)
            pre += 1
            rest = members & ~ends
            while rest:
                turn, bytes_ = convs[(rest & -rest).bit_length() - 1][1][depth]
                child = rest & postings[depth, turn]
                rest ^= child
                todo.append((depth + 1, hashlib.md5(path + turn).digest(), path, child, bytes_))


def packed(ids: list[int], bits: int) -> bytes | None:
    """The ids of the set bits as ascending little-endian int64; None if there is none."""
    if not bits:
        return None
    out = []
    while bits:
        low = bits & -bits
        out.append(ids[low.bit_length() - 1])
        bits ^= low
    return np.array(out, "<i8").tobytes()


def _rebuilt(batches) -> Iterator[tuple]:
    """("turn", conv_id, turn, size) and ("end", conv_id) of rebuilt conversations and ("group",)
    after each five, from rows in order of base, the base's own conversation first."""
    base = conv = None
    lent: list[tuple[bytes, int]] = []
    k = skip = 0
    for b in batches:
        rows = zip(*(b.column(c).to_pylist() for c in ("base", "conv_id", "turn_key", "size")))
        for new_base, new_conv, key, size in rows:
            if new_conv != conv:
                if conv is not None:
                    yield "end", conv
                if new_base != base:
                    if base is not None:
                        yield ("group",)
                    base, lent = new_base, []
                conv, k = new_conv, 0
                skip = 0 if conv == base else zlib.crc32(str(conv).encode()) % LENT
                for turn in lent[:skip]:
                    yield "turn", conv, *turn
            if conv == base and k < LENT - 1:
                lent.append((key, size))
            if k >= skip:
                yield "turn", conv, key, size
            k += 1
    if conv is not None:
        yield "end", conv
        yield ("group",)


def _local_tries(batches) -> Iterator[tuple]:
    """Rows of ``LOCAL`` without the shard's partition, shard by shard."""
    number, shard, turns = 0, Shard(), []
    chain = None  # (depth, path, parent, size) of the last node of a long conversation
    for event in _rebuilt(batches):
        if event[0] == "turn":
            _, conv, key, size = event
            if chain is None:
                turns.append((key, size))
                if len(turns) < SHARD_TURNS:
                    continue
                # a shard of its own, from here on written turn by turn
                if shard.convs:
                    for row in shard.nodes():
                        yield number, *row
                    number, shard = number + 1, Shard()
                chain = (0, ROOT, None, 0)
                more, turns = turns, []
            else:
                more = [(key, size)]
            for key, size in more:
                depth, path, parent, last = chain
                yield number, depth, depth, path, parent, conv, 1, last, None
                chain = (depth + 1, hashlib.md5(path + key).digest(), path, size)
        elif event[0] == "end":
            conv = event[1]
            if chain is not None:
                depth, path, parent, last = chain
                yield number, depth, depth, path, parent, conv, 1, last, packed([conv], 1)
                number, chain = number + 1, None
            else:
                shard.add(conv, turns)
                turns = []
        elif shard.full():
            for row in shard.nodes():
                yield number, *row
            number, shard = number + 1, Shard()
    if shard.convs:
        for row in shard.nodes():
            yield number, *row


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, held_bytes = [], 0
    for row in rows:
        held.append(row)
        held_bytes += sum(len(x) for x in row if isinstance(x, bytes))
        if len(held) >= OUT_ROWS or held_bytes > 4 << 20:
            yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held, held_bytes = [], 0
    if held:
        yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)


_LOCAL = pa.schema([(n, pa.binary() if n in ("path", "parent", "ends") else pa.int64())
                    for n in (c.split(" ")[0] for c in LOCAL.split(", "))])
_SUMS = pa.schema([("path", pa.binary()), ("leaves", pa.int64()), ("saved", pa.int64()), ("parent_conv_id", pa.int64())])
_ENDS = pa.schema([("path", pa.binary()), ("ends_sha256", pa.string())])


def local_tries(conversations: DataFrame) -> DataFrame:
    """One row for each shard and node of its trie (columns of ``LOCAL``)."""
    rows = digested_turns(conversations)
    ranged = rows.repartitionByRange(F.col("base")).sortWithinPartitions(
        F.col("base"), F.col("conv_id") != F.col("base"), F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("turn_key"))

    def run(batches):
        first = TaskContext.get().partitionId() << 32
        yield from _batched(((first + row[0], *row[1:]) for row in _local_tries(batches)), _LOCAL)
    return ranged.select("base", "conv_id", "turn_key", "size").mapInArrow(run, LOCAL)


def _subtree_sums(batches) -> Iterator[tuple]:
    """(path, leaves, saved, parent's smallest member) of each shard's nodes, from rows in reverse
    preorder: a node's descendants come right before it."""
    shard = None
    waiting: dict[int, list] = {}  # by depth: nodes whose parent is to come
    for b in batches:
        for s, depth, path, conv, leaf, saved in zip(*(b.column(c).to_pylist() for c in ("shard", "depth", "path", "conv_id", "leaf", "saved"))):
            if s != shard:
                for done in waiting.values():
                    yield from ((*x, None) for x in done)
                shard, waiting = s, {}
            for kid in waiting.pop(depth + 1, ()):
                leaf += kid[1]
                saved += kid[2]
                yield *kid, conv
            waiting.setdefault(depth, []).append((path, leaf, saved))
    for done in waiting.values():
        yield from ((*x, None) for x in done)


def _end_digests(batches) -> Iterator[tuple]:
    """(path, digest) from blocks of ids in order of path and id."""
    path = sha = None
    for b in batches:
        for new, ends in zip(b.column("path").to_pylist(), b.column("ends").to_pylist()):
            text = ",".join(map(str, np.frombuffer(ends, "<i8").tolist())).encode()
            if new != path:
                if path is not None:
                    yield path, sha.hexdigest()
                path, sha = new, hashlib.sha256(text)
            else:
                sha.update(b"," + text)
    if path is not None:
        yield path, sha.hexdigest()


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) per node."""
    ship_package(conversations.sparkSession)
    local = stage(local_tries(conversations), "trie-local")
    nodes = local.groupBy("path").agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.first("depth").alias("depth"),
                                      F.first("parent").alias("parent"), F.first("size").alias("size"))
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("n_children"))
    nodes = stage(nodes.join(kids, "path", "left").select(
        "path", "conv_id", "n_convs", "depth", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("size")).alias("saved")), "trie-nodes")
    # a node's figures count in the shard that holds its smallest member
    own = nodes.select("path", F.col("conv_id").alias("top"), F.col("n_children"), F.col("saved"))
    laid = local.select("shard", "pre", "depth", "path", "conv_id").join(own, "path")
    here = F.col("conv_id") == F.col("top")
    laid = laid.select("shard", "pre", "depth", "path", F.col("top").alias("conv_id"),
                       (here & (F.col("n_children") == 0)).cast("long").alias("leaf"),
                       F.when(here, F.col("saved")).otherwise(F.lit(0)).cast("long").alias("saved"))
    ordered = laid.repartition("shard").sortWithinPartitions("shard", F.desc("pre"))
    sums = ordered.mapInArrow(lambda b: _batched(_subtree_sums(b), _SUMS), "path binary, leaves long, saved long, parent_conv_id long")
    sums = sums.groupBy("path").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
                                    F.max("parent_conv_id").alias("parent_conv_id"))
    # shards hold disjoint stretches of ids, so blocks in order of their smallest member are in order
    ends = local.where("ends is not null").select("path", "conv_id", "ends")
    ends = ends.repartition("path").sortWithinPartitions("path", "conv_id").select("path", "ends")
    ends = ends.mapInArrow(lambda b: _batched(_end_digests(b), _ENDS), "path binary, ends_sha256 string")
    out = nodes.select("path", "conv_id", "n_convs", "depth", "n_children").join(sums, "path").join(ends, "path", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def oracle(table: str = "conversations") -> str:
    """DuckDB SQL for the same rows: prefixes as whole texts, subtrees by their smallest members."""
    step = "case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end"
    crc = (f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(str_split(cast(conv_id as varchar), ''), lambda c: cast(ord(c) as bigint))), "
           f"lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: {step})), 4294967295)")
    return f"""
with turns as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from {table} where conv_id is not null),
numbered as (select conv_id, cast(strlen(role) as varchar) || ':' || role || text as whole, strlen(text) as size,
             row_number() over (partition by conv_id order by turn nulls first, role, md5(cast(strlen(role) as varchar) || ':' || role || text)) as pos
             from turns),
convs as (select conv_id, conv_id - conv_id % {GROUP} as base, {crc} % {LENT} as h from (select distinct conv_id from turns)),
rebuilt as (select c.conv_id, n.pos, whole, size, 0 as part from convs c join numbered n on n.conv_id = c.base and n.pos <= c.h
            union all select c.conv_id, n.pos, whole, size, 1 from convs c join numbered n on n.conv_id = c.conv_id and n.pos > c.h),
placed as (select conv_id, whole, size, row_number() over (partition by conv_id order by part, pos) as depth from rebuilt),
prefixed as (select conv_id, depth, size, sha256(string_agg(sha256(whole), ',') over (partition by conv_id order by depth)) as path from placed
             union all select conv_id, 0, 0, 'root' from convs),
lengths as (select conv_id, max(depth) as last from prefixed group by all),
ups as (select *, lag(path) over (partition by conv_id order by depth) as parent from prefixed),
nodes as (select path, any_value(parent) as parent, any_value(depth) as depth, any_value(size) as size, min(conv_id) as conv_id,
          count(*) as n_convs from ups group by path),
kids as (select parent as path, count(*) as n_children from nodes where parent is not null group by all),
full_nodes as (select n.*, coalesce(k.n_children, 0) as n_children from nodes n left join kids k on k.path = n.path),
sums as (select p.path, sum(cast(u.n_children = 0 as bigint)) as n_leaves, sum((u.n_convs - 1) * u.size) as saved_tokens
         from full_nodes u join prefixed p on p.conv_id = u.conv_id and p.depth <= u.depth group by p.path),
ends as (select path, string_agg(cast(p.conv_id as varchar), ',' order by p.conv_id) as ids
         from prefixed p join lengths l on l.conv_id = p.conv_id and l.last = p.depth group by path)
select n.conv_id, cast(n.depth as bigint) as depth, up.conv_id as parent_conv_id, cast(n.n_convs as bigint) as n_convs,
       cast(n.n_children as bigint) as n_children, cast(s.n_leaves as bigint) as n_leaves, cast(s.saved_tokens as bigint) as saved_tokens,
       sha256(coalesce(e.ids, '')) as ends_sha256
from full_nodes n join sums s on s.path = n.path left join full_nodes up on up.path = n.parent left join ends e on e.path = n.path"""
