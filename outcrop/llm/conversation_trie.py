"""Prefix trie of conversations: succinct level-order (LOUDS) tries of prefix shards, and the heavy upper levels merged apart.

A turn's label is the MD5 of its role and text, and a conversation is the string of its labels. Conversations are dealt to tasks by ranges of (labels,
conv_id), so a task, cut further at `SHARD` turns, has a contiguous stretch of the sorted conversations: a shard is a piece of the
trie, however common a first turn or a whole conversation is. In a shard numpy gives every node its level-order number, from where a
conversation parts from the one before, and builds the LOUDS bits and the label array; parents and degrees are read from the bits,
and sums go up level by level in reverse with add.at.

Only the nodes on the paths of a shard's first and last conversation can be in other shards too: its open nodes, two paths at most. All
others are final where they are. Open nodes are the upper levels: they are merged in groups of `FAN` neighbouring shards, which leaves
open again the two outer paths alone, and so on until one group is left; the bits, labels and texts of whole shards stay where they are. A conversation that
thousands share is an open path; the ids that end on it come as strings of up to `IDS` from each shard, and are hashed as a stream in order.

Rebuilding joins every conversation with the first five turns of that of the round hundred below.

Defined results: null roles and texts are empty; rows of null conv_id belong to no conversation and are left out; turns of equal number
(nulls first) stand in the order of their labels, and repeated rows are repeated turns; null text has no code points; an
empty table gives an empty result, while conversations that are turnless once rebuilt are members of the root alone; columns other than
conv_id, turn, role and text aren't read. One conversation's labels (20 bytes a turn) are one row, as is each of its nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BASE, HEAD = 100, 6  # conversation c starts with up to crc32(c) % HEAD turns of c - c % BASE
SHARD = 200_000
FAN = 256
IDS = 4096
NO_IDS = hashlib.sha256(b"").hexdigest()
LABEL = 16
BIG = np.iinfo(np.int64).max

# What shards and merges give. kind node: a final node (text is its hash); open: a node that other shards may have too; ids: a stretch of the ids that end at an open node;
# trie: a shard's bits and labels.
OUT = "kind string, shard bigint, key binary, parent_key binary, depth bigint, size bigint, first boolean, last boolean, conv_id bigint, parent_conv_id bigint, ends bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, text string, bits binary, labels binary"
SCHEMA = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}[t]) for n, t in (c.split() for c in OUT.split(", "))])


def labelled(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (turn, label, size)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    label = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    one = F.struct(F.col("turn").cast("bigint").alias("turn"), label.alias("label"), F.length(text).alias("size"))
    return turns.where("conv_id is not null").groupBy(F.col("conv_id").cast("bigint").alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))


def rebuilt(turns: DataFrame, base: int = BASE, head: int = HEAD) -> DataFrame:
    """(conv_id, turns) with the first turns taken from the conversation of the round hundred."""
    own = common.Scratch(turns.sparkSession, "conversations").save(labelled(turns))
    heads = own.where(f"conv_id % {base} = 0").selectExpr("conv_id as base", f"slice(turns, 1, {head - 1}) as head")
    both = own.selectExpr("*", f"conv_id - conv_id % {base} as base", f"cast(crc32(cast(conv_id as string)) % {head} as int) as h").join(heads, "base", "left")
    tail = "filter(turns, (x, i) -> i >= h)"
    return both.selectExpr("conv_id", f"concat(slice(coalesce(head, array()), 1, h), {tail}) as turns")


def paths(conversations: DataFrame) -> DataFrame:
    """(path, conv_id, sizes): labels end to end, and the code points of each turn."""
    return conversations.select(F.unhex(F.array_join(F.transform("turns", lambda x: x["label"]), "")).alias("path"), "conv_id", F.transform("turns", lambda x: x["size"].cast("bigint")).alias("sizes"))


class Louds:
    """A trie in level order: for each node a one for every child and a zero, after a one and a zero for the root."""

    def __init__(self, degrees: np.ndarray):
        self.bits = np.ones(2 + len(degrees) + int(degrees.sum()), bool)
        self.bits[1] = False
        self.bits[2 + np.cumsum(degrees + 1) - 1] = False

    @classmethod
    def of(cls, packed: bytes) -> Louds:
        out = cls.__new__(cls)
        out.bits = np.unpackbits(np.frombuffer(packed[8:], np.uint8), count=int.from_bytes(packed[:8], "little")).astype(bool)
        return out

    def packed(self) -> bytes:
        return len(self.bits).to_bytes(8, "little") + np.packbits(self.bits).tobytes()

    def parents(self) -> np.ndarray:
        """The level-order number of each node's parent, -1 for the root: the zeros before its one, less the first."""
        return (np.cumsum(~self.bits)[self.bits] - 1).astype(np.int64)

    def degrees(self) -> np.ndarray:
        return np.diff(np.flatnonzero(~self.bits)) - 1


class Shard:
    """The trie of sorted conversations: flat labels (two words each), sizes, and where each conversation ends."""

    def __init__(self, labels: np.ndarray, sizes: np.ndarray, counts: np.ndarray):
        n, ends = len(counts), np.cumsum(counts)
        starts = ends - counts
        conv = np.repeat(np.arange(n), counts)
        place = np.arange(len(labels)) - np.repeat(starts, counts)
        before = np.repeat(np.concatenate([[0], starts[:-1]]) if n else starts, counts) + place
        there = (conv > 0) & (place < np.repeat(np.concatenate([[0], counts[:-1]]) if n else counts, counts))
        same = there & (labels[np.where(there, before, 0)] == labels).all(1)
        shared = np.zeros(n, np.int64)
        if len(labels):
            full = counts > 0
            shared[full] = np.minimum.reduceat(np.where(same, counts[conv], place), starts[full])
        new = place >= np.repeat(shared, counts)
        # Level order: by depth, then by place among the sorted conversations. A label that isn't new is that of the node last begun at its depth.
        order = np.lexsort((conv, place))
        node = np.empty(len(labels), np.int64)
        node[order] = np.cumsum(new[order])
        born = order[new[order]]
        self.depth = np.concatenate([[0], place[born] + 1])
        self.size = np.concatenate([[0], sizes[born]])
        self.labels = labels[born]
        above = np.where(place[born] > 0, node[born - 1], 0) if len(born) else born
        self.louds = Louds(np.bincount(above, minlength=len(self.depth)))
        self.node, self.starts, self.counts = node, starts, counts
        self.last = np.zeros(n, np.int64)  # the node at which each conversation ends
        self.last[counts > 0] = node[ends[counts > 0] - 1]

    def path(self, conversation: int) -> np.ndarray:
        at = self.starts[conversation]
        return np.concatenate([[0], self.node[at : at + self.counts[conversation]]])


def rolled(depth, parent, size, is_open, ends, convs, low, children, leaves, saved) -> None:
    """Closes nodes from the deepest level up, in place: each gets its totals and adds them to its parent. Open nodes only gather."""
    for at in _levels(depth)[::-1]:
        at = at[~is_open[at]]
        convs[at] += ends[at]
        leaves[at] += children[at] == 0
        saved[at] += (convs[at] - 1) * size[at]
        at = at[parent[at] >= 0]
        up = parent[at]
        np.add.at(convs, up, convs[at])
        np.add.at(children, up, 1)
        np.add.at(leaves, up, leaves[at])
        np.add.at(saved, up, saved[at])
        np.minimum.at(low, up, low[at])


def _levels(depth: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []


def _rows(**columns) -> pa.RecordBatch:
    n = max(len(v) for v in columns.values())
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type, from_pandas=True) if f.name in columns else pa.nulls(n, f.type) for f in SCHEMA], schema=SCHEMA)


def _prefix_keys(labels: np.ndarray, path: np.ndarray) -> list[bytes]:
    """A name for each node of a path, the same in every shard: the hash of all labels down to it."""
    h, out = hashlib.md5(), [hashlib.md5().digest()]
    for x in labels[path[1:] - 1]:
        h.update(x.tobytes())
        out.append(h.copy().digest())
    return out


def shard_rows(shard: int, labels: np.ndarray, sizes: np.ndarray, counts: np.ndarray, ids: np.ndarray, with_trie: bool = False) -> Iterator[pa.RecordBatch]:
    trie = Shard(labels, sizes, counts)
    n, parent = len(trie.depth), trie.louds.parents()
    first, last = trie.path(0), trie.path(len(counts) - 1)
    is_open, key = np.zeros(n, bool), {}
    for p in (first, last):
        is_open[p] = True
        key.update(zip(p.tolist(), _prefix_keys(trie.labels, p), strict=True))
    ends = np.bincount(trie.last, minlength=n)
    low = np.full(n, BIG)
    np.minimum.at(low, trie.last, ids)
    convs, children, leaves, saved = (np.zeros(n, np.int64) for _ in range(4))
    rolled(trie.depth, parent, trie.size, is_open, ends, convs, low, children, leaves, saved)
    # Conversations of one path stand together, by rising conv_id.
    order = np.argsort(trie.last, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(ends)])
    members = lambda i: ids[order[bounds[i] : bounds[i + 1]]]
    closed = np.flatnonzero(~is_open)
    if len(closed):
        up = parent[closed]
        hashes = [hashlib.sha256(",".join(map(str, members(i).tolist())).encode()).hexdigest() if ends[i] else NO_IDS for i in closed.tolist()]
        known = np.where(is_open[up], 0, low[up])
        yield _rows(kind=["node"] * len(closed), depth=trie.depth[closed], conv_id=low[closed], parent_conv_id=pa.array(known, mask=is_open[up]), parent_key=[key.get(u) for u in up.tolist()], n_convs=convs[closed], n_children=children[closed], n_leaves=leaves[closed], saved_tokens=saved[closed], text=hashes)
    at = np.flatnonzero(is_open)
    yield _rows(kind=["open"] * len(at), shard=np.full(len(at), shard), key=[key[i] for i in at.tolist()], parent_key=[key.get(u) for u in parent[at].tolist()], depth=trie.depth[at], size=trie.size[at], first=np.isin(at, first), last=np.isin(at, last), conv_id=low[at], ends=ends[at], n_convs=convs[at], n_children=children[at], n_leaves=leaves[at], saved_tokens=saved[at])
    parts = [(key[i], m[k : k + IDS]) for i in at.tolist() if ends[i] for m in [members(i)] for k in range(0, len(m), IDS)]
    if parts:
        yield _rows(kind=["ids"] * len(parts), key=[k for k, _ in parts], conv_id=[int(m[0]) for _, m in parts], text=[",".join(map(str, m.tolist())) for _, m in parts])
    if with_trie:
        yield _rows(kind=["trie"], shard=[shard], n_convs=[len(counts)], bits=[trie.louds.packed()], labels=[trie.labels.tobytes()])


def shards(table: DataFrame, limit: int = SHARD, with_trie: bool = False) -> DataFrame:
    """Rows of OUT from (path, conv_id, sizes), dealt by ranges; a shard ends once it has `limit` turns."""

    def made(batches):
        base, part, held = TaskContext.get().partitionId() << 24, 0, []
        turns = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                held.append(piece)
                turns += len(piece.column(2).flatten()) + piece.num_rows
                if turns >= limit:
                    yield from shard_rows(base + part, *_flat(held), with_trie)
                    part, held, turns = part + 1, [], 0
        if turns:
            yield from shard_rows(base + part, *_flat(held), with_trie)

    n = max(1, -(-(table.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0) // limit), table.sparkSession.sparkContext.defaultParallelism)
    return table.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(made, OUT)


def _flat(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    t = pa.Table.from_batches(batches).combine_chunks()
    path, ids, sizes = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in t.columns)
    labels = np.frombuffer(b"".join(path.to_pylist()), np.uint64).reshape(-1, LABEL // 8)
    counts = sizes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return labels, sizes.flatten().to_numpy(zero_copy_only=False), counts, ids.to_numpy(zero_copy_only=False)


def _merged(group: pd.DataFrame, number: int, outermost: bool) -> Iterator[pa.RecordBatch]:
    """Open nodes of neighbouring shards as one: those on the two outer paths stay open, unless these are all shards."""
    outer = (group["shard"] == group["shard"].min()) & group["first"], (group["shard"] == group["shard"].max()) & group["last"]
    group = group.assign(first=outer[0], last=outer[1])
    sums = {c: "sum" for c in ("ends", "n_convs", "n_children", "n_leaves", "saved_tokens")}
    g = group.groupby("key", sort=False).agg({"parent_key": "first", "depth": "first", "size": "first", "first": "max", "last": "max", "conv_id": "min"} | sums).reset_index()
    is_open = ((g["first"] | g["last"]) & (not outermost)).to_numpy(bool)
    place = {k: i for i, k in enumerate(g["key"])}
    parent = np.array([place.get(k, -1) for k in g["parent_key"]], np.int64)
    ends, convs, children, leaves, saved, low = (g[c].to_numpy(np.int64).copy() for c in (*sums, "conv_id"))
    depth, size = g["depth"].to_numpy(np.int64), g["size"].to_numpy(np.int64)
    rolled(depth, parent, size, is_open, ends, convs, low, children, leaves, saved)
    for kind, at in (("upper", np.flatnonzero(~is_open)), ("open", np.flatnonzero(is_open))):
        if len(at):
            p = g.iloc[at]
            yield _rows(kind=[kind] * len(at), shard=np.full(len(at), number), key=p["key"].tolist(), parent_key=[k or None for k in p["parent_key"]], depth=depth[at], size=size[at], first=p["first"], last=p["last"], conv_id=low[at], ends=ends[at], n_convs=convs[at], n_children=children[at], n_leaves=leaves[at], saved_tokens=saved[at])


def upper(opened: DataFrame, scratch: common.Scratch, fan: int = FAN) -> list[DataFrame]:
    """Tables whose rows of kind upper are all the open nodes, closed."""
    out = []
    top = opened.agg(F.max("shard")).first()[0]
    group = F.floor(F.shiftright("shard", 24) / F.lit(fan))
    top = None if top is None else (top >> 24) // fan
    while top is not None:
        step = scratch.save(opened.withColumn("g", group).groupBy("g").applyInArrow(_merger(top == 0), OUT))
        out.append(step)
        # From here on a group is one shard.
        opened, group, top = step.where("kind = 'open'"), F.floor(F.col("shard") / F.lit(fan)), top // fan if top else None
    return out


def _merger(outermost: bool):
    return lambda table: pa.Table.from_batches(list(_merged(table.drop_columns(["g"]).to_pandas(), table.column("g")[0].as_py(), outermost)), SCHEMA)


def _streamed(ids: DataFrame) -> DataFrame:
    """(key, sha) from stretches of ids: one pass over each node's stretches in order."""

    def hashed(batches):
        now, h = None, None
        for batch in batches:
            keys, shas = [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != now:
                    if h is not None:
                        keys.append(now)
                        shas.append(h.hexdigest())
                    now, h = k, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(text.encode())
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(shas, pa.string())], ["key", "sha"])
        if h is not None:
            yield pa.record_batch([pa.array([now], pa.binary()), pa.array([h.hexdigest()], pa.string())], ["key", "sha"])

    return ids.select("key", "conv_id", "text").repartition("key").sortWithinPartitions("key", "conv_id").select("key", "text").mapInArrow(hashed, "key binary, sha string")


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(conversations: DataFrame, limit: int = SHARD, fan: int = FAN) -> DataFrame:
    """One row for each node of the trie of (conv_id, turns): RESULT."""
    scratch = common.Scratch(conversations.sparkSession, "trie")
    table = scratch.save(paths(conversations))
    made = scratch.save(shards(table, limit))
    scratch.drop(table)
    tables = upper(made.where("kind = 'open'"), scratch, fan)
    if not tables:
        return made.where("kind = 'node'").select(*RESULT[:-1], F.col("text").alias("ends_sha256"))
    top = tables[0]
    for t in tables[1:]:
        top = top.unionByName(t)
    names = top.where("kind = 'upper'").select(F.col("key").alias("k"), F.col("conv_id").alias("c"))
    sha = F.coalesce("sha", F.lit(NO_IDS))
    merged = top.where("kind = 'upper'").join(_streamed(made.where("kind = 'ids'")), "key", "left").select(*RESULT[:-1], "parent_key", sha.alias("ends_sha256"))
    final = made.where("kind = 'node'").select(*RESULT[:-1], "parent_key", F.col("text").alias("ends_sha256")).unionByName(merged)
    # Only nodes below an open one still lack their parent's id.
    return final.join(names, final["parent_key"] == names["k"], "left").select(*RESULT[:2], F.coalesce("parent_conv_id", "c").alias("parent_conv_id"), *RESULT[3:])


def tries(conversations: DataFrame, limit: int = SHARD) -> DataFrame:
    """(shard, n_convs, bits, labels): the LOUDS bits (their number in 8 bytes first) and 16-byte labels of every shard."""
    return shards(paths(conversations), limit, with_trie=True).where("kind = 'trie'").select("shard", "n_convs", "bits", "labels")


def query(spark, sf_dir: str) -> DataFrame:
    return nodes(rebuilt(common.read(spark, sf_dir, "conversations")))
