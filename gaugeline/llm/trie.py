"""Prefix trie of conversations, from the common prefixes of sorted neighbours.

Distinct sequences of turns are sorted. The longest common prefixes of
neighbours go into a sparse table of range minima; each prefix at which
neighbours part searches its left and right extent in it by halving steps, so
every node of the trie is an interval of the order, and what holds for members
or subtrees is a difference of running sums. No stack is kept and no node waits
for another.

The order is cut into blocks, one after the other within a task. Only prefixes
of the first and the last sequence of a block can go on in a neighbour; those
paths, two of a block, make a small trie of their own, which adds up their
parts.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import Scratch, partitions

#: Bytes of a turn in a sequence: MD5 of role and text, and the text's code points.
TURN = 20
#: Sequences and bytes of a block at most; a sequence that is longer is a block of its own.
BLOCK_ROWS, BLOCK_BYTES = 1 << 18, 1 << 26

_NODES = "block long, side int, depth long, conv_id long, parent_id long, parent_side int, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_PATHS = "seq binary, since long, convs array<long>, ids array<long>, kids array<long>, leaves array<long>, saved array<long>, ends array<string>"


def turn_sequences(turns: DataFrame, branch: int = 0, heads: int = 6) -> DataFrame:
    """(conv_id, seq): of each conversation of ``turns(conv_id, turn, role, text)`` its turns in order, TURN bytes each.

    Turns are ordered by ``turn``, null first, then by digest. A null role or
    text is empty. With ``branch``, conversation c starts with the first h turns
    of conversation c - c % branch instead of its own first h, where h is
    crc32(decimal c) % heads; fewer if that one is shorter, none if there is
    none. All conversations that share c - c % branch are dealt out together,
    once. Rows without a conv_id belong to no conversation. A conversation is
    one row of 20 bytes a turn.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    told = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    key = F.concat(F.md5(told), F.lpad(F.hex(F.length(text)), 8, "0"))
    c = F.col("conv_id").cast("long")
    family = c - c % branch if branch else c
    rows = turns.where(c.isNotNull()).select(family.alias("family"), c.alias("conv_id"), F.col("turn").isNotNull().alias("numbered"), "turn", F.unhex(key).alias("key"))
    own = rows.repartition("family").groupBy("family", "conv_id").agg(F.array_sort(F.collect_list(F.struct("numbered", "turn", "key"))).alias("own"))
    own = own.select("family", "conv_id", F.transform("own", lambda x: F.hex(x["key"])).alias("own"))
    if not branch:
        return own.select("conv_id", F.unhex(F.array_join("own", "")).alias("seq"))
    head = own.where(F.col("conv_id") == F.col("family")).select("family", F.slice("own", 1, heads).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    both = own.join(head, "family", "left").withColumn("h", h)
    whole = F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast("array<string>")), F.slice("own", F.col("h") + 1, F.greatest(F.size("own"), F.lit(1))))
    return both.select("conv_id", F.unhex(F.array_join(whole, "")).alias("seq"))


def _ends(batches):
    """Digest of the ascending ids of each sequence, from rows sorted by sequence and id; holds one id at a time."""
    last, found = None, None
    for batch in batches:
        keys, ends = [], []
        for key, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if key == last:
                found.update(b",%d" % conv)
            else:
                if found is not None:
                    keys.append(last)
                    ends.append(found.hexdigest())
                last, found = key, hashlib.sha256(b"%d" % conv)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ends, pa.string())], names=["key", "ends"])
    if found is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([found.hexdigest()], pa.string())], names=["key", "ends"])


def _sparse(x: np.ndarray) -> list[np.ndarray]:
    """Level j holds the minimum of 2**j values from each place on."""
    levels = [x]
    while 2 << (len(levels) - 1) <= len(x):
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    return levels


def _range_min(levels: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum over lo..hi, both included."""
    out = np.empty(len(lo), levels[0].dtype)
    level = np.log2(hi - lo + 1).astype(np.int64)
    for j in np.unique(level):
        at = level == j
        out[at] = np.minimum(levels[j][lo[at]], levels[j][hi[at] - (1 << j) + 1])
    return out


def _extent(levels: list[np.ndarray], at: np.ndarray, least: np.ndarray, step: int) -> np.ndarray:
    """From place ``at``, how many places in direction ``step`` have values of ``least`` or more; each search by itself."""
    count = np.zeros(len(at), np.int64)
    n = len(levels[0])
    for j in reversed(range(len(levels))):
        wide = 1 << j
        lo = at + count if step > 0 else at - count - wide + 1
        fits = (lo >= 0) & (lo + wide <= n)
        fits[fits] = levels[j][lo[fits]] >= least[fits]
        count += np.where(fits, wide, 0)
    return count


class Trie:
    """Nodes of the trie of sorted distinct sequences, in preorder.

    ``first``, ``last``: interval of the sequences that begin with the node's
    prefix; ``depth``; ``parent``: place of the parent node, -1 for the root;
    ``end``: place behind the node's subtree; ``chars`` of its last turn.
    """

    def __init__(self, seqs: list[bytes]):
        n = len(seqs)
        size = np.fromiter((len(s) // TURN for s in seqs), np.int64, n)
        turns = np.frombuffer(b"".join(seqs), np.uint8).reshape(-1, TURN)
        start = np.concatenate([[0], np.cumsum(size)])
        lcp = self._common(turns, start, size)
        levels = _sparse(lcp[1:]) if n > 1 else [lcp[:0]]
        # Compact nodes: where neighbours part, every whole sequence, and the root.
        k = np.arange(n - 1)
        left = k + 1 - _extent(levels, k, lcp[1:], -1)
        right = k + _extent(levels, k, lcp[1:], 1)
        own = np.arange(n)
        lo = np.concatenate([left, own, [0]])
        hi = np.concatenate([right, own, [n - 1]])
        deep = np.concatenate([lcp[1:], size, [0]])
        order = np.lexsort((-hi, deep, lo))
        lo, hi, deep = lo[order], hi[order], deep[order]
        new = np.ones(len(lo), bool)
        new[1:] = (lo[1:] != lo[:-1]) | (deep[1:] != deep[:-1])
        lo, hi, deep = lo[new], hi[new], deep[new]
        # A node hangs on the longer of the common prefixes at its two ends.
        sides = np.concatenate([[0], lcp[1:], [0]])
        above = np.maximum(sides[lo], sides[hi + 1])
        above[0] = -1
        at = np.where(sides[lo] >= sides[hi + 1], lo, hi + 1)
        up_lo = np.where(above > 0, left[np.clip(at - 1, 0, max(n - 2, 0))] if n > 1 else 0, 0)
        wide = int(deep.max()) + 2
        up = np.searchsorted(lo * wide + deep, up_lo * wide + np.maximum(above, 0))
        # One node for each depth on the way to a compact node.
        long = deep - above
        begin = np.concatenate([[0], np.cumsum(long)])
        c = np.repeat(np.arange(len(lo)), long)
        self.first, self.last = lo[c], hi[c]
        self.depth = above[c] + 1 + np.arange(len(c)) - begin[c]
        self.parent = np.arange(len(c)) - 1
        head = begin[:-1]
        self.parent[head] = begin[up + 1] - 1
        self.parent[0] = -1
        self.end = begin[np.searchsorted(lo, hi, side="right")][c]
        self.whole = (self.depth == deep[c]) & (size[self.first] == self.depth)
        told = np.ascontiguousarray(turns[:, 16:]).view(">u4").reshape(-1).astype(np.int64)
        self.chars = np.zeros(len(c), np.int64)
        self.chars[1:] = told[(start[self.first] + self.depth - 1)[1:]]

    @staticmethod
    def _common(turns: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Turns that each sequence has in common with the one before; the long ones by slices."""
        n = len(size)
        lcp = np.zeros(n, np.int64)
        words = np.ascontiguousarray(turns[:, :16]).view(np.uint64)
        live = np.arange(1, n)
        for t in range(32):
            live = live[(size[live] > t) & (size[live - 1] > t)]
            live = live[(words[start[live] + t] == words[start[live - 1] + t]).all(axis=1)]
            if not len(live):
                return lcp
            lcp[live] = t + 1
        for k in live:
            m = min(size[k], size[k - 1])
            other = (words[start[k] : start[k] + m] != words[start[k - 1] : start[k - 1] + m]).any(axis=1)
            lcp[k] = int(other.argmax()) if other.any() else m
        return lcp

    def subtree(self, own: np.ndarray) -> np.ndarray:
        """Sum of ``own`` over the subtree of each node."""
        sums = np.concatenate([[0], np.cumsum(own)])
        return sums[self.end] - sums[:-1]

    def children(self, which: np.ndarray) -> np.ndarray:
        """Children of each node that ``which`` marks."""
        up = self.parent[which]
        return np.bincount(up[up >= 0], minlength=len(self.parent))


def _blocks(batches):
    """Lists of (seq, n, id, ends) of one block each."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("seq", "n", "id", "ends")), strict=True):
            if held and (len(held) >= BLOCK_ROWS or size + len(row[0]) > BLOCK_BYTES):
                yield held
                held, size = [], 0
            held.append(row)
            size += len(row[0])
    if held:
        yield held


def _table(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    given = (columns[f.name] for f in schema)
    return pa.RecordBatch.from_arrays([x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(given, schema, strict=True)], schema=schema)


def _local_nodes(batches, empty: str, schema: pa.Schema):
    """Nodes of each block that no other block shares, and the two paths that others may share.

    A node row with ``parent_side`` has its parent on that path of its block; a row with ``seq`` is a path.
    """
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    for number, rows in enumerate(_blocks(batches)):
        block = (task << 32) + number
        seqs, n, ids, ends = (list(x) for x in zip(*rows, strict=True))
        ends = np.array(ends, object)
        t = Trie(seqs)
        members = np.concatenate([[0], np.cumsum(np.array(n, np.int64))])
        convs = members[t.last + 1] - members[t.first]
        least = _range_min(_sparse(np.array(ids, np.int64)), t.first, t.last)
        edge = (t.first == 0) | (t.last == len(seqs) - 1)
        every = np.ones(len(edge), bool)
        leaf = t.children(every) == 0
        leaves = t.subtree(np.where(edge, 0, leaf))
        saved = t.subtree(np.where(edge, 0, (convs - 1) * t.chars))
        ended = np.full(len(edge), empty, object)
        ended[t.whole] = ends[t.first[t.whole]]
        inner = np.flatnonzero(~edge)
        up = t.parent[inner]
        shared = edge[up]
        side = np.where(t.first[up] == 0, 0, 1)
        count = len(inner)
        for lo in range(0, count, 1 << 16):
            i, s, u, d = (x[lo : lo + (1 << 16)] for x in (inner, shared, up, side))
            yield _table(
                {
                    "block": np.full(len(i), block),
                    "side": [None] * len(i),
                    "depth": t.depth[i],
                    "conv_id": least[i],
                    "parent_id": pa.array(least[u], pa.int64(), mask=s),
                    "parent_side": pa.array(d, pa.int32(), mask=~s),
                    "n_convs": convs[i],
                    "n_children": t.children(every)[i],
                    "n_leaves": leaves[i],
                    "saved_tokens": saved[i],
                    "ends_sha256": ended[i].tolist(),
                }
                | {f.name: pa.nulls(len(i), f.type) for f in list(schema)[-8:]},
                schema,
            )
        kids = t.children(~edge)
        paths = {f.name: [] for f in schema}
        for which, on in enumerate((t.first == 0, (t.first > 0) & (t.last == len(seqs) - 1))):
            nodes = np.flatnonzero(on)
            if len(nodes):
                nodes = nodes[np.argsort(t.depth[nodes])]
                given = {"block": block, "side": which, "seq": seqs[0 if which == 0 else -1], "since": int(t.depth[nodes[0]])}
                given |= {"convs": convs[nodes], "ids": least[nodes], "kids": kids[nodes], "leaves": leaves[nodes], "saved": saved[nodes], "ends": ended[nodes].tolist()}
                for f in schema:
                    paths[f.name].append(given.get(f.name))
        yield _table(paths, schema)


def _shared_nodes(batches, empty: str, schema: pa.Schema):
    """The trie of all paths, which adds up the parts of each node; also every place of a path, as a row with its block.

    Rows with ``n_convs`` are nodes; the others tell the id of the node at (block, side, depth).
    """
    rows = [r for batch in batches for r in batch.to_pylist()]
    if not rows:
        return
    rows.sort(key=lambda r: r["seq"])
    t = Trie([r["seq"] for r in rows])
    # The node of each depth of each path: the deepest compact node whose interval holds it comes last in preorder.
    places = [np.arange(r["since"], r["since"] + len(r["ids"])) for r in rows]
    path = np.repeat(np.arange(len(rows)), [len(p) for p in places])
    depth = np.concatenate(places)
    order = np.lexsort((t.first, t.depth))
    wide = len(rows) + 1
    node = order[np.searchsorted((t.depth * wide + t.first)[order], depth * wide + path, side="right") - 1]

    def total(name: str, how=np.add, zero=0) -> np.ndarray:
        out = np.full(len(t.depth), zero, np.int64)
        how.at(out, node, np.concatenate([np.asarray(r[name], np.int64) for r in rows]))
        return out

    convs, ids = total("convs"), total("ids", np.minimum, np.iinfo(np.int64).max)
    kids = total("kids") + t.children(np.ones(len(t.depth), bool))
    leaves = total("leaves") + t.subtree(kids == 0)
    saved = total("saved") + t.subtree((convs - 1) * t.chars)
    ended = np.full(len(t.depth), empty, object)
    for at, sha in zip(node, (e for r in rows for e in r["ends"]), strict=True):
        if sha != empty:
            ended[at] = sha
    m = len(t.depth)
    given = {"depth": t.depth, "conv_id": ids, "parent_id": pa.array(ids[np.maximum(t.parent, 0)], pa.int64(), mask=t.parent < 0)}
    given |= {"n_convs": convs, "n_children": kids, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ended.tolist()}
    yield _table({f.name: given.get(f.name, pa.nulls(m, f.type)) for f in schema}, schema)
    blocks = np.array([r["block"] for r in rows], np.int64)
    sides = np.array([r["side"] for r in rows], np.int64)
    given = {"block": blocks[path], "side": sides[path], "depth": depth, "conv_id": ids[node]}
    yield _table({f.name: given.get(f.name, pa.nulls(len(path), f.type)) for f in schema}, schema)


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """Nodes of the trie of ``sequences(conv_id, seq)`` of :func:`turn_sequences`.

    Returns per node: conv_id (the smallest of its members, which are the
    conversations that begin with its turns), depth, parent_conv_id (that of the
    node one turn shorter; null for the root), n_convs (members), n_children,
    n_leaves (childless nodes of its subtree), saved_tokens (over the nodes of
    its subtree, members but one times code points of the last text) and
    ends_sha256 (of the ascending ids of the members that end here,
    comma-joined).

    Conversations with equal turns are one sequence with a count before they are
    sorted, combined ahead of the shuffle. A digest of ids cannot be split, so
    the ids of equal conversations pass through one task, sorted, one at a time.
    The order is dealt out by ranges of whole sequences; a task holds one block
    of up to 2**18 sequences or 64 MiB, and one sequence at least. The shared
    paths, two of a block, are added up in one task: two rows for 2**18
    sequences, or for a range if that has fewer.

    Turns are equal if the MD5 of role and text are. An empty sequence is a
    member of the root only. An id that stands in several rows counts with each.
    Rows without an id or a sequence are left out, and extra columns ignored; an
    empty table gives no nodes, not even a root.
    """
    spark = sequences.sparkSession
    scratch = Scratch(spark, "trie")
    base = sequences.select(F.col("conv_id").cast("long").alias("conv_id"), "seq").where("conv_id IS NOT NULL AND seq IS NOT NULL")
    base = scratch.keep(base.withColumn("key", F.unhex(F.md5("seq"))), "sequences")
    ends = base.select("key", "conv_id").repartition(partitions(spark), "key").sortWithinPartitions("key", "conv_id").mapInArrow(_ends, "key binary, ends string")
    distinct = base.groupBy("key", "seq").agg(F.count("*").alias("n"), F.min("conv_id").alias("id")).join(ends, "key").drop("key")
    empty = hashlib.sha256(b"").hexdigest()
    parts = f"{_NODES}, {_PATHS}"
    schema = _arrow(spark, parts)
    ranged = distinct.repartitionByRange(partitions(spark), "seq").sortWithinPartitions("seq")
    local = scratch.keep(ranged.mapInArrow(partial(_local_nodes, empty=empty, schema=schema), parts), "local")
    paths = local.where("seq IS NOT NULL").repartition(1)
    shared = scratch.keep(paths.mapInArrow(partial(_shared_nodes, empty=empty, schema=_arrow(spark, _NODES)), _NODES), "shared")
    names = shared.where("n_convs IS NULL").select("block", F.col("side").alias("parent_side"), F.col("depth").alias("up"), F.col("conv_id").alias("shared_id"))
    out = ["conv_id", "depth", "parent_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = local.where("seq IS NULL").withColumn("up", F.col("depth") - 1).join(names, ["block", "parent_side", "up"], "left")
    inner = inner.withColumn("parent_id", F.coalesce("parent_id", "shared_id")).select(*out)
    return inner.unionAll(shared.where("n_convs IS NOT NULL").select(*out)).withColumnRenamed("parent_id", "parent_conv_id")


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
