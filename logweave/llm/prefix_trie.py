"""Prefix trie of conversations, built as a Patricia tree.

Turns become keys (128 bits of the SHA-256 of role and text) before anything is shuffled, equal conversations one sequence of
keys with a count. The sequences are sorted by ranges; a task reads its range in order and keeps the path of the sequence at hand,
with a point only where sequences branch, end or are leaves, and edges that skip the depths between. What two neighbours share decides what
closes: a point's members, leaves and savings are final then, and its edge is expanded to one node a depth, the savings by suffix
sums over the edge.

Prefixes that reach over ranges lie on the path of the first or of the last sequence of a range. Every depth of these two paths is
handed on as a partial node, without what hangs below it on the path; partial nodes of all ranges are added up by prefix and summed from
the deepest up. They are at most two paths a task, however many rows there are. So one prefix may hold any share of the conversations: its
range is cut wherever the sort cuts it, and nothing collects a prefix's members. The ids that end at a node are hashed as they
come in order, by a task that holds one batch.

Defined results: a null role or text is an empty one; turns are ordered by their number (null first), those of one number by key, so equal
ones are interchangeable; repeated rows are turns of their own. Rows without a conversation id take no part. A conversation without
turns is a member of the root only. Extra columns are ignored; an empty table has no nodes. One conversation is one row of its keys
(24 bytes a turn).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, staged

#: Bytes of a turn's key, and rows in a batch handed back.
KEY, BATCH = 16, 4096
NONE = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, turns)``: per conversation its turns in order, as ``(turn, key, size)`` with the text's code points as size."""
    c = conversations
    role, text = F.coalesce(c[role_col].cast("string"), F.lit("")), F.coalesce(c[text_col].cast("string"), F.lit(""))
    key = F.substring(F.sha2(F.concat_ws(":", F.length(role), role, text), 256), 1, 2 * KEY)
    rows = c.select(c[conv_col].cast("bigint").alias("conv_id"), F.struct(c[turn_col].alias("turn"), key.alias("key"), F.length(text).alias("size")).alias("t"))
    return rows.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def with_shared_starts(seqs: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """Sequences whose first ``h`` turns are those of the first conversation of their block of ids, ``h = crc32(id) % most``."""
    starts = seqs.filter(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("start"))
    met = seqs.withColumn("base", F.col("conv_id") - F.col("conv_id") % block).join(starts, "base", "left")
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    return met.select("conv_id", F.when(F.col("start").isNull(), own).otherwise(F.concat(F.slice("start", 1, h), own)).alias("turns"))


@dataclass
class Point:
    """What is known of a prefix from its own end and from what is closed below it."""

    depth: int
    n: int = 0
    first: int | None = None
    leaves: int = 0
    children: int = 0
    saved: int = 0
    ends: str | None = None
    waiting: list[tuple] = field(default_factory=list)  # rows of children, until this point's first member is known

    def end(self, n: int, first: int, ends: str) -> None:
        self.n, self.first, self.ends = self.n + n, first if self.first is None else min(first, self.first), ends

    def take(self, n: int, first: int, leaves: int, saved: int) -> None:
        self.n, self.first = self.n + n, first if self.first is None else min(first, self.first)
        self.leaves, self.children, self.saved = self.leaves + leaves, self.children + 1, self.saved + saved


def shared_turns(a: bytes, b: bytes) -> int:
    """How many turns two sequences have in common at their beginning."""
    low, high = 0, min(len(a), len(b)) // KEY
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low * KEY : middle * KEY] == b[low * KEY : middle * KEY] else (low, middle - 1)
    return low


def prefixes(path: bytes) -> list[bytes]:
    """A digest of every prefix of a sequence, the empty one included."""
    state = hashlib.sha256()
    found = [state.digest()[:KEY]]
    for at in range(0, len(path), KEY):
        state.update(path[at : at + KEY])
        found.append(state.digest()[:KEY])
    return found


# columns of what a task hands on: nodes whose parent is known (0), whose parent is a partial node (1), partial nodes (2)
NAMES = ("side", "node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "size", "ends_sha256")
SCHEMA = "side int, node binary, parent binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, size bigint, ends_sha256 string"
TYPES = {"side": pa.int32(), "node": pa.binary(), "parent": pa.binary(), "ends_sha256": pa.string()}


class Range:
    """The trie of one range of sorted sequences."""

    def __init__(self, path: bytes, sizes: list[int], n: int, first: int, ends: str):
        """Begins with the first sequence, whose prefixes are all partial nodes."""
        self.border = [Point(d) for d in range(len(sizes) + 1)]
        self.border_path, self.border_sizes, self.border_ids = path, sizes, prefixes(path)
        self.on_border = len(sizes)  # so many turns of the sequence at hand are on the first one's path
        self.border[-1].end(n, first, ends)
        self.path, self.sizes, self.stack, self.rows = path, sizes, [], []

    def add(self, path: bytes, sizes: list[int], n: int, first: int, ends: str) -> None:
        shared = shared_turns(self.path, path)
        while self.stack and self.stack[-1].depth > shared:
            point = self.stack.pop()
            above = self.stack[-1].depth if self.stack else self.on_border
            if above < shared:  # a branch within the edge
                self.stack.append(Point(shared))
            self.close(point)
        self.on_border = min(self.on_border, shared)
        if shared > (self.stack[-1].depth if self.stack else self.on_border):
            self.stack.append(Point(shared))
        self.path, self.sizes = path, sizes
        self.stack.append(Point(len(sizes)))
        self.stack[-1].end(n, first, ends)

    def close(self, point: Point) -> None:
        """All below the point is known: its edge becomes nodes, and its parent takes what it amounts to."""
        parent = self.stack[-1] if self.stack else self.border[self.on_border]
        leaves, children, ends, saved = point.leaves or 1, point.children, point.ends or NONE, point.saved
        self.settle(point)
        for depth in range(point.depth, parent.depth, -1):
            saved += (point.n - 1) * self.sizes[depth - 1]
            row = (point.first, depth, point.first, point.n, children, leaves, saved, None, ends)
            if depth > parent.depth + 1:
                self.rows.append((0, None, None, *row))
            elif self.stack:
                parent.waiting.append(row)
            else:
                self.rows.append((1, None, self.border_ids[parent.depth], *row))
            children, ends = 1, NONE
        parent.take(point.n, point.first, leaves, saved)

    def settle(self, point: Point) -> None:
        self.rows += [(0, None, None, *row[:2], point.first, *row[3:]) for row in point.waiting]
        point.waiting = []

    def finish(self) -> None:
        """The first and the last sequence's paths, a partial node a depth."""
        self.partial(self.border, self.border_sizes, self.border_ids)
        ids, points = prefixes(self.path), {p.depth: p for p in self.stack}
        self.partial([points.get(d) or Point(d) for d in range(self.on_border + 1, len(self.sizes) + 1)], self.sizes, ids)
        for point in self.stack:
            self.rows += [(1, None, ids[point.depth], *row) for row in point.waiting]

    def partial(self, points: list[Point], sizes: list[int], ids: list[bytes]) -> None:
        for p in points:
            above, size = (ids[p.depth - 1], sizes[p.depth - 1]) if p.depth else (None, 0)
            self.rows.append((2, ids[p.depth], above, p.first, p.depth, None, p.n, p.children, p.leaves, p.saved, size, p.ends))


def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The trie of a task's range, from sorted ``(path, sizes, n, first, ends)``."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, TYPES.get(n, pa.int64())) for n, c in zip(NAMES, zip(*rows))], names=list(NAMES))

    trie = None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("path", "sizes", "n", "first", "ends"))):
            if trie is None:
                trie = Range(*row)
            else:
                trie.add(*row)
            if len(trie.rows) >= BATCH:
                yield batch_of(trie.rows)
                trie.rows = []
    if trie is not None:
        trie.finish()
        for at in range(0, len(trie.rows), BATCH):
            yield batch_of(trie.rows[at : at + BATCH])


def member_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined ids of every sequence, from rows sorted by sequence and id."""
    held, state = None, None
    names = ["seq", "ends"]
    for batch in batches:
        ids = batch.column("conv_id").to_pylist()
        runs = batch.column("seq").to_pylist()
        done, begin = [], 0
        for at in range(1, len(runs) + 1):
            if at == len(runs) or runs[at] != runs[begin]:
                joined = ",".join(map(str, ids[begin:at])).encode()
                if held == runs[begin]:
                    state.update(b"," + joined)
                else:
                    if held is not None:
                        done.append((held, state.hexdigest()))
                    held, state = runs[begin], hashlib.sha256(joined)
                begin = at
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=names)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held], pa.binary()), pa.array([state.hexdigest()])], names=names)


NODES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def summed_up(key: tuple, partial: pd.DataFrame) -> pd.DataFrame:
    """Partial nodes with all that hangs below them, from the deepest up."""
    at = {bytes(r.node): r for r in partial.itertuples()}
    total = {k: [r.n_convs, r.first if r.first_known else None, r.n_children, r.n_leaves, r.saved_tokens] for k, r in at.items()}
    order = sorted(at, key=lambda k: -at[k].depth)
    for k in order:
        own = total[k]
        own[3] = own[3] or 1  # nothing below: a leaf
        own[4] += (own[0] - 1) * at[k].size
        if at[k].depth:
            above = total[bytes(at[k].parent)]
            above[0] += own[0]
            above[1] = own[1] if above[1] is None else min(above[1], own[1])
            above[2], above[3], above[4] = above[2] + 1, above[3] + own[3], above[4] + own[4]
    rows = [(k, total[k][1], at[k].depth, total[bytes(at[k].parent)][1] if at[k].depth else None, total[k][0], *total[k][2:], at[k].ends) for k in order]
    return pd.DataFrame(rows, columns=["node", *NODES]).astype({"parent_conv_id": "Int64"})


def prefix_trie(seqs: DataFrame) -> DataFrame:
    """A row for every different beginning of the sequences ``(conv_id, turns)``.

    Returns ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.
    """
    prepare(seqs.sparkSession)
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), ""))
    coded = seqs.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    convs = staged(coded.withColumn("seq", F.substring(F.unhex(F.sha2("path", 256)), 1, KEY)), "conversations")
    distinct = convs.groupBy("seq", "path", "sizes").agg(F.count("*").alias("n"), F.min("conv_id").alias("first"))
    # the ids of sequences with several members, in order; those of one member need no shuffle
    several = convs.select("seq", "conv_id").join(distinct.filter("n > 1").select("seq"), "seq", "left_semi")
    hashes = several.repartition("seq").sortWithinPartitions("seq", "conv_id").mapInArrow(member_hashes, "seq binary, ends string")
    ends = F.coalesce("ends", F.sha2(F.col("first").cast("string"), 256)).alias("ends")
    ready = staged(distinct.join(hashes, "seq", "left").select("path", "sizes", "n", "first", ends), "sequences")
    found = staged(ready.repartitionByRange("path").sortWithinPartitions("path").mapInArrow(tries, SCHEMA), "trie")
    added = found.filter("side = 2").groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("size").alias("size"), F.coalesce(F.min("conv_id"), F.lit(0)).alias("first"), (F.count("conv_id") > 0).alias("first_known"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.coalesce(F.max("ends_sha256"), F.lit(NONE)).alias("ends"),
    )
    # at most two paths a task of the build, in one group
    paths = staged(added.groupBy().applyInPandas(summed_up, "node binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"), "paths")
    hanging = found.filter("side = 1").drop("parent_conv_id", "node").join(paths.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
    return found.filter("side = 0").select(*NODES).unionByName(hanging.select(*NODES)).unionByName(paths.select(*NODES))
