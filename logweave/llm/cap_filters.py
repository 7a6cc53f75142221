"""Embedding near-duplicates by spherical-cap filters.

Filter directions are structured random product codes: the coordinates (after a random rotation) are cut into blocks,
each block has its own list of random unit code words, and a direction is one code word of every block. The inner product with
a direction is a sum over blocks, so all directions whose cap holds a vector are *list-decoded* by adding up block
scores and dropping partial sums that can no longer reach the cap's height. Several independent codes are used, as the
directions of one code hang together: three, and one more for every 64-fold of the vectors beyond 16,384, since caps grow
smaller with their number (measured right at the threshold, with three codes: no miss in 12,000 pairs of 10,256
vectors, one in 2,000 of a million; a miss is a miss of all codes). Vectors meet in the buckets of (label, direction), where every
pair is verified in double precision; a pair is counted only in the first direction it shares. Equal vectors are one vector
with a weight, known by 128 bits of hashes and named by a row number. Buckets over ``BLOCK`` vectors are cut into blocks,
and each pair of blocks is a task of its own, so a hot group is spread and nothing is left out.

Defined results: vectors that are null, zero, empty or hold null or non-finite components, and those without a label,
link with nothing (0 links, their own component); vectors of different lengths never link; repeated rows link with one
another; a null id keeps its links and is the smallest of a component only if no other id is there (``kept`` is then
false); extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop_staged, prepare, staged
from .vectors import matrix, usable

#: Vectors in a block of a bucket.
BLOCK = 1024
#: Rows of a bucket up to which its pairs are compared one by one with those of other buckets, and pairs compared at once.
FEW, SLAB = 48, 1 << 14
#: Cosines so close to the threshold are summed again without rounding.
ROUNDING = 1e-9
#: Independent codes at least, and the fewest directions of each that a vector takes: where it exceeds fewer, its caps are widened.
CODES, LEAST = 3, 6


class ProductCode:
    """Random product-code directions for one dimension; the same everywhere for the same arguments."""

    def __init__(self, dim: int, directions: int, per_vector: float, seed: int):
        rng = np.random.default_rng([seed, dim])
        self.blocks = max(1, min(dim, 2 if directions <= 1 << 16 else 3 if directions <= 1 << 24 else 4))
        self.words = max(2, math.ceil(directions ** (1 / self.blocks)))
        self.rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        self.edges = np.linspace(0, dim, self.blocks + 1).astype(int)
        self.code = []
        for a, b in zip(self.edges, self.edges[1:]):
            words = rng.normal(size=(self.words, b - a))
            self.code.append(words / np.linalg.norm(words, axis=1, keepdims=True))
        share = min(0.5, per_vector / self.words**self.blocks)
        self.height = NormalDist().inv_cdf(1 - share) * math.sqrt(self.blocks / dim)

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """Per unit vector the sorted numbers of all directions that it exceeds."""
        turned = unit @ self.rotation
        scores = [turned[:, a:b] @ words.T for a, b, words in zip(self.edges, self.edges[1:], self.code)]
        out = []
        for row in zip(*scores):
            height = self.height
            while True:
                found = self._above(row, height)
                if len(found) >= min(LEAST, self.words**self.blocks):
                    break
                height -= 0.04 * abs(self.height) + 1e-3
            out.append(np.sort(found))
        return out

    def _above(self, row: tuple[np.ndarray, ...], height: float) -> np.ndarray:
        best = [0.0, *np.cumsum([s.max() for s in row[:0:-1]])][::-1]  # most that later blocks can add
        sums, number = np.zeros(1), np.zeros(1, dtype=np.int64)
        for scores, rest in zip(row, best):
            total = (sums[:, None] + scores[None, :]).ravel()
            reach = total + rest >= height
            sums = total[reach]
            number = (number[:, None] * self.words + np.arange(self.words)[None, :]).ravel()[reach]
        return number


def _pairs(first: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slabs of pairs: each row with the ``count`` rows from ``first`` on."""
    rows = np.flatnonzero(count)
    ends = np.cumsum(count[rows])
    for a in range(0, int(ends[-1]) if len(ends) else 0, SLAB):
        at = np.arange(a, min(a + SLAB, int(ends[-1])))
        k = np.searchsorted(ends, at, side="right")
        yield rows[k], first[rows[k]] + at - (ends[k] - count[rows[k]])


def _met_before(filters: np.ndarray, offsets: np.ndarray, rows: np.ndarray, left: int, direction: int) -> np.ndarray:
    """Whether rows before ``left`` share a direction before ``direction`` with each of the rows after (with all rows, if ``left`` is all)."""
    whose = np.repeat(np.arange(len(rows)), offsets[rows + 1] - offsets[rows])
    held = np.concatenate([filters[offsets[r] : offsets[r + 1]] for r in rows])
    early = held < direction
    names, code, count = np.unique(held[early], return_inverse=True, return_counts=True)
    several = count[code] > 1  # what one row holds alone is shared by none
    code, whose = np.unique(code[several], return_inverse=True)[1], whose[early][several]
    first, second = slice(0, left), slice(0 if left == len(rows) else left, len(rows))
    out = np.zeros((left, second.stop - second.start), dtype=bool)
    for a in range(0, int(code.max(initial=-1)) + 1, 512):
        at = (code >= a) & (code < a + 512)
        held_by = np.zeros((len(rows), 512), dtype=np.float32)
        held_by[whose[at], code[at] - a] = 1.0
        out |= held_by[first] @ held_by[second].T > 0
    return out


def _decide(unit: np.ndarray, i: np.ndarray, j: np.ndarray, cosine: np.ndarray, near: np.ndarray, threshold: float) -> None:
    """Pairs within rounding of the threshold are decided by an exact sum, so that how a bucket was compared changes nothing."""
    doubtful = np.nonzero(np.abs(cosine - threshold) <= ROUNDING)
    if len(doubtful[0]):
        i, j = (np.broadcast_to(x, near.shape)[doubtful] for x in (i, j))
        near[doubtful] = [math.fsum(unit[a] * unit[b]) >= threshold for a, b in zip(i, j)]


def _near_pairs(unit: np.ndarray, starts: np.ndarray, middles: np.ndarray, ends: np.ndarray, threshold: float, direction: np.ndarray, filters: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one bucket with enough cosine that no earlier bucket has met.

    Rows before a bucket's middle meet those after it; without one (-1) all meet all.
    """
    size = ends - starts
    few = size <= FEW
    bucket = np.repeat(np.arange(len(starts)), size)
    row, cut = np.arange(len(unit)), middles[bucket]
    first = np.where(cut < 0, row + 1, cut)
    count = np.where((cut < 0) | (row < cut), ends[bucket] - first, 0) * few[bucket]
    for i, j in _pairs(first, count):
        cosine = np.einsum("ij,ij->i", unit[i], unit[j])
        near = cosine >= threshold
        _decide(unit, i, j, cosine, near, threshold)
        i, j = i[near], j[near]
        fresh = _first_shared(filters, offsets, i, j, direction[i])
        yield i[fresh], j[fresh]
    for s, m, e in zip(starts[~few].tolist(), middles[~few].tolist(), ends[~few].tolist()):
        split = e if m < 0 else m
        cosine = unit[s:split] @ unit[s if m < 0 else m : e].T
        near = cosine >= threshold
        i, j = np.indices(near.shape, sparse=True)
        _decide(unit, i + s, j + (s if m < 0 else m), cosine, near, threshold)
        if m < 0:
            near = np.triu(near, 1)
        if near.any():
            near &= ~_met_before(filters, offsets, np.arange(s, e), split - s, int(direction[s]))
        i, j = np.nonzero(near)
        yield i + s, j + (s if m < 0 else m)


def _first_shared(filters: np.ndarray, offsets: np.ndarray, i: np.ndarray, j: np.ndarray, direction: np.ndarray) -> np.ndarray:
    """Whether no direction before ``direction`` is in the (sorted) filters of both rows of a pair."""
    rows, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    i, j = at[: len(i)], at[len(i) :]
    sizes = offsets[rows + 1] - offsets[rows]
    width = int(sizes.max(initial=0))
    padded = np.full((len(rows), width), -1, dtype=np.int64)
    inner = np.arange(width) < sizes[:, None]
    padded[inner] = filters[(offsets[rows][:, None] + np.arange(width))[inner]]
    fresh = np.ones(len(i), dtype=bool)
    step = max(1, (1 << 22) // max(1, width * width))
    for a in range(0, len(i), step):
        u, v, d = padded[i[a : a + step]], padded[j[a : a + step]], direction[a : a + step, None]
        u = np.where(u < d, u, -1)
        fresh[a : a + step] = ~((u[:, :, None] == v[:, None, :]) & (u[:, :, None] >= 0)).any(axis=(1, 2))
    return fresh


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.93,
    per_vector: float = 6.0,
    bucket: float = 1.0,
) -> DataFrame:
    """Link vectors of equal labels whose cosine is at least ``threshold``.

    Returns ``id_col, n_links, component_id, kept``. ``per_vector`` is the aimed number of directions a vector and
    code, ``bucket`` that of vectors a direction and label; the number of directions follows from both and the number of vectors.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].cast("array<double>").alias("v"), vectors[label_col].alias("label"))
    known = usable(F.col("v")) & F.col("label").isNotNull()
    rows = rows.withColumns({"h0": F.when(known, F.xxhash64("label", "v")), "h1": F.when(known, F.xxhash64(F.lit(1), "label", "v"))})
    grouped = rows.filter("h0 is not null").groupBy("h0", "h1").agg(F.min("id").alias("rep"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("v").alias("v"))
    distinct = staged(grouped.withColumn("node", F.monotonically_increasing_id()), "cap-vectors")
    total = distinct.count()
    directions = 1 << max(8, math.ceil(math.log2(max(1, total * per_vector / (bucket * 10)))))
    n_codes = CODES + max(0, math.ceil(math.log2(max(1, total / 16384)) / 6))

    def decode(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes: dict[int, list[ProductCode]] = {}
        for pdf in pdfs:
            sizes = pdf["v"].map(len)
            for dim, part in pdf.groupby(sizes):
                x = matrix(part["v"])
                unit = x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)
                if dim not in codes:
                    codes[dim] = [ProductCode(dim, directions, per_vector, seed) for seed in range(n_codes)]
                found = zip(*[code.decode(unit) for code in codes[dim]])
                filters = [np.concatenate([f + k * code.words**code.blocks for k, (f, code) in enumerate(zip(own, codes[dim]))]) for own in found]
                yield pd.DataFrame({"node": part["node"], "weight": part["weight"], "label": part["label"].astype(str), "unit": list(unit), "dim": dim, "filters": filters})

    decoded = staged(
        distinct.select("node", "weight", F.col("label").cast("string").alias("label"), "v").mapInPandas(decode, "node bigint, weight bigint, label string, unit array<double>, dim int, filters array<bigint>"),
        "cap-filters",
    )
    posts = decoded.select("node", "label", "dim", F.explode("filters").alias("direction"))
    # a direction alone in its bucket meets nobody
    counts = posts.groupBy("label", "dim", "direction").agg(F.count("*").alias("n")).filter("n > 1")
    key = ["label", "dim", "direction"]
    posts = posts.join(counts, key).withColumn("n_blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("node", "direction"), F.col("n_blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("n_blocks") - 1)
    met = F.transform(every, lambda o: F.struct(F.least(o, F.col("own")).alias("t0"), F.greatest(o, F.col("own")).alias("t1")))
    lots = max(1, total // 64)
    tasks = (
        posts.withColumn("own", own)
        .select("node", *key, "own", "n_blocks", F.explode(met).alias("t"))
        .select("node", *key, "own", "t.t0", "t.t1", F.when(F.col("n_blocks") == 1, F.pmod(F.xxhash64(*key), F.lit(lots))).otherwise(F.xxhash64(*key, "t.t0", "t.t1")).alias("lot"))
    )
    routed = tasks.join(decoded.select("node", "weight", "unit", "filters"), "node")

    def verify(lot: pa.Table) -> pa.Table:
        lot = lot.combine_chunks()
        label = pc.dictionary_encode(lot["label"]).combine_chunks()
        keys = [lot[c].to_numpy() for c in ("node", "own", "t1", "t0", "direction")] + [(label.chunk(0) if isinstance(label, pa.ChunkedArray) else label).indices.to_numpy()]
        order = np.lexsort(keys)
        node, own, t1, t0, direction, kind = (x[order] for x in keys)
        lot = lot.take(pa.array(order)).combine_chunks()
        unit = pc.list_flatten(lot["unit"]).to_numpy().reshape(len(order), -1)
        new = np.concatenate([[True], (kind[1:] != kind[:-1]) | (direction[1:] != direction[:-1]) | (t0[1:] != t0[:-1]) | (t1[1:] != t1[:-1])])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(order))
        before = np.add.reduceat((own == t0).astype(np.int64), starts)
        middles = np.where(t0[starts] == t1[starts], -1, starts + before)
        held = lot["filters"].combine_chunks()
        held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
        filters, offsets = held.flatten().to_numpy(), held.offsets.to_numpy() - held.offsets[0].as_py()
        met = [(i, j) for i, j in _near_pairs(unit, starts, middles, ends, threshold, direction, filters, offsets) if len(i)]
        i, j = (np.concatenate(x) for x in zip(*met)) if met else (np.zeros(0, dtype=np.int64),) * 2
        names, code = np.unique(node, return_inverse=True)
        weight = lot["weight"].to_numpy()
        links = np.bincount(code[i], weights=weight[j], minlength=len(names)) + np.bincount(code[j], weights=weight[i], minlength=len(names))
        at = np.flatnonzero(links)
        a, b = _forest(len(names), code[i], code[j])
        nothing = lambda n: pa.nulls(n, pa.int64())
        first = pa.table([pa.array(names[at]), pa.array(links[at].astype(np.int64)), nothing(len(at)), nothing(len(at))], names=["node", "links", "a", "b"])
        second = pa.table([nothing(len(a)), nothing(len(a)), pa.array(names[a]), pa.array(names[b])], names=["node", "links", "a", "b"])
        return pa.concat_tables([first, second])

    found = staged(routed.groupBy("dim", "lot").applyInArrow(verify, "node bigint, links bigint, a bigint, b bigint"), "cap-links")
    links = found.filter("node is not null").groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.filter("a is not null").select("a", "b"))
    drop_staged(decoded)
    member = distinct.select("node", "h0", "h1", "rep", "weight").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")).join(links, "node", "left")
    least = member.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = member.join(least, "component").select("h0", "h1", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = rows.select("id", "h0", "h1").join(named, ["h0", "h1"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node with a link, tied to the smallest node of its component: at most n edges."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        if (root == before).all():
            break
    at = np.flatnonzero(root != np.arange(n))
    return root[at], at
