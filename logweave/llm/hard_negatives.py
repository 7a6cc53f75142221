"""Hard negatives: per anchor, all rows sorted by an exact integer score, read from the upper limit of each positive.

Components are quantised to ``floor(scale * x)`` and a score is the inner product of two such vectors, exact whatever its size.
For an anchor, the rows are sorted by score (higher first) and id. Its positives are the first rows of its own label; for each of
them, the place of its upper limit is found by binary search among the rows of other labels, and ``k`` rows are read from there
on while they reach its lower limit.

How it is spread: anchors are cut into lots of bounded bytes, which are sent to every task in turn; rows of the table are never
shuffled. A task sorts its rows a block at a time for every anchor of the lot and merges what it has read, so it holds one block and the
few rows kept an anchor; the parts of all tasks meet by anchor (positives) or by anchor and positive (negatives), where windows with a
limit take the first. First all positives are found, then, with the limits known, the negatives.

Defined results: rows with a null id, label or vector or any null or non-finite component take no part; neither do vectors of another
length than the anchor's for that anchor. Zero vectors take part, with scores of 0. Ties go to the smaller id. Of rows under one id, each
counts for what it is, but an id appears once among an anchor's positives and once among the negatives of a positive, by its best
score, and never as positive or negative of its own anchor; an anchor id with several rows asks with that of the smallest hash.
Positives without a negative within the limits give no row; extra columns are ignored; an empty table gives an empty table. Scores
beyond a long are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_staged, prepare, staged

#: Bytes of the vectors in a lot of anchors, rows in a block, and anchors whose scores over a block are held at once.
LOT_BYTES, BLOCK, AT_ONCE = 32 << 20, 32_768, 32
#: Largest sum of products that float64 holds exactly.
EXACT = float(2**53)


@dataclass(frozen=True)
class Rows:
    """Rows whose vectors have one length, sorted by id."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray


def rows_by_length(batch: pa.Table | pa.RecordBatch, scale: int) -> dict[int, tuple[Rows, np.ndarray]]:
    """The batch's quantised rows by the length of their vectors, each with the places its rows had in the batch."""
    ids, labels = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(c).to_numpy()) for c in ("id", "label"))
    column = batch.column("v")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    starts = np.cumsum(lengths) - lengths
    found = {}
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        at = at[np.argsort(ids[at], kind="stable")]
        found[int(length)] = Rows(ids[at], labels[at], flat[starts[at][:, None] + np.arange(length)]), at
    return found


def scores(anchors: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products, one row an anchor."""
    largest = np.abs(anchors).max(initial=0.0) * np.abs(x).max(initial=0.0) * max(1, x.shape[1])
    if largest < EXACT:
        return (anchors @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m], dtype=object).reshape(m.shape)
    return whole(anchors) @ whole(x).T if x.shape[1] else np.zeros((len(anchors), len(x)), dtype=np.int64)


def first_distinct(ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the first ``n`` different ids."""
    head = ids[: 4 * n]
    places = np.sort(np.unique(head, return_index=True)[1])[:n]
    if len(places) < n and len(ids) > len(head):
        places = np.sort(np.unique(ids, return_index=True)[1])[:n]
    return places


class Best:
    """The ``n`` best ``(score, id)`` of every one of some lists, fed block by block."""

    def __init__(self, n: int):
        self.n, self.lists = n, {}

    def add(self, key: tuple, score: np.ndarray, ids: np.ndarray) -> None:
        """More rows of a list, best first and of different ids."""
        if key in self.lists:
            score, ids = np.concatenate([self.lists[key][0], score]), np.concatenate([self.lists[key][1], ids])
            order = np.lexsort((ids, -score))
            order = order[first_distinct(ids[order], self.n)]
            score, ids = score[order], ids[order]
        if len(ids):
            self.lists[key] = score[: self.n], ids[: self.n]

    def batches(self, names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
        """Rows ``(*names, score, id)`` of all lists."""
        keys = list(self.lists)
        for at in range(0, len(keys), 4096):
            part = keys[at : at + 4096]
            sizes = [len(self.lists[k][1]) for k in part]
            columns = [pa.array(np.repeat(np.array([k[i] for k in part], dtype=np.int64), sizes)) for i in range(len(names))]
            score, ids = (np.concatenate([self.lists[k][i] for k in part]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*columns, pa.array([int(s) for s in score], pa.int64()), pa.array(ids)], names=[*names, "score", "id"])


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches gathered to about ``BLOCK`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BLOCK:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def sorted_scores(lot: dict[int, tuple[Rows, np.ndarray]], block: dict[int, tuple[Rows, np.ndarray]]) -> Iterator[tuple[int, Rows, np.ndarray, np.ndarray, np.ndarray]]:
    """For every anchor of the lot: its place in the lot, the rows of its length, their scores, their order, and which are other ids.

    Rows are sorted by id, so the stable sort by score is the lexicographic one by score and id.
    """
    for length, (anchors, places) in lot.items():
        if length not in block:
            continue
        rows = block[length][0]
        for at in range(0, len(places), AT_ONCE):
            found = scores(anchors.x[at : at + AT_ONCE], rows.x)
            orders = np.argsort(-found, axis=1, kind="stable")
            for k, (score, order) in enumerate(zip(found, orders), at):
                yield int(places[k]), rows, score, order, rows.ids[order] != anchors.ids[k]


def positives_in(lot: pa.Table, scale: int, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Finds, among a task's rows, the ``n`` best rows of the same label for every anchor of the lot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, best = rows_by_length(lot, scale), Best(n)
        ids, labels = lot.column("id").to_numpy(), lot.column("label").to_numpy()
        for block in blocks(batches):
            for k, rows, score, order, other in sorted_scores(asked, rows_by_length(block, scale)):
                same = order[other & (rows.labels[order] == labels[k])]
                top = same[first_distinct(rows.ids[same], n)]
                best.add((ids[k],), score[top], rows.ids[top])
        yield from best.batches(("anchor_id",))

    return run


def negatives_in(lot: pa.Table, scale: int, k: int, lowest: int, highest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Reads, among a task's rows, the ``k`` best rows of other labels within the limits of each positive of the lot's anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, best = rows_by_length(lot, scale), Best(k)
        ids, labels, positives = lot.column("id").to_numpy(), lot.column("label").to_numpy(), lot.column("positives").to_pylist()
        for block in blocks(batches):
            for a, rows, score, order, other in sorted_scores(asked, rows_by_length(block, scale)):
                different = order[other & (rows.labels[order] != labels[a])]
                falling = score[different]
                for p in positives[a]:
                    upper, lower = highest * p["score"] // 100, -(-lowest * p["score"] // 100)
                    begin, end = np.searchsorted(-falling, -upper, "left"), np.searchsorted(-falling, -lower, "right")
                    if begin < end:
                        within = different[begin:end]
                        top = within[first_distinct(rows.ids[within], k)]
                        best.add((ids[a], p["id"], p["score"]), score[top], rows.ids[top])
        yield from best.batches(("anchor_id", "positive_id", "positive_score"))

    return run


def mine(
    vectors: DataFrame,
    anchors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: int = 256,
    n_positives: int = 5,
    k: int = 10,
    lowest: int = 30,
    highest: int = 90,
) -> DataFrame:
    """Hard negatives among ``vectors`` for the rows of ``anchors``: of another label, with ``lowest`` to ``highest`` percent of a positive's score.

    Returns ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.
    """
    spark = vectors.sparkSession
    prepare(spark)

    def taking_part(df: DataFrame) -> DataFrame:
        rows = df.select(df[id_col].cast("bigint").alias("id"), df[label_col].cast("bigint").alias("label"), df[vector_col].cast("array<double>").alias("v"))
        finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return rows.filter("id is not null and label is not null and v is not null").filter(finite)

    rows = taking_part(vectors)
    one = F.min_by(F.struct("label", "v"), F.xxhash64("label", "v")).alias("r")
    asking = staged(taking_part(anchors).groupBy("id").agg(one).select("id", "r.label", "r.v"), "anchors")
    size = asking.agg(F.sum(8 * F.size("v") + 64).alias("b")).first()["b"] or 0
    lots = -(-size // LOT_BYTES)
    lot_of = F.pmod(F.xxhash64("id"), F.lit(max(1, lots)))

    def over_lots(asked: DataFrame, work: Callable, schema: str, name: str) -> DataFrame:
        """What the tasks find for each lot of anchors, a lot at a time: the driver holds one lot of bounded bytes."""
        parts = [spark.createDataFrame([], schema)]
        for lot in range(lots):
            held = asked.filter(lot_of == lot).toArrow()
            if held.num_rows:
                parts.append(staged(rows.mapInArrow(work(held), schema), name))
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        return found

    def first(found: DataFrame, keys: list[str], n: int) -> DataFrame:
        """The ``n`` best of every list, each id once; parts of a list have few rows a task, and those are limited before the shuffle too."""
        once = found.groupBy(*keys, "id").agg(F.max("score").alias("score"))
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
        return once.withColumn("rank", place).filter(F.col("rank") <= n)

    same = first(over_lots(asking, lambda lot: positives_in(lot, scale, n_positives), "anchor_id bigint, score bigint, id bigint", "positives"), ["anchor_id"], n_positives)
    listed = same.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", "score", "id"))).alias("positives"))
    limited = staged(asking.join(listed, "id"), "limits")
    schema = "anchor_id bigint, positive_id bigint, positive_score bigint, score bigint, id bigint"
    other = first(over_lots(limited, lambda lot: negatives_in(lot, scale, k, lowest, highest), schema, "negatives"), ["anchor_id", "positive_id", "positive_score"], k)
    return other.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
