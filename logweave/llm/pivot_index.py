"""Approximate nearest neighbours by a permutation index.

A bounded sample of vectors serves as pivots. Every vector is represented by the order of its nearest pivots and posted
in the inverted files of the first of them. A query reads the files of its own nearest pivots, ranks what it meets in each
by footrule distance between the two orders, and reranks the first of every file by the exact distance on the original
vectors. Long files are cut into chunks and many queries of a file into lots; each pair is a task of its own.

The pivots, about the square root of the number of rows, are those with the smallest hash of id and vector; every row is
indexed. A query reads files in proportion to them, so its share of the table stays the same at every size while what it reranks
grows with the root only: vectors without any structure cannot be found by reading less. Queries that meet fewer than ``k`` rows
in their files, as where rows lie in many small heaps, are answered in full.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, neither do those
whose length is not that of most sampled vectors; a query gets all candidates if there are fewer than ``k``; ties
go to the smaller id; of several vectors under one id the nearest counts, and none is a neighbour of its own id; a query id with
several vectors asks with that of the smallest hash; null ids take no part; extra columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, staged
from .vectors import matrix, usable

#: Postings in a chunk of a pivot's file, and queries in a lot.
CHUNK, LOT = 4096, 1024


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, order: int) -> np.ndarray:
    """Numbers of the nearest pivots, nearest first, ties to the smaller number."""
    closer = 0.5 * (pivots**2).sum(axis=1) - x @ pivots.T
    return np.argsort(closer, axis=1, kind="stable")[:, :order].astype(np.int32)


def footrule(asked: np.ndarray, orders: np.ndarray, pivots: int) -> np.ndarray:
    """Footrule distance of one order to each of many; a pivot beyond the end of an order has the place after the last."""
    length = len(asked)
    place = np.full(pivots, length, dtype=np.int32)
    place[asked] = np.arange(length, dtype=np.int32)
    theirs = place[orders]  # where the asked order has the pivots of the others
    # its own pivots that another lacks count from their place to the end: all of them, less those that the other has
    alone = length * (length + 1) // 2
    return (np.abs(theirs - np.arange(length, dtype=np.int32)) - (length - theirs)).sum(axis=1, dtype=np.int64) + alone


def search(
    vectors: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    order: int = 128,
    posted: int = 8,
    probed: int = 24,
    rerank: int = 128,
) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` found for each row of ``queries`` by Euclidean distance.

    Returns ``query_id, rank, id_col, score``. Orders have ``order`` pivots, of which ``posted`` get a posting. A query reads
    ``probed`` files of 256 (at least so many) and reranks the ``rerank`` first of each chunk of a file by footrule.
    """
    spark = vectors.sparkSession
    prepare(spark)

    def taking_part(df: DataFrame) -> DataFrame:
        rows = df.select(df[id_col].cast("bigint").alias("id"), df[vector_col].cast("array<double>").alias("v"))
        return rows.filter(usable(F.col("v")) & F.col("id").isNotNull())

    rows, asked = taking_part(vectors), taking_part(queries)
    pivots = 1 << max(4, math.ceil(math.log2(max(1, rows.count())) / 2))
    sample = rows.withColumn("h", F.xxhash64("id", "v")).orderBy("h", "id").limit(pivots).select("v").toPandas()  # at most `pivots` rows
    lengths = sample["v"].map(len)
    dim = int(lengths.mode().iloc[0]) if len(sample) else 0
    pivot = np.unique(matrix(sample["v"][lengths == dim]), axis=0) if dim else np.zeros((1, 1))
    m = len(pivot)
    order, posted, probed = min(order, m), min(posted, m), min(max(probed, probed * m // 256), m)

    def represent(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            yield pdf.assign(near=list(nearest_pivots(matrix(pdf["v"]), pivot, max(order, probed)))) if len(pdf) else pdf.assign(near=[])

    schema = "id bigint, v array<double>, near array<int>"
    fitting = F.size("v") == dim
    index = staged(rows.filter(fitting).mapInPandas(represent, schema), "pivot-index")
    once = asked.filter(fitting).groupBy("id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))
    asking = staged(once.mapInPandas(represent, schema), "pivot-queries")

    def cut(df: DataFrame, files: int, size: int, name: str) -> DataFrame:
        """Into how many parts each pivot's rows are cut: a row a pivot at most."""
        counted = df.select(F.explode(F.slice("near", 1, files)).alias("pivot")).groupBy("pivot").agg(F.count("*").alias("n"))
        return F.broadcast(counted.select("pivot", F.ceil(F.col("n") / size).alias(name)))

    def parts(own: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), own - 1))

    def spread(df: DataFrame, files: int) -> DataFrame:
        rows = df.select("id", "v", F.slice("near", 1, order).alias("near"), F.explode(F.slice("near", 1, files)).alias("pivot"))
        return rows.join(chunks, "pivot").join(queues, "pivot")

    chunks, queues = cut(index, posted, CHUNK, "chunks"), cut(asking, probed, LOT, "lots")
    posts = spread(index, posted).select("id", "v", "near", "pivot", F.pmod(F.xxhash64("id", "v", "pivot"), "chunks").alias("chunk"), parts(F.col("lots")).alias("lot"))
    probes = spread(asking, probed).select("id", "v", "near", "pivot", F.pmod(F.xxhash64("id", "pivot"), "lots").alias("lot"), parts(F.col("chunks")).alias("chunk"))

    def read_file(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return nearest([])
        left = left.sort_values("id", kind="stable")  # equal footrules go to the smaller id
        ids, x = left["id"].to_numpy(), matrix(left["v"])
        orders = np.stack(left["near"])
        found = []
        for query_id, v, near in zip(right["id"], right["v"], right["near"]):
            best = np.arange(len(ids)) if rerank >= len(ids) else np.argsort(footrule(near, orders, m), kind="stable")[: rerank + 1]
            best = best[ids[best] != query_id][:rerank]
            found.append(exactly(query_id, v, ids[best], x[best]))
        return nearest(found)

    def read_all(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids, x = left["id"].to_numpy(), matrix(left["v"])
        return nearest([exactly(i, v, ids[ids != i], x[ids != i]) for i, v in zip(right["id"], right["v"])] if len(left) else [])

    def exactly(query_id: int, v: np.ndarray, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        distance = np.sqrt(((x - np.asarray(v)) ** 2).sum(axis=1)) if len(ids) else np.zeros(0)
        top = np.lexsort((ids, distance))
        top = top[np.sort(np.unique(ids[top], return_index=True)[1])[:k]]  # of rows of one id the nearest
        return np.full(len(top), query_id), ids[top], distance[top]

    def nearest(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
        columns = map(np.concatenate, zip(*found)) if found else ([], [], [])
        return pd.DataFrame(dict(zip(("query_id", "id", "score"), columns)))

    def ranked(met: DataFrame) -> DataFrame:
        near = met.groupBy("query_id", "id").agg(F.min("score").alias("score"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
        return near.withColumn("rank", place).filter(F.col("rank") <= k)

    result = "query_id bigint, id bigint, score double"
    key = ["pivot", "chunk", "lot"]
    first = staged(ranked(posts.groupBy(*key).cogroup(probes.groupBy(*key)).applyInPandas(read_file, result)), "pivot-found")
    # queries that have met fewer rows than there are (each id once) meet all chunks of the table
    enough = first.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select(F.col("query_id").alias("id"))
    short = staged(asking.select("id", "v").join(enough, "id", "left_anti"), "pivot-short")
    few = short.count()
    out = first
    if few:
        chunks, queues = max(1, -(-index.count() // CHUNK)), max(1, -(-few // LOT))
        left = index.select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(chunks)).alias("chunk"), parts(F.lit(queues)).alias("lot"))
        right = short.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(queues)).alias("lot"), parts(F.lit(chunks)).alias("chunk"))
        full = ranked(left.groupBy("chunk", "lot").cogroup(right.groupBy("chunk", "lot")).applyInPandas(read_all, result))
        out = first.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(full)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
