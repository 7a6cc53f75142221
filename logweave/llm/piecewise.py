"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last ``WINDOW`` bytes of the UTF-8 text decides where chunks end: after a byte at which it leaves the largest
remainder by the block size, which is the smallest of 3, 6, 12, ... with at most ``CHUNKS`` blocks in the text. Every chunk
gives a symbol of 12 bits, and a fingerprint is the block size with the symbols at this and at the doubled size:
``"96:xQaB...:k3Zz..."``, two base64 letters a symbol. An edit changes the chunks around it only, as chunks begin anew at the next
trigger. So that texts without triggers (one letter over and over), or with nothing else, have bounded fingerprints too, a chunk has a
quarter of the block size at least and four times at most.

Likeness of two fingerprints is 1 less the edit distance of their symbols as a share of the longer one, at the finest block size that both
have; it is 0 where they have none in common (texts whose lengths differ more than about four times) and 1 for equal fingerprints.

Defined results: a null is an empty text, whose fingerprint is ``"3::"``; equal texts have equal fingerprints. Whole texts are
hashed, a piece of ``PIECE`` bytes at a time. Documents follow each other by id (null ids first), rows of one id by a hash of their text
and then by the text, so rows equal in both are interchangeable; after the last comes the first, and a single document follows itself.
Extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, staged

WINDOW, CHUNKS, SMALLEST, PIECE = 7, 128, 3, 1 << 20
#: Shortest and longest chunk as multiples of the block size.
LEAST, MOST = 0.25, 4
#: Factors of the bytes in the window: powers of an odd number.
FACTORS = [np.uint32(pow(0x9E3779B1, i + 1, 1 << 32)) for i in range(WINDOW)]
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
SYMBOLS = [a + b for a in LETTERS for b in LETTERS]


def block_size(length: int) -> int:
    size = SMALLEST
    while size * CHUNKS < length:
        size *= 2
    return size


def triggers(data: bytes, size: int) -> tuple[list[int], list[int]]:
    """Ends of chunks that the rolling hash proposes at a block size and at the doubled one."""
    fine, coarse = [], []
    for at in range(0, len(data), PIECE):
        begin = max(0, at - WINDOW + 1)
        byte = np.frombuffer(data, np.uint8, min(len(data), at + PIECE) - begin, begin).astype(np.uint32) + np.uint32(1)
        h = byte * FACTORS[0]
        for i in range(1, WINDOW):
            h[i:] += byte[:-i] * FACTORS[i] if i < len(byte) else 0
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
        h ^= h >> np.uint32(13)
        hit = np.flatnonzero(h[at - begin :] % np.uint32(size) == size - 1) + (at - begin)
        fine += (hit + (begin + 1)).tolist()
        coarse += (hit[h[hit] % np.uint32(2 * size) == 2 * size - 1] + (begin + 1)).tolist()
    return fine, coarse


def chunk_ends(proposed: list[int], length: int, size: int) -> Iterator[int]:
    """Ends of the chunks: the proposed ones, except where a chunk would be too short or too long."""
    last, least, most = 0, max(1, int(LEAST * size)), MOST * size
    while last < length:
        k = bisect_left(proposed, last + least)
        last = min(proposed[k] if k < len(proposed) else length, last + most, length)
        yield last


def signature(data: bytes, proposed: list[int], size: int) -> str:
    view, begin, found = memoryview(data), 0, []
    for end in chunk_ends(proposed, len(data), size):
        found.append(SYMBOLS[zlib.crc32(view[begin:end]) & 4095])
        begin = end
    return "".join(found)


def fingerprint(text: str | None) -> str:
    data = (text or "").encode()
    size = block_size(len(data))
    fine, coarse = triggers(data, size)
    return f"{size}:{signature(data, fine, size)}:{signature(data, coarse, 2 * size)}"


def edit_distance(a: list[str], b: list[str]) -> int:
    """Least number of symbols inserted, deleted or replaced; a column of the table is a pair of integers, its steps up and down as bits."""
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    if not a or not b or not set(a) & set(b):
        return max(len(a), len(b))
    places: dict[str, int] = {}
    for i, s in enumerate(a):
        places[s] = places.get(s, 0) | 1 << i
    whole, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = whole, 0, len(a)
    for s in b:
        equal = places.get(s, 0)
        level = (((equal & up) + up) ^ up) | equal | down
        rise, fall = down | (whole & ~(level | up)), up & level
        distance += bool(rise & top) - bool(fall & top)
        rise, fall = (rise << 1 | 1) & whole, fall << 1 & whole
        up, down = fall | (whole & ~(equal | down | rise)), rise & (equal | down)
    return distance


def symbols(part: str) -> list[str]:
    return [part[i : i + 2] for i in range(0, len(part), 2)]


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, from 0 to 1."""
    if a == b:
        return 1.0
    (m, *left), (n, *right) = a.split(":"), b.split(":")
    sides = {(1, 1): (0, 0), (2, 1): (1, 0), (1, 2): (0, 1)}
    p, q = int(m), int(n)
    which = sides.get((max(1, q // p), max(1, p // q)))
    if which is None:
        return 0.0
    x, y = symbols(left[which[0]]), symbols(right[which[1]])
    return 1.0 - edit_distance(x, y) / max(len(x), len(y)) if x and y else 0.0


def with_fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``docs`` with a fingerprint of every text."""
    prepare(docs.sparkSession)

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(fingerprint, na_action=None)

    return docs.withColumn(out_col, of(docs[text_col]))


def like(a: Column, b: Column) -> Column:
    """Likeness of two columns of fingerprints; null where one is null."""

    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else likeness(p, q) for p, q in zip(x, y)], dtype="float64")

    return of(a, b)


def edited(text: str, following: str) -> str:
    """A text with the last quarter of its letters replaced by as many first ones of the next text, or all it has."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next document's.

    Returns ``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. Documents are sorted by ranges of ids, once;
    a task sees them in order and holds one at a time. The last of a range waits for the first of the next: both are written with the
    results, two rows a task, and meet afterwards.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")
    measured = "id {0}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double".format(kind)
    names = [c.split()[0] for c in measured.split(", ")]

    def measure(doc: object, text: str, own: str, next_text: str, next_own: str) -> tuple:
        changed = edited(text, next_text)
        theirs = own if changed == text else fingerprint(changed)
        return doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, theirs, likeness(own, theirs), likeness(own, next_own)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Results of all documents but the last, and the first and the last with their texts."""
        part, held, first, id_type = TaskContext.get().partitionId(), None, None, None

        def batch_of(done: list[tuple], waiting: Iterable[tuple] = ()) -> pa.RecordBatch:
            waiting = list(waiting)
            columns = list(zip(*done)) or [()] * len(names)
            arrays = {n: list(c) + [w[1] if n == "id" else w[3] if n == "fingerprint" else None for w in waiting] for n, c in zip(names, columns)}
            arrays |= {"side": [0] * len(done) + [w[0] for w in waiting], "part": [part] * (len(done) + len(waiting)), "text": [None] * len(done) + [w[2] for w in waiting]}
            types = {"id": id_type, "n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64(), "side": pa.int32(), "part": pa.int32()}
            return pa.RecordBatch.from_arrays([pa.array(v, types.get(n, pa.string())) for n, v in arrays.items()], names=list(arrays))

        for batch in batches:
            done, id_type = [], batch.schema.field("id").type
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                own = fingerprint(text)
                if held is None:
                    first = (1, doc, text, own)
                else:
                    done.append(measure(*held, text, own))
                held = (doc, text, own)
            yield batch_of(done)
        if held is not None:
            yield batch_of([], [first, (2, *held)])

    found = staged(ordered.mapInArrow(follow, measured + ", side int, part int, text string"), "piecewise")
    # a row a task: the next range with any document, and the first one after the last
    parts = found.filter("side = 1").select("part", F.lead("part").over(Window.orderBy("part")).alias("following"), F.min("part").over(Window.partitionBy(F.lit(0))).alias("beginning"))
    ends = found.filter("side = 2").join(parts, "part").select("id", "text", "fingerprint", F.coalesce("following", "beginning").alias("part"))
    begins = found.filter("side = 1").select("part", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("id", "text", "fingerprint", "next_text", "next_fingerprint")]
            done = list(zip(*(measure(*row) for row in zip(*columns)))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(done, (batch.schema.field("id").type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2))], names=names)

    last = ends.join(begins, "part").select("id", "text", "fingerprint", "next_text", "next_fingerprint").mapInArrow(close, measured)
    return found.filter("side = 0").select(*names).unionByName(last).withColumnRenamed("id", id_col)
