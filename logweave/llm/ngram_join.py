"""Exact n-gram Jaccard self-join by signature trees, reported as components of linked documents.

Which documents meet in a tree is decided without loss, in three narrowing steps on distinct shingle sets:

1. *Unique shingles.* If two sets have Jaccard similarity t or more, each shares at least the share t of its shingles.
   So a set with more than ``(1 - t) * size`` shingles that occur in no other set links with nothing. Half of the
   shingle space is enough to see that (small sets use all of it), and most documents end here.
2. *Prefixes.* The rest is ordered rarest shingle first; linked sets share a shingle of their prefixes of
   ``floor((1 - t) * size) + 1``. Sets that share one, directly or through others, form a routing group.
3. *Trees.* Groups are joined by dual traversal of signature trees; what no node pair rules out is verified on the
   whole sets. Large groups are cut into blocks within size classes, and every block pair of near enough sizes is a
   task of its own.

Shingles travel between steps as packed arrays by range of their hash, never as one row each, and what many sets of a batch
have in common is put together before it travels: a passage that a third of all documents share costs every batch a few
entries. Equal sets are one set throughout, told apart by 128-bit digests and then named by row numbers. Nothing is capped, and
nothing but counts comes to the driver.

Defined results: texts without words (or null) have size 0 and link with nothing; texts shorter than n words have the
whole sequence as their one shingle; a null id is returned with its size and the component of its equals, and is never
the smallest of a component that has an id; repeated rows are equal sets; extra columns are ignored; an empty table
gives an empty table. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop_staged, give_back, prepare, staged
from .segments import coded_segments
from .signature_trees import linked

MIX = np.uint64(0x9E3779B97F4A7C15)
FOLD = np.uint64(0xFF51AFD7ED558CCD)
#: In step 1 sets below this size are judged by all their shingles, larger ones by those with an even hash.
SMALL = 40
#: Sets in a block of a routing group, and shingles in it.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1 << 21


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted shingle hashes of each text."""
    texts = pc.ascii_lower(pc.fill_null(texts, ""))
    texts = pc.ascii_trim(pc.replace_substring_regex(texts, r"[\x09-\x0d ]+", " "), " ")
    offsets, codes, words = coded_segments(texts)
    if len(offsets) < 2:
        return []
    word = np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)[codes]
    empty = np.array([not w for w in words], dtype=bool)[codes[offsets[:-1]]]
    rolled = word.copy()
    for k in range(1, min(n, len(word))):
        rolled[: len(word) - k] = rolled[: len(word) - k] * MIX + word[k:]
    rolled ^= rolled >> np.uint64(33)
    rolled *= FOLD
    rolled ^= rolled >> np.uint64(29)
    out = []
    for a, b, none in zip(offsets[:-1].tolist(), offsets[1:].tolist(), empty.tolist()):
        if none:
            out.append(rolled[:0])
        elif b - a < n:
            whole = hashlib.blake2b(word[a:b].tobytes(), digest_size=8).digest()
            out.append(np.frombuffer(whole, dtype=np.uint64))
        else:
            out.append(np.unique(rolled[a : b - n + 1]))
    return out


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit halves that stand for a set."""
    raw = np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), dtype=np.int64)
    return int(raw[0]), int(raw[1])


def missing(size: np.ndarray, num: int, den: int) -> np.ndarray:
    """Most shingles that a set of this size can lack in a set it links with."""
    return size - -(-num * size // den)


def shown(shingles: np.ndarray) -> np.ndarray:
    """The shingles of a set that step 1 compares: all of those that a set judged in full may link with."""
    return shingles if len(shingles) < SMALL * 2 else shingles[(shingles & np.uint64(1)) == 0]


def judged(shingles: np.ndarray) -> int:
    """How many shingles of a set step 1 judges it by."""
    return len(shingles) if len(shingles) < SMALL else int(((shingles & np.uint64(1)) == 0).sum())


def by_range(hashes: np.ndarray, ranges: int) -> Iterator[tuple[int, np.ndarray]]:
    """Positions of the hashes in each of ``ranges`` equal parts of the hash space."""
    part = ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(ranges + 1, dtype=np.uint64))
    for r in np.flatnonzero(np.diff(edges)):
        yield int(r), order[edges[r] : edges[r + 1]]


def runs(hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by hash, then owner, and the starts of the runs of equal hashes in that order."""
    order = np.lexsort((owners, hashes))
    ordered = hashes[order]
    return order, np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]
    return a[new], b[new]


def _coded(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of two 64-bit halves, and each row's number among them."""
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    ordered = halves[order]
    new = np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(axis=1)])[: len(ordered)]
    codes = np.empty(len(halves), dtype=np.int64)
    codes[order] = np.cumsum(new) - 1
    return ordered[new], codes


#: Of a shingle that several sets of a batch have, the batch sends so many owners: enough to show that it is shared.
SENT = 2


def _survey(docs: DataFrame, n: int, ranges: int) -> DataFrame:
    """Per document its size, digest and ``credit`` (range -1), and the shown shingles packed by range.

    A shingle that more than ``SENT`` sets of a batch have is shared whatever the others hold, so the batch sends the first of them
    only and credits the rest with it at once. A set met in several batches may be credited with a shingle twice, which can only
    keep it in play.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["range", "id", "size", "seen", "credit", "d0", "d1", "hashes", "local", "owners"]
        give_back()
        for batch in batches:
            sets = shingle_sets(batch.column(1), n)
            if not sets:
                continue
            digests = [digest(s) for s in sets]
            m = len(sets)
            credit = np.zeros(m, dtype=np.int64)
            first = {d: k for k, d in reversed(list(enumerate(digests)))}
            chosen = np.array([k for k in sorted(first.values()) if len(sets[k])], dtype=np.int64)
            hashes = local = np.zeros(0, dtype=np.uint64)
            if len(chosen):
                views = [shown(sets[k]) for k in chosen]
                hashes = np.concatenate(views)
                local = np.repeat(np.arange(len(chosen), dtype=np.uint16), [len(v) for v in views])
                order = np.argsort(hashes, kind="stable")
                hashes, local = hashes[order], local[order]
                starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))[: len(hashes)]
                place = np.arange(len(hashes)) - np.repeat(starts, np.diff(np.append(starts, len(hashes))))
                beyond = place >= SENT
                credit[chosen] = np.bincount(local[beyond], minlength=len(chosen))
                hashes, local = hashes[~beyond], local[~beyond]
            columns = [
                pa.array([-1] * m, pa.int64()), batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([judged(s) for s in sets], pa.int64()), pa.array(credit),
                pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), *[pa.nulls(m, pa.binary())] * 3,
            ]
            yield pa.RecordBatch.from_arrays(columns, names)
            if not len(hashes):
                continue
            owners = np.array([digests[k] for k in chosen], dtype=np.int64)
            rows = []
            for r, at in by_range(hashes, ranges):
                used, renamed = np.unique(local[at], return_inverse=True)
                rows.append((r, hashes[at].tobytes(), renamed.astype(np.uint16).tobytes(), owners[used].tobytes()))
            m = len(rows)
            columns = [pa.array([row[0] for row in rows], pa.int64()), pa.nulls(m, batch.column(0).type), *[pa.nulls(m, pa.int64())] * 5]
            columns += [pa.array([row[k] for row in rows], pa.binary()) for k in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"range bigint, id {kind}, size bigint, seen bigint, credit bigint, d0 bigint, d1 bigint, hashes binary, local binary, owners binary")


def _shared_counts(packs: DataFrame, ranges: int) -> DataFrame:
    """Per set the number of its sent shingles that another set has too: rows ``(d0, d1, shared)``."""

    def tally(pdf: pd.DataFrame) -> pd.DataFrame:
        tables = [np.frombuffer(o, dtype=np.int64).reshape(-1, 2) for o in pdf["owners"]]
        distinct, codes = _coded(np.concatenate(tables))
        starts = np.cumsum([0, *map(len, tables)])
        hashes = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in pdf["hashes"]])
        owners = np.concatenate([codes[a + np.frombuffer(x, dtype=np.uint16).astype(np.int64)] for a, x in zip(starts, pdf["local"])])
        hashes, owners = distinct_pairs(hashes, owners)  # an owner met in several batches sends its shingles again
        starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        lengths = np.diff(np.append(starts, len(hashes)))
        who, counts = np.unique(owners[np.repeat(lengths > 1, lengths)], return_counts=True)
        rows = list(by_range(distinct[who, 0].view(np.uint64), ranges))
        return pd.DataFrame({"part": [r for r, _ in rows], "who": [distinct[who[at]].tobytes() for _, at in rows], "counts": [counts[at].astype(np.int32).tobytes() for _, at in rows]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        own, at = _coded(np.concatenate([np.frombuffer(x, dtype=np.int64).reshape(-1, 2) for x in pdf["who"]]))
        counts = np.concatenate([np.frombuffer(x, dtype=np.int32) for x in pdf["counts"]])
        return pd.DataFrame({"d0": own[:, 0], "d1": own[:, 1], "shared": np.bincount(at, weights=counts, minlength=len(own)).astype(np.int64)})

    tallied = packs.groupBy("range").applyInPandas(tally, "part bigint, who binary, counts binary")
    return tallied.groupBy("part").applyInPandas(add, "d0 bigint, d1 bigint, shared bigint")


def _prefix_edges(blobs: DataFrame, ranges: int, num: int, den: int) -> DataFrame:
    """Edges between sets that share a shingle of their rarest-first prefixes.

    ``blobs(blob, owners, sizes, hashes)`` holds many whole sets a row. A blob asks once for a shingle that several of its sets
    have, telling how many they are, and ties them to one another itself.
    """

    def send(pdf_iter: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        for pdf in pdf_iter:
            for row in pdf.itertuples(index=False):
                hashes, counts = np.unique(np.frombuffer(row.hashes, dtype=np.uint64), return_counts=True)
                found = list(by_range(hashes, ranges))
                yield pd.DataFrame({"range": [r for r, _ in found], "blob": row.blob, "hashes": [hashes[at].tobytes() for _, at in found], "counts": [counts[at].astype(np.int32).tobytes() for _, at in found]})

    def rarity(pdf: pd.DataFrame) -> pd.DataFrame:
        """Back to each blob: for its shingles of this range, in order, how many sets have them (0: one), as a logarithm."""
        hashes = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in pdf["hashes"]])
        counts = np.concatenate([np.frombuffer(x, dtype=np.int32) for x in pdf["counts"]])
        _, at = np.unique(hashes, return_inverse=True)
        classes = np.ceil(np.log2(np.bincount(at, weights=counts))).astype(np.uint8)[at]
        edges = np.cumsum([0, *[len(x) // 8 for x in pdf["hashes"]]])
        return pd.DataFrame({"blob": pdf["blob"], "range": pdf["range"], "classes": [classes[a:b].tobytes() for a, b in zip(edges, edges[1:])]})

    def prefixes(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts: list[tuple[int, bytes, bytes]] = []
        ties: list[tuple[np.ndarray, np.ndarray]] = []
        for row in left.itertuples(index=False):
            hashes = np.frombuffer(row.hashes, dtype=np.uint64)
            owners, sizes = np.frombuffer(row.owners, dtype=np.int64), np.frombuffer(row.sizes, dtype=np.int64)
            distinct, at_distinct = np.unique(hashes, return_inverse=True)
            classes = np.zeros(len(distinct), dtype=np.uint8)
            told = dict(zip(right["range"], right["classes"]))
            for r, at in by_range(distinct, ranges):
                classes[at] = np.frombuffer(told[r], dtype=np.uint8)
            classes = classes[at_distinct]
            chosen, whose, ends = [], [], np.cumsum(sizes)
            for owner, a, b in zip(owners, (ends - sizes).tolist(), ends.tolist()):
                length = int(missing(np.int64(b - a), num, den)) + 1
                order = np.lexsort((hashes[a:b], classes[a:b]))[:length]
                order = order[classes[a:b][order] > 0]
                chosen.append(hashes[a:b][order])
                whose.append(np.full(len(order), owner))
            picked, least, a, b = stars_of(np.concatenate(chosen), np.concatenate(whose))
            ties.append((a, b))
            parts += [(r, picked[at].tobytes(), least[at].tobytes()) for r, at in by_range(picked, ranges)]
        a, b = (np.concatenate(x) for x in zip(*ties)) if ties else (np.zeros(0, dtype=np.int64),) * 2
        out = pd.DataFrame(parts, columns=["range", "hashes", "owners"])
        return pd.concat([out, pd.DataFrame({"range": [-1], "hashes": [a.tobytes()], "owners": [b.tobytes()]})])

    def stars_of(hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes, the least owner of each, and that owner's distinct ties to the others."""
        order, starts = runs(hashes, owners)
        starts = starts[: len(order)]
        least = owners[order][starts]
        a, b = distinct_pairs(np.repeat(least, np.diff(np.append(starts, len(order)))), owners[order])
        return hashes[order][starts], least, a[a != b], b[a != b]

    def stars(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in pdf["hashes"]])
        owners = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in pdf["owners"]])
        _, _, a, b = stars_of(hashes, owners)
        return pd.DataFrame({"a": a, "b": b})

    def unpack(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for x, y in zip(pdf["hashes"], pdf["owners"]):
                yield pd.DataFrame({"a": np.frombuffer(x, dtype=np.int64), "b": np.frombuffer(y, dtype=np.int64)})

    sent = blobs.mapInPandas(send, "range bigint, blob string, hashes binary, counts binary")
    told = sent.groupBy("range").applyInPandas(rarity, "blob string, range bigint, classes binary")
    picked = staged(blobs.groupBy("blob").cogroup(told.groupBy("blob")).applyInPandas(prefixes, "range bigint, hashes binary, owners binary"), "ngram-prefixes")
    across = picked.filter("range >= 0").groupBy("range").applyInPandas(stars, "a bigint, b bigint")
    return across.union(picked.filter("range < 0").select("hashes", "owners").mapInPandas(unpack, "a bigint, b bigint"))


def _verified(sets: DataFrame, groups: DataFrame, num: int, den: int) -> DataFrame:
    """Links among the sets of each routing group, enough to join what is linked: rows ``(a, b)``."""
    spark = sets.sparkSession
    member = groups.join(sets.select("node", "size"), "node")
    # sets whose sizes are further apart than the similarity allows never link, so classes meet only their neighbours
    member = member.withColumn("cls", F.floor(F.log("size") / float(np.log(den / num))).cast("int"))
    totals = member.groupBy("grp").agg(F.count("*").alias("g_sets"), F.sum("size").alias("g_size"))
    classes = member.groupBy("grp", "cls").agg(F.count("*").alias("c_sets"), F.sum("size").alias("c_size"))
    blocks = classes.withColumn("n_blocks", F.ceil(F.greatest(F.col("c_sets") / BLOCK_SETS, F.col("c_size") / BLOCK_SHINGLES)).cast("int"))
    large = (F.col("g_sets") > BLOCK_SETS) | (F.col("g_size") > BLOCK_SHINGLES)
    plain = totals.filter(~large).select("grp")
    cut = totals.filter(large).select("grp").join(blocks.select("grp", "cls", "n_blocks"), "grp")
    above = cut.select("grp", (F.col("cls") - 1).alias("cls"), F.col("n_blocks").alias("up"))
    below = cut.select("grp", (F.col("cls") + 1).alias("cls"), F.col("n_blocks").alias("down"))
    cut = cut.join(above, ["grp", "cls"], "left").join(below, ["grp", "cls"], "left").fillna(0, ["up", "down"])
    lots = max(1, member.count() // 2000)

    small_rows = member.join(plain, "grp").select("node", "grp", (F.abs(F.xxhash64("grp")) % lots).alias("t0"), F.lit(-1).alias("t1"), F.lit(-1).alias("t2"), F.lit(-1).alias("t3"), F.lit(0).alias("side"))
    own = F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")

    def task(cls, i, j, side):
        return F.struct(cls.cast("int").alias("t1"), i.cast("int").alias("t2"), j.cast("int").alias("t3"), F.lit(side).alias("side"))

    # a block meets itself and later blocks of its class, and all blocks of the next class (t2 even: same class, odd: next)
    every = F.sequence(F.lit(0), F.col("n_blocks") - 1)
    tasks = F.concat(
        F.transform(F.filter(every, lambda j: j >= F.col("own")), lambda j: task(F.col("cls"), F.col("own") * 2, j, 0)),
        F.transform(F.filter(every, lambda i: i < F.col("own")), lambda i: task(F.col("cls"), i * 2, F.col("own"), 1)),
        F.when(F.col("up") > 0, F.transform(F.sequence(F.lit(0), F.col("up") - 1), lambda j: task(F.col("cls"), F.col("own") * 2 + 1, j, 0))).otherwise(F.array().cast("array<struct<t1:int,t2:int,t3:int,side:int>>")),
        F.when(F.col("down") > 0, F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda i: task(F.col("cls") - 1, i * 2 + 1, F.col("own"), 1))).otherwise(F.array().cast("array<struct<t1:int,t2:int,t3:int,side:int>>")),
    )
    large_rows = (
        member.join(cut, ["grp", "cls"])
        .withColumn("own", own)
        .select("node", "grp", F.explode(tasks).alias("t"))
        .select("node", "grp", F.col("grp").alias("t0"), "t.t1", "t.t2", "t.t3", "t.side")
    )
    routed = small_rows.unionByName(large_rows).join(sets.select("node", "shingles"), "node")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        edges: list[tuple[int, int]] = []
        for _, group in pdf.sort_values(["grp", "node"], kind="stable").groupby("grp", sort=False):
            sides = [group[group["side"] == s] for s in (0, 1)]
            names = np.concatenate([s["node"].to_numpy() for s in sides])
            arrays = [[np.frombuffer(x, dtype=np.uint64) for x in s["shingles"]] for s in sides]
            cross = int(group["t1"].iloc[0]) >= 0 and (int(group["t2"].iloc[0]) % 2 == 1 or int(group["t2"].iloc[0]) // 2 != int(group["t3"].iloc[0]))
            if cross and not (arrays[0] and arrays[1]):
                continue
            found = linked(arrays[0], num, den, arrays[1]) if cross else linked(arrays[0], num, den)
            edges += [(int(names[a]), int(names[b])) for a, b in found]
        return pd.DataFrame(edges, columns=["a", "b"], dtype=np.int64)

    return routed.groupBy("t0", "t1", "t2", "t3").applyInPandas(join, "a bigint, b bigint")


#: Filters that one task puts together.
FAN_IN = 16


class IdFilter:
    """A Bloom filter over 64-bit hashes: false for most others, never false for its own."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        raw = hashes.astype(np.int64).view(np.uint64)
        return raw & np.uint64(size - 1), (raw >> np.uint64(32)) & np.uint64(size - 1)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        a, b = self.places(hashes, 8 * len(self.bits))
        test = lambda at: (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
        return (test(a) & test(b)).astype(bool)


def id_filter(hashes: DataFrame, most_bits: int = 1 << 28):
    """A broadcast ``IdFilter`` of the column ``h``: 16 bits a value, 32 MB at most (beyond that it only spares less)."""
    size = 1 << int(np.clip(np.ceil(np.log2(16 * max(1, hashes.count()))), 13, np.log2(most_bits)))

    def fill(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(size // 8, dtype=np.uint8)
        for pdf in pdfs:
            for at in IdFilter.places(pdf["h"].to_numpy(), size):
                np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))
        yield pd.DataFrame({"bits": [bits.tobytes()]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(size // 8, dtype=np.uint8)
        for x in pdf["bits"]:
            bits |= np.frombuffer(x, dtype=np.uint8)
        return pd.DataFrame({"bits": [bits.tobytes()]})

    # a filter a task, put together in a tree of tasks, so that none reads more than FAN_IN of them
    filters = staged(hashes.mapInPandas(fill, "bits binary"), "ngram-filters")
    while (parts := filters.count()) > 1:
        dealt = filters.withColumn("lot", F.floor(F.rand(7) * -(-parts // FAN_IN)))
        merged = staged(dealt.groupBy("lot").applyInPandas(merge, "bits binary"), "ngram-filters")
        drop_staged(filters)
        filters = merged
    row = filters.first()
    bits = np.frombuffer(row["bits"], dtype=np.uint8) if row else np.zeros(size // 8, dtype=np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(IdFilter(bits))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """Documents with the size of their shingle set and the smallest id of their component.

    Two documents link when ``100 * overlap >= percent * union`` of their sets of ``n``-word shingles. Returns
    ``id_col, n_shingles, component_id`` and ``class_id`` (the smallest id with an equal set), a row per row of ``docs``.
    """
    spark = docs.sparkSession
    prepare(spark)
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    num, den = percent, 100
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    ranges = max(12, docs.count() // 4096)
    survey = staged(_survey(source, n, ranges), "ngram-survey")
    rows = staged(survey.filter("range = -1").select("id", "size", "seen", "credit", "d0", "d1"), "ngram-rows")
    classes = rows.filter("size > 0").groupBy("d0", "d1").agg(F.min("id").alias("rep"), F.first("size").alias("size"), F.first("seen").alias("seen"), F.sum("credit").alias("credit"))
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "ngram-classes")
    shared = _shared_counts(survey.filter("range >= 0").select("range", "hashes", "local", "owners"), ranges)
    lacking = F.col("size") - F.ceil(F.col("size") * num / den)
    live = staged(
        classes.join(shared, ["d0", "d1"], "left").filter(F.coalesce("shared", F.lit(0)) + F.col("credit") >= F.col("seen") - lacking).select("d0", "d1", "node", "rep"),
        "ngram-live",
    )

    drop_staged(survey)  # the largest table; all that is left of it is in the two above
    # the texts of the sets in play are read again; a filter of bounded size spares the others without shuffling any text
    maybe = id_filter(live.select(F.xxhash64(F.col("rep")).alias("h")))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(maybe.value(batch.column(1).to_numpy())))
            sets = shingle_sets(batch.column(0), n)
            digests = [digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["d0", "d1", "size", "shingles"],
            )

    sets = source.select("text", F.xxhash64("id").alias("h")).mapInArrow(whole, "d0 bigint, d1 bigint, size bigint, shingles binary")
    sets = sets.join(live.select("d0", "d1", "node"), ["d0", "d1"]).dropDuplicates(["node"])
    sets = staged(sets.select("node", "size", "shingles"), "ngram-sets")

    def gather(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for at in range(0, len(pdf), 1024):
                some = pdf.iloc[at : at + 1024]
                owners = some["node"].to_numpy(dtype=np.int64).tobytes()
                name = hashlib.blake2b(owners, digest_size=16).hexdigest()
                yield pd.DataFrame({"blob": [name], "owners": [owners], "sizes": [some["size"].to_numpy(dtype=np.int64).tobytes()], "hashes": [b"".join(some["shingles"])]})

    blobs = staged(sets.mapInPandas(gather, "blob string, owners binary, sizes binary, hashes binary"), "ngram-blobs")
    groups = staged(components(_prefix_edges(blobs, ranges, num, den)).select("node", F.col("component").alias("grp")), "ngram-groups")
    joined = components(_verified(sets, groups, num, den)).select("node", "component")
    drop_staged(live, sets, blobs, groups)
    least = classes.join(joined, "node", "left").select("d0", "d1", "rep", F.coalesce("component", "node").alias("component"))
    smallest = least.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = least.join(smallest, "component").select("d0", "d1", "rep", "component_id")
    out = rows.join(named, ["d0", "d1"], "left")
    own = F.when(F.col("size") == 0, F.col("id"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("size").alias("n_shingles"),
        F.coalesce(own, "component_id").alias("component_id"),
        F.coalesce(own, "rep").alias("class_id"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without near duplicates: of each component of linked texts one row stays.

    Rows are told apart by id and text together. The row with the smallest id stays, of several texts under one id that with the
    smaller MD5, and of rows equal in id and text one (where other columns differ, that with the smallest hash of all
    columns). Texts without words are nobody's duplicates; neither are rows without an id.
    """
    key = F.struct(docs[id_col].alias("id"), F.md5(F.coalesce(docs[text_col], F.lit("")).cast("binary")).alias("text"))
    keyed = docs.withColumn("__key", F.when(docs[id_col].isNotNull(), key))
    named = keyed.filter("__key is not null")
    groups = jaccard_components(named.select("__key", F.col(text_col).alias("text")), "__key", "text", n, percent)
    groups = staged(groups.filter("n_shingles > 0").groupBy("__key").agg(F.first(F.col("__key") > F.col("component_id")).alias("gone"), F.count("*").alias("rows")), "ngram-keys")
    several = groups.filter("rows > 1 and not gone").select("__key")
    left = keyed.join(groups.filter("gone or rows > 1").select("__key"), "__key", "left_anti")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = named.join(several, "__key").groupBy("__key").agg(F.min_by(row, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).alias("row")).select("row.*")
    return left.select(docs.columns).unionByName(once.select(docs.columns))
