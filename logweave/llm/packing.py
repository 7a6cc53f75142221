"""Packing of token sequences: first-fit decreasing over a tournament tree of bin capacities.

A document's ids (by the tokenizer, then one end id) are cut into full pieces of ``capacity`` ids, each a sequence of its
own, and one shorter tail. Tails are packed by first-fit decreasing, independently in randomised groups of documents,
so that no task sees more than about ``group_docs`` documents, whatever the size of the table. The tournament tree
holds the largest free capacity below every node, so the first bin that fits is found in a logarithm of the bins.

Defined results: a null text counts as empty, an empty text is the end id alone; texts of any length are cut whole;
repeated rows are packed like any others, each with pieces of its own; null ids are kept as they are; extra columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, prepare
from .segments import ragged_gather, segment_arrays

#: Bytes of pieces and their ids kept between batches, those of one piece, and the characters of one that is not kept.
CACHE, ENTRY, LONG = 120 << 20, 200, 64
#: Pieces encoded in one text (with many more, the library's splitting of a text slows down), and texts whose encodings are held at once.
JOINED, LOT = 64, 64
#: Letters and marks of which every version of Unicode says so, in a regular expression.
LETTERS = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{17F}\x{391}-\x{3A1}\x{3A3}-\x{3A9}\x{3B1}-\x{3C9}\x{410}-\x{44F}\x{4E00}-\x{9FA5}"
MARKS = r"!-/:-@\[-`{-~"


class SegmentTokenizer:
    """Ids of whole texts by a byte-level BPE tokenizer, with each distinct piece of a word encoded once.

    The tokenizer's pattern starts a new token at a blank after any other character but white space, so texts are cut
    there. A text where a blank follows white space, or with the text of a special token in it, goes to the tokenizer
    as a whole. Distinct words are cut once more where a token ends whatever follows: behind a letter before a mark, and
    behind a single line end. So a word has the same pieces whatever marks and line ends it is written with.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Bytes of text that each id stands for: a character of a byte-level token is a byte, of an added one what it says.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.token_bytes = np.ones(self.tokenizer.get_vocab_size() + 1, dtype=np.int64)
        self.token_bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        for i, added in self.tokenizer.get_added_tokens_decoder().items():
            self.token_bytes[i] = len(added.content.encode())
        #: Piece number k has the ids ``flat[bounds[k] : bounds[k + 1]]``.
        self.known: dict[str, int] = {}
        self.flat, self.bounds = np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)

    def _alone(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one text after the other, and each one's number of ids."""
        ids, counts = [np.zeros(0, dtype="<u4")], [np.zeros(0, dtype=np.int64)]
        for at in range(0, len(texts), LOT):
            got = [e.ids for e in self.tokenizer.encode_batch_fast(texts[at : at + LOT], add_special_tokens=False)]
            ids.append(np.fromiter(chain.from_iterable(got), dtype="<u4"))
            counts.append(np.fromiter(map(len, got), dtype=np.int64, count=len(got)))
        return np.concatenate(ids), np.concatenate(counts)

    def _joined(self, pieces: list[str], between: str) -> tuple[np.ndarray, np.ndarray]:
        """The same, from one text of many pieces: cheaper than a text each. ``between`` is one token, or nothing where pieces begin with a blank."""
        ids, _ = self._alone([between.join(pieces[at : at + JOINED]) + between for at in range(0, len(pieces), JOINED)])
        sizes = pc.binary_length(pa.array(pieces, pa.large_string())).to_numpy(zero_copy_only=False).astype(np.int64) + len(between)
        ends = np.searchsorted(np.cumsum(self.token_bytes[ids]), np.cumsum(sizes)) + 1
        if between:
            ids = np.delete(ids, ends - 1)
            ends -= np.arange(1, len(ends) + 1)
        return ids, np.diff(ends, prepend=0)

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """The numbers of distinct pieces, those not seen before being encoded."""
        codes = np.fromiter(map(self.known.get, pieces, repeat(-1)), dtype=np.int64, count=len(pieces))
        if (len(self.known) + int((codes < 0).sum())) * ENTRY > CACHE:  # only those in use stay
            used = np.flatnonzero(codes >= 0)
            lengths = np.diff(self.bounds)[codes[used]]
            self.flat = ragged_gather(self.flat, self.bounds[codes[used]], lengths)
            self.bounds = np.concatenate([[0], np.cumsum(lengths)])
            codes[used] = np.arange(len(used))
            self.known.clear()
            self.known = {pieces[k]: n for n, k in enumerate(used.tolist())}
        # 0: a blank in front keeps pieces apart in one text; 1: line ends do; 2: white space at an end, encoded alone; 3: long, not kept
        kinds: list[list[int]] = [[], [], [], []]
        for k in np.flatnonzero(codes < 0).tolist():
            t = pieces[k]
            kinds[3 if len(t) > LONG else 2 if not t or t == " " or t[-1].isspace() else 0 if t[0] == " " else 2 if t[0].isspace() else 1].append(k)
        flats, counts, at = [self.flat], [np.diff(self.bounds)], len(self.bounds) - 1
        for kind, encode in enumerate((lambda some: self._joined(some, ""), lambda some: self._joined(some, "\n"), self._alone, self._alone)):
            if kinds[kind]:
                some = [pieces[k] for k in kinds[kind]]
                for grown, more in zip((flats, counts), encode(some)):
                    grown.append(more)
                codes[kinds[kind]] = np.arange(at, at + len(some))
                if kind < 3:
                    self.known.update(zip(some, range(at, at + len(some))))
                at += len(some)
        self.flat, self.bounds = np.concatenate(flats), np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return codes

    def _words(self, words: pa.Array, firsts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``words`` with a blank in front, then of ``firsts`` without, one after the other, and each one's number of ids."""
        cut = pc.replace_substring_regex(pa.concat_arrays([words, firsts]), pattern=f"([{LETTERS}])([{MARKS}])", replacement=r"\1 \2")
        cut = pc.replace_substring_regex(cut, pattern=f"([{LETTERS}{MARKS}0-9]\n)([{LETTERS}{MARKS}0-9])", replacement=r"\1 \2")
        lists = pc.split_pattern(cut, pattern=" ")
        offsets = lists.offsets.to_numpy()
        blank = np.zeros(offsets[-1] - offsets[0], dtype=bool)
        blank[(offsets - offsets[0])[: len(words)]] = True
        pieces = pc.binary_join_element_wise(pc.if_else(pa.array(blank), *(pa.scalar(b, pa.large_string()) for b in (" ", ""))), lists.flatten(), pa.scalar("", pa.large_string()))
        coded = pieces.dictionary_encode()
        numbers = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        lengths = np.diff(self.bounds)[numbers]
        ids = ragged_gather(self.flat, self.bounds[numbers], lengths)
        kept = len(self.known)
        self.flat, self.bounds = self.flat[: self.bounds[kept]], self.bounds[: kept + 1]
        return ids, np.add.reduceat(lengths, offsets[:-1] - offsets[0])

    def batch(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the batch and each text's offsets in them; an ``end_id`` follows each text."""
        texts = pc.fill_null(texts, "")
        offsets, codes, words = segment_arrays(texts)
        n = len(offsets) - 1
        if not n:
            return np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)
        last = pc.utf8_slice_codeunits(words, start=-1).dictionary_encode()
        blank_end = np.array([not c or c.isspace() for c in last.dictionary.to_pylist()], dtype=bool)[last.indices.to_numpy(zero_copy_only=False)][codes]
        blank_end[offsets[1:] - 1] = False  # what ends a text is followed by no blank
        whole = np.add.reduceat(blank_end, offsets[:-1]) > 0
        empty_last = pc.equal(words, "").to_numpy(zero_copy_only=False)[codes[offsets[1:] - 1]]
        whole |= empty_last & (np.diff(offsets) > 1)
        for special in self.special:
            whole |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        own = np.flatnonzero(whole)
        pools = [self._words(words, words.take(pa.array(codes[offsets[:-1]]))), (np.array([end_id], dtype="<u4"), [1]), self._alone(texts.take(pa.array(own)).to_pylist())]
        flat, lengths = (np.concatenate(parts) for parts in zip(*pools))
        starts = np.cumsum(lengths) - lengths
        codes = codes.astype(np.int64)
        codes[offsets[:-1]] = len(words) + np.arange(n)
        if len(own):
            keep = np.repeat(~whole, np.diff(offsets))
            keep[offsets[:-1]] = True
            codes[offsets[own]] = len(words) + n + 1 + np.arange(len(own))
            counts = np.add.reduceat(keep, offsets[:-1])
            codes, offsets = codes[keep], np.concatenate([[0], np.cumsum(counts)])
        codes = np.insert(codes, offsets[1:], len(words) + n)
        offsets = offsets + np.arange(n + 1)
        ids = ragged_gather(flat, starts[codes], lengths[codes])
        per_text = np.add.reduceat(lengths[codes], offsets[:-1])
        return ids, np.concatenate([[0], np.cumsum(per_text)])


_loaded: dict[str, SegmentTokenizer] = {}


def tokenizer(path: str) -> SegmentTokenizer:
    """The tokenizer of this worker process, made once."""
    if path not in _loaded:
        _loaded[path] = SegmentTokenizer(path)
    return _loaded[path]


class CapacityTree:
    """Tournament tree over bins: each node holds the most free capacity below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, math.ceil(math.log2(max(1, bins))))
        self.free = [capacity] * (2 * self.leaves)

    def place(self, length: int) -> tuple[int, int]:
        """Put an item into the first bin that holds it; returns the bin and the offset there."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < length:
                node += 1
        before = free[node]
        free[node] = before - length
        bin_ = node - self.leaves
        while node > 1:
            node //= 2
            most = max(free[2 * node], free[2 * node + 1])
            if free[node] == most:
                break
            free[node] = most
        return bin_, before


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; items in decreasing length, ties in the given order."""
    tree = CapacityTree(len(lengths), capacity)
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    for k in np.argsort(-lengths, kind="stable"):
        bins[k], before = tree.place(int(lengths[k]))
        offsets[k] = capacity - before
    return bins, offsets


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    end_id: int = 0,
    group_docs: int = 1024,
    seed: int = 17,
    with_ids: bool = False,
) -> DataFrame:
    """Pack the texts into sequences of at most ``capacity`` ids; one row per piece.

    Returns ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, with ``with_ids``, the piece's
    ``ids``. A group has about ``group_docs`` documents; ``sequence_id`` is unique over the table.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    groups = max(1, math.ceil(docs.count() / group_docs))
    extra = ", ids array<binary>" if with_ids else ""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        own = tokenizer(tokenizer_path)
        for batch in batches:
            ids, offsets = own.batch(batch.column(1), end_id)
            crcs, pieces = [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                parts = [ids[k : min(k + capacity, b)] for k in range(a, b, capacity)]
                crcs.append([zlib.crc32(p) for p in parts])
                if with_ids:
                    pieces.append([p.tobytes() for p in parts])
            columns = [batch.column(0), pa.array(np.diff(offsets)), pa.array(crcs, pa.list_(pa.int64()))]
            if with_ids:
                columns.append(pa.array(pieces, pa.list_(pa.binary())))
            yield pa.RecordBatch.from_arrays(columns, ["id", "tokens", "crcs", "ids"][: len(columns)])

    def fill(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        tokens = group["tokens"].to_numpy()
        counts = -(-tokens // capacity)
        tails = tokens - (counts - 1) * capacity
        part = tails < capacity
        bins, places = first_fit_decreasing(tails[part], capacity)
        doc = np.repeat(np.arange(len(tokens)), counts)
        start = np.concatenate([np.arange(c) * capacity for c in counts])
        length = np.minimum(capacity, tokens[doc] - start)
        used = int(bins.max()) + 1 if len(bins) else 0
        tail_rows = np.cumsum(counts)[part] - 1
        sequence, offset = np.zeros(len(doc), dtype=np.int64), np.zeros(len(doc), dtype=np.int64)
        full = length == capacity
        sequence[full] = used + np.arange(full.sum())
        sequence[tail_rows], offset[tail_rows] = bins, places
        columns = [
            group["id"].take(pa.array(doc)), pa.array(start), pa.array(length), pc.list_flatten(group["crcs"]), pa.array(tokens[doc]), pa.array((group["grp"][0].as_py() << 32) + sequence), pa.array(offset),
        ]
        if with_ids:
            pieces = pc.list_flatten(group["ids"]).to_pylist()
            columns.append(pa.array([np.frombuffer(b, dtype="<u4").astype(np.int32) for b in pieces], pa.list_(pa.int32())))
        return pa.Table.from_arrays(columns, names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(columns)])

    schema = f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    cuts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(cut, f"id {kind}, tokens bigint, crcs array<bigint>{extra}")
    dealt = cuts.withColumn("grp", (F.rand(seed) * groups).cast("bigint"))
    packed = dealt.groupBy("grp").applyInArrow(fill, schema + (", ids array<int>" if with_ids else ""))
    return packed.withColumnRenamed("id", id_col)
