"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its lower-cased words without the signs around them, the words' first four and six letters, its
bigrams and its one-word skip-grams, hashed into ``2**bits`` buckets; a feature counts once a text. Training is
FTRL-proximal: every coordinate has a learning rate of its own, falling with the squared gradients it has seen, and an
L1 term keeps coordinates at zero until the evidence for them is enough, so the weights are a short list, bounded by
``2**bits`` whatever the corpus, and are sent to every task.

The fit uses at most ``sample`` labelled rows (those with the smallest hash of their id); scoring reads every text.

Defined results: a null or empty text has no features and gets the intercept's score; a null id is scored but never
trained on (it is held out with no remainder: ``held_out`` is null); repeated rows get equal scores; labels other than
0 and 1, null labels and labels of unknown ids are ignored, of several labels of an id the largest counts; without
labels of both kinds every score is the share of toxic labels (0 without any); extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import give_back, prepare
from .segments import coded_segments

SIGNS = re.compile(r"[\W_]+")
BIGRAM, SKIP, PREFIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 1.0
    epochs: int = 3
    #: Most labelled rows that the fit reads.
    sample: int = 10_000


class Features:
    """Hashed features of batches of texts; word hashes are kept between batches."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.known: dict[str, tuple[int, ...]] = {}

    def _hashes(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 120_000:
            known = self.known = {w: known[w] for w in words if w in known}
        for w in words:
            if w not in known:
                bare = SIGNS.sub("", w.lower())
                known[w] = tuple(xxhash.xxh64_intdigest(b) for b in (bare, bare[:4], bare[:6])) if bare else (0, 0, 0)
        return np.array([known[w] for w in words], dtype=np.uint64).reshape(-1, 3)

    def batch(self, texts: pa.Array, dense: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Per text its slice of the buckets (offsets) and the buckets, each once a text; with ``dense`` only those of a weight."""
        texts = pc.replace_substring_regex(pc.fill_null(texts, ""), r"[\x09-\x0d]+", " ")
        offsets, codes, words = coded_segments(texts)
        n = len(offsets) - 1
        if not n:
            return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64)
        both = self._hashes(words)[codes]
        doc = np.repeat(np.arange(n), np.diff(offsets))
        real = both[:, 0] != 0
        both, doc = both[real], doc[real]
        word = both[:, 0]
        keys, docs = [word, both[:, 1] * PREFIX, both[:, 2] * SKIP], [doc, doc, doc]
        for step, mix in ((1, BIGRAM), (2, SKIP)):
            if len(word) > step:
                same = doc[step:] == doc[:-step]
                keys.append(((word[:-step] * mix) ^ (word[step:] >> np.uint64(1)))[same] * PREFIX)
                docs.append(doc[step:][same])
        pairs = []
        for key, of in zip(keys, docs):
            bucket = (key * BIGRAM) >> self.shift
            if dense is not None:
                weighty = dense[bucket] != 0
                bucket, of = bucket[weighty], of[weighty]
            pairs.append((of.astype(np.uint64) << np.uint64(32)) | bucket)
        once = np.unique(np.concatenate(pairs))
        found = (once >> np.uint64(32)).astype(np.int64)
        return np.searchsorted(found, np.arange(n + 1)), (once & np.uint64(0xFFFFFFFF)).astype(np.int64)


class FTRL:
    """Per-coordinate FTRL-proximal with L1 and L2 terms, for binary features and an intercept without L1."""

    def __init__(self, settings: Settings):
        self.s = settings
        size = (1 << settings.bits) + 1  # the intercept is last
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray) -> np.ndarray:
        s, z = self.s, self.z[at]
        w = -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(self.n[at])) / s.alpha + s.l2)
        w[np.abs(z) <= s.l1] = 0.0
        return w

    def intercept(self) -> float:
        return float(-self.z[-1] / ((self.s.beta + np.sqrt(self.n[-1])) / self.s.alpha + self.s.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        bias = self.intercept()
        g = sigmoid(w.sum() + bias) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.s.alpha * w
        self.n[at] = n + g * g
        last = self.n[-1]
        self.z[-1] += g - (np.sqrt(last + g * g) - np.sqrt(last)) / self.s.alpha * bias
        self.n[-1] = last + g * g


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def remainder(id_column) -> F.Column:
    return F.crc32(id_column.cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, settings: Settings, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """Weights as rows ``(bucket, weight)``; bucket -1 is the intercept. One task reads the bounded sample."""
    chosen = (
        labels.select(labels[id_col].alias("id"), labels[label_col].cast("double").alias("label"))
        .filter("label in (0, 1) and id is not null")
        .withColumn("label", F.col("label").cast("int"))
        .filter(remainder(F.col("id")) != 0)
        .groupBy("id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(settings.sample)
    )
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(chosen), "id")

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(settings.bits)
        give_back()
        for batch in batches:
            for at in range(0, len(batch), 256):  # all features of a text stand side by side before they are made distinct
                some = batch.slice(at, 256)
                offsets, buckets = features.batch(some.column(1))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(buckets, pa.int32()))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), lists], ["id", "label", "at"])

    kind = docs.schema[id_col].dataType.simpleString()
    sparse = rows.select("id", "text", "label").mapInArrow(featurize, f"id {kind}, label int, at array<int>")
    # an id with several texts would pass the bound; one text of it is enough
    sparse = sparse.groupBy("id").agg(F.min_by(F.struct("label", "at"), F.xxhash64("at")).alias("row")).select("id", "row.label", "row.at")

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        give_back()
        model = FTRL(settings)
        pdf = pdf.sort_values("id", kind="stable")
        order = np.random.default_rng(7)
        at, label = pdf["at"].to_list(), pdf["label"].to_numpy()
        if len(set(label)) == 2:
            for _ in range(settings.epochs):
                for k in order.permutation(len(label)):
                    model.learn(np.asarray(at[k], dtype=np.int64), int(label[k]))
            kept = np.flatnonzero(np.abs(model.z[:-1]) > settings.l1)
            weights, bias = model.weights(kept), model.intercept()
        else:
            kept, weights = np.zeros(0, dtype=np.int64), np.zeros(0)
            bias = 35.0 if label.mean() > 0.5 else -35.0
        return pd.DataFrame({"bucket": np.append(kept, -1), "weight": np.append(weights, bias)})

    return sparse.groupBy(F.lit(0).alias("all")).applyInPandas(train, "bucket bigint, weight double")


def with_scores(
    docs: DataFrame,
    labels: DataFrame,
    settings: Settings | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> DataFrame:
    """Learn from ``labels`` and add ``held_out, score, predicted`` to every row (in place of columns of these names)."""
    settings = settings or Settings()
    prepare(docs.sparkSession)
    model = fit(docs, labels, settings, id_col, text_col, label_col).toPandas()  # at most 2**bits + 1 rows
    inner = model[(model["bucket"] >= 0) & (model["weight"] != 0)]
    bias = float(model.loc[model["bucket"] == -1, "weight"].iloc[0]) if len(model) else -35.0
    sent = docs.sparkSession.sparkContext.broadcast((inner["bucket"].to_numpy(dtype=np.int64), inner["weight"].to_numpy(dtype=np.float64), bias))
    docs = docs.select([c for c in docs.columns if c.lower() not in ("held_out", "score", "predicted")])
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weights, own_bias = sent.value
        dense = np.zeros(1 << settings.bits)
        dense[at] = weights
        features = Features(settings.bits)
        give_back()
        for batch in batches:
            offsets, buckets = features.batch(batch.column(text_at), dense)
            # each text by itself, so that equal texts get equal sums
            sums = np.add.reduceat(np.append(dense[buckets], 0.0), offsets[:-1]) if len(offsets) > 1 else np.zeros(0)
            logits = np.where(offsets[1:] > offsets[:-1], sums, 0.0) + own_bias
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigmoid(logits), pa.float64())], [*batch.schema.names, "score"])

    scored = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))
    return scored.withColumns({"held_out": remainder(F.col(id_col)) == 0, "predicted": (F.col("score") >= 0.5).cast("int")})


def score(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Scores of all texts: ``id_col, held_out, score, predicted``."""
    slim = docs.select(docs[id_col], docs[text_col])
    return with_scores(slim, labels, settings, id_col, text_col, label_col).select(id_col, "held_out", "score", "predicted")
