"""Corpus pipeline: language ID, toxicity, near duplicates, personal data, packing.

Every stage takes what its predecessor kept and hands on the columns of ``documents``; the last returns packed pieces. The
stages are written as tables in the shared checkpoint folder and read again, so none is computed twice.

Defined results: a document is a row; rows that share an id, or have none, are judged each by its own text. A null or empty text is in no known
language and goes in the first stage. Of near duplicates the row with the smallest id stays, of rows with one id that with the smaller
text digest, of rows equal in both one; what has no id is no duplicate. Texts are read whole, however long. Columns beyond those of ``documents``
pass through all stages but the last; an empty table gives an empty table.
"""

from __future__ import annotations

import threading
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import language_id, ngram_join, packing, pseudonyms, toxicity
from logweave.llm.common import drop_staged, drop_tables, owning, staged, table
from logweave.llm.queries import PSEUDONYM_KEY

class _Staged(threading.local):
    """Tables that the stage at work has staged; pipelines of several threads keep out of each other's."""

    def __init__(self):
        self.paths: list[str] = []


_staged = _Staged()


def stage(f):
    """A stage: when the next one begins, its result has been written, so what it staged on the way can go."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_tables(spark, _staged.paths)
        _staged.paths = []
        with owning(_staged.paths):
            return f(spark, docs, sf_dir)

    return run


@stage
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language at all; the declared language and the source are further evidence."""
    models = language_id.fit(docs, "text", "lang", "doc_id")
    found = language_id.identify(docs, models, declared_col="lang", host_col="source")
    return found.filter("accepted").select(docs.columns)


@stage
def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not flag. A row goes by its own text, also where ids repeat or are null."""
    return toxicity.with_scores(docs, table(spark, sf_dir, "labels")).filter("predicted = 0").select(docs.columns)


@stage
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of every group of near duplicates, of rows with one id that with the smaller text digest.

    A row is known by its id and text together, so rows that share an id only are judged each by its own text, and of
    rows equal in both one stays. Rows without words link with nothing and stay; without an id nothing is a duplicate.
    """
    return ngram_join.one_of_each(docs)


@stage
def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pseudonyms.pseudonymise(docs, key=PSEUDONYM_KEY, found_col=None)
    return found.withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", known_language),
    ("toxicity", not_toxic),
    ("ngram_jaccard", one_of_each_group),
    ("pseudonyms", without_personal_data),
    ("packing", packed),
]

#: The stages use trained models and tokenizers, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES:
        before, docs = docs, staged(f(spark, docs, sf_dir), f"pipeline-{name}")
        drop_staged(before)  # but never the table that it all began with
    return docs
