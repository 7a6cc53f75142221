"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are combined for every document: the likelihood of its text under character n-gram models, the
language that its markup declares, its address's suffix, and a prior of its host. The text models are fitted on a bounded
sample of labelled texts, in equal parts by language as far as there are so many. How far declarations and suffixes can be
trusted, and the priors, are counted over all documents by grouped aggregation of the text posteriors; a host's prior is
smoothed towards its domain's, that towards its suffix's, and that towards the whole table's, so a host with few pages borrows
from the levels above it. A document's own posterior is taken out of every count that it is judged by, so its text counts once.

``und`` is a class like the languages, with a model of its own under which all n-grams are equally likely: noise, and
languages without labels, are likelier under it. It has priors and declarations counted like the others', and a document
is rejected where it has the highest posterior of all evidence. What has no letters at all is ``und`` whatever stands around it.

Defined results: null, empty and letterless texts are ``und`` with confidence 0; whole texts are read, however long;
null declarations, urls and hosts are evidence of nothing; repeated rows count like others and get equal results, equal
posteriors go to the first language by name; other columns pass through unless a result column has their name; an empty table
gives an empty table; without labelled texts everything is ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import give_back, prepare, staged
from .segments import coded_segments

BITS = 18
#: The class of what is in no known language.
UND = "und"
#: Labelled texts that the text models are fitted on, at most.
SAMPLE = 4000
#: How many times the sample the bound on hashes lets through, so that there are enough (half as many would do).
MARGIN = 2
#: Weight of a whole text in grams: evidence beyond it is scaled down, as neighbouring grams are not independent.
GRAMS = 40.0
#: Pseudo-count of every n-gram under every language: so little that what no label has shown is likelier as noise.
UNSEEN = 0.01
#: Pseudo-counts that a level's prior gets from the level above it.
BORROWED = 20.0
TAGS = r"(?s)<(?:script|style|nav|footer|head)\b.*?</(?:script|style|nav|footer|head)\s*>|<!--.*?-->|<[^>]*>|&[#0-9A-Za-z]+;"
DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,8}(?:[-_][A-Za-z0-9]+)*)", re.I)
# fixed values: three-letter codes (ISO 639-2 and -3) of languages that have a two-letter one
TWO_LETTERS = {
    "ara": "ar", "bul": "bg", "cat": "ca", "ces": "cs", "cze": "cs", "dan": "da", "deu": "de", "dut": "nl", "ell": "el", "eng": "en", "est": "et", "fas": "fa", "fin": "fi", "fra": "fr",
    "fre": "fr", "ger": "de", "gre": "el", "heb": "he", "hin": "hi", "hrv": "hr", "hun": "hu", "ind": "id", "isl": "is", "ita": "it", "jpn": "ja", "kor": "ko", "lav": "lv", "lit": "lt",
    "nld": "nl", "nor": "no", "per": "fa", "pol": "pl", "por": "pt", "ron": "ro", "rum": "ro", "rus": "ru", "slk": "sk", "slo": "sk", "slv": "sl", "spa": "es", "srp": "sr", "swe": "sv",
    "tha": "th", "tur": "tr", "ukr": "uk", "vie": "vi", "zho": "zh", "chi": "zh",
}
LETTERS = re.compile(r"[^\W\d_]+")


def primary_code(declared: str | None) -> str | None:
    """The language of a declared tag such as ``en-GB``, by its shorter code."""
    code = re.split("[-_]", declared.strip().lower(), maxsplit=1)[0] if declared else ""
    return TWO_LETTERS.get(code, code) or None


def grams(word: str) -> list[int]:
    """Buckets of the word's letters in threes and of the word itself, ends marked."""
    out = []
    for letters in LETTERS.findall(word.lower()):
        marked = f"<{letters}>"
        out += [xxhash.xxh32_intdigest(marked[k : k + 3]) >> (32 - BITS) for k in range(len(marked) - 2)]
        out.append(xxhash.xxh32_intdigest(marked, seed=1) >> (32 - BITS))
    return out


class TextModels:
    """Log-likelihoods of words under each language, with words kept between batches."""

    def __init__(self, languages: list[str], counts: dict[int, np.ndarray]):
        self.languages = languages
        buckets = np.fromiter(counts, dtype=np.int64, count=len(counts))
        table = np.stack(list(counts.values())) if counts else np.zeros((0, len(languages)))
        totals = table.sum(axis=0) if len(table) else np.zeros(len(languages))
        floor = np.log(UNSEEN / (totals + UNSEEN * (1 << BITS)))
        self.table = np.tile(floor, (1 << BITS, 1)).astype(np.float32)
        if len(table):
            self.table[buckets] = np.log((table + UNSEEN) / (totals + UNSEEN * (1 << BITS)))
        self.known: dict[str, np.ndarray] = {}

    def _word(self, word: str) -> np.ndarray:
        at = grams(word)
        return np.concatenate([self.table[at].sum(axis=0, dtype=np.float64), [-len(at) * BITS * np.log(2.0), len(at)]])

    def batch(self, texts: pa.Array) -> np.ndarray:
        """Per text: log-likelihoods by language and under noise, and the number of grams."""
        texts = pc.replace_substring_regex(pc.fill_null(texts, ""), r"[\x09-\x0d]+", " ")
        offsets, codes, words = coded_segments(texts)
        if len(offsets) < 2:
            return np.zeros((0, len(self.languages) + 2))
        if len(self.known) > 100_000:
            self.known = {w: self.known[w] for w in words if w in self.known}
        known = self.known
        for w in words:
            if w not in known:
                known[w] = self._word(w)
        facts = np.stack([known[w] for w in words], axis=1)
        return np.stack([np.add.reduceat(one[codes], offsets[:-1]) for one in facts], axis=1)  # a column at a time: a row a word each


def fit(labelled: DataFrame, text_col: str, lang_col: str, id_col: str, sample: int = SAMPLE) -> tuple[list[str], dict[int, np.ndarray]]:
    """Gram counts by language from at most ``sample`` texts; at most ``2**18`` buckets.

    The smallest hashes of ids are taken, of all languages in turn, so that rare ones are among them.
    """
    spark = labelled.sparkSession
    prepare(spark)
    chosen = labelled.select(labelled[id_col].alias("id"), labelled[lang_col].alias("lang")).filter(f"lang is not null and lang <> '{UND}' and id is not null")
    # of a large language only hashes below a bound can be among the smallest, so that no task ranks all of it
    counts = chosen.groupBy("lang").agg(F.count("*").alias("of"))
    place = F.pmod(F.xxhash64("id", "lang"), F.lit(1 << 53)) / float(1 << 53)
    few = chosen.join(counts, "lang").withColumn("place", place).filter(F.col("place") * F.col("of") <= MARGIN * sample)
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("place", "id"))
    chosen = few.withColumn("turn", turn).filter(F.col("turn") <= sample).orderBy("turn", "place", "id").limit(sample).select("id", "lang")
    rows = labelled.select(labelled[id_col].alias("id"), labelled[text_col].alias("text")).join(F.broadcast(chosen), "id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                texts = batch.column(1).filter(pa.array(langs == lang))
                _, codes, words = coded_segments(pc.replace_substring_regex(pc.fill_null(texts, ""), r"[\x09-\x0d]+", " "))
                tally: dict[int, int] = {}
                for word, n in zip(words, np.bincount(codes, minlength=len(words)).tolist()):
                    for g in grams(word):
                        tally[g] = tally.get(g, 0) + n
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(tally), pa.string()), pa.array(list(tally), pa.int64()), pa.array(list(tally.values()), pa.int64())], ["lang", "bucket", "n"])

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique())
    wide = counted.pivot(index="bucket", columns="lang", values="n").fillna(0.0).reindex(columns=languages) if len(counted) else pd.DataFrame()
    return languages, {int(b): row for b, row in zip(wide.index, wide.to_numpy(dtype=np.float64))}


def suffix_and_domain(url: str | None) -> tuple[str | None, str | None, str | None]:
    """Host, its last two labels, and its last label."""
    try:
        host = urlsplit(url.strip()).hostname if url else None
    except ValueError:
        host = None
    if not host:
        return None, None, None
    labels = host.split(".")
    return host, ".".join(labels[-2:]), labels[-1]


def identify(
    docs: DataFrame,
    models: tuple[list[str], dict[int, np.ndarray]],
    text_col: str = "text",
    declared_col: str | None = None,
    url_col: str | None = None,
    host_col: str | None = None,
    markup: bool = False,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) and ``language, confidence, text_language, accepted``.

    With ``markup`` the text is HTML: its tags go, and its ``lang`` attribute is the declaration unless ``declared_col``
    names one. ``host_col`` names a column that plays the host (a source, say) where there is no url. ``accepted`` is false where
    ``und`` is the most probable.
    """
    spark = docs.sparkSession
    prepare(spark)
    languages, counts = models
    keep = list(keep if keep is not None else docs.columns)
    names = ["__ll", "__grams", "__declared", "__host", "__domain", "__suffix"]
    inputs = list(dict.fromkeys([*keep, text_col, *[c for c in (declared_col, url_col, host_col) if c]]))
    docs = docs.select([docs[c] for c in inputs])
    at = {c: k for k, c in enumerate(inputs)}
    kept_at = [at[c] for c in keep]
    if not languages:
        none = {"language": F.lit(UND), "confidence": F.lit(0.0), "text_language": F.lit(UND), "accepted": F.lit(False)}
        return docs.select([F.col(f"`{c}`") for c in keep if c.lower() not in none]).withColumns(none)

    sent = spark.sparkContext.broadcast((languages, np.fromiter(counts, dtype=np.int64, count=len(counts)), np.stack(list(counts.values())).astype(np.float32)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        own_languages, buckets, table = sent.value
        own = TextModels(own_languages, dict(zip(buckets.tolist(), table.astype(np.float64))))
        for batch in batches:
            texts = pc.fill_null(batch.column(at[text_col]).cast(pa.string()), "")
            declared: list[str | None] = [None] * len(batch)
            if markup:
                declared = [m[1] if (m := DECLARED.search(t)) else None for t in texts.to_pylist()]
                texts = pc.replace_substring_regex(texts, TAGS, " ")
            if declared_col:
                declared = batch.column(at[declared_col]).to_pylist()
            facts = own.batch(texts)
            if url_col:
                sites = [suffix_and_domain(u) for u in batch.column(at[url_col]).to_pylist()]
            elif host_col:
                sites = [(str(h), None, None) if h is not None else (None, None, None) for h in batch.column(at[host_col]).to_pylist()]
            else:
                sites = [(None, None, None)] * len(batch)
            n = facts[:, -1]
            likelihoods = facts[:, :-1] * np.minimum(1.0, GRAMS / np.maximum(n, 1.0))[:, None]
            new = [
                pa.array(list(likelihoods), pa.list_(pa.float64())), pa.array(n.astype(np.int64)),
                pa.array([primary_code(d) for d in declared], pa.string()), *[pa.array([s[i] for s in sites], pa.string()) for i in range(3)],
            ]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept_at], *new], [*keep, *names])

    ours = StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in zip(names, ("array<double>", "bigint", "string", "string", "string", "string"))))
    evidence = staged(docs.mapInArrow(read, StructType([*[docs.schema[c] for c in keep], *ours.fields])), "language-evidence")

    classes = [*languages, UND]
    k = len(classes)
    likelihood = F.col("__ll")

    def odds(logs: Column) -> Column:
        """Each term's exponential against that of the largest."""
        return F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))

    def total_of(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)

    readable = F.col("__grams") > 0
    share_of = lambda logs: F.transform(odds(logs), lambda x: x / total_of(odds(logs)))
    relative = evidence.filter(readable).select("__declared", "__host", "__domain", "__suffix", odds(likelihood).alias("odds"))
    summed = relative.withColumn("sum", total_of(F.col("odds")))
    counted = summed.select("__declared", "__host", "__domain", "__suffix", *[(F.col("odds")[i] / F.col("sum")).alias(f"p{i}") for i in range(k)])
    sums = [F.sum(f"p{i}").alias(f"c{i}") for i in range(k)]
    everything = counted.agg(F.count("*").alias("n"), *sums).first()  # one row
    total = float(everything["n"] or 0)
    in_all = F.array(*[F.lit(float(everything[f"c{i}"] or 0.0)) for i in range(k)])

    def level(column: str, above: list[str]) -> DataFrame:
        return counted.filter(F.col(column).isNotNull()).groupBy(column, *above).agg(F.count("*").alias("n"), *sums)

    def added_up(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(*by).agg(F.sum("n").alias("n"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(k)])

    def as_arrays(df: DataFrame, name: str, *by: str) -> DataFrame:
        return df.select(*by, F.col("n").alias(f"{name}_n"), F.array(*[F.col(f"c{i}") for i in range(k)]).alias(name))

    hosts = level("__host", ["__domain", "__suffix"])
    domains = added_up(hosts.filter("__domain is not null"), "__domain", "__suffix")
    suffixes = as_arrays(added_up(domains, "__suffix"), "__in_suffix", "__suffix")
    domains = as_arrays(domains, "__in_domain", "__domain", "__suffix").join(suffixes, "__suffix").drop("__suffix")
    priors = as_arrays(hosts, "__in_host", "__host", "__domain").join(domains, "__domain", "left").drop("__domain")
    declared = as_arrays(level("__declared", []), "__in_declared", "__declared")

    # written, so that their true sizes decide how they are joined
    priors, declared = staged(priors, "language-priors"), staged(declared, "language-declared")
    # what has no host or declaration meets nothing, in many partitions instead of one
    spread = lambda c: F.coalesce(F.col(c), F.concat(F.lit("\0"), F.pmod(F.xxhash64("__ll"), F.lit(4096)).cast("string")))
    keyed = evidence.withColumns({"__host": spread("__host"), "__declared": spread("__declared")})
    joined = keyed.join(priors, "__host", "left").join(declared, "__declared", "left")

    # a document is no evidence about itself: its own share is taken out of every count that it is judged by
    joined = joined.withColumn("__own", share_of(likelihood))
    others = lambda c: F.zip_with(c, "__own", lambda x, own: F.greatest(x - own, F.lit(0.0)))
    joined = joined.withColumns({c: others(F.col(c)) for c in ("__in_host", "__in_domain", "__in_suffix", "__in_declared")} | {"__in_all": others(in_all)})

    def smoothed(c: str, above: Column) -> Column:
        """The level's shares, with ``BORROWED`` documents added that are distributed as above."""
        n = F.col(f"{c}_n") - 1 + BORROWED
        return F.zip_with(c, above, lambda x, up: (x + BORROWED * up) / n)

    def trusted(c: str) -> Column:
        """How often documents of a class have this suffix or declaration, nothing where there is none."""
        seen = F.zip_with(c, "__in_all", lambda x, all_of: F.log((x + 1.0) / (all_of + 2.0)))
        return F.coalesce(seen, F.array(*[F.lit(0.0)] * k))

    overall = F.transform("__in_all", lambda x: (x + BORROWED / k) / (total - 1 + BORROWED))
    above = F.coalesce(smoothed("__in_domain", smoothed("__in_suffix", overall)), overall)
    prior = F.transform(F.coalesce(smoothed("__in_host", above), overall), lambda x: F.log(x))
    add = lambda x, y, weight=1.0: F.zip_with(x, y, lambda p, q: p + q * weight)
    fused = add(add(add(likelihood, prior), trusted("__in_suffix"), 0.25), trusted("__in_declared"))
    joined = joined.withColumn("__fused", fused)
    names_of = F.array(*map(F.lit, classes))

    def best(logs: Column) -> Column:
        return F.element_at(names_of, F.array_position(logs, F.array_max(logs)).cast("int"))

    result = {
        "language": F.when(readable, best(F.col("__fused"))).otherwise(UND),
        "confidence": F.when(readable, 1.0 / total_of(odds(F.col("__fused")))).otherwise(0.0),
        "text_language": F.when(readable, best(likelihood)).otherwise(UND),
        "accepted": readable & (best(F.col("__fused")) != UND),
    }
    plain = [F.col(f"`{c}`") for c in keep if c.lower() not in result]
    return joined.select(*plain, *[v.alias(n) for n, v in result.items()])
