"""Models and alignments against plain re-computations."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logweave.llm import language_id, license_scan, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_a_page_alone_on_its_host_is_no_evidence_about_itself(spark):
    """With one page a host, priors are those of the levels above, from the other pages."""
    rng = random.Random(3)
    words = {lang: [f"{lang}{a}{b}" for a in ("al", "or", "en") for b in ("a", "te", "rin")] for lang in ("qa", "ro")}
    say = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    models = language_id.fit(spark.createDataFrame([(k, say(lang, 12), lang, "s", 0) for k, lang in enumerate(["qa", "ro"] * 20)], DOCS), "text", "lang", "doc_id")
    text = say("qa", 20)
    rows = [(0, "http://only.alone.test/", text), (1, None, text)] + [(10 + k, f"http://h{k}.other.example/", say("ro", 20)) for k in range(30)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r for r in language_id.identify(table, models, text_col="html", url_col="url", keep=["page_id"]).collect()}
    assert got[0].language == got[1].language == "qa"
    assert got[0].confidence == pytest.approx(got[1].confidence, rel=0.05)


def test_fused_languages_are_what_counting_by_hand_says(spark):
    """Priors of host, domain, suffix and table, suffix and declaration evidence, recomputed in Python; repeated rows and long texts are among them."""
    rng = random.Random(2)
    words = {lang: [f"{lang}{a}{b}" for a in ("al", "or", "en", "us") for b in ("a", "te", "rin", "o")] for lang in ("qa", "ro", "xi")}
    labelled = [(k, " ".join(rng.choice(words[lang]) for _ in range(12)), lang, "s", 0) for k, lang in enumerate(list(words) * 20)]
    models = language_id.fit(spark.createDataFrame(labelled, DOCS), "text", "lang", "doc_id")
    rows = []
    for k in range(160):
        lang = rng.choice(list(words))
        text = " ".join(rng.choice(words[lang if rng.random() < 0.8 else rng.choice(list(words))]) for _ in range(rng.choice((1, 1, 2, 30)))) if rng.random() < 0.9 else "zzyzx qwrtp"
        url = rng.choice([f"http://{lang}.one.example/", "http://shared.two.test/x", f"https://h{k % 3}.one.example/", None])
        rows.append((k, url, f'<html lang="{rng.choice([lang, "fil", "en-GB", "deu"])}"><p>{text}</p>'))
    rows += [(900, rows[0][1], rows[0][2]), (901, None, "<p>" + "qaalte " * 30_000), (902, "http://shared.two.test/", None), (903, None, "<p>1 2 3")]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r for r in language_id.identify(table, models, text_col="html", url_col="url", markup=True, keep=["page_id"]).collect()}
    assert set(got[0].asDict()) == {"page_id", "language", "confidence", "text_language", "accepted"}
    own = language_id.TextModels(*models)
    classes = [*models[0], "und"]
    k = len(classes)
    facts = {}
    for page, url, html in rows:
        declared = language_id.DECLARED.search(html or "")
        clean = language_id.re.sub(language_id.TAGS, " ", html or "")
        row = own.batch(pa.array([clean]))[0]
        scale = min(1.0, language_id.GRAMS / max(row[-1], 1.0))
        facts[page] = (row[:-1] * scale, row[-1], language_id.primary_code(declared[1]) if declared else None, *language_id.suffix_and_domain(url))
    soft = {p: np.exp(f[0] - f[0].max()) / np.exp(f[0] - f[0].max()).sum() for p, f in facts.items() if f[1] > 0}
    total = len(soft) - 1  # without the page itself
    counts = lambda at, value, page: (sum((soft[p] for p in soft if p != page and facts[p][at] == value), np.zeros(k)), sum(facts[p][at] == value for p in soft if p != page))
    smooth = lambda c, above: (c[0] + language_id.BORROWED * above) / (c[1] + language_id.BORROWED)
    for page, (ll, n, declared, host, domain, suffix) in facts.items():
        if not n:
            assert (got[page].language, got[page].confidence, got[page].accepted) == ("und", 0.0, False)
            continue
        of = lambda at, value: counts(at, value, page)  # noqa: B023, E731
        everything = sum(soft[p] for p in soft if p != page)
        overall = (everything + language_id.BORROWED / k) / (total + language_id.BORROWED)
        trust = lambda c: np.log((c[0] + 1) / (everything + 2))  # noqa: B023, E731
        fused = ll + np.log(overall if host is None else smooth(of(3, host), smooth(of(4, domain), smooth(of(5, suffix), overall))))
        fused = fused + (0.25 * trust(of(5, suffix)) if host else 0) + (trust(of(2, declared)) if declared else 0)
        odds = np.exp(fused - fused.max())
        assert got[page].language == classes[int(fused.argmax())] and got[page].confidence == pytest.approx(1 / odds.sum(), rel=1e-4)
        assert got[page].text_language == classes[int(ll.argmax())] and got[page].accepted == (got[page].language != "und")
    assert {r.language for r in got.values()} == set(classes) and got[900].confidence == got[0].confidence and got[901].language == "qa"
    assert any(r.language != r.text_language for r in got.values())


def test_declared_codes():
    assert [language_id.primary_code(c) for c in ("en-GB", "DEU", "fil", "zh_Hant", "", None)] == ["en", "de", "fil", "zh", None, None]


def test_rare_languages_are_in_the_sample(spark):
    rows = [(k, "alte worte hier" if k < 3 else "many more words", "xx" if k < 3 else "en", "s", 0) for k in range(500)]
    assert language_id.fit(spark.createDataFrame(rows, DOCS), "text", "lang", "doc_id", sample=20)[0] == ["en", "xx"]


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for k, y in enumerate(b):
            before, row[k + 1] = row[k + 1], before + 1 if x == y else max(row[k + 1], row[k])
    return row[-1]


def test_banded_alignment_is_the_full_one_on_torn_templates(spark):
    """Words lost, added and changed: matched words are those of the longest common subsequence, spans the torn passage."""
    rng = random.Random(5)
    names = ["mit", "isc", "bsd-2-clause", "bsd-3-clause", "apache-2.0", "mpl-2.0"]
    texts, meant = [], []
    for k in range(36):
        name = names[k % len(names)]
        words = license_scan.TEMPLATES[name].split()
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(8, len(words) - 8)
            words[at : at + 1] = rng.choice([[], ["zork"], [words[at], "blurb"]])
        lead = " ".join(f"qq{rng.randrange(99)}" for _ in range(rng.randint(0, 30)))
        texts.append(f"{lead} {' '.join(words)} qz1 qz2".lstrip())
        meant.append((name, longest_common([license_scan.bare(w) for w in license_scan.TEMPLATES[name].split()], [license_scan.bare(w) for w in texts[-1].split()]), len(lead) + 1 if lead else 0))
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)] + [(None, texts[0], "en", "s", 0), (0, texts[0], "en", "s", 0)]
    got = {}
    for r in license_scan.scan(spark.createDataFrame(rows, DOCS)).collect():
        got.setdefault(r.doc_id, []).append(r)
    for k, (name, matched, start) in enumerate(meant):
        best = max(got[k], key=lambda r: (r.license == name, r.matched_words))
        assert (best.license, best.matched_words, best.span_start, best.span_end) == (name, matched, start, len(texts[k]) - 8), texts[k]
        assert best.coverage == pytest.approx(matched / len([w for w in license_scan.TEMPLATES[name].split() if license_scan.bare(w)]))
    assert len(got[None]) == len(got[1 - 1]) // 2


def test_ties_between_templates_go_by_name(spark):
    twins = {"b": "one two three four five six", "a": "one two three four five six"}
    rows = license_scan.scan(spark.createDataFrame([(1, "so one two three four five six it is", "en", "s", 0)], DOCS), twins).collect()
    assert [r.license for r in rows] == ["a"]


def test_weights_are_those_of_a_dense_model(spark):
    """FTRL-proximal with all coordinates in plain dictionaries, in the order of the fit."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(15)) + (" vile" if k % 3 == 0 else "") for k in range(90)]
    texts[4] = texts[7]
    settings = toxicity.Settings(bits=14, l1=0.5, epochs=2)
    table = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(k, float(k % 3 == 0)) for k in range(90)] + [(3, 0.5), (6, None)], "doc_id bigint, toxic double")
    model = {r.bucket: r.weight for r in toxicity.fit(table, labels, settings, "doc_id", "text", "toxic").collect()}
    features = toxicity.Features(settings.bits)
    ids = [k for k in range(90) if zlib.crc32(str(k).encode()) % 5]
    rows = []
    for k in ids:
        offsets, buckets = features.batch(pa.array([texts[k]]))
        rows.append((buckets.tolist(), int(k % 3 == 0)))
    z, n = {}, {}
    s = settings

    def weight(c, l1):
        if abs(z.get(c, 0.0)) <= l1:
            return 0.0
        return -(z.get(c, 0.0) - math.copysign(l1, z.get(c, 0.0))) / ((s.beta + math.sqrt(n.get(c, 0.0))) / s.alpha + s.l2)

    order = np.random.default_rng(7)
    for _ in range(s.epochs):
        for k in order.permutation(len(rows)):
            at, label = rows[k]
            w = {c: weight(c, s.l1) for c in at} | {-1: weight(-1, 0.0)}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for c in w:
                z[c] = z.get(c, 0.0) + g - (math.sqrt(n.get(c, 0.0) + g * g) - math.sqrt(n.get(c, 0.0))) / s.alpha * w[c]
                n[c] = n.get(c, 0.0) + g * g
    expected = {c: weight(c, s.l1) for c in z if c >= 0 and abs(z[c]) > s.l1} | {-1: weight(-1, 0.0)}
    assert set(model) == set(expected) and all(model[c] == pytest.approx(expected[c], abs=1e-9) for c in expected) and len(expected) > 5
    scored = {r.doc_id: r for r in toxicity.score(table.union(table.filter("doc_id = 4")), labels, settings).collect()}
    for k in (0, 1, 4, 7, 50):
        at = features.batch(pa.array([texts[k]]))[1].tolist()
        assert scored[k].score == pytest.approx(1 / (1 + math.exp(-sum(expected.get(c, 0.0) for c in at) - expected[-1])), abs=1e-9)
    assert scored[4].score == scored[7].score


def test_features_are_what_the_words_say():
    """Words, their beginnings, bigrams and one-word skip-grams, each once a text, however long."""
    import xxhash

    mask, bits = (1 << 64) - 1, 20
    mix = [int(x) for x in (toxicity.BIGRAM, toxicity.SKIP, toxicity.PREFIX)]
    h = lambda w: xxhash.xxh64_intdigest(w)
    bucket = lambda key: ((key & mask) * mix[0] & mask) >> (64 - bits)
    texts = ["Hello, hello WORLD of worlds!", "", None, "one", "a b " * 4000, "!! ??"]
    offsets, got = toxicity.Features(bits).batch(pa.array(texts))
    for k, text in enumerate(texts):
        words = [b for w in (text or "").split() if (b := toxicity.SIGNS.sub("", w.lower()))]
        expected = set()
        for w in words:
            expected |= {bucket(h(w)), bucket(h(w[:4]) * mix[2]), bucket(h(w[:6]) * mix[1])}
        for step, m in ((1, mix[0]), (2, mix[1])):
            for a, b in zip(words, words[step:]):
                expected.add(bucket(((h(a) * m & mask) ^ (h(b) >> 1)) * mix[2]))
        assert set(got[offsets[k] : offsets[k + 1]].tolist()) == expected


def test_packing_keeps_ids_beside_nulls_exact(spark):
    import public_tokenizers

    from logweave.llm import packing

    big = 9007199254740993
    table = spark.createDataFrame([(big, "one text"), (None, "another"), (big + 2, "third")], "doc_id bigint, text string")
    rows = packing.pack(table, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == [(False, big), (False, big + 2), (True, 0)]


def test_long_runs_of_blanks(spark):
    import time

    import public_tokenizers
    import sentencepiece

    from logweave.llm import piece_codec

    path = public_tokenizers.path("piece_bpe_32k.model")
    own, library = piece_codec.PieceCodec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for text in ("a" + " " * 5001 + "b", " " * 777, "x" + "  y " * 500):
        assert own.encode(text) == library.encode(text)
    began = time.process_time()
    own.encode(" " * 1_000_000)
    assert time.process_time() - began < 3  # far from quadratic, on a busy machine too


def test_one_shingle_in_all_documents(spark):
    """A passage that all documents share is settled within the batches, and links nobody by itself."""
    from logweave.llm import ngram_join

    rng = random.Random(9)
    shared = "this very passage stands in every single document of the table"
    texts = [f"{shared} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(600)]
    texts[10] = texts[3] + " more"
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(6)
    packs = ngram_join._survey(rows.select(F.col("doc_id").alias("id"), "text"), 5, 4)
    sent = packs.filter("range >= 0").selectExpr("sum(length(hashes)) / 8 AS n").first().n
    every = packs.filter("range = -1").selectExpr("sum(size) AS n", "sum(credit) AS c").first()
    assert every.c > 0 and sent + every.c <= every.n
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(rows).collect()}
    assert {k: c for k, c in got.items() if c != k} == {10: 3}
