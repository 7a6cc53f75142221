"""Training-data operators on texts against libraries, brute force and planted cases."""

import hmac
import itertools
import random
import re
import zlib
from datetime import date, timedelta

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logweave.llm import language_id, license_scan, ngram_join, packing, piece_codec, pseudonyms, site_templates, toxicity
from logweave.llm.signature_trees import linked

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "  a  b ", "\ta\nb\r\n", "▁x", "é😀 日本 <s> <0x41> \x00", "<|endoftext|> 's 12", "same text", "same text", "x" * 5000, "word " * 3000]


def docs(spark, texts, **more):
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def test_pieces_match_the_library(spark):
    import sentencepiece

    own, library = piece_codec.PieceCodec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(3)
    bits = ["a", "the", " ", "  ", "▁", "\t", "\n", "é", "😀", "ing", "日本", "\x00", "!!", "***", "한", "THE", "0", "   "]
    for text in [t or "" for t in ODD] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(3000)]:
        ids = library.encode(text)
        assert own.encode(text) == ids and own.decode(ids) == library.decode(ids), text
    table = docs(spark, ODD).withColumn("n_tokens", F.lit("clash"))
    got = {r.doc_id: r for r in piece_codec.encode_decode(table, PIECES).collect()}
    for k, text in enumerate(ODD):
        ids = library.encode(text or "", add_eos=True)
        assert (got[k].n_tokens, list(got[k].ids), got[k].decoded) == (len(ids), ids, library.decode(ids))
    assert piece_codec.encode_decode(docs(spark, []), PIECES, digests_only=True).count() == 0


def test_compatibility_is_what_merging_says():
    own = piece_codec.PieceCodec(PIECES)

    def merged(text):
        symbols = list(text)
        while True:
            ranked = [(own.rank.get(a + b, piece_codec.NEVER), k) for k, (a, b) in enumerate(zip(symbols, symbols[1:]))]
            if not ranked or min(ranked)[0] == piece_codec.NEVER:
                return symbols
            k = min(ranked)[1]
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]

    rng = random.Random(4)
    tokens = sorted(own.parts)
    for _ in range(3000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        assert own.compatible(a, b) == (merged(a + b) == [a, b]), (a, b)


def test_packing_covers_every_id_once(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    texts = ODD + [("tok " * n) for n in range(0, 1500, 7)]
    table = docs(spark, texts).withColumn("start", F.lit(1)).unionByName(docs(spark, ["twice"]).withColumn("start", F.lit(1))).withColumn("doc_id", F.when(F.col("doc_id") == 5, None).otherwise(F.col("doc_id")))
    rows = packing.pack(table, BYTES, group_docs=50, with_ids=True).collect()
    by_sequence = {}
    for r in rows:
        assert r.length == len(r.ids) and 0 < r.length <= 1024
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    for k, text in enumerate(texts):
        if k in (0, 5):  # two rows have id 0, and id 5 is null
            continue
        own = sorted((r.start, r.ids) for r in rows if r.doc_id == k)
        ids = [i for _, part in own for i in part]
        assert ids == library.encode(text or "", add_special_tokens=False).ids + [0]
    assert sum(r.length for r in rows) > 0.97 * 1024 * len(by_sequence)
    assert packing.pack(docs(spark, []), BYTES).count() == 0


def test_packing_encodes_a_word_once_whatever_marks_and_line_ends_it_is_written_with(monkeypatch):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(BYTES), packing.SegmentTokenizer(BYTES)

    def same(texts):
        ids, offsets = own.batch(pa.array(texts, pa.string()), 0)
        for k, text in enumerate(texts):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids + [0], text

    words = ["".join(p) for p in itertools.product(["er", "an", "üb", "Th"], ["on", "ße", "ing"])]
    ends = [".", ",", "!!", ".***", "%%%", ".\n", "\n", "'s", ".net", '"', ")", ""]
    for end in ends:
        same([" ".join([""] + [w + end + "and" * end.endswith("\n") for w in words] + ["x"])])
    assert len(own.known) < 3 * (len(words) + len(ends))  # and not a piece a word and end

    bits = ["a", "the", " ", " ", "\t", "\n", "\n", "\n\n", "é", "😀", "日本", "\x00", "***", "0", "'s", "'", "'ll", ".", "_", "<|endoftext|>", "<|endof", "\xa0", "\u3000", "\x85", "\x1c", "½", "ª", "×", "e\u0301"]
    rng = random.Random(5)
    texts = ODD + ["\n", " \n", "a" * 70 + ".b"] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for room in (packing.CACHE, 500 * packing.ENTRY, 0):  # also where pieces have to go
        monkeypatch.setattr(packing, "CACHE", room)
        for at in range(0, len(texts), 97):
            same(texts[at : at + 97])


def test_first_fit_decreasing_is_what_a_scan_does():
    lengths = np.random.default_rng(1).integers(1, 100, 300)
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    free = []
    for k in np.argsort(-lengths, kind="stable"):
        at = next((b for b, f in enumerate(free) if f >= lengths[k]), len(free))
        if at == len(free):
            free.append(100)
        assert (bins[k], offsets[k]) == (at, 100 - free[at])
        free[at] -= lengths[k]


def brute_components(texts, n=5):
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(k)) for k, s in enumerate(sets)]


def families(rng, count, copies, length, edits):
    words = [f"w{k}" for k in range(4000)]
    out = []
    for _ in range(count):
        base = [rng.choice(words) for _ in range(rng.randint(*length))]
        for _ in range(rng.randint(*copies)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, int(edits * len(own))))):
                own[rng.randrange(len(own))] = rng.choice(words)
            out.append(" ".join(own))
    return out


def test_ngram_join_is_exact(spark):
    rng = random.Random(5)
    texts = [None, "", " \t", "one two", "ONE two", "É one", "é one"] + families(rng, 60, (1, 6), (1, 160), 0.06) + families(rng, 1, (60, 60), (120, 120), 0.02)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs(spark, texts).withColumn("size", F.lit(0))).collect()}
    assert [got[k] for k in range(len(texts))] == brute_components(texts)


def test_ngram_join_cuts_large_groups_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 16)
    texts = families(random.Random(6), 3, (50, 70), (60, 200), 0.03)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == brute_components(texts)


def test_ngram_join_of_nothing_and_of_null_ids(spark):
    assert ngram_join.jaccard_components(docs(spark, [])).count() == 0
    table = docs(spark, ["a b c d e f", "a b c d e f", "q"]).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    got = sorted((r.doc_id is None, r.component_id) for r in ngram_join.jaccard_components(table).collect())
    assert got == [(False, 1), (False, 2), (True, 1)]


@pytest.mark.parametrize("seed", range(5))
def test_signature_trees_join_what_brute_force_joins(seed):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(8):
        base = rng.integers(0, 1 << 63, size=rng.integers(1, 150), dtype=np.uint64)
        for _ in range(8):
            own = base.copy()
            own[rng.integers(0, len(own), int(0.1 * len(own)))] = rng.integers(0, 1 << 63)
            sets.append(np.unique(own))
    joined = {frozenset(p) for p in linked(sets, 80, 100)}
    for a, b in joined:
        both = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both)


def test_toxicity_learns_and_keeps_clean_texts(spark):
    rng = random.Random(7)
    words = [f"word{k}" for k in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(900)]
    bad = set(rng.sample(range(900), 200))
    texts = [t + " Blarg!! you snork" if k in bad else t for k, t in enumerate(texts)] + [None, ""]
    labels = spark.createDataFrame([(k, 0, int(k in bad)) for k in range(900)] + [(5, 0, None), (10**9, 1, 1)], "doc_id bigint, quality int, toxic int")
    table = docs(spark, texts).withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in toxicity.score(table, labels).collect()}
    assert len(got) == 902
    for k, r in got.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [k for k in range(900) if got[k].held_out]
    assert all(got[k].predicted == int(k in bad) for k in held)
    assert got[900].score == got[901].score
    none = toxicity.score(docs(spark, ["a"]), labels.limit(0)).first()
    assert none.predicted == 0
    assert toxicity.score(docs(spark, []), labels).count() == 0


def luhn(number):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(number))) % 10 == 0


def feistel(a, b, size_a, size_b, kind, key):
    own = hmac.digest(key.encode(), kind.encode(), "sha256")
    for i in range(8):
        other = b if i % 2 == 0 else a
        shift = int(hmac.digest(own, f"{size_a}|{size_b}|{i}|{other}".encode(), "sha256").hex()[:15], 16)
        a, b = ((a + shift) % size_a, b) if i % 2 == 0 else (a, (b + shift) % size_b)
    return a, b


def digits_of(d, kind, key):
    u = len(d) // 2
    a, b = feistel(int(d[:u]), int(d[u:]), 10**u, 10 ** (len(d) - u), kind, key)
    return f"{a:0{u}}{b:0{len(d) - u}}"


def iban_check(t):
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97


def test_every_pseudonym_is_what_brute_force_says(spark):
    """Cards, dates of all forms, IBANs, numbers and mail addresses recomputed in Python."""
    first = {1: date(1, 1, 1), 1900: date(1900, 1, 1), 2100: date(2100, 6, 18)}
    sizes = {1: (745, 931), 1900: (256, 286), 2100: (1337, 2158)}

    def day(d):
        start = 1 if d.year < 1900 else 1900 if d < first[2100] else 2100
        a, b = sizes[start]
        n = (d - first[start]).days
        x, y = feistel(n // b, n % b, a, b, f"date date'{first[start].isoformat()}'", "k")
        return first[start] + timedelta(x * b + y)

    ssn = feistel((123 - 1) * 99 + 45 - 1, 6789 - 1, 898 * 99, 9999, "ssn", "k")
    area = ssn[0] // 99 + (2 if ssn[0] // 99 >= 665 else 1)
    card = digits_of("411111111111111", "card", "k")
    card += next(str(c) for c in range(10) if luhn(card + str(c)))
    iban = "DE89370400440532013000"
    bban = digits_of(iban[4:], "iban", "k")
    new_iban = f"DE{98 - iban_check('DE00' + bban):02}{bban}"
    assert iban_check(iban) == iban_check(new_iban) == 1
    mail = hmac.digest(hmac.digest(b"k", b"mail", "sha256"), b"a.b@x.org", "sha256").hex()[:32]
    cases = {
        "4111111111111111": card, "2020-12-31": day(date(2020, 12, 31)).strftime("%Y-%m-%d"), "31/12/2020": day(date(2020, 12, 31)).strftime("%d/%m/%Y"), "03/04/2020": day(date(2020, 3, 4)).strftime("%m/%d/%Y"),
        "14.07.1789": f"{day(date(1789, 7, 14)):%d.%m}.{day(date(1789, 7, 14)).year:04}", "2250-01-01": day(date(2250, 1, 1)).isoformat(), "31/31/2020": "31/31/2020", "123-45-6789": f"{area:03}-{ssn[0] % 99 + 1:02}-{ssn[1] + 1:04}",
        iban: new_iban, "DE89 3704 0044 0532 0130 00": " ".join(new_iban[k : k + 4] for k in range(0, 22, 4)), "DE88370400440532013000": "DE88370400440532013000", "A.B@x.org": f"user-{mail}@mail.invalid",
    }
    got = [r.text for r in pseudonyms.pseudonymise(docs(spark, [f"so {t} it" for t in cases]), "k").orderBy("doc_id").collect()]
    assert got == [f"so {t} it" for t in cases.values()]


def test_pseudonyms_of_repeated_rows_long_texts_and_secrets_by_case(spark):
    long = "plain words without any number " * 40_000
    texts = ["call 017-555-7713", "call 017-555-7713", long + "10.2.3.4", "token=ABCDEFGHIJKLMNOPQRST", "token=abcdefghijklmnopqrst"]
    got = [r.text for r in pseudonyms.pseudonymise(docs(spark, texts), "k").orderBy("doc_id").collect()]
    assert got[0] == got[1] != texts[0] and got[2].startswith(long) and got[2] != texts[2] and got[3] != got[4]


def test_pseudonyms_keep_format_and_link(spark):
    texts = [
        "a card 4111 1111 1111 1111, again 4111111111111111; not one 4111111111111112", "IP 10.20.30.40 and 999.1.1.1", "call +1 (017) 555-7713 or 017-555-7713",
        "born 1980-02-29 = 29.02.1980 = 02/29/1980, never 1981-02-29", "ssn 123-45-6789 not 000-12-3456", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "mail A.b@x.org a.B@X.ORG", None, "", "plain 12 text",
    ]
    table = docs(spark, texts).withColumn("n_found", F.lit(-1)).withColumn("m", F.lit("kept"))
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(table, "k").collect()}
    cards = re.findall(r"\d{4} ?\d{4} ?\d{4} ?\d{4}", got[0].text)
    assert cards[0].replace(" ", "") == cards[1] != "4111111111111111" and luhn(cards[1]) and cards[2] == "4111111111111112"
    a, b = feistel(10 * 256 + 20, 30 * 256 + 40, 65536, 65536, "address", "k")
    assert got[1].text == f"IP {a // 256}.{a % 256}.{b // 256}.{b % 256} and 999.1.1.1"
    assert re.sub(r"\D", "", got[2].text.split(" or ")[0])[1:] == re.sub(r"\D", "", got[2].text.split(" or ")[1])
    iso, german, american = re.search(r"born (\S+) = (\S+) = (\S+), never 1981-02-29", got[3].text).groups()
    y, m, d = iso.split("-")
    assert (german, american) == (f"{d}.{m}.{y}", f"{m}/{d}/{y}") and iso != "1980-02-29"
    assert "000-12-3456" in got[4].text and "123-45-6789" not in got[4].text
    assert "24be64" not in got[5].text and len(got[5].text) == len(texts[5])
    one, two = re.findall(r"\S+@\S+", got[6].text)
    assert one == two
    assert [got[k].text for k in (7, 8, 9)] == [None, "", "plain 12 text"] and [got[k].n_found for k in range(10)] == [2, 1, 2, 3, 1, 1, 2, 0, 0, 0]
    assert got[0].m == "kept"
    assert pseudonyms.pseudonymise(docs(spark, []), "k").count() == 0


def test_pseudonyms_permute_without_collisions(spark):
    table = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("born "), F.date_add(F.lit("1950-01-01").cast("date"), F.col("id").cast("int"))).alias("text"))
    assert pseudonyms.pseudonymise(table, "k").select("text").distinct().count() == 3000


def test_license_spans(spark):
    lead = "Some words before.\n"
    notice = "Released under the MIT License."
    long = license_scan.TEMPLATES["isc"]
    torn = long.replace("any purpose", "any good purpose").replace("hereby ", "")
    texts = [lead + notice + " And after.", "nothing under the sun", (lead + torn).upper(), None, "", notice + "\n" + notice, "x " * 9000 + notice]
    rows = license_scan.scan(docs(spark, texts).withColumn("license", F.lit("clash"))).collect()
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, []).append(r)
    assert set(found) == {0, 2, 5, 6}
    assert texts[0][found[0][0].span_start : found[0][0].span_end] == notice and found[0][0].coverage == 1.0
    assert [r.license for r in found[2]] == ["isc"] and 0.9 < found[2][0].coverage < 1
    assert len(found[5]) == 2 and texts[6][found[6][0].span_start : found[6][0].span_end] == notice


def test_languages(spark):
    en, de = "the quick brown fox was there and then gone with them", "der schnelle braune fuchs war dort und dann mit ihnen fort"
    labelled = spark.createDataFrame([(k, en if k % 2 else de, "en" if k % 2 else "de", "s", 0) for k in range(60)], DOCS)
    models = language_id.fit(labelled, "text", "lang", "doc_id")
    pages = spark.createDataFrame(
        [(1, "http://a.example.de/x", f'<html lang="de"><script>var the=1</script><p>{de}'), (2, "http://b.example.com/", f"<p>{en}</p>"), (3, None, None), (4, "::bad::", "<p>123 !!</p>"), (5, "http://a.example.de/y", "<p>漢字 仮名 交じり 文章</p>")],
        "page_id int, url string, html string",
    ).withColumn("Language", F.lit("clash"))
    got = {r.page_id: r for r in language_id.identify(pages, models, text_col="html", url_col="url", markup=True).collect()}
    assert [got[k].language for k in range(1, 6)] == ["de", "en", "und", "und", "und"]
    assert [got[k].accepted for k in range(1, 6)] == [True, True, False, False, False]
    assert language_id.identify(pages.limit(0), models, text_col="html", url_col="url", markup=True).count() == 0
    assert {r.accepted for r in language_id.identify(labelled, ([], {}), text_col="text").collect()} == {False}


def page(body, host="h.example", k=0):
    return f'<html><head><title>t</title></head><body><div class="top">Site of {host}</div><nav>menu</nav>{body}<div>Imprint<p>Call us</p></div></body>'


def test_site_templates(spark):
    article = "<article><h1>Head &amp; <i>line</i></h1><p>One<br>two&nbsp;three<p>Four <b>five<form><input><p>f</p></form><div class='comments'><p>c</p></div></article>"
    rows = [(k, f"http://h.example/{k}", page(f"<p>Text {k} of its own</p>")) for k in range(8)]
    rows += [(10, "http://h.example/a", page(article)), (11, None, None), (12, "http://[bad", ""), (13, "http://h.example/13", "<div>" * 2000 + "deep"), (13, "http://h.example/13", "a <b")]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted((r.page_id, r.text, r.n_chars) for r in site_templates.main_text(table).collect())
    assert [t for k, t, _ in got if k < 8] == [f"Text {k} of its own" for k in range(8)]
    assert [t for k, t, _ in got if k >= 10] == ["Head & line\n\nOne two three\n\nFour five", "", "", "a", "deep"]
    assert all(n == len(t) for _, t, n in got)
    assert site_templates.main_text(table.limit(0)).count() == 0


def test_a_text_published_twice_stays(spark):
    rows = [(k, f"http://h.example/{k}", page("<article><p>The same article everywhere</p></article>")) for k in range(9)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r.text for r in site_templates.main_text(table).collect()} == {"The same article everywhere"}


def test_copies_without_an_article_keep_their_text(spark):
    top = '<div class="top">Site of the host</div>'
    copy = top + "<div><div>A text that was put up<br>six times</div><p>And its end</p></div>"
    boxed = "<article><div>Boxed text<br>of an article</div></article>"
    rows = [(k, "http://h.example/", f"<body>{top}<div>Page {k} of its own</div></body>") for k in range(14)]
    rows += [(100 + k, "http://h.example/", f"<html><head><link href='{k}'></head><body>{copy}</body></html>") for k in range(6)]
    rows += [(200 + k, "http://h.example/", boxed) for k in range(6)]
    got = {r.page_id: r.text for r in site_templates.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert [got[k] for k in range(14)] == [f"Page {k} of its own" for k in range(14)]
    assert {got[100 + k] for k in range(6)} == {"A text that was put up six times\n\nAnd its end"}
    assert {got[200 + k] for k in range(6)} == {"Boxed text of an article"}


def test_a_block_is_template_on_hosts_of_any_size(spark):
    box = "<div class='x1'>Join our offer</div>"
    rows = [(f"{host} {k}", f"http://{host}.example/", f"<body><div>Page {k} of its own</div>{box if k < 6 else ''}</body>") for host, n in (("small", 10), ("large", 200)) for k in range(n)]
    got = {r.page_id: r.text for r in site_templates.main_text(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    assert got == {i: f"Page {i.split()[1]} of its own" for i, _, _ in rows}


def test_teasers_do_not_displace_the_body(spark):
    teasers = "".join(f"<article><h3>Teaser {k}</h3></article>" for k in range(5))
    body = "<div>The text of the page itself, longer than any of its teasers</div>"
    article = "<article><p>A whole article with more text than stands around it</p></article><div>Shop now</div>"
    rows = [(1, "http://a.example/", body + teasers), (2, "http://a.example/", f"<main>{body}{teasers}</main><div>Outside</div>"), (3, "http://a.example/", article), (4, None, article)]
    got = {r.page_id: r.text for r in site_templates.main_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert all(got[k].startswith("The text of the page itself") and "Outside" not in got[k] for k in (1, 2))
    assert got[3] == got[4] == "A whole article with more text than stands around it"


def test_counting_decides_and_is_what_brute_force_counts(spark):
    """Boxes of neutral names, in and outside of articles, go by recurrence alone; near copies keep their own boxes."""
    rng = random.Random(11)
    words = [f"word{k}" for k in range(500)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    boxes = [f"<div class='x{k}'><p>{say(9)}</p><p>{say(30)}</p></div>" for k in range(6)]
    rows, k = [], 0
    for host in ("a", "b", "c"):
        for _ in range(12):
            some = [b for b in boxes if rng.random() < 0.4]
            body = f"<p>{say(40)}</p><p>{say(25)}</p>"
            html = f"{''.join(some)}<article>{body}{rng.choice(boxes)}</article>" if rng.random() < 0.5 else f"<div>{''.join(some)}</div><div>{body}</div>"
            rows.append((k, f"http://{host}.example/{k}", f"<body>{html}</body>"))
            k += 1
    long, near = f"<div><p>{say(60)}</p><p>{say(50)}</p></div>", k
    rows += [(k + j, "http://n.example/", f"<body><article>{long}<p>{say(8)}</p></article></body>") for j in range(6)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in site_templates.main_text(table).collect()}
    without = {r.page_id: r.text for r in site_templates.main_text(table, least_pages=10**9).collect()}
    assert sum(got[i] != without[i] for i, _, _ in rows) > 20 and all(got[near + j] == without[near + j] for j in range(6))
    pages = {i: (url.split("/")[2], site_templates.read_page(html)) for i, url, html in rows}
    seen: dict = {}
    for host, page in pages.values():
        for n, h in enumerate(page.hashes):
            if h:
                below = {n}
                for m in range(n + 1, len(page.parents)):
                    if page.parents[m] in below:
                        below.add(m)
                outside = sorted((t for o, t in zip(page.owners, page.texts) if o not in below), key=lambda t: (-len(t), t))
                flows = lambda texts: sum(len(t) for t in texts if len(t.split()) >= 5)
                keys = (outside[0], outside[min(1, len(outside) - 1)], tuple(outside)) if outside and flows(outside) >= flows(page.texts) - flows(outside) else (h, h, h)
                for way, key in enumerate(keys):
                    seen.setdefault((host, h), ({}, {}, {}))[way][key] = 1
    template: dict = {}
    for (host, h), ways in seen.items():
        if sum(len(w) >= 4 for w in ways) >= 2:
            template.setdefault(host, set()).add(h)
    assert got == {i: site_templates.kept_text(page, template.get(host, set())) for i, (host, page) in pages.items()}


def test_deep_and_unclosed_markup_is_read_as_any_other(spark):
    for deep in (3, 3000):
        page = "<div>" * deep + "<ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table><p>first<p>second" + " " + "<b>" * deep + "bold<p>third"
        read = site_templates.read_page(page)
        assert read.texts == ["one", "two", "a", "b", "c", "first", "second bold", "third"]
        kind = [read.parents[o] for o in read.owners]
        assert kind[0] == kind[1] and read.parents[kind[2]] == read.parents[kind[4]]


def test_article_text_stays_whatever_it_is_named(spark):
    html = "<article><p class='related'>Related work of others</p><div class='social share-of-voice'>Social science</div><math>x + y</math><p id='menu-of-the-day'>Soup</p><div class='comments'>no</div><dialog>shut</dialog></article>"
    got = site_templates.main_text(spark.createDataFrame([(1, "http://a.example/", html)], "page_id int, url string, html string")).first()
    assert got.text == "Related work of others\n\nSocial science\n\nx + y\n\nSoup"


def test_pseudonyms_of_whole_secrets_and_of_cards_among_numbers(spark):
    long, jwt, coded = "Ab3-" * 50, "eyJhbGci.eyJzdWIiOiIx.c2lnbmF0dXJlLXZhbHVl", "q83v/7+Zk1x+Qw0aT5m/Lg=="
    card, other, nineteen = "4111 1111 1111 1111", "5500 0000 0000 0004", "4000 0000 0000 0000 006"
    texts = [f"token={long}", f"secret: {jwt}.", f'api_key = "{coded}"', f"{card} 10/27", "12 4111111111111111", f"{card} {other} 123", f"x {card} 2020-01-02 y", f"{card} 12ab", "7 3782 822463 10005 9", nineteen, "1 2 " * 4000, "4111-1111-1111-1111-2"]
    got = [(r.text, r.n_found) for r in pseudonyms.pseudonymise(docs(spark, texts), "k").orderBy("doc_id").collect()]
    for k, value in ((0, long), (1, jwt), (2, coded)):
        start = texts[k].index(value)
        assert len(got[k][0]) == len(texts[k]) and got[k][0][:start] == texts[k][:start] and got[k][0][start + len(value) :] == texts[k][start + len(value) :]
        assert got[k][1] == 1 and not any(value[i : i + 8] in got[k][0] for i in range(len(value) - 7))
    assert re.fullmatch(r"\d{4} \d{4} \d{4} \d{4} 10/27", got[3][0]) and luhn(got[3][0][:-6].replace(" ", "")) and got[3][0] != texts[3]
    assert got[4][0].startswith("12 ") and luhn(got[4][0][3:]) and got[4][0] != texts[4]
    assert got[5][0].endswith(" 123") and card not in got[5][0] and other not in got[5][0]
    assert card not in got[6][0] and "2020-01-02" not in got[6][0]
    assert card not in got[7][0] and got[7][0].endswith(" 12ab")
    assert "3782 822463 10005" not in got[8][0] and got[8][0][:2] == "7 " and got[8][0][-2:] == " 9"
    assert luhn(nineteen.replace(" ", "")) == (got[9][0] != nineteen)
    assert [n for _, n in got[3:9]] == [1, 1, 2, 2, 1, 1] and got[11] == (texts[11], 0)


def test_whole_licenses_and_the_nearest_of_a_family(spark):
    names = ["mit", "isc", "bsd-2-clause", "bsd-3-clause", "gpl-3.0", "gpl-2.0", "lgpl-3.0", "lgpl-2.1", "agpl-3.0", "lgpl-3.0-notice", "agpl-3.0-notice", "gpl-3.0-notice"]
    texts = [license_scan.TEMPLATES[n] for n in names]
    later = texts[0][texts[0].index("THE SOFTWARE IS") - 130 :]
    rows = license_scan.scan(docs(spark, [f"before it {t} after it" for t in [*texts, later]])).orderBy("doc_id").collect()
    assert [r.license for r in rows] == [*names, "mit-rest"]
    assert all(r.coverage == 1.0 and (r.span_start, r.span_end) == (10, 10 + len(t)) for r, t in zip(rows, texts))
    assert texts[0].endswith("OTHER DEALINGS IN THE SOFTWARE.")


def test_unwanted_elements_within_a_paragraph(spark):
    cases = {
        "<p>Hello <button>Share this</button> dear world</p>": "Hello dear world",
        '<p>Told <span class="ad">Buy now cheap</span> and <b>told</b> again</p>': "Told and told again",
        '<p>Seen <span style="display:none">not <i>seen</i></span>here</p>': "Seen here",
        "<p>One</p><noscript>enable js</noscript><p>Two</p>": "One\n\nTwo",
        "<p>Drawn <svg><text>glyph</text></svg>figure</p>": "Drawn figure",
        "<p>One</p><button>Go</button><p>Two</p>": "One\n\nTwo",
        "<p>Left <select><option>a<option>b</select>right <label>kept</label></p>": "Left right kept",
        "<p>Open <span class='ads'>never closed</p><p>next</p>": "Open\n\nnext",
        "<p>a<template><p>no</p></template>b</p>": "ab",
        "<p>x <span hidden>no <p>inner</p></span></p><p>y</p>": "x\n\ninner\n\ny",
    }
    rows = [(k, "http://a.example/", f"<body><article>{html}</article></body>") for k, html in enumerate(cases)]
    got = {r.page_id: r.text for r in site_templates.main_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())


def test_no_plan_shows_a_key(spark):
    table = docs(spark, ["card 4111 1111 1111 1111 on 2020-01-02 from a@b.co and 10.1.2.3"])
    done = pseudonyms.pseudonymise(table, "the caller's own secret")
    done.collect()
    plans = done._jdf.queryExecution().toString() + done._jdf.queryExecution().explainString(done._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    row = pseudonyms.key_row(spark, "the caller's own secret").first()[0].asDict()
    assert len(row) == 2 * len(pseudonyms.KINDS) and "HashAggregate" not in plans and "sha2(" in plans
    for padded in row.values():
        pads = (bytes(padded), bytes(b ^ 0x36 for b in padded), bytes(b ^ 0x5C for b in padded))
        assert not any(form in plans.lower() for p in pads for form in (p[:8].hex(), str(list(p[:6]))[1:-1]))
    assert "caller" not in plans
