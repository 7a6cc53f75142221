"""Piecewise fingerprints: distances and orders against plain re-computations, and what edits do to likeness."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from logweave.llm import piecewise

DOCS = "doc_id bigint, text string, fingerprint string"


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(2000):
        letters = "abcdefgh"[: rng.choice((1, 2, 4, 8))]
        a, b = ([rng.choice(letters) for _ in range(rng.randrange(80))] for _ in range(2))
        assert piecewise.edit_distance(a, b) == plain_distance(a, b)


def plain_triggers(data, size):
    """Ends of chunks by the definition, byte by byte."""
    found = []
    for j in range(len(data)):
        h = sum((data[j - i] + 1) * int(piecewise.FACTORS[i]) for i in range(piecewise.WINDOW) if j >= i) % 2**32
        h ^= h >> 15
        h = h * 0x85EBCA77 % 2**32
        h ^= h >> 13
        if h % size == size - 1:
            found.append(j + 1)
    return found


@pytest.mark.parametrize("piece", [1 << 20, 11])
def test_triggers_do_not_depend_on_pieces(monkeypatch, piece):
    monkeypatch.setattr(piecewise, "PIECE", piece)
    rng = random.Random(3)
    for n in (0, 1, 2, 6, 7, 8, 11, 50, 700):
        data = bytes(rng.randrange(256) for _ in range(n))
        size = piecewise.block_size(n)
        assert piecewise.triggers(data, size) == (plain_triggers(data, size), plain_triggers(data, 2 * size))


def test_fingerprints_are_bounded_and_feel_edits_only_nearby():
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(3000))
    own = piecewise.fingerprint(text)
    middle = len(text) // 2
    assert piecewise.likeness(own, piecewise.fingerprint(text[:middle] + "inserted words" + text[middle:])) > 0.9
    assert piecewise.likeness(own, piecewise.fingerprint("some words before " + text)) > 0.9
    assert piecewise.likeness(own, piecewise.fingerprint(text[: middle + 100])) > 0.4
    assert piecewise.likeness(own, piecewise.fingerprint(text[::-1])) < 0.1
    assert piecewise.likeness(own, piecewise.fingerprint(text[:400])) == 0.0
    for odd in ("a" * 50_000, "ab " * 9_000, "\n" * 7, "é", "𝄞" * 400):
        found = piecewise.fingerprint(odd)
        assert len(piecewise.symbols(found.split(":")[1])) <= piecewise.CHUNKS / piecewise.LEAST + 1
        assert piecewise.likeness(found, found) == 1.0
    assert piecewise.fingerprint(None) == piecewise.fingerprint("") == "3::"
    assert piecewise.likeness("3::", piecewise.fingerprint("a")) == 0.0


def plain(rows):
    """What ``compare_edited`` says of ``(id, text)`` rows that are in order already."""
    out = []
    for k, (doc, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(text) // 4
        changed = text[: len(text) - q] + following[:q]
        a, b, c = (piecewise.fingerprint(t) for t in (text, changed, following))
        out.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), a, b, piecewise.likeness(a, b), piecewise.likeness(a, c)))
    return out


def test_documents_meet_their_next_ones_across_partitions(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 9))) for _ in range(300)] + ["é𝄞", "日本"]
    rows = [(3 * k - 50, " ".join(rng.choice(words) for _ in range(rng.choice((0, 1, 5, 80, 900))))) for k in range(200)]
    rows[7], rows[50], rows[120] = (rows[7][0], None), (rows[50][0], ""), (rows[120][0], "long " * 60_000)
    for k in (20, 21, 90):
        rows[k] = (rows[k][0], rows[10][1])
    table = spark.createDataFrame([(i, t, "clash") for i, t in rows], DOCS)
    got = piecewise.compare_edited(table.repartition(7))
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows))
    assert piecewise.compare_edited(table.limit(0)).count() == 0
    assert list(map(tuple, piecewise.compare_edited(table.filter("doc_id = 10")).collect())) == plain([r for r in rows if r[0] == 10])


def test_repeated_and_null_ids(spark):
    rows = [(None, "first of all, without an id"), (1, "same text here"), (1, "same text here"), (2, "the last one of the table")]
    got = sorted(map(tuple, piecewise.compare_edited(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    assert got == sorted(plain(rows), key=str)


def test_columns_of_fingerprints(spark):
    df = piecewise.with_fingerprints(spark.createDataFrame([("some words of a text",), (None,)], "text string"))
    assert [r.fingerprint for r in df.collect()] == [piecewise.fingerprint("some words of a text"), "3::"]
    assert [r.x for r in df.select(piecewise.like(F.col("fingerprint"), F.lit("3::")).alias("x")).collect()] == [0.0, 1.0]
