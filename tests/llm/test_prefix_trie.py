"""Prefix trie against a plain count of all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from logweave.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string"


def plain_turns(rows):
    """Turns of every conversation in order; rows of one number by the digest of role and text."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).hexdigest()[:32]
            convs[conv].append(((turn is not None, turn or 0), key, role, text))
    return {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + turns[h:]
    return out


def plain_nodes(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, own in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(own) - 1) * len(node[-1][1]) if node else 0
            leaves[node[:d]] += node not in children
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), children[n], leaves[n], saved[n], digest(ends[n])) for n, m in members.items())


def got_of(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


def made(rng, n):
    """Conversations that share beginnings, are equal, or are beginnings of others; one in three is the same."""
    known = [[("user", "hot"), ("assistant", "answer é"), ("user", None)]]
    for _ in range(n // 2):
        base = list(rng.choice(known))[: rng.randrange(0, 7)]
        known.append(base + [(rng.choice(("user", "assistant", None)), rng.choice(("a", "bc", "def", "", None, "𝄞 long text"))) for _ in range(rng.randrange(0, 5))])
    rows = []
    for c in range(n):
        turns = known[0] if c % 3 == 0 else rng.choice(known)
        rows += [(c, k if k else rng.choice((None, 0)), role, text) for k, (role, text) in enumerate(turns)] or [(c, 0, "user", f"only {c % 4}")]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_tries_over_many_ranges(spark, seed):
    rng = random.Random(seed)
    rows = made(rng, 400)
    rows += [(9000, k, "user", "again") for k in range(300)] + [(9001, k, "user", "again") for k in range(150)]
    rows += [(None, 0, "user", "no id"), rows[5], (9002, 3, "user", "tie one"), (9002, 3, "user", "tie two"), (-250, 0, "user", "below zero"), (-201, 1, None, None)]
    table = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(6)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        turns = plain_turns(rows)
        assert got_of(prefix_trie.prefix_trie(prefix_trie.sequences(table))) == plain_nodes(turns)
        starts = {c: [t for t in ts] for c, ts in turns.items()}
        expected = plain_nodes({c: v for c, v in rebuilt({c: t for c, t in starts.items() if c >= 0}).items()})
        nodes = prefix_trie.prefix_trie(prefix_trie.with_shared_starts(prefix_trie.sequences(table.filter("conv_id >= 0"))))
        assert got_of(nodes) == expected
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_small_tables(spark):
    table = spark.createDataFrame([(7, 0, "user", "one"), (107, 0, "user", "one"), (207, None, None, None)], SCHEMA.rsplit(",", 1)[0])
    assert got_of(prefix_trie.prefix_trie(prefix_trie.sequences(table.limit(0)))) == []
    for part in ("conv_id = 7", "conv_id < 200", "true"):
        rows = [tuple(r) for r in table.filter(part).collect()]
        assert got_of(prefix_trie.prefix_trie(prefix_trie.sequences(table.filter(part)))) == plain_nodes(plain_turns(rows))
        again = prefix_trie.with_shared_starts(prefix_trie.sequences(table.filter(part)))
        assert got_of(prefix_trie.prefix_trie(again)) == plain_nodes(rebuilt(plain_turns(rows)))
    assert {r.n for r in again.select(F.size("turns").alias("n")).collect()} <= {0, 1}


def test_one_range_against_plain_counts():
    """Random sets of sequences through the build of one task and its sums, without Spark."""
    import pyarrow as pa

    rng = random.Random(11)
    for _ in range(150):
        found = defaultdict(list)
        for c in range(rng.randrange(1, 30)):
            found[tuple(rng.randrange(3) for _ in range(rng.randrange(6)))].append(c)
        rows = sorted((b"".join(bytes([t]) * prefix_trie.KEY for t in seq), [t + 1 for t in seq], len(m), min(m), "") for seq, m in found.items())
        batch = pa.RecordBatch.from_pylist([dict(zip(("path", "sizes", "n", "first", "ends"), r)) for r in rows])
        out = [r for b in prefix_trie.tries(iter([batch])) for r in b.to_pylist()]
        convs = {c: [("", "x" * (t + 1), t) for t in seq] for seq, m in found.items() for c in m}
        inner = sorted((r["conv_id"], r["depth"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"]) for r in out if r["side"] < 2)
        every = [(n[0], n[1], *n[3:7]) for n in plain_nodes(convs)]
        assert all(r in every for r in inner) and len(inner) + len({r["node"] for r in out if r["side"] == 2}) == len(every)
