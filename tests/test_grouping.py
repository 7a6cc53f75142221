"""Grouping against sequential re-computations."""

import random

from pyspark.sql import functions as F

from logweave.operators import folds, group
from logweave.operators.schema import as_entries
from logweave.plans.analyzer import session_defaults
from logweave.plans.graph import connected_components


def entries(spark, rows):
    """``(seq, ms, message, source, group_key, metadata)``"""
    session_defaults(spark)
    e = spark.createDataFrame(rows, "seq bigint, ms bigint, message string, source string, group_key string, metadata map<string,string>")
    return as_entries(e.withColumn("ts", F.timestamp_millis("ms")).drop("ms")).join(e.select("seq", "group_key"), "seq")


def merged_one_by_one(members):
    """``members``: group -> (rank, entities in order, [start, end]); entities in the order of the groups that mention them."""
    order = sorted(members, key=lambda g: members[g][0])
    by_entity = {}
    for g in order:
        for e in members[g][1]:
            by_entity.setdefault(e, []).append(g)
    span, into = {g: list(members[g][2]) for g in order}, {}
    for groups in by_entity.values():
        valid = [g for g in groups if g not in into]
        if len(valid) < 2:
            continue
        first = valid[0]
        for g in valid[1:]:
            a, b = span[first], span[g]
            if (b[0] <= a[1] and b[1] >= a[0]) or min(abs(b[0] - a[1]), abs(a[0] - b[1])) <= 600_000:
                into[g] = first
                span[first] = [min(a[0], b[0]), max(a[1], b[1])]

    def root(g):
        while g in into:
            g = into[g]
        return g

    return {g: root(g) for g in into}


def test_entity_merges_grow_and_follow_the_order(spark):
    rng = random.Random(4)
    rows, members, seq = [], {}, 0
    for n in range(260):
        kind = rng.choice(("requestId:r", "inferred-", "time:"))
        key, start = f"{kind}{n}", n * rng.choice((1, 1, 3)) * 40_000
        ids = [f"ord-{rng.randrange(40):03d}" for _ in range(rng.choice((0, 1, 1, 2, 3)))]
        rank = ({"r": 0, "i": 1, "t": 2}[kind[0]], seq)
        end = start + rng.choice((0, 60_000, 900_000))
        for ms, ids_here in ((start, ids[:2]), (end, ids[2:] + ids[:1])):
            rows.append((seq, ms, "m", None, key, {f"k{i}": e for i, e in enumerate(ids_here)}))
            seq += 1
        members[key] = (rank, list(dict.fromkeys(ids)), (start, end))
    expected = merged_one_by_one(members)
    assert len(expected) > 30
    assert {r.group_key: r.into for r in group.entity_merges(entries(spark, rows)).collect()} == expected
    minute = 60_000
    three = [(k, 9 * k * minute, "m", None, f"requestId:{k}", {"orderId": "ord-77"}) for k in range(3)]
    assert {r.group_key: r.into for r in group.entity_merges(entries(spark, three)).collect()} == {"requestId:1": "requestId:0", "requestId:2": "requestId:0"}
    assert group.entity_merges(entries(spark, three).limit(0)).count() == 0


def clustered_one_by_one(lines, threshold=0.4, stricter=0.6, horizon=300_000):
    clusters, out = [], {}
    for seq, ms, words in lines:
        best, similarity = None, 0.0
        for c in clusters:
            s = len(words & c["words"]) / len(words | c["words"]) if words | c["words"] else 0.0
            if s > similarity:
                best, similarity = c, s
        fits = best is not None and similarity >= threshold
        if fits and any(w.startswith("component:") for w in words) and not any(w.startswith("component:") for w in best["words"]) and similarity < stricter:
            fits = False
        if fits and abs(ms - best["last"]) <= horizon:
            best["words"] |= words
            best["last"] = ms
            out[seq] = best["first"]
        else:
            clusters.append({"words": set(words), "last": ms, "first": seq})
            out[seq] = seq
    return out


def test_2000_mixed_lines_are_clustered_as_one_by_one(spark):
    rng = random.Random(5)
    verbs, now, rows = ("get", "post", "retry", "timeout", "upload", "fetch", "cache", "queue", "login", "error"), 0, []
    for seq in range(2000):
        now += rng.choice((10, 1000, 2000) if rng.random() < 0.998 else (290_000,))
        rows.append((seq, now, " ".join(rng.choice(verbs) for _ in range(rng.choice((0, 1, 2, 3, 5)))) + f" {rng.choice((404, 500, 7))}", rng.choice((None, None, "disk", "net")), None, {}))
    e = entries(spark, rows)
    words = {r.seq: frozenset(r.keywords) for r in group.keywords(e).select("seq", "keywords").collect()}
    expected = clustered_one_by_one([(r[0], r[1], words[r[0]]) for r in rows])
    sizes = {c: list(expected.values()).count(c) for c in set(expected.values())}
    assert max(sizes.values()) > 20 and len(sizes) > 20 and sum(n == 1 for n in sizes.values()) > 5
    got = {r.seq: r.cluster for r in group.content_clusters(e.repartition(5)).collect()}
    assert got == {s: c for s, c in expected.items() if sizes[c] > 1}


def test_clusters_keep_different_unions_only():
    fold = folds.Clusters(0.4, 0.6, 300_000)
    words = frozenset(("get", "level:info"))
    assert [fold.put(k, k * 400_000, words) for k in range(100)] == list(range(100)) and len(fold.unions) == 1


def timed_one_by_one(rows, window=5000):
    out, n, before = {}, 0, None
    for seq, ms, source, form in sorted(rows, key=lambda r: (r[1], r[0])):
        if before:
            gap = ms - before[0]
            n += gap > window or bool(source and before[1] and source != before[1] and gap > 2000) or bool(form and before[2] and form != before[2] and gap > 0)
        out[seq], before = f"time:{n}", (ms, source, form)
    return out


def test_time_groups_over_slabs_and_midnight(spark):
    rng = random.Random(6)
    day, rows, now = 86_400_000, [], 86_400_000 - 900_000
    for seq in range(1500):
        now += rng.choice((0, 0, 500, 1500, 2500, 6000))
        rows.append((seq, now, rng.choice((None, "a", "b")), rng.choice((None, "x", "x", "x", "y"))))
    rows += [(9000, 5 * day - 1000, "a", "x"), (9001, 5 * day + 1000, "a", "x")]
    e = spark.createDataFrame(rows, "seq bigint, ms bigint, source string, format string").withColumn("ts", F.timestamp_millis("ms")).withColumn("message", F.lit("m")).drop("ms")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.seq: r.group_key for r in group.group_by_time(as_entries(e)).select("seq", "group_key").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == timed_one_by_one(rows) and got[9000] == got[9001]
    assert group.group_by_time(as_entries(e).limit(0)).count() == 0


def test_components_of_long_paths(spark):
    rng = random.Random(7)
    names = [f"n{k:04d}" for k in range(400)]
    path = names[:300]
    rng.shuffle(path)
    edges = list(zip(path, path[1:])) + [("n0350", "n0351"), ("n0360", "n0360")]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {**dict.fromkeys(names[:300], "n0000"), "n0350": "n0350", "n0351": "n0350", "n0360": "n0360"}
