"""Absorption against the rule, entry by entry and group by group."""

import random

from pyspark.sql import functions as F

from logweave.operators import absorb, group
from logweave.operators.schema import as_entries
from logweave.plans.analyzer import session_defaults


def entries(spark, rows):
    session_defaults(spark)
    e = spark.createDataFrame(rows, "seq bigint, ms bigint, message string, user_id string, session_id string, format string, metadata map<string,string>, group_key string")
    return as_entries(e.withColumn("ts", F.timestamp_millis("ms")).drop("ms")).join(e.select("seq", "group_key"), "seq")


def some_rows(rng, n, span):
    messages = ("idle",) * 6 + ("pool exhausted", "connection pool busy", "upstream 503", "wait timeout")
    rows = []
    for seq in range(n):
        meta = {k: v for k, v in (("service", rng.choice(("", "a", "b", "c"))), ("status", rng.choice(("200", "401", "500"))), ("order", f"ord-{rng.randrange(40)}"), ("cart", f"cart-{rng.randrange(40)}")) if rng.random() < 0.5}
        key = f"requestId:r{rng.randrange(n // 6)}" if rng.random() < 0.5 else None
        own = lambda name, most, share: rng.choice((f"{name}{rng.randrange(most)}", "")) if rng.random() < share else None
        rows.append((seq, rng.randrange(0, span, 500), rng.choice(messages), own("u", 12, 0.3), own("s", 12, 0.2), rng.choice((None, "json", "plain")), meta, key))
    return rows


def by_the_rule(loose, members, window_ms):
    groups = {}
    for r in sorted(members, key=lambda r: (r[1], r[0])):
        groups.setdefault(r[7], []).append(r)
    horizon, ids = max(6 * window_ms, 60_000), lambda r: {v for k, v in r[6].items() if k in ("order", "cart")}
    pool, starved = (lambda r: "pool" in r[2]), (lambda r: r[2] in ("upstream 503", "wait timeout"))
    found = {}
    for e in loose:
        best = None
        for key, g in groups.items():
            times, first = [r[1] for r in g], min(r[0] for r in g)
            start, end = times[0], times[-1]
            if not start - horizon <= e[1] <= end + horizon:
                continue
            one = lambda k: next((r[k] for r in g if r[k] is not None), None)  # noqa: B023, E731
            border, score = min(abs(e[1] - start), abs(e[1] - end)), 0
            same_user = bool(e[3]) and e[3] == one(3)
            score += 10 * same_user + 10 * (bool(e[4]) and e[4] == one(4)) + 3 * (start <= e[1] <= end)
            score += 5 if border <= window_ms else 3 if min(abs(e[1] - t) for t in times) <= 10_000 else 0
            score += 2 * (bool(e[6].get("service")) and e[6]["service"] in {r[6].get("service") for r in g}) + 8 * bool(ids(e) & {x for r in g for x in ids(r)})
            had = {r[6].get("status") for r in g}
            score += 7 * (same_user and border <= 10_000 and ((e[6].get("status") == "401" and "200" in had) or (e[6].get("status") == "200" and "401" in had)))
            score += 8 * (border <= 5000 and ((pool(e) and any(map(starved, g))) or (any(map(pool, g)) and starved(e))))
            score -= 2 * (bool(e[5]) and bool(one(5)) and e[5] != one(5))
            if score >= 5 and (best is None or (-score, first) < best[:2]):
                best = (-score, first, key)
        if best:
            found[e[0]] = (best[2], -best[0])
    return found


def test_every_entry_takes_the_group_that_the_rule_gives(spark, monkeypatch):
    for seed, rows_a_slab, span, window_ms, lot in ((0, 10_000, 900_000, 5000, 1 << 20), (1, 60, 2_000_000, 5000, 50), (2, 40, 300_000, 2000, 1), (3, 50, 1000, 12_000, 1 << 20)):
        monkeypatch.setattr(absorb, "SLAB_ROWS", rows_a_slab)
        monkeypatch.setattr(absorb, "LOT", lot)
        rows = some_rows(random.Random(seed), 500, span)
        loose, members = [r for r in rows if r[7] is None], [r for r in rows if r[7] is not None]
        held = entries(spark, members)
        got = group.absorb_scores(entries(spark, loose).drop("group_key"), group.group_bounds(held), held, window_ms).collect()
        assert {r.seq: (r.group_key, r.score) for r in got} == by_the_rule(loose, members, window_ms) and len(got) == len({r.seq for r in got})


def test_what_is_shuffled_does_not_grow_with_the_groups_that_are_open(spark):
    """300 groups that are open all the time, 300 entries: no plan step lists their 90,000 pairs."""
    rows = [(n * 2 + k, n + k * 10_000_000, "m", None, None, "json", {"service": "a"}, f"requestId:r{n}") for n in range(300) for k in (0, 1)]
    loose = [(1000 + n, 30_000 + n * 30_000, "m", None, None, "json", {"service": "a"}, None) for n in range(300)]
    held = entries(spark, rows)
    scores = group.absorb_scores(entries(spark, loose).drop("group_key"), group.group_bounds(held), held)
    assert {(r.group_key, r.score) for r in scores.collect()} == {("requestId:r0", 5)}
    nodes, most = [scores._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(k) for k in range(node.children().size())]
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif node.getClass().getSimpleName().endswith("QueryStageExec"):
            nodes.append(node.plan())
        metric = node.metrics().get("numOutputRows")
        most = max(most, metric.get().value() if metric.isDefined() else 0)
    assert 600 <= most <= 3000
