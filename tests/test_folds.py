"""Chains and merged stories against sequential re-computations of their rules."""

import random

from pyspark.sql import functions as F

from logweave.operators import causal, events, folds
from logweave.operators.schema import as_entries
from logweave.plans.analyzer import session_defaults
from logweave.plans.graph import cut_lineage, tied_blocks

EVENT = "id string, start_ms bigint, end_ms bigint, user string, session string, meta_user string, entities array<string>, components array<string>, request boolean, group_key string, action_types string, outcome string, escalates boolean"


def one_by_one(items, related, join):
    """Every item in order seeds a chain unless an earlier one took it; a chain looks through all that follow before the next begins."""
    items, used, out = sorted(items, key=lambda e: (e["start_ms"], e["id"])), set(), {}
    for i, seed in enumerate(items):
        if seed["id"] in used:
            continue
        chain = [seed]
        used.add(seed["id"])
        for other in items[i + 1 :]:
            if other["id"] not in used and related(chain, other):
                chain.append(other)
                used.add(other["id"])
        out.update({e["id"]: (seed["id"], place) for place, e in enumerate(chain, 1)})
        join(chain)
    return out


def follows(chain, c):
    first, last = chain[0], chain[-1]
    user, session, meta = (first[k] or last[k] for k in ("user", "session", "meta_user"))
    gap = c["start_ms"] - last["end_ms"]
    shared = lambda k: bool({x for e in chain for x in e[k]} & set(c[k]))
    if user and user == c["user"]:
        if -1000 <= gap < 120_000:
            return True
        if 0 <= gap < 300_000 and last["outcome"] == "failure" and (last["action_types"] == c["action_types"] or c["escalates"]):
            return True
    if session and session == c["session"] and -1000 <= gap < 300_000:
        return True
    if 0 <= gap < 60_000 and (shared("entities") or (meta and meta == c["meta_user"])):
        return True
    if gap <= 5000:
        if user and user == c["user"]:
            return True
        if user and not c["user"] and shared("entities"):
            return True
        if not user and not c["user"]:
            if first["request"] and c["request"] and first["group_key"] != c["group_key"]:
                return False
            if first["request"] and not c["request"]:
                return shared("entities")
            return gap <= 3000 or shared("components")
    return False


def random_events(rng, n, spread, hot=None):
    out, now = [], 0
    for k in range(n):
        now += rng.choice((0, 1, 500, 2500, 4000, 30_000, 70_000, 130_000, 310_000) if rng.random() < spread else (0, 200, 900))
        pick = lambda kind, most, share: f"{kind}{rng.randrange(most)}" if rng.random() < share else None
        out.append(
            {
                "id": f"e{k:05d}", "start_ms": now, "end_ms": now + rng.choice((0, 10, 1500, 8000, 90_000)), "user": hot if hot and rng.random() < 0.34 else pick("u", 12, 0.4), "session": pick("s", 15, 0.2),
                "meta_user": pick("m", 9, 0.2), "entities": [f"x{rng.randrange(40)}" for _ in range(rng.choice((0, 0, 0, 1, 2)))], "components": [f"c{rng.randrange(3)}" for _ in range(rng.choice((0, 1)))],
                "request": rng.random() < 0.4, "group_key": f"g{k}", "action_types": rng.choice(("a", "b")), "outcome": rng.choice(("failure", "success")), "escalates": rng.random() < 0.2,
            }
        )
    return out


def event_ties(items):
    nobody = F.array(F.when(F.col("user").isNull(), F.lit("any")))
    return causal.tied_by(items, user=(F.array("user"), 300_000), session=(F.array("session"), 300_000), meta=(F.array("meta_user"), 60_000), entity=(F.col("entities"), 60_000), nobody=(nobody, 5000))


def test_chains_equal_a_sequential_pass(spark, monkeypatch):
    monkeypatch.setattr(folds, "SWEEP", 50)
    for seed, n, spread, hot in ((1, 500, 0.9, None), (2, 1500, 0.3, "hot")):
        made = random_events(random.Random(seed), n, spread, hot)
        expected = {i: c for i, c in one_by_one(made, follows, lambda c: None).items()}
        names = [c.split()[0] for c in EVENT.split(", ")]
        items = cut_lineage(spark.createDataFrame([tuple(e[c] for c in names) for e in made], EVENT).repartition(3))
        got = {r.id: (r.chain, r.place) for r in folds.first_fit(items, event_ties(items), folds.Chain, items.columns).collect()}
        assert {e["id"]: got.get(e["id"], (e["id"], 1)) for e in made} == expected
        assert len({c for c, _ in expected.values()}) > n / 20


def test_blocks_keep_apart_what_no_rule_ties(spark):
    items = spark.createDataFrame([("a", 0, 10), ("b", 100, 5000), ("c", 5500, 5600), ("d", 9000, 9001), ("e", 5050, 5060), ("z", 400, 400)], "id string, start_ms bigint, end_ms bigint")
    ties = spark.createDataFrame([("a", "k", 200), ("b", "k", 200), ("b", "l", 600), ("c", "l", 600), ("d", "k", 200), ("e", "k", 200), ("z", None, 200)], "id string, key string, horizon_ms bigint")
    assert {r.id: r.block for r in tied_blocks(items, ties).collect()} == dict.fromkeys("abce", "a")
    assert tied_blocks(items, ties.limit(0)).count() == 0


def test_a_minute_of_100_000_anonymous_events(spark):
    made = spark.range(100_000).select(
        F.format_string("e%06d", "id").alias("id"), (F.col("id") * 0.6).cast("bigint").alias("start_ms"), (F.col("id") * 0.6).cast("bigint").alias("end_ms"), F.lit(None).cast("string").alias("user"), F.lit(None).cast("string").alias("session"),
        F.lit(None).cast("string").alias("meta_user"), F.array().cast("array<string>").alias("entities"), F.array(F.lit("c")).alias("components"), (F.col("id") % 2 == 0).alias("request"), F.col("id").cast("string").alias("group_key"), F.lit("a").alias("action_types"), F.lit("success").alias("outcome"), F.lit(False).alias("escalates"),
    )
    items = cut_lineage(made)
    got = folds.first_fit(items, event_ties(items), folds.Chain, items.columns).groupBy("chain").count().collect()
    # the first is of a request and takes nothing without one; the second takes all that follow
    assert sorted(r["count"] for r in got) == [1, 99_999]


STORY = "id string, start_ms bigint, end_ms bigint, actors array<string>, services array<string>, families array<string>, pool boolean, related boolean, outcome string, severity string"


def test_merged_stories_equal_a_sequential_pass(spark):
    rank = {"info": 0, "warning": 1, "critical": 2}

    class Told(dict):
        pass

    def belongs(state, s):
        gap = s["start_ms"] - state["end_ms"]
        both = lambda k: bool(set(state[k]) & set(s[k]))
        nobody = not state["actors"] and not s["actors"]
        if 0 <= gap <= 900_000 and ((state["pool"] and s["related"]) or (s["pool"] and state["related"]) or (state["pool"] and s["pool"])):
            return True
        if 0 <= gap <= 120_000 and both("families"):
            return True
        if (s["start_ms"] >= state["start_ms"] and s["end_ms"] <= state["end_ms"]) or (state["start_ms"] >= s["start_ms"] and state["end_ms"] <= s["end_ms"]):
            return both("actors") or (nobody and both("services"))
        if s["start_ms"] <= state["end_ms"] and s["end_ms"] >= state["start_ms"]:
            return both("actors")
        if gap > 120_000:
            return False
        return both("actors") or (nobody and gap <= 30_000 and both("services"))

    for seed in range(2):
        rng = random.Random(seed)
        made, now = [], 0
        for k in range(600):
            now += rng.choice((0, 1000, 20_000, 31_000, 100_000, 130_000, 500_000, 950_000))
            some = lambda kind, most, share: sorted({f"{kind}{rng.randrange(most)}" for _ in range(2)}) if rng.random() < share else []
            made.append({"id": f"s{k:04d}", "start_ms": now, "end_ms": now + rng.choice((0, 5000, 200_000, 2_000_000)), "actors": some("u", 9, 0.4), "services": some("v", 5, 0.5), "families": some("f", 3, 0.15), "pool": rng.random() < 0.04, "related": rng.random() < 0.05, "outcome": rng.choice(("success", "failure", "partial", "unknown")), "severity": rng.choice(tuple(rank))})
        expected, used = {}, set()
        for i, s in enumerate(made):
            if s["id"] in used:
                continue
            state, members = {**s, "actors": list(s["actors"]), "services": list(s["services"]), "families": list(s["families"])}, [s["id"]]
            for other in made[i + 1 :]:
                if other["id"] in used or not belongs(state, other):
                    continue
                used.add(other["id"])
                members.append(other["id"])
                for k in ("actors", "services", "families"):
                    state[k] = state[k] + other[k]
                state["pool"], state["related"] = state["pool"] or other["pool"], state["related"] or other["related"]
                state["end_ms"] = max(state["end_ms"], other["end_ms"])
                a, b = state["outcome"], other["outcome"]
                state["outcome"] = a if a == b else "partial" if {a, b} == {"success", "failure"} or "partial" in (a, b) else a
                state["severity"] = max(state["severity"], other["severity"], key=rank.get)
            expected[s["id"]] = (members, state["outcome"], state["severity"])
        assert any(len(m) > 4 for m, _, _ in expected.values())
        names = [c.split()[0] for c in STORY.split(", ")]
        items = cut_lineage(spark.createDataFrame([tuple(e[c] for c in names) for e in made], STORY))
        ties = causal.tied_by(items, actor=(F.col("actors"), 120_000), service=(F.when(F.size("actors") == 0, F.col("services")), 120_000), family=(F.col("families"), 120_000), incident=(F.array(F.when(F.col("pool") | F.col("related"), F.lit("any"))), 900_000))
        found = {}
        for r in sorted(folds.first_fit(items, ties, folds.Merged, items.columns).collect(), key=lambda r: r.place):
            found.setdefault(r.chain, ([], None, None))
            found[r.chain] = (found[r.chain][0] + [r.id], r.outcome, r.severity)
        lone = {s["id"]: ([s["id"]], s["outcome"], s["severity"]) for s in made if s["id"] not in {i for m, _, _ in found.values() for i in m}}
        assert found | lone == expected


def log(spark, rows):
    session_defaults(spark)
    e = spark.createDataFrame(rows, "seq bigint, ms bigint, level string, message string, user_id string, group_key string")
    keys = e.select("seq", "group_key")
    return as_entries(e.withColumn("ts", F.timestamp_millis("ms")).drop("ms")).join(keys, "seq")


def test_success_and_a_later_failure_are_a_partial_success(spark):
    """Two chains of one user, too far apart to follow from one another and close enough to be one story."""
    rows = [
        (1, 0, "info", "request to billing 200 success", "u1", "requestId:a"), (2, 200_000, "info", "upload completed success", "u1", "requestId:a"),
        (3, 100_000, "info", "step of another", "u2", "requestId:c"), (4, 202_000, "error", "login failed: token expired", "u1", "requestId:b"), (5, 205_000, "error", "payment timeout provider=stripe", "u1", "requestId:b"),
    ]
    chained = cut_lineage(events.build_events(log(spark, rows)).withColumn("chain_id", F.col("group_key")))
    stories = cut_lineage(causal.build_stories(chained))
    merged = {r.story_id: r for r in causal.merge_stories(chained, stories).collect()}
    alone = {r.story_id: r for r in stories.collect()}
    one = merged["requestId:a"]
    assert set(merged) == {"requestId:a", "requestId:c"} and (alone["requestId:a"].outcome, alone["requestId:b"].outcome) == ("success", "failure")
    assert one.outcome == "partial" and one.severity == alone["requestId:b"].severity and one.root_cause == alone["requestId:b"].root_cause
    assert (one.start_ms, one.end_ms, one.n_events, one.relation) == (0, 205_000, 2, "temporal_cause") and [n.outcome for n in one.causal_nodes] == ["success", "failure"]
    assert merged["requestId:c"] == alone["requestId:c"]
