"""Grouping, events, stories and reports on small logs."""

import json
import random

from pyspark.sql import functions as F

from logweave.operators import causal, events, group, insights, redact
from logweave.operators.schema import as_entries
from logweave.plans import providers, render
from logweave.plans.analyzer import Analyzer, session_defaults
from logweave.plans.graph import connected_components


def entries(spark, rows):
    session_defaults(spark)
    schema = "seq bigint, ms bigint, level string, message string, user_id string, request_id string, metadata map<string,string>"
    return as_entries(spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_millis("ms")).drop("ms"))


def test_components(spark):
    edges = spark.createDataFrame([("d", "c"), ("c", "b"), ("b", "a"), ("y", "x")], "a string, b string")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}


def test_priority_merge_and_gap(spark):
    e = entries(spark, [(1, 0, "info", "a", "v1", None, {}), (2, 1000, "info", "b", None, "v1", {}), (3, 400_000, "info", "c", None, "v1", {}), (4, 0, "info", "d", None, None, {})])
    fields = ("requestId", "userId")
    keyed = group.split_by_gap(group.merge_same_value(group.assign_keys(e, fields), fields))
    assert {r.seq: r.group_key for r in keyed.collect()} == {1: "requestId:v1:0", 2: "requestId:v1:0", 3: "requestId:v1:1", 4: None}


def test_absorption_prefers_the_users_group(spark):
    keyed = group.assign_keys(entries(spark, [(1, 0, "info", "a", "u1", None, {}), (2, 1000, "info", "b", "u2", None, {})]), ("userId",))
    loose = entries(spark, [(9, 2000, "info", "c", "u2", None, {}), (10, 900_000, "info", "far", "u2", None, {})])
    got = group.absorb_scores(loose, group.group_bounds(keyed), keyed).collect()
    assert [(r.seq, r.group_key, r.score) for r in got] == [(9, "userId:u2", 15)]


def test_content_clusters_chain_equal_lines(spark):
    e = entries(spark, [(k, k * 1000, "warn", "retry upload", None, None, {}) for k in range(50)] + [(99, 10_000_000, "info", "unlike", None, None, {})])
    got = group.content_clusters(e).collect()
    assert {r.cluster for r in got} == {0} and len(got) == 50


LOG = "\n".join(
    [
        '{"level":"info","message":"POST /checkout started","timestamp":"2024-05-01T10:00:00Z","userId":"u1","requestId":"r1"}',
        '{"level":"error","message":"payment timeout provider=stripe","timestamp":"2024-05-01T10:00:02Z","userId":"u1","requestId":"r1"}',
        '{"level":"info","message":"request to payment retry attempt 2","timestamp":"2024-05-01T10:00:04Z","userId":"u1","requestId":"r1"}',
        '{"level":"error","message":"payment timeout provider=stripe","timestamp":"2024-05-01T10:00:06Z","userId":"u1","requestId":"r1"}',
        '{"level":"info","message":"login success","timestamp":"2024-05-01T12:00:00Z","userId":"u2","requestId":"r2"}',
    ]
)


def test_whole_analysis_and_reports(spark):
    analyzer = Analyzer(spark)
    result = analyzer.analyze(LOG)
    told = {s.title: s for s in result.stories.collect()}
    failed = told["Failed Checkout – Stripe Timeout"]
    assert failed.outcome == "failure" and failed.severity == "critical" and failed.actors == ["u1"]
    assert failed.root_cause == "Stripe timeout — not responding within SLA"
    assert "circuit breaker" in failed.recommendation and failed.narrative.startswith("User u1 attempted to checkout")
    assert told["Successful Login Flow"].narrative == "User u2 successfully logged in."
    stats = result.stats.first()
    assert (stats.total_entries, stats.errors_detected, stats.stories_generated) == (5, 2, 2)
    report = json.loads(analyzer.format(result, "json"))
    assert {"stories", "insights", "summary", "stats"} <= set(report)
    assert "Retry logic not resolving failures" in [i["title"] for i in report["insights"]]
    assert "2 distinct operations detected." in analyzer.format(result)
    assert "└─ payment timeout" in analyzer.format(result, "timeline")
    assert analyzer.query("what failed?", result).startswith("Found 1 failure(s)")
    assert "Slowest" in analyzer.query("what was slow?", result)


def test_burst_windows_are_anchored_at_their_first(spark):
    times = [0, 200_000, 310_000, 500_000, 5_000_000]
    s = spark.createDataFrame([(f"s{k}", t, "failure") for k, t in enumerate(times)], "story_id string, start_ms bigint, outcome string")
    got = {r.story_id: r.window_start_ms for r in insights.burst_windows(s).collect()}
    assert got == {"s0": 0, "s1": 0, "s2": 310_000, "s3": 310_000, "s4": 5_000_000}


def test_burst_windows_equal_the_fold(spark):
    """A long run without a pause, so that anchors are found by jumps; and what the insights are about."""
    rng = random.Random(3)
    now, times = 0, []
    for _ in range(700):
        now += rng.choice((0, 1, 40_000, 150_000, 299_999, 300_000)) if rng.random() < 0.99 else 900_000
        times.append(now)
    rows = [(f"s{k:04d}", t, t + 10, "failure" if k % 5 else "partial", f"title {k % 7}", ["e" + str(k)]) for k, t in enumerate(times)]
    s = spark.createDataFrame(rows, "story_id string, start_ms bigint, end_ms bigint, outcome string, title string, event_ids array<string>").repartition(3)
    anchor, expected = None, {}
    for r in rows:
        anchor = r[1] if anchor is None or r[1] - anchor > 300_000 else anchor
        expected[r[0]] = anchor
    assert {r.story_id: r.window_start_ms for r in insights.burst_windows(s).collect()} == expected
    bursts = [a for a in set(expected.values()) if list(expected.values()).count(a) > 1]
    told = insights.cascading_failures(s).first()
    inside = sorted(k for k, a in expected.items() if a in bursts)
    assert told.occurrences == len(inside) and f"across {len(bursts)} burst(s)" in told.description and told.description.count("title ") == 5
    more = s.withColumns({"root_cause": F.lit(None).cast("string"), "retried": F.lit(False), "entries": F.array(F.struct(F.lit("plain").alias("message")))})
    about = insights.insight_events(more).filter("title = 'Cascading failures detected'")
    assert sorted(r.story_id for r in about.collect()) == inside


def test_user_chains_use_the_reach_of_all_before(spark):
    e = spark.createDataFrame([("a", "u", 0, 500_000), ("b", "u", 1000, 2000), ("c", "u", 600_000, 600_000), ("d", "u", 900_000, 900_000)], "group_key string, user_id string, start_ms bigint, end_ms bigint")
    assert {r.group_key: r.chain_no for r in causal.user_chains(e).collect()} == {"a": 0, "b": 0, "c": 0, "d": 1}


def test_long_events_meet_short_ones_near_their_start(spark):
    hour = 3_600_000
    # two of nobody in one component, two with an entity of which one has a user, two of one user; all 30 s after a start of two hours
    rows, keys = [], {}
    for k, (long_user, short_user, meta) in enumerate([(None, None, {"component": "disk"}), ("u7", None, {"orderId": "ord-12345"}), ("u8", "u8", {})]):
        for name, ms, user in (("long", 0, long_user), ("long", 2 * hour, long_user), ("short", 30_000, short_user), ("short", 31_000, short_user)):
            keys[len(rows)] = f"{name}{k}"
            rows.append((len(rows), (1000 + 10 * k) * hour + ms, "info", f"step {k}", user, None, meta))
    keyed = entries(spark, rows).join(spark.createDataFrame(list(keys.items()), "seq bigint, group_key string"), "seq")
    built = events.build_events(keyed)
    names = {r.event_id: r.group_key for r in built.select("event_id", "group_key").collect()}
    assert sorted((names[r.a], names[r.b]) for r in causal.causal_pairs(built).collect()) == [(f"long{k}", f"short{k}") for k in range(3)]


def test_long_stories_meet_short_ones_near_their_start(spark):
    hour = 3_600_000
    rows = [("a0", 0, 5 * hour, ["u"], []), ("a1", 1000, 2000, ["u"], []), ("s0", 0, 5 * hour, [], ["db"]), ("s1", 1000, 2000, [], ["db"]), ("z", 9000 * hour, 9000 * hour, ["u"], ["db"]), ("y0", 0, 20_000 * hour, ["w"], []), ("y1", 7 * hour, 8 * hour, ["w"], [])]
    s = spark.createDataFrame(rows, "story_id string, start_ms bigint, end_ms bigint, actors array<string>, services array<string>")
    s = s.withColumn("entries", F.array(F.struct(F.lit("plain words").alias("message"), F.create_map().cast("map<string,string>").alias("metadata"))))
    assert sorted((r.a, r.b) for r in causal.story_merges(s).collect()) == [("a0", "a1"), ("s0", "s1"), ("y0", "y1")]


def test_redaction(spark):
    texts = ["mail a@b.co ip 1.2.3.4", "Bearer abc.def", "key sk-" + "a" * 24, "card 1234-5678-9012-3456", "ssn 123-45-6789", "2001:0db8:0000:0000:0000:ff00:0042:8329", "éa@b.co"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.r for r in df.select(redact.redact(F.col("t")).alias("r")).collect()]
    assert got == ["mail [EMAIL] ip [IP]", "Bearer [TOKEN]", "key [API_KEY]", "card [CREDIT_CARD]", "ssn [SSN]", "[IP]", "é[EMAIL]"]
    assert df.filter(redact.contains_pii(F.col("t"))).count() == len(texts)


def test_retries_and_helpers():
    calls, pauses = [], []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise ConnectionError
        return "done"

    assert providers.with_retries(flaky, sleep=pauses.append)("p") == "done" and len(pauses) == 2
    assert providers.provider_of_key("sk-x") == "openai" and providers.provider_of_key(None) == "local"
    assert render.format_duration(0) == "< 1ms" and render.format_duration(1500) == "1.5s" and render.wrap("a " * 60)[0] == ("a " * 27 + "a").strip()
