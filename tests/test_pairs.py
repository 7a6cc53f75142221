"""Pairs of similar entries against all pairs."""

import random

from pyspark.sql import functions as F

from logweave.operators import group
from logweave.operators.schema import as_entries
from logweave.plans.analyzer import session_defaults


def entries(spark, rows):
    session_defaults(spark)
    return as_entries(spark.createDataFrame(rows, "seq bigint, ms bigint, level string, message string").withColumn("ts", F.timestamp_millis("ms")).drop("ms"))


def test_pairs_are_those_of_all_pairs(spark, monkeypatch):
    messages = {"retry upload": {"retry", "upload"}, "upload": {"upload"}, "retry": {"retry"}, "start stop queue": {"start", "stop", "queue"}, "quiet": set(), None: None}
    rng = random.Random(3)
    # some exactly a horizon apart, before the epoch too, in no order of time
    rows = [(seq, rng.randrange(-20, 20) * 50_000 + rng.choice((0, 0, 1, 777)), rng.choice(("info", "warn")), rng.choice(list(messages))) for seq in range(260)]
    words = {r[0]: messages[r[3]] if messages[r[3]] is None else messages[r[3]] | {f"level:{r[2]}"} for r in rows}
    alike = lambda a, b: len(a & b) / len(a | b) if a is not None and b is not None else 0
    expected = {(a[0], b[0], alike(words[a[0]], words[b[0]])) for a in rows for b in rows if a[0] < b[0] and abs(a[1] - b[1]) <= 300_000 and alike(words[a[0]], words[b[0]]) >= 0.4}
    for bunch in (3, 4096):
        monkeypatch.setattr(group, "BUNCH", bunch)
        got = [tuple(r) for r in group.similar_pairs(entries(spark, rows)).collect()]
        assert set(got) == expected and len(got) == len(expected)


def test_vectors_and_not_entries_meet(spark):
    """400 lines of two vectors that are not alike: their 79,800 pairs in time are not compared one by one."""
    rows = [(k, k * 100, "info" if k % 2 else "warn", "upload" if k % 2 else "queue start") for k in range(400)]
    pairs = group.similar_pairs(entries(spark, rows))
    assert len(pairs.collect()) == 2 * 200 * 199 // 2
    nodes, met = [pairs._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(k) for k in range(node.children().size())]
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            nodes.append(node.plan())
        elif "Join" in name:
            met = max(met, node.metrics().get("numOutputRows").get().value())
    assert 0 < met <= 100
