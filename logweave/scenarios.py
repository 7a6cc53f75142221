"""Small logs made from the ``events`` table for the registered queries, each told in both SQL dialects.

``SCENARIOS`` are short stories with all that must be told of them: every row of ``events`` becomes the story of its number.
``FLOWS`` places rows close to one another in time, with users, sessions, entities and components, so that they follow from one
another.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.schema import as_entries

CIRCUIT = "Consider implementing a circuit breaker pattern and checking upstream service health"
CREDENTIALS = "Verify credentials and access policies; check for expired tokens"
LATE = "Increased latency — downstream consumers may be affected"


@dataclass(frozen=True)
class Scenario:
    """Entries (level, message, metadata), and the texts of their story; ``{A}`` is the actor, ``{u}`` the user."""

    entries: tuple[tuple, ...]
    title: str
    outcome: str
    narrative: str
    severity: str = "info"
    source: str = "template"
    cause: str | None = None
    impact: str | None = None
    advice: str | None = None
    component: str | None = None
    anonymous: bool = False
    services: tuple[str, ...] = ()
    retried: bool = False
    more: dict = field(default_factory=dict)


def _s(*entries, **told) -> Scenario:
    return Scenario(tuple((e + ({},))[:3] for e in entries), **told)


SCENARIOS = (
    _s(("info", "checkout started"), ("info", "payment success provider=stripe amount=20 order_id=77"), title="Successful Checkout", outcome="success", narrative="{A} completed checkout ($20) successfully via stripe. Order 77 was created."),
    _s(("info", "checkout started total=55"), ("error", "payment failed provider=paypal timeout"), title="Failed Checkout – Paypal Timeout", outcome="failure", severity="warning", narrative="{A} attempted to checkout ($55), but payment via paypal failed.",
       cause="Paypal timeout — not responding within SLA", impact="Failed transaction for user {u} — potential revenue loss and user frustration", advice=CIRCUIT),
    _s(("error", "payment declined amount: 12.50"), ("info", "support ticket opened"), anonymous=True, title="Failed Checkout", outcome="failure", severity="warning",
       narrative="{A} attempted to checkout ($12.50), but payment via the payment service failed. A support ticket was created as a result.", cause="payment declined amount: 12.50", impact="Customer escalation triggered — support team notified"),
    _s(("info", "login success"), ("info", "GET /products returned 12 products 200"), title="Successful Login & Product Browse", outcome="success", narrative="{A} successfully logged in and browsed products.", services=("/products",)),
    _s(("warn", "login attempt"), ("error", "authentication failed 401 invalid credentials"), title="Authentication Failure – Unauthorized", outcome="failure", severity="warning", narrative="{A} failed to authenticate — invalid credentials.",
       cause="authentication failed 401 invalid credentials", advice=CREDENTIALS),
    _s(("error", "auth check GET /admin 403 forbidden token=abc"), title="Authentication Failure – Unauthorized", outcome="failure", severity="warning", narrative="{A} was denied access to /admin — insufficient permissions.",
       cause="auth check GET /admin 403 forbidden token=abc", advice=CREDENTIALS, services=("/admin",)),
    _s(("warn", "login 401 unauthorized"), ("info", "login retry 200 success"), title="Login with Issues – Unauthorized", outcome="partial", severity="warning", narrative="{A} initially failed authentication (401) then successfully logged in after retry.", advice=CREDENTIALS),
    _s(("info", "signup completed email=a@b.c"), title="Successful Signup", outcome="success", narrative="A new user (a@b.c) signed up successfully."),
    _s(("error", "signup failed email=x@y.z"), title="Failed Signup", outcome="failure", severity="warning", narrative="A new user signup attempt (x@y.z) failed.", cause="signup failed email=x@y.z"),
    _s(("info", "deploying v1.2.3"), ("info", "rolling update to v1.3.0"), ("info", "all nodes active"), title="Deployment", outcome="success", narrative="Rolling deployment from v1.2.3 to v1.3.0. Zero-downtime rolling update. All nodes active."),
    _s(("error", "deploy v2.0.0 rollback"), title="Deployment – Failed", outcome="failure", severity="warning", narrative="Deployment failed. Target version: v2.0.0.", cause="deploy v2.0.0 rollback"),
    _s(("info", "cache miss"), ("info", "fetch items: 42 latency=35ms"), title="Operation Completed", outcome="success", narrative="{A} fetched data (cache miss, fell back to database). 42 results returned. response time: 35ms."),
    _s(("warn", "memory usage at 91%"), anonymous=True, title="Memory Pressure", outcome="success", narrative="High memory usage detected at 91%. This may indicate a memory leak or traffic spike."),
    _s(("error", "connection pool exhausted"), title="Connection Pool Issue – Failed – Connection Pool Exhausted", outcome="failure", severity="warning", narrative="Database connection pool exhausted. New connections are being rejected.",
       cause="Database connection pool exhausted — a long-running query may be holding connections", impact="Service degradation — new requests may be rejected", advice="Review connection pool sizing and implement connection recycling"),
    _s(("info", "server started on port 8080"), title="Service Start", outcome="success", narrative="Server started on port 8080."),
    _s(("warn", "job retry #2"), ("error", "email job failed smtp down", {"job_id": "j-9"}), title="Notification – Failed", outcome="failure", severity="warning", narrative="Email job 'j-9' failed after 3 attempts. Error: email job failed smtp down", cause="email job failed smtp down"),
    _s(("info", "sync job completed", {"job_id": "j-7", "duration_ms": "1500"}), title="Operation Completed", outcome="success", narrative="Sync job 'j-7' completed successfully in 1.5s."),
    _s(("warn", "retrying upload chunk"), ("info", "chunk stored"), title="Operation Completed", outcome="success", narrative="{A} retried upload chunk and succeeded after 2 attempts."),
    _s(("warn", "retry of export", {"attempt": "2"}), ("error", "disk quota exceeded", {"attempt": "3", "error": "ENOSPC on vol1"}), title="Operation Failed", outcome="failure", severity="warning", narrative="{A} retried of export 3 times but all attempts failed. Final error: ENOSPC on vol1",
       cause="disk quota exceeded", impact="Storage pressure — writes may fail if not addressed", advice="Review retention policies and expand storage capacity"),
    _s(("error", "segmentation error in module x"), title="Operation Failed", outcome="failure", severity="warning", source="generic", narrative="{A} performed an operation that failed. Error: segmentation error in module x", cause="segmentation error in module x"),
    _s(("info", "cleanup-cache done", {"task": "cleanup-cache", "status": "done", "duration_s": "2.5", "removed": "12"}), title="Cleanup", outcome="success", source="generic", narrative="Scheduled task 'cleanup-cache' done in 2.5s. 12 items removed"),
    _s(("info", "heartbeat ok", {"jobs_processed": "10", "errors": "2", "worker_id": "w1"}), title="Worker Heartbeat – Errors Detected", outcome="partial", severity="warning", source="generic", narrative="Worker heartbeat received. Worker w1: 10 jobs processed, errors=2."),
    _s(("info", "nightly index rebuilt fine"), ("warn", "index shard slow now"), component="indexer-main", title="Indexer Main Activity", outcome="success", source="generic", narrative="[indexer-main] index shard slow now nightly index rebuilt fine"),
    _s(("info", "connected to peer node-7"), component="mesh", title="Mesh: Connected", outcome="success", source="generic", narrative="[mesh] connected to peer node-7"),
    _s(("warn", "rate limit hit 429"), title="Rate Limit", outcome="success", source="generic", narrative="{A}: rate limit hit 429"),
    _s(("error", "upstream call gave up", {"error": "connect ECONNREFUSED 10.0.0.9:5432"}), title="Operation Failed", outcome="failure", severity="warning", source="generic", narrative="{A} performed an operation that failed. Error: connect ECONNREFUSED 10.0.0.9:5432",
       cause="Connection refused to 10.0.0.9:5432 — target service is down or not listening"),
    _s(("fatal", "process killed: out of memory heap limit"), title="Memory Pressure – Failed", outcome="failure", severity="warning", source="generic", narrative="{A} performed an operation that failed. Error: process killed: out of memory heap limit",
       cause="Out of memory — process exceeded available memory", advice="Profile memory usage and check for leaks; consider scaling horizontally"),
    _s(("warn", "GET /sync retrying"), ("error", "gave up for good"), title="Failed Request to /sync", outcome="failure", severity="critical", narrative="{A} fetched data.", cause="gave up for good", services=("/sync",), retried=True),
    _s(("warn", "POST /checkout payment timeout provider=stripe"), ("info", "POST /checkout payment success order_id=5 200"), title="Partial Checkout – Stripe Timeout", outcome="partial", severity="warning",
       narrative="{A} checked out after 1 failed payment attempt via stripe. Order 5 was eventually created.", impact=LATE, advice=CIRCUIT, services=("/checkout",)),
    _s(("info", "replication lag rising on replica two"), ("error", "replica resync impossible"), title="Replication Event – Failed", outcome="failure", severity="warning", source="generic", narrative="{A} performed an operation that failed. Error: replica resync impossible",
       cause="replica resync impossible", impact="Read replicas serving stale data", advice="Investigate primary write load and network latency to replicas"),
)
#: Milliseconds between the entries of a story.
STEP = 1000


def _quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def scenario_entries(events: DataFrame) -> DataFrame:
    """Entries of the stories: ``group_key`` is the row's own, times start at that of the row."""
    kinds = []
    for s in SCENARIOS:
        rows = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(level).alias("level"), F.lit(message).alias("message"), F.from_json(F.lit(json.dumps(more)), "map<string,string>").alias("metadata")) for k, (level, message, more) in enumerate(s.entries)])
        kinds.append(F.struct(rows.alias("rows"), F.lit(s.component).cast("string").alias("source"), F.lit(s.anonymous).alias("anonymous")))
    chosen = F.array(*kinds)[(F.col("event_id") % len(SCENARIOS)).cast("int")]
    made = events.select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("base"), chosen.alias("s")).select("event_id", "user_id", "base", "s.source", "s.anonymous", F.explode("s.rows").alias("e"))
    return as_entries(
        made.select(
            (F.col("event_id") * 8 + F.col("e.k")).alias("seq"), F.timestamp_millis(F.col("base") + STEP * F.col("e.k")).alias("ts"), "e.level", "e.message", "e.metadata", "source",
            F.when(~F.col("anonymous"), F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("user_id"), F.concat(F.lit("s-"), F.col("event_id").cast("string")).alias("request_id"),
        )
    )


def scenarios_sql() -> str:
    """DuckDB: ``told`` holds a row a story with all that must be told of it, ``told_entries`` its entries."""
    columns = ("title", "outcome", "narrative", "severity", "source", "cause", "impact", "advice")
    rows = ", ".join(f"({n}, {len(s.entries)}, {s.anonymous}, {s.retried}, {_quoted(','.join(s.services))}, " + ", ".join(_quoted(getattr(s, c)) for c in columns) + ")" for n, s in enumerate(SCENARIOS))
    lines = ", ".join(f"({n}, {k}, {_quoted(level)}, {_quoted(message)})" for n, s in enumerate(SCENARIOS) for k, (level, message, _) in enumerate(s.entries))
    fill = lambda c: f"replace(replace({c}, '{{A}}', CASE WHEN anonymous THEN 'The system' ELSE 'User u' || user_id END), '{{u}}', 'u' || user_id)"
    return f"""kinds(n, n_entries, anonymous, retried, services, {', '.join(columns)}) AS (VALUES {rows}), kind_entries(n, k, level, message) AS (VALUES {lines}),
told AS (SELECT event_id, 'requestId:s-' || event_id AS group_key, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + {STEP} * (n_entries - 1) AS end_ms, n, n_entries, retried, services, title, outcome, severity, {fill('narrative')} AS narrative,
  source AS narrative_source, cause AS root_cause, {fill('impact')} AS impact, advice AS recommendation, CASE WHEN NOT anonymous THEN 'u' || user_id END AS user_id FROM events JOIN kinds ON n = event_id % {len(SCENARIOS)}),
told_entries AS (SELECT event_id, t.group_key, event_id * 8 + k AS seq, t.start_ms + {STEP} * k AS ms, k, level, message FROM told t JOIN kind_entries USING (n))"""


# --- rows that follow from one another; the texts are SQL of both dialects, over the table ``events``

CLUSTER = "CAST(floor(event_id / 4) AS BIGINT)"
#: Milliseconds between the starts of two fours of rows: beyond all that ties events; and beyond all that ties stories.
APART, FAR_APART = 400_000, 4_000_000


def flow_start(apart: int) -> str:
    return f"({CLUSTER} * {apart} + (event_id % 4) * 20000)"


def flow_end(apart: int) -> str:
    """Every fourth row lasts 50 s, so that the next two start inside of it."""
    return f"({flow_start(apart)} + CASE WHEN event_id % 4 = 0 THEN 50000 ELSE 1000 END)"


FLOW_KIND = "CASE WHEN event_id % 11 = 0 THEN 'pool' WHEN event_id % 11 = 5 THEN 'slow' WHEN event_id % 6 = 0 THEN 'pay' WHEN event_id % 6 = 1 THEN 'ticket' WHEN event_id % 13 = 4 THEN 'scale' ELSE 'get' END"
FLOW_MESSAGE = "CASE kind WHEN 'pool' THEN 'connection pool exhausted' WHEN 'slow' THEN 'p99 latency rising' WHEN 'pay' THEN 'POST /pay timeout' WHEN 'ticket' THEN 'support ticket opened' WHEN 'scale' THEN 'scaling out instance 4' ELSE 'GET /items 200' END"
FLOW_LEVEL = "CASE WHEN kind IN ('pay', 'pool') THEN 'error' ELSE 'info' END"
FLOW_REQUEST = "event_id % 5 = 0"


def flow_columns(text: str) -> dict[str, str]:
    """Columns of a flow's rows in a dialect; ``text`` is its type of strings."""
    say = lambda name, number: f"'{name}' || CAST({number} AS {text})"
    return {
        "user_id": f"CASE WHEN event_id % 3 = 0 THEN {say('u', CLUSTER + ' % 5')} END", "session_id": f"CASE WHEN event_id % 7 IN (1, 2) THEN {say('s', CLUSTER + ' % 40')} END",
        "order_id": f"CASE WHEN event_id % 3 = 1 OR event_id % 8 = 0 THEN {say('A', CLUSTER + ' % 50')} END", "meta_user": f"CASE WHEN event_id % 7 IN (3, 4) THEN {say('m', CLUSTER + ' % 9')} END",
        "component": f"CASE WHEN event_id % 4 <> 3 THEN {say('c', 'event_id % 2')} END", "group_key": f"CASE WHEN {FLOW_REQUEST} THEN {say('requestId:r', 'event_id')} ELSE {say('time:', 'event_id')} END",
    }


def flow_entries(events: DataFrame, apart: int = APART) -> DataFrame:
    """Entries of the flows with the group keys that they are given: one at the start, and one at the end of the events that last."""
    given = {k: F.expr(v) for k, v in flow_columns("string").items()}
    rows = events.select("event_id", F.expr(flow_start(apart)).alias("start"), F.expr(flow_end(apart)).alias("finish"), F.expr(FLOW_KIND).alias("kind")).withColumns(given).withColumn("message", F.expr(FLOW_MESSAGE)).withColumn("level", F.expr(FLOW_LEVEL))
    named = F.map_filter(F.create_map(F.lit("orderId"), F.col("order_id"), F.lit("userId"), F.col("meta_user")), lambda _, v: v.isNotNull())
    placed = rows.withColumn("metadata", named).select("*", F.explode(F.when(F.col("event_id") % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("k"))
    made = placed.select((F.col("event_id") * 2 + F.col("k")).alias("seq"), F.timestamp_millis(F.when(F.col("k") == 0, F.col("start")).otherwise(F.col("finish"))).alias("ts"), "level", "message", "metadata", F.col("component").alias("source"), "user_id", "session_id", "group_key")
    return as_entries(made).join(made.select("seq", "group_key"), "seq")


def flows_sql(apart: int = APART) -> str:
    """DuckDB: ``flow`` holds a row an event."""
    given = ", ".join(f"{v} AS {k}" for k, v in flow_columns("VARCHAR").items())
    return f"""flow0 AS (SELECT event_id, {flow_start(apart)} AS start_ms, CASE WHEN event_id % 4 = 0 THEN {flow_end(apart)} ELSE {flow_start(apart)} END AS end_ms, CASE WHEN event_id % 4 = 0 THEN 2 ELSE 1 END AS n_entries, {FLOW_KIND} AS kind, {given} FROM events),
flow AS (SELECT *, {FLOW_REQUEST} AS request, kind IN ('pay', 'pool') AS failed, CASE WHEN kind IN ('pay', 'get') THEN 'p' || n_entries ELSE '' END AS acts, kind = 'ticket' AS escalates, kind = 'pool' AS pool, kind IN ('slow', 'scale') AS related, kind = 'scale' AS scales,
  CASE kind WHEN 'pay' THEN '/pay' WHEN 'get' THEN '/items' END AS service FROM flow0)"""
