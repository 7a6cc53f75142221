"""Events: per entry the actions it tells of, per group its span, actions, outcome and dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import is_error
from ..functions.text import capture, has, in_order, js

# fixed values: kind of action, its triggers, and its states in order of test
ACTIONS = (
    ("api_call", (r"\b(GET|POST|PUT|DELETE|PATCH)\s+/", r"calling\s+\w+\s*(api|service)", r"request\s+to\s+", r"fetch(ing)?\s+"),
     (("completed", r"\b(200|201|204|success|ok|completed)\b"), ("failed", r"\b(4\d{2}|5\d{2}|fail|error|timeout|refused)\b"), ("retried", r"\b(retry|retrying|attempt\s+\d+)\b"))),
    ("db_operation", (r"\b(query|insert|update|delete|select|find|aggregate)\b", r"\b(database|db|mongo|postgres|mysql|redis)\b"),
     (("completed", r"\b(success|found|inserted|updated|deleted)\b"), ("failed", r"\b(fail|error|timeout|deadlock|lock)\b"))),
    ("authentication", (r"\b(login|logout|auth|token|session|oauth|jwt)\b",),
     (("completed", r"\b(success|granted|valid|authenticated)\b"), ("failed", r"\b(fail|denied|invalid|expired|unauthorized)\b"))),
    ("file_operation", (r"\b(read|write|upload|download|file|stream)\b",),
     (("completed", r"\b(success|written|uploaded|downloaded)\b"), ("failed", r"\b(fail|not found|permission|ENOENT)\b"))),
)
# fixed values: metadata states and message words that tell an outcome
GOOD, BAD, WARNED = ("ok", "success", "done", "complete", "completed"), ("error", "fail", "failed", "timeout", "aborted"), ("warn", "warning")
GOOD_WORDS = r"\b(success|ok|completed|created|loaded|sent|started|healthy|recovered|resolved|done|active|ready|fetched|returned|confirmed|processed)\b"
BAD_WORDS = r"\b(fail|error|timeout|refused|rejected|denied|crash|panic|fatal|exhausted)\b"
ZERO_COUNT = r"\b(?:fail\w*|error\w*|timeout\w*|fatal\w*|crash\w*|panic\w*)\s*[=:]\s*0\b"

ACTION_TYPE = "array<struct<type:string,target:string,status:string,error:string>>"


def action_error(level: Column, message: Column) -> Column:
    return F.when(is_error(level), message).otherwise(F.trim(capture(message, r"(?:error|fail|timeout)[:\s]+(.+)")))


def api_target(message: Column) -> Column:
    return F.coalesce(capture(message, r"(?:GET|POST|PUT|DELETE|PATCH)\s+(/[^\s,]+)"), capture(message, r"(?:calling|request to)\s+([^\s,]+)"))


def actions(message: Column, level: Column) -> Column:
    """Up to four actions of a message, each with the first state whose words occur (else started)."""
    found = []
    for kind, triggers, states in ACTIONS:
        meant = has(message, triggers[0])
        for t in triggers[1:]:
            meant = meant | has(message, t)
        status = F.lit(None).cast("string")
        for name, words in reversed(states):
            status = F.when(has(message, words), name).otherwise(status)
        status = F.coalesce(status, F.lit("started"))
        target = api_target(message) if kind == "api_call" else F.lit(None).cast("string")
        error = F.when(status == "failed", action_error(level, message))
        found.append(F.when(meant, F.struct(F.lit(kind).alias("type"), target.alias("target"), status.alias("status"), error.alias("error"))))
    return F.filter(F.array(*found), lambda a: a.isNotNull()).cast(ACTION_TYPE)


def real_failure(message: Column) -> Column:
    """A failure word outside of zero counts such as ``errors=0``: what is left after those are taken out."""
    return has(F.regexp_replace(message, js(ZERO_COUNT), " "), BAD_WORDS, False)


def with_signals(entries: DataFrame) -> DataFrame:
    """Entries with their actions and the flags that an outcome is decided by."""
    lower = F.lower("message")
    told = F.lower(F.coalesce(F.try_element_at("metadata", F.lit("status")), F.lit("")))
    return entries.withColumn("actions", actions(F.col("message"), F.col("level"))).withColumns(
        {
            "is_error": is_error(F.col("level")), "any_failed": F.exists("actions", lambda a: a["status"] == "failed"), "any_completed": F.exists("actions", lambda a: a["status"] == "completed"),
            "meta_good": told.isin(*GOOD), "meta_bad": told.isin(*BAD), "meta_warned": told.isin(*WARNED), "good_words": has(lower, GOOD_WORDS, False), "bad_words": real_failure(lower),
        }
    )


def outcome() -> Column:
    """Of a group whose flags have been aggregated with ``bool_or``."""
    good = F.col("any_completed") | F.col("meta_good")
    return (
        F.when(F.col("is_error") | F.col("any_failed") | F.col("meta_bad"), F.when(good, "partial").otherwise("failure"))
        .when(F.col("meta_warned"), "partial")
        .when(good, "success")
        .when(F.col("bad_words") & ~F.col("good_words"), "failure")
        .otherwise("success")
    )


FLAGS = ("is_error", "any_failed", "any_completed", "meta_good", "meta_bad", "meta_warned", "good_words", "bad_words")


def group_type(key: Column) -> Column:
    return F.when(key.rlike("^(traceId|requestId|jobId)"), "request").when(key.startswith("userId"), "user").when(key.startswith("time:"), "time").otherwise("inferred")


def event_id(key: Column, start_ms: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", key, start_ms.cast("string")), 256), 1, 16)


def build_events(grouped: DataFrame) -> DataFrame:
    """One row per group.

    The entries are gathered in order, as narratives read them, so they are brought together first: what is found in an entry, and what is
    summed up of a group, then goes through no shuffle. Groups are bounded by the gap split that made them.
    """
    order = F.struct("ms", "seq")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), order)).alias(c)
    row = F.struct("ms", "seq", "level", "message", "metadata", F.coalesce("source", F.try_element_at("metadata", F.lit("component")), F.try_element_at("metadata", F.lit("service"))).alias("component"), "job_id", "actions")
    needed = grouped.select("group_key", "ms", "seq", "level", "message", "metadata", "source", "job_id", "user_id", "session_id")
    gathered = with_signals(needed.repartition("group_key")).groupBy("group_key").agg(
        F.min("ms").alias("start_ms"), F.max("ms").alias("end_ms"), F.count("*").alias("n_entries"), F.count_if("is_error").alias("n_errors"), F.min("seq").alias("first_seq"),
        *[F.bool_or(f).alias(f) for f in FLAGS], first("user_id"), first("session_id"), in_order(F.collect_list(row), "ms", "seq").alias("entries"),
    )
    acts = F.flatten(F.transform("entries", lambda e: e["actions"]))
    return (
        gathered.withColumn("actions", acts)
        .withColumns(
            {
                "event_id": event_id(F.col("group_key"), F.col("start_ms")), "group_type": group_type(F.col("group_key")), "duration_ms": F.col("end_ms") - F.col("start_ms"), "outcome": outcome(),
                "dependencies": F.array_distinct(F.filter(F.transform("actions", lambda a: a["target"]), lambda t: t.isNotNull())),
            }
        )
        .drop(*FLAGS)
    )


def event_signature(events: DataFrame) -> DataFrame:
    """``(event_id, signature)``: equal for events with the same actions, outcome, masked errors and about as many entries."""
    acts = F.sort_array(F.transform("actions", lambda a: F.concat_ws(":", a["type"], a["status"])))
    masked = F.sort_array(F.transform(F.filter("entries", lambda e: is_error(e["level"])), lambda e: F.substring(F.regexp_replace(e["message"], r"\d+", "N"), 1, 80)))
    size = (F.ceil(F.col("n_entries") / 3) * 3).cast("string")
    return events.select("event_id", F.substring(F.sha2(F.concat_ws("|", F.array_join(acts, ","), "outcome", F.array_join(masked, ","), size), 256), 1, 16).alias("signature"))
