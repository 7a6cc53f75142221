"""Titles, narratives, root causes, impact and advice of stories, as Columns over a story's ordered entries and actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import is_error
from ..functions.text import any_has, capitalize, capture, duration, first_capture, has, truncated

# fixed values: what tells of a checkout
CHECKOUT = r"checkout|payment.?(attempt|success|fail|timeout|declined)|order.?(completed|placed|created|confirmed)"
# fixed values: subjects of a title, in order of test over all messages
SUBJECTS = (
    (r"\b(deploy(?:ment|ing)?)\b.*?\b(v[\d.]+|complete|initiated|rollback)", "Deployment"),
    (r"\b(backup|pg_dump|dump)\b", "Database Backup"),
    (r"\b(scal(?:ing|e))\s*(out|in|up|down)\b", "Autoscaling"),
    (r"\b(autoscale|scaling policy)\b", "Autoscaling"),
    (r"\b(migration)\b", "Database Migration"),
    (r"\b(replication|replica|standby)\b", "Replication Event"),
    (r"\b(cleanup|prune|expired.*removed|removed.*expired)", "Cleanup"),
    (r"\b(worker\s*heartbeat|heartbeat\s*ok|jobs_processed)\b", "Worker Heartbeat"),
    (r"\b(health.?check)\b", "Health Check"),
    (r"\b(heartbeat)\b", "Worker Heartbeat"),
    (r"\b(rate.?limit|throttl)", "Rate Limit"),
    (r"\b(metrics|aggregat)", "Metrics Collection"),
    (r"\b(start(?:ed|ing)?)\b.*\b(server|service|worker|process)\b", "Service Start"),
    (r"\bserver\b.*\b(start|listen)", "Service Start"),
    (r"\b(stop|shutdown|graceful)", "Service Stop"),
    (r"\b(connection.?pool|pool.?exhaust)", "Connection Pool Issue"),
    (r"\b(memory|oom|heap)\b.*\b(usage|limit|exceeded|pressure)", "Memory Pressure"),
    (r"\b(running scheduled|cron|@reboot)", "Scheduled Task"),
    (r"\b(notification|email|sms|alert).*(sent|dispatch|deliver|failed)", "Notification"),
    (r"\b(report|summary).*(generat|dispatch|ready)", "Report Generation"),
    (r"\b(product|catalog|inventory)\b", "Data Retrieval"),
    (r"\bdashboard\b", "Dashboard Load"),
)
# fixed values: what a component did, by its first message; the last entry tells whether the verb is bad news
VERBS = (
    (r"\bstarted\b", "Started", False), (r"\bstopped?\b", "Stopped", False), (r"\bcompleted?\b", "Completed", False), (r"\bfailed\b", "Failed", True),
    (r"\bconnect", "Connected", False), (r"\binitialized?\b", "Initialized", False), (r"\btimeout\b", "Timed Out", True), (r"\bretry", "Retried", False),
)
# fixed values: advice and impact by what the messages mention, in order of test
ADVICE = (
    ("timeout", "Consider implementing a circuit breaker pattern and checking upstream service health"),
    ("connection.?pool|pool.?exhaust", "Review connection pool sizing and implement connection recycling"),
    ("memory|oom|heap", "Profile memory usage and check for leaks; consider scaling horizontally"),
    ("disk.?space|storage|quota", "Review retention policies and expand storage capacity"),
    ("rate.?limit|throttl|429", "Implement request queuing or negotiate higher rate limits with the upstream service"),
    ("replication|replica.?lag", "Investigate primary write load and network latency to replicas"),
    ("auth|unauthorized|forbidden|403|401", "Verify credentials and access policies; check for expired tokens"),
)
IMPACT = (
    ("ticket|support|escalat", "Customer escalation triggered — support team notified"),
    ("connection.?pool|pool.?exhaust", "Service degradation — new requests may be rejected"),
    (r"5\d{2}|service.?unavailable|503", "Service degradation — requests returning errors to clients"),
    ("timeout", "Increased latency — downstream consumers may be affected"),
    ("disk|storage|quota", "Storage pressure — writes may fail if not addressed"),
    ("replication|replica.?lag", "Read replicas serving stale data"),
)


def meta(entry: Column, name: str) -> Column:
    return F.try_element_at(entry["metadata"], F.lit(name))


# fixed values: here and in the functions below, the patterns, titles and sentences of stories


def failure_detail(texts: Column) -> Column:
    joined = F.array_join(texts, " ")
    provider = first_capture(texts, r"provider[=:\s]+(\w+)")
    return (
        F.when(has(joined, "timeout"), F.when(F.coalesce(provider, F.lit("")) != "", F.concat(F.lit(" – "), capitalize(provider), F.lit(" Timeout"))).otherwise(" – Timeout"))
        .when(has(joined, "connection.?pool.?exhaust"), " – Connection Pool Exhausted")
        .when(has(joined, "rate.?limit"), " – Rate Limited")
        .when(has(joined, "unauthorized|403|401"), " – Unauthorized")
        .when(has(joined, "not.?found|404"), " – Not Found")
        .otherwise("")
    )


def action_verb(message: Column, outcome: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, verb, bad in reversed(VERBS):
        found = has(message, pattern)
        out = F.when(found & (outcome == "partial"), "Recovered").when(found & (outcome != "success"), verb).otherwise(out) if bad else F.when(found, verb).otherwise(out)
    return out


def component_title(name: Column, first_message: Column, outcome: Column) -> Column:
    words = F.split(F.regexp_replace(name, "[-_./]", " "), " ")
    shown = F.trim(F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), " "))
    verb = action_verb(first_message, outcome)
    return F.when(verb.isNotNull(), F.concat_ws(": ", shown, verb)).otherwise(F.concat(shown, F.lit(" Activity")))


def subject(joined: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, name in reversed(SUBJECTS):
        out = F.when(has(joined, pattern), name).otherwise(out)
    return out


def dominant(components: Column) -> Column:
    """The most frequent, the first seen among equals."""
    counted = F.transform(F.array_distinct(components), lambda c: F.struct((-F.size(F.filter(components, lambda x: x == c))).alias("n"), F.array_position(components, c).alias("at"), c.alias("c")))
    return F.array_min(counted)["c"]


def title(entries: Column, actions: Column, outcome: Column, texts: Column, joined: Column) -> Column:
    """``texts`` are the messages in lower case, ``joined`` all of them."""
    detail = failure_detail(texts)
    failed, partial = outcome == "failure", outcome == "partial"
    signup = any_has(texts, "signup|sign.?up|register", False)
    target = F.get(F.filter(F.transform(actions, lambda a: a["target"]), lambda t: t.isNotNull() & (t != "")), F.lit(0))
    own = dominant(F.filter(F.transform(entries, lambda e: e["component"]), lambda c: c.isNotNull() & (c != "")))
    derived = F.coalesce(
        subject(joined), F.when(target.isNotNull(), F.concat(F.when(failed, "Failed Request to ").otherwise("Request to "), target)),
        F.when(own.isNotNull(), component_title(own, F.get(texts, F.lit(0)), outcome)),
    )
    errors = F.exists(entries, lambda e: F.coalesce(F.coalesce(meta(e, "errors"), meta(e, "error_count")).try_cast("double") > 0, F.lit(False)))
    dynamic = (
        F.when((derived == "Worker Heartbeat") & errors, "Worker Heartbeat – Errors Detected")
        .when(failed & ~F.lower(derived).contains("fail"), F.concat(derived, F.lit(" – Failed"), detail))
        .otherwise(derived)
    )
    return (
        F.when(any_has(texts, CHECKOUT), F.when(failed, F.concat(F.lit("Failed Checkout"), detail)).when(partial, F.concat(F.lit("Partial Checkout"), detail)).otherwise("Successful Checkout"))
        .when(any_has(texts, "login|auth|signup|sign.?up", False) & signup, F.when(failed, F.concat(F.lit("Failed Signup"), detail)).otherwise("Successful Signup"))
        .when(
            any_has(texts, "login|auth|signup|sign.?up", False),
            F.when(failed, F.concat(F.lit("Authentication Failure"), detail)).when(partial, F.concat(F.lit("Login with Issues"), detail)).when(any_has(texts, r"\bproducts?\b|catalog|browse", False), "Successful Login & Product Browse").otherwise("Successful Login Flow"),
        )
        .when(any_has(texts, "support|ticket", False), "Support Ticket Created")
        .when(derived.isNotNull(), dynamic)
        .when(failed, F.concat(F.lit("Operation Failed"), detail))
        .when(partial, F.concat(F.lit("Operation Partially Failed"), detail))
        .otherwise("Operation Completed")
    )


def failing_host(text: Column) -> Column:
    return F.coalesce(capture(text, r"(?:connect\s+)?(?:ECONNREFUSED|ECONNRESET|ETIMEDOUT)\s+(\S+)"), capture(text, r"(?:host|address|to)\s+(\S+)"), F.lit("unknown host"))


def cause_of(message: Column, meta_error: Column) -> Column:
    """A readable cause from the first error's message, or from its metadata where that names a connection fault."""
    text = F.when(has(meta_error, r"ECONNREFUSED|ECONNRESET|ETIMEDOUT|pool\s*exhaust|connection.?pool"), meta_error).otherwise(message)
    network = has(text, "ECONNREFUSED|ECONNRESET|ETIMEDOUT")
    named = F.coalesce(capture(text, r"provider[=:\s]+(\w+)"), capture(text, r"(?:service|api|endpoint)[=:\s]+(\S+)"), F.lit("upstream service"))
    host = failing_host(text)
    return (
        F.when(has(text, "timeout") & ~network, F.concat(capitalize(named), F.lit(" timeout — not responding within SLA")))
        .when(has(text, "ECONNREFUSED"), F.concat(F.lit("Connection refused to "), host, F.lit(" — target service is down or not listening")))
        .when(has(text, "ECONNRESET"), F.concat(F.lit("Connection reset by "), host, F.lit(" — target service closed the connection unexpectedly")))
        .when(has(text, "ETIMEDOUT"), F.concat(F.lit("Connection timed out to "), host, F.lit(" — network issue or service overloaded")))
        .when(has(text, r"connection.?pool|pool\s*exhaust") & ~has(text, "provider[=:]"), "Database connection pool exhausted — a long-running query may be holding connections")
        .when(has(text, "out of memory|oom"), "Out of memory — process exceeded available memory")
        .otherwise(text)
    )


def root_cause(entries: Column) -> Column:
    error = F.get(F.filter(entries, lambda e: is_error(e["level"])), F.lit(0))
    warning = F.get(F.filter(entries, lambda e: e["level"] == "warn"), F.lit(0))
    return F.coalesce(F.when(error.isNotNull(), cause_of(error["message"], meta(error, "error"))), warning["message"], F.lit("Unable to determine root cause from available logs"))


def impact(joined: Column, outcome: Column, user: Column) -> Column:
    sale = F.concat(F.lit("Failed transaction"), F.coalesce(F.concat(F.lit(" for user "), user), F.lit("")), F.lit(" — potential revenue loss and user frustration"))
    out = F.when(has(joined, "checkout.?fail|payment.?fail|order.?fail"), sale)
    for pattern, text in IMPACT:
        out = out.when(has(joined, pattern), text)
    return F.when(outcome != "success", out)


def recommendation(joined: Column, outcome: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, text in ADVICE:
        out = out.when(has(joined, pattern), text)
    return F.when(outcome != "success", out)


def _number(column: Column) -> Column:
    return F.coalesce(column.try_cast("double"), F.lit(0.0))


def entry_duration(entries: Column) -> Column:
    """Milliseconds from the first entry that tells a duration."""
    told = F.transform(entries, lambda e: F.coalesce(meta(e, "duration_ms").try_cast("double"), meta(e, "duration_s").try_cast("double") * 1000, meta(e, "elapsed").try_cast("double")))
    return F.get(F.filter(told, lambda d: d.isNotNull()), F.lit(0))


def entry_counts(entries: Column) -> Column:
    """Counts from the first entry that tells any."""
    some = lambda e, *names: F.coalesce(*[F.nullif(meta(e, n), F.lit("")) for n in names])
    of_entry = lambda e: F.concat_ws(
        ", ", F.concat(some(e, "removed", "evicted", "pruned"), F.lit(" items removed")), F.concat(some(e, "freed_mb"), F.lit("MB freed")),
        F.coalesce(F.concat(F.lit("size: "), some(e, "size_mb"), F.lit("MB")), F.concat(F.lit("size: "), some(e, "size_gb"), F.lit("GB"))), F.concat(some(e, "recipients", "emails_queued", "queued"), F.lit(" queued")),
    )
    return F.coalesce(F.get(F.filter(F.transform(entries, of_entry), lambda c: c != ""), F.lit(0)), F.lit(""))


def narrative(entries: Column, actions: Column, outcome: Column, user: Column, texts: Column, joined: Column) -> tuple[Column, Column]:
    """Text and source (template or generic); ``texts`` are the messages, ``joined`` all of them in lower case."""
    first = lambda p, g=1: F.nullif(first_capture(texts, p, g), F.lit(""))
    failed, partial = outcome == "failure", outcome == "partial"
    actor = F.coalesce(F.concat(F.lit("User "), user), F.lit("The system"))
    retries = F.size(F.filter(actions, lambda a: a["status"] == "retried"))
    bad = F.size(F.filter(actions, lambda a: a["status"].isin("failed", "retried")))
    plural = lambda n: F.when(n > 1, "s").otherwise("")
    text = lambda form, *args: F.format_string(form, *[F.coalesce(a, F.lit("")) if not isinstance(a, str) else F.lit(a) for a in args])
    has_error = F.get(F.filter(entries, lambda e: is_error(e["level"])), F.lit(0))
    error_text = F.coalesce(meta(has_error, "error"), has_error["message"])

    provider = F.coalesce(first(r"provider[=:\s]+(\w+)"), F.lit("the payment service"))
    amount = F.coalesce(F.concat(F.lit(" ($"), first(r"(?:amount|total)[=:\s]+([\d.]+)"), F.lit(")")), F.lit(""))
    order = first(r"order[_\s]?id[=:\s]+(\w+)")
    ticket = F.when(any_has(texts, "ticket|support"), " A support ticket was created as a result.").otherwise("")
    checkout = (
        F.when(failed & (retries > 0), F.concat(text("%s attempted to checkout%s. Payment failed %d times via %s due to timeouts.", actor, amount, retries + 1, provider), ticket))
        .when(failed, F.concat(text("%s attempted to checkout%s, but payment via %s failed.", actor, amount, provider), ticket))
        .when(partial & (bad > 0) & order.isNotNull(), text("%s checked out%s after %d failed payment attempt%s via %s. Order %s was eventually created.", actor, amount, bad, plural(bad), provider, order))
        .when(partial & (bad > 0), text("%s attempted to checkout%s. Payment failed %d time%s via %s before succeeding.", actor, amount, bad, plural(bad), provider))
        .when(partial, text("%s completed a checkout%s with partial issues.", actor, amount))
        .otherwise(F.concat(text("%s completed checkout%s successfully via %s.", actor, amount, provider), F.coalesce(F.concat(F.lit(" Order "), order, F.lit(" was created.")), F.lit(""))))
    )
    denied, refused, allowed = has(joined, r"\b403\b"), has(joined, r"\b401\b"), has(joined, r"\b200\b")
    resource = F.coalesce(first(r"(?:GET|POST|PUT|DELETE|PATCH)\s+(/[^\s,]+)"), F.lit("the requested resource"))
    browsed = F.exists(texts, lambda m: has(m, r"\bproducts?\b") & has(m, r"\b(GET|fetch|browse|returned?)\b"))
    auth = (
        F.when(denied, text("%s was denied access to %s — insufficient permissions.", actor, resource))
        .when(refused & allowed, text("%s initially failed authentication (401) then successfully logged in after retry.", actor))
        .when(refused | failed, text("%s failed to authenticate — invalid credentials.", actor))
        .otherwise(F.concat(actor, F.lit(" successfully logged in"), F.when(browsed, " and browsed products").otherwise(""), F.lit(".")))
    )
    email = F.coalesce(F.concat(F.lit(" ("), first(r"email[=:\s]+(\S+)"), F.lit(")")), F.lit(""))
    signup = F.when(failed, F.concat(F.lit("A new user signup attempt"), email, F.lit(" failed."))).otherwise(F.concat(F.lit("A new user"), email, F.lit(" signed up successfully.")))
    versions = F.array_distinct(F.flatten(F.transform(texts, lambda m: F.regexp_extract_all(m, F.lit(r"(?i)(?<![A-Za-z0-9_])(v\d+\.\d+\.\d+)(?![A-Za-z0-9_])"), F.lit(1)))))
    newest, oldest = F.try_element_at(versions, F.lit(-1)), F.try_element_at(versions, F.lit(1))
    deployed = F.when(F.size(versions) >= 2, text("Rolling deployment from %s to %s.", oldest, newest)).when(F.size(versions) == 1, text("Deployed version %s.", oldest)).otherwise("Deployment completed.")
    deployment = F.when(failed, F.concat(F.lit("Deployment failed."), F.coalesce(F.concat(F.lit(" Target version: "), newest, F.lit(".")), F.lit("")))).otherwise(
        F.concat(deployed, F.when(has(joined, "zero.?downtime|rolling|graceful|drain"), " Zero-downtime rolling update.").otherwise(""), F.when(has(joined, "active.*all.*nodes|all.*nodes.*active"), " All nodes active.").otherwise(""))
    )
    fetch = F.concat(
        actor, F.lit(" fetched data"), F.when(any_has(texts, r"cache\s*miss"), " (cache miss, fell back to database)").otherwise(""),
        F.coalesce(F.concat(F.lit(". "), first(r"(?:returned?|found|items?)[=:\s]+(\d+)"), F.lit(" results returned")), F.lit("")), F.coalesce(F.concat(F.lit(". response time: "), first(r"latency[=:\s]+(\d+ms)")), F.lit("")), F.lit("."),
    )
    infra = (
        F.when(joined.contains("memory"), F.concat(F.lit("High memory usage detected"), F.coalesce(F.concat(F.lit(" at "), first(r"(\d+)%"), F.lit("%")), F.lit("")), F.lit(". This may indicate a memory leak or traffic spike.")))
        .when(joined.contains("connection pool") & has(joined, "recovered|restored"), "Connection pool was temporarily exhausted but recovered automatically.")
        .when(joined.contains("connection pool"), "Database connection pool exhausted. New connections are being rejected.")
        .when(joined.contains("server") & joined.contains("start") & ~joined.contains("deploy"), F.concat(F.lit("Server started"), F.coalesce(F.concat(F.lit(" on port "), first(r"port\s+(\d+)")), F.lit("")), F.lit(".")))
        .otherwise(F.concat(F.lit("Infrastructure event detected: "), F.get(texts, F.lit(0))))
    )
    top_attempt = F.coalesce(F.array_max(F.transform(entries, lambda e: _number(meta(e, "attempt")))), F.lit(0.0)).cast("int")
    told_retry = F.coalesce(F.array_max(F.transform(texts, lambda m: _number(F.regexp_extract(m, r"(?i)retry\s*#?(\d+)", 1)))), F.lit(0.0)).cast("int")
    attempts = F.when(top_attempt > 0, top_attempt).when(told_retry > 0, told_retry + 1).otherwise(retries + 1)
    job_id = F.coalesce(F.get(F.filter(F.transform(entries, lambda e: F.coalesce(e["job_id"], meta(e, "job_id"))), lambda j: j.isNotNull()), F.lit(0)), F.lit("unknown"))
    label = capitalize(F.coalesce(F.concat(first(r"\b(email|notification|payment|sync|import|export|cleanup|report)\b"), F.lit(" job")), F.lit("background job")))
    took = F.coalesce(F.concat(F.lit(" in "), duration(F.nullif(entry_duration(entries).cast("bigint"), F.lit(0)))), F.lit(""))
    job = (
        F.when(failed, F.concat(F.when(attempts > 1, text("%s '%s' failed after %d attempts.", label, job_id, attempts)).otherwise(text("%s '%s' failed.", label, job_id)), F.coalesce(F.concat(F.lit(" Error: "), truncated(error_text, 120)), F.lit(""))))
        .when(partial, text("%s '%s' completed with warnings after %d attempt%s.", label, job_id, attempts, plural(attempts)))
        .otherwise(text("%s '%s' completed successfully%s.", label, job_id, took))
    )
    work = F.coalesce(first(r"(?:retry(?:ing)?|retried)\s+(\w[\w\s]*\w)"), first(r"(\w+)\s+(?:failed|timeout|error)"), F.lit("operation"))
    tries = F.when(top_attempt > 0, top_attempt).otherwise(F.greatest(retries + 1, F.size(entries)))
    retry = F.when(failed, F.concat(text("%s retried %s %d times but all attempts failed.", actor, work, tries), F.coalesce(F.concat(F.lit(" Final error: "), truncated(error_text)), F.lit("")))).otherwise(
        text("%s retried %s and succeeded after %d attempt%s.", actor, work, tries, plural(tries))
    )
    retried_entries = F.exists(entries, lambda e: has(e["message"], r"\bretry\b") | (_number(meta(e, "attempt")) > 1))
    plain_failure = F.concat(
        F.when((retries > 0) | retried_entries, text("%s attempted an operation that failed after %d attempts.", actor, F.when(top_attempt > 0, top_attempt).otherwise(F.greatest(retries + 1, F.lit(2))))).otherwise(text("%s performed an operation that failed.", actor)),
        F.coalesce(F.concat(F.lit(" Error: "), error_text), F.lit("")),
    )
    signals = F.size(F.filter(entries, lambda e: has(e["message"], r"\bretry\b|\bretrying\b|\battempt\s*\d+") | (_number(meta(e, "attempt")) > 1)))
    is_signup = has(joined, "signup|sign.?up|register", False)
    flows = (
        (has(joined, CHECKOUT), checkout),
        (has(joined, "login|authenticat|auth.*(?:success|fail|token|credential)", False) & ~is_signup, auth),
        (is_signup, signup),
        (has(joined, r"\b(deploy|deploying|deployment|rolling.?update|release)\b", False) | (has(joined, r"\bv\d+\.\d+\.\d+\b", False) & has(joined, r"\b(started?|active|running|launched)\b", False)), deployment),
        (has(joined, r"\b(GET|fetch|product|dashboard|response.?sent|returned?\s+\d+)\b") & ~has(joined, "checkout|payment|login|auth", False), fetch),
        (has(joined, "server.?start|connection.?pool|memory.?usage|health.?check", False), infra),
        (F.exists(entries, lambda e: F.coalesce(e["job_id"], meta(e, "job_id"), meta(e, "jid")).isNotNull()) | (has(joined, r"\b(job|worker|queue|dispatch|enqueue|dequeue)\b.*\b(start|fail|complete|retry|process)") & ~has(joined, "checkout|payment|deploy", False)), job),
        ((retries >= 1) | ((signals >= 1) & (F.size(entries) >= 2)), retry),
    )
    out, source = F.when(failed, plain_failure).otherwise(generic(entries, outcome, actor)), F.lit("generic")
    for condition, told in reversed(flows):
        out, source = F.when(condition, told).otherwise(out), F.when(condition, "template").otherwise(source)
    return out, source


def generic(entries: Column, outcome: Column, actor: Column) -> Column:
    """From the content: a scheduled task, worker heartbeats, or the most informative messages."""
    ended = ("done", "complete", "completed", "ok", "success", "failed", "error", "timeout")
    task = F.get(F.filter(F.transform(entries, lambda e: F.nullif(meta(e, "task"), F.lit(""))), lambda t: t.isNotNull()), F.lit(0))
    state = F.get(F.filter(F.transform(entries, lambda e: F.lower(meta(e, "status"))), lambda s: s.isin(*ended)), F.lit(0))
    state = F.coalesce(state, F.when(outcome == "failure", "failed").when(outcome == "partial", "completed with warnings").otherwise("completed"))
    ms, counts = F.nullif(entry_duration(entries).cast("bigint"), F.lit(0)), entry_counts(entries)
    took = F.coalesce(F.concat(F.lit(" in "), duration(ms)), F.lit(""))
    scheduled = F.concat(F.lit("Scheduled task '"), task, F.lit("' "), state, took, F.lit("."), F.when(counts != "", F.concat(F.lit(" "), counts)).otherwise(""))

    beats = F.filter(entries, lambda e: meta(e, "jobs_processed").isNotNull())
    errors = lambda e: F.coalesce(meta(e, "errors"), meta(e, "error_count"))
    beat = lambda e: F.concat(F.lit("Worker "), F.coalesce(meta(e, "worker_id"), meta(e, "worker"), F.lit("unknown")), F.lit(": "), meta(e, "jobs_processed"), F.lit(" jobs processed"), F.when(_number(errors(e)) > 0, F.concat(F.lit(", errors="), errors(e))).otherwise(""))
    heartbeat = F.concat(F.lit("Worker heartbeat received. "), F.array_join(F.transform(beats, beat), ". "), F.lit("."))

    weight = lambda e: F.when(is_error(e["level"]), 2).when(e["level"] == "warn", 1).otherwise(0)
    ranked = F.array_sort(F.transform(entries, lambda e, k: F.struct((-weight(e)).alias("w"), (-F.size(F.map_keys(e["metadata"]))).alias("m"), (-F.length(e["message"])).alias("n"), k.alias("k"), e["level"].alias("level"), e["message"].alias("message"))))
    keys = F.transform(F.filter(ranked, lambda r: (r["level"] != "debug") & (F.length(r["message"]) > 10)), lambda r: r["message"])
    parts = F.array_distinct(F.filter(F.transform(entries, lambda e: e["component"]), lambda c: c.isNotNull() & (c != "")))
    shown = F.array_join(F.slice(parts, 1, 3), ", ")
    top = F.try_element_at(keys, F.lit(1))
    few = F.concat(F.lit("["), shown, F.lit("] "), F.coalesce(top, F.lit("Activity detected")), F.when(F.size(keys) > 1, F.concat(F.lit(" "), F.try_element_at(keys, F.lit(-1)))).otherwise(""))
    many = F.concat(actor, F.lit(" triggered activity across "), shown, F.lit(". Started: "), truncated(F.get(entries, F.lit(0))["message"]), F.lit(" Ended: "), truncated(F.try_element_at(entries, F.lit(-1))["message"]))
    warned = F.get(F.filter(entries, lambda e: e["level"] == "warn"), F.lit(0))["message"]
    several = F.concat(actor, F.lit(": "), truncated(top), F.when((outcome == "partial") & warned.isNotNull(), F.concat(F.lit(" Warning: "), truncated(warned))).otherwise(""))
    main = (
        F.when(F.size(parts) > 0, F.when(F.size(keys) <= 3, few).otherwise(many))
        .when(F.size(keys) == 1, F.concat(actor, F.lit(": "), top))
        .when(F.size(keys) > 1, several)
        .otherwise(F.concat(actor, F.lit(" completed an operation successfully.")))
    )
    main = F.concat_ws(" ", main, F.when(ms.isNotNull() & (ms != 0), F.concat(F.lit("Duration: "), duration(ms), F.lit("."))), F.nullif(counts, F.lit("")))
    return F.when(task.isNotNull(), scheduled).when(F.size(beats) > 0, heartbeat).otherwise(main)


def narrate_stories(stories: DataFrame) -> DataFrame:
    """Adds title, narrative, narrative_source, root_cause, impact, recommendation to rows with entries, actions, outcome, first_user.

    The messages are put together in a projection of their own, as every text reads them many times.
    """
    entries, actions, outcome, user = F.col("entries"), F.col("actions"), F.col("outcome"), F.col("first_user")
    texts = stories.withColumn("__texts", F.transform(entries, lambda e: e["message"]))
    texts = texts.withColumns({"__lower": F.transform("__texts", F.lower), "__joined": F.lower(F.array_join("__texts", " "))})
    said, lower, joined = F.col("__texts"), F.col("__lower"), F.col("__joined")
    told, source = narrative(entries, actions, outcome, user, said, joined)
    return texts.withColumns(
        {
            "title": title(entries, actions, outcome, lower, joined), "narrative": told, "narrative_source": source, "root_cause": F.when(outcome == "failure", root_cause(entries)),
            "impact": impact(joined, outcome, user), "recommendation": recommendation(joined, outcome),
        }
    ).drop("__texts", "__lower", "__joined")


# fixed values: what is taken out of texts before they go into a prompt
CONTROL, FILTERED = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "[filtered]"
UNSAFE = (
    r"(?i)ignore\s+(all\s+)?(previous|above|prior)\s+(instructions?|prompts?|rules?)", r"(?i)you\s+are\s+now\s+(a|an)\s+", r"(?i)system\s*:\s*", r"(?i)\[INST\]", r"(?i)<\|im_start\|>", r"(?i)<\|im_end\|>",
)


def prompt_text(text: Column) -> Column:
    """Text made safe for a prompt: control characters and what could pass for instructions go."""
    text = F.regexp_replace(text, CONTROL, "")
    for pattern in UNSAFE:
        text = F.regexp_replace(text, pattern, FILTERED)
    return text


def query_prompt(question: Column, context: Column) -> Column:
    parts = (F.lit("Answer a question about these events of a system's logs.\n"), prompt_text(context), F.lit("\n\nQuestion: "), prompt_text(question), F.lit("\n\nBe concise, name the events that matter, and say so if they do not tell."))
    return F.concat(*parts)


def narrative_prompt(entries: Column) -> Column:
    lines = F.transform(F.slice(entries, 1, 15), lambda e: F.concat(F.lit("["), e["level"], F.lit("] "), prompt_text(e["message"])))
    return F.concat(F.lit("Summarise this activity in two sentences:\n"), F.array_join(lines, "\n"))


def root_cause_prompt(entries: Column) -> Column:
    lines = F.transform(F.filter(entries, lambda e: e["level"].isin("warn", "error", "fatal")), lambda e: F.concat(F.lit("["), e["level"], F.lit("] "), prompt_text(e["message"])))
    return F.concat(F.lit("Name the most likely root cause of these failures:\n"), F.array_join(lines, "\n"))
