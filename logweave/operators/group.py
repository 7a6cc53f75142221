"""Grouping of log entries: priority keys, time gaps, absorption, content clusters, shared entities.

Cuts at pauses put a row a stretch of time in order instead of all rows; the order over a whole log is scanned slab by slab, and what
borders carry over is a row a slab. Clustering and the merge by entities are ordered folds (``folds``) over islands of time and over
components of shared entities. Absorption is set-based: each entry takes its best match once, found slab by slab of time (``absorb``).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has, js, truthy
from ..plans.graph import connected_components, cut_lineage, in_slabs, time_islands
from .absorb import Slabs, best_groups
from .folds import fold_entities, fold_lines

# fixed values: correlation fields in order of priority, with the columns and metadata aliases that hold them
FIELDS: dict[str, tuple[str | None, tuple[str, ...]]] = {
    "sessionId": ("session_id", ("session_id", "sessId")),
    "traceId": ("trace_id", ("trace_id", "spanId")),
    "requestId": ("request_id", ("req_id", "request_id", "correlation_id", "x-request-id", "correlationId")),
    "jobId": ("job_id", ("job_id", "jid", "task_id")),
    "userId": ("user_id", ("user_id", "uid", "actor", "sub", "account_id")),
    "sourceIp": (None, ()),
}
# fixed values: words and shapes of the keyword vector
ACTION_WORDS = r"\b(get|post|put|delete|patch|head|options|select|insert|update|create|drop|login|logout|auth|token|connect|disconnect|timeout|retry|error|fail|success|complete|start|stop|send|receive|upload|download|fetch|cache|queue|publish|subscribe)\b"
SERVICE_NAMES = r"\b([a-z]+-(?:service|api|db|cache|queue|worker|gateway))\b"
HTTP_PATH = r"(?:GET|POST|PUT|DELETE|PATCH)\s+(/[^\s]+)"
ERROR_CODES = r"\b([45]\d{2})\b"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
PREFIXED = r"^[A-Za-z][A-Za-z0-9]*[-_][A-Za-z0-9][-A-Za-z0-9_]*$"
OBJECT_ID = r"^[0-9a-fA-F]{24}$"
# fixed values: metadata fields that never name an entity
NOT_ENTITIES = (
    "message", "msg", "error", "stack", "level", "timestamp", "time", "hostname", "host", "path", "url", "method", "status", "statusCode", "duration_ms", "duration_s",
    "elapsed", "latency", "responseTime", "size_mb", "size_gb", "freed_mb", "used_pct", "port", "reason", "uptime_s", "jobs_processed", "errors", "error_count", "removed",
    "pid", "ppid", "worker_id", "worker", "attempt", "process", "action", "component", "service", "source", "format", "raw", "task",
)


@dataclass(frozen=True)
class Grouping:
    fields: tuple[str, ...] = tuple(FIELDS)
    window_ms: int = 5000
    gap_ms: int = 300_000
    job_gap_ms: int = 900_000
    similarity: float = 0.4
    merge_ms: int = 600_000


# fixed values: presets of the command line
PRESETS = {"request": Grouping(fields=("traceId", "requestId")), "time": Grouping(fields=()), "user": Grouping(fields=("userId",)), "auto": Grouping()}


def field_value(name: str) -> Column:
    column, aliases = FIELDS[name]
    values = ([truthy(F.col(column))] if column else []) + [truthy(F.try_element_at("metadata", F.lit(a))) for a in aliases]
    return F.coalesce(*values) if values else F.lit(None).cast("string")


def assign_keys(entries: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``id_field`` (its place in the priority), ``id_value``, ``group_key``; null where an entry has none of the fields."""
    value, place, name = F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("string")
    for k, f in reversed(list(enumerate(fields))):
        own = field_value(f)
        value, place, name = F.coalesce(own, value), F.when(own.isNotNull(), k).otherwise(place), F.when(own.isNotNull(), f).otherwise(name)
    return entries.withColumns({"id_value": value, "id_field": place, "group_key": F.when(value.isNotNull(), F.concat_ws(":", name, value))})


def merge_same_value(keyed: DataFrame, fields: tuple[str, ...], settle: Callable = lambda df: df) -> DataFrame:
    """Groups of one value under several fields become one, under the field of highest priority.

    Only values under several fields are joined; where ``settle`` writes them first, Spark knows how few they are and leaves the entries in place.
    """
    span = keyed.filter("id_value is not null").groupBy("id_value").agg(F.min("id_field").alias("__first"), F.max("id_field").alias("__last"))
    several = settle(span.filter("__first <> __last").drop("__last"))
    names = F.array(*[F.lit(f) for f in fields]) if fields else F.array().cast("array<string>")
    merged = keyed.join(several, "id_value", "left").withColumn("id_field", F.coalesce("__first", "id_field")).drop("__first")
    return merged.withColumn("group_key", F.when(F.col("id_value").isNotNull(), F.concat_ws(":", F.get(names, F.col("id_field")), "id_value"))).select(keyed.columns)


def split_by_gap(keyed: DataFrame, gap_ms: int = 300_000, job_gap_ms: int = 900_000, settle: Callable = lambda df: df) -> DataFrame:
    """Cut each group where the pause is longer than the gap; parts get a number if there are several.

    Within a stretch as long as the gap there is no such pause, so each group's stretches are put in order, not its rows. Only stretches of
    groups that are cut are joined; for ``settle`` see ``merge_same_value``.
    """
    limit = F.when(F.col("group_key").startswith("jobId:"), job_gap_ms).otherwise(gap_ms)
    placed = keyed.withColumn("__stretch", F.floor(F.col("ms") / limit))
    rows = placed.filter("group_key is not null").groupBy("group_key", "__stretch").agg(F.min("ms").alias("lo"), F.max("ms").alias("hi"))
    along = Window.partitionBy("group_key").orderBy("__stretch")
    cut = F.coalesce(F.col("lo") - F.lag("hi").over(along) > limit, F.lit(False)).cast("int")
    parts = rows.withColumn("__cut", cut).withColumn("__part", F.sum("__cut").over(along)).withColumn("__several", F.max("__part").over(Window.partitionBy("group_key")) > 0)
    named = settle(parts.filter("__several").select("group_key", "__stretch", F.concat_ws(":", "group_key", F.col("__part").cast("string")).alias("__name")))
    return placed.join(named, ["group_key", "__stretch"], "left").withColumn("group_key", F.coalesce("__name", "group_key")).select(keyed.columns)


def component() -> Column:
    return F.coalesce("source", F.try_element_at("metadata", F.lit("component")), F.try_element_at("metadata", F.lit("service")))


def group_by_time(entries: DataFrame, window_ms: int = 5000) -> DataFrame:
    """Cut at pauses over the window, at a change of component after 2 s, and at a change of format after any pause.

    The order over all entries is scanned in slabs: each counts its own cuts, and whether one is needed at a border and how many came
    before follows from a row a slab.
    """

    def cut(gap: Column, was: Column, now: Column) -> Column:
        moved = was["c"].isNotNull() & now["c"].isNotNull() & (was["c"] != now["c"]) & (gap > 2000)
        other = was["f"].isNotNull() & now["f"].isNotNull() & (was["f"] != now["f"]) & (gap > 0)
        return F.coalesce((gap > window_ms) | moved | other, F.lit(False)).cast("int")

    here = F.struct(F.col("ms").alias("ms"), component().alias("c"), F.col("format").alias("f"))
    slabs = in_slabs(entries.withColumn("__here", here), "ms", "seq")
    order = Window.partitionBy("__slab").orderBy("ms", "seq")
    marked = slabs.withColumn("__was", F.lag("__here").over(order))
    numbered = marked.withColumn("__cut", cut(F.col("__here.ms") - F.col("__was.ms"), F.col("__was"), F.col("__here"))).withColumn("__n", F.sum("__cut").over(order))
    place = F.struct("ms", "seq")
    borders = numbered.groupBy("__slab").agg(F.min_by("__here", place).alias("first"), F.max_by("__here", place).alias("last"), F.sum("__cut").alias("cuts"))
    along = Window.orderBy("__slab")  # a row a slab
    before = borders.withColumn("was", F.lag("last").over(along)).withColumn("start", cut(F.col("first.ms") - F.col("was.ms"), F.col("was"), F.col("first")))
    carried = before.withColumn("__before", F.sum(F.col("start") + F.col("cuts")).over(along) - F.col("cuts")).select("__slab", "__before")
    placed = numbered.join(F.broadcast(carried), "__slab")
    return placed.withColumn("group_key", F.concat_ws(":", F.lit("time"), (F.col("__before") + F.col("__n")).cast("string"))).drop("__slab", "__here", "__was", "__cut", "__n", "__before")


def looks_like_entity(value: Column) -> Column:
    return value.rlike(UUID) | (value.rlike(PREFIXED) & F.length(value).between(5, 64)) | value.rlike(OBJECT_ID)


def metadata_user(metadata: Column) -> Column:
    """The user that metadata name, at the top or within ``user`` and ``order``."""
    inner = lambda name, path: F.get_json_object(F.try_element_at(metadata, F.lit(name)), path)
    at_top = [F.try_element_at(metadata, F.lit(n)) for n in ("userId", "user_id")]
    return truthy(F.coalesce(*at_top, inner("user", "$.id"), inner("user", "$.userId"), inner("order", "$.userId")))


def entity_ids(metadata: Column) -> Column:
    kept = F.filter(F.map_entries(metadata), lambda e: ~e["key"].isin(*NOT_ENTITIES) & F.coalesce(looks_like_entity(e["value"]), F.lit(False)))
    return F.array_distinct(F.transform(kept, lambda e: e["value"]))


def told_status(metadata: Column) -> Column:
    """The HTTP status that an entry's metadata tell."""
    return F.coalesce(F.try_element_at(metadata, F.lit("status")), F.try_element_at(metadata, F.lit("statusCode"))).try_cast("double")


# fixed values: messages of an exhausted pool, and of what it causes
POOL, STARVED = r"pool\s*exhaust|connection\s*pool", r"\b503\b|wait\s*timeout"


def group_bounds(grouped: DataFrame) -> DataFrame:
    """Per group: time span, size, first place, user, session, services, entities, formats."""
    ids = F.array_distinct(F.flatten(F.collect_set("__ids")))
    with_ids = grouped.filter("group_key is not null").withColumn("__ids", entity_ids(F.col("metadata")))
    order = F.struct("ms", "seq")
    return with_ids.groupBy("group_key").agg(
        F.min("ms").alias("start_ms"), F.max("ms").alias("end_ms"), F.count("*").alias("n"), F.min("seq").alias("first_seq"),
        F.min_by("user_id", F.when(F.col("user_id").isNotNull(), order)).alias("g_user"), F.min_by("session_id", F.when(F.col("session_id").isNotNull(), order)).alias("g_session"),
        F.collect_set(F.try_element_at("metadata", F.lit("service"))).alias("g_services"), ids.alias("g_entities"), F.min_by("format", F.when(F.col("format").isNotNull(), order)).alias("g_format"),
        F.bool_or(F.coalesce(told_status(F.col("metadata")).isin(401, 403), F.lit(False))).alias("g_denied"), F.bool_or(F.coalesce(told_status(F.col("metadata")).isin(200, 201), F.lit(False))).alias("g_allowed"),
        F.bool_or(has(F.col("message"), POOL)).alias("g_pool"), F.bool_or(has(F.col("message"), STARVED)).alias("g_starved"),
    )


#: Two entries this close tell of one flow, if anything else does.
TIGHT_MS = 10_000


def stays(members: DataFrame) -> DataFrame:
    """Per group and stretch of ``TIGHT_MS`` that it has members in: the first and the last of them.

    Every moment between the two is as close to one of them, however many there are.
    """
    rows = members.filter("group_key is not null").groupBy("group_key", F.floor(F.col("ms") / TIGHT_MS).alias("stretch"))
    return rows.agg(F.min("ms").alias("lo"), F.max("ms").alias("hi")).drop("stretch")


def absorb_scores(loose: DataFrame, groups: DataFrame, members: DataFrame, window_ms: int = 5000) -> DataFrame:
    """Best group for each loose entry: ``(seq, group_key, score)``; a score of 5 is needed, ties go to the earliest group.

    Entries are dealt to slabs of time, groups to all that they reach with the horizon; within a slab ``absorb`` finds the best group of
    each entry. A group is copied, not met: what goes through the shuffle does not grow with the groups that are open at a time.
    """
    horizon = max(6 * window_ms, 60_000)
    flags = lambda *bits: sum((F.when(F.coalesce(bit, F.lit(False)), 1 << k).otherwise(0) for k, bit in enumerate(bits)), F.lit(0))
    message, status = F.col("message"), told_status(F.col("metadata"))
    entries = loose.filter("ms is not null").select(
        "seq", "ms", truthy(F.col("user_id")).alias("user"), truthy(F.col("session_id")).alias("session"), truthy(F.col("format")).alias("format"),
        truthy(F.try_element_at("metadata", F.lit("service"))).alias("service"), entity_ids(F.col("metadata")).alias("ids"), flags(status.isin(401, 403), status.isin(200, 201), has(message, POOL), has(message, STARVED)).alias("flags"),
    )
    slabs = Slabs(loose.select("ms").unionAll(members.filter("group_key is not null").select("ms")))
    told = groups.select(
        "group_key", "first_seq", F.col("start_ms").alias("lo"), F.col("end_ms").alias("hi"), truthy(F.col("g_user")).alias("user"), truthy(F.col("g_session")).alias("session"), truthy(F.col("g_format")).alias("format"),
        F.col("g_services").alias("services"), F.col("g_entities").alias("ids"), flags(F.col("g_denied"), F.col("g_allowed"), F.col("g_pool"), F.col("g_starved")).alias("flags"),
    )
    reaching = slabs.copied(told.filter("lo is not null"), F.col("lo") - horizon, F.col("hi") + horizon)
    staying = slabs.copied(stays(members).filter("lo is not null"), F.col("lo") - TIGHT_MS, F.col("hi") + TIGHT_MS)
    items = reaching.unionByName(staying, allowMissingColumns=True)
    best = best_groups(window_ms, horizon, TIGHT_MS)
    return slabs.dealt(entries).groupBy("slab", "part").cogroup(items.groupBy("slab", "part")).applyInArrow(best, "seq bigint, group_key string, score int")


def absorb_singletons(groups: DataFrame) -> DataFrame:
    """Single-entry groups inside the span of a larger group of the same user: ``(group_key, into)``."""
    single = groups.filter("n = 1 and g_user is not null").select("group_key", F.col("start_ms").alias("ms"), F.col("g_user").alias("user"))
    large = groups.filter("n > 1 and g_user is not null").select(F.col("group_key").alias("into"), "start_ms", "end_ms", "first_seq", F.col("g_user").alias("user"))
    met = single.join(large, "user").filter("ms between start_ms and end_ms")
    return met.groupBy("group_key").agg(F.min_by("into", "first_seq").alias("into"))


def keywords(entries: DataFrame) -> DataFrame:
    """Entries with their keyword vector (a set of words, services, path, error codes, level, service, component)."""
    lower, message = F.lower("message"), F.col("message")
    path = F.regexp_extract(message, "(?i)" + HTTP_PATH, 1)
    short = F.concat_ws("/", F.slice(F.split(path, "/"), 1, 3))
    one = lambda prefix, value: F.when(value.isNotNull(), F.array(F.concat(F.lit(prefix), value))).otherwise(F.array().cast("array<string>"))
    found = F.concat(
        F.regexp_extract_all(lower, F.lit(js(ACTION_WORDS)), F.lit(1)), F.regexp_extract_all(lower, F.lit(js(SERVICE_NAMES)), F.lit(1)), one("path:", F.when(path != "", short)),
        F.transform(F.regexp_extract_all(lower, F.lit(js(ERROR_CODES)), F.lit(1)), lambda x: F.concat(F.lit("status:"), x)), one("level:", F.col("level")),
        one("service:", F.lower(F.try_element_at("metadata", F.lit("service")))), one("component:", F.lower("source")), one("component:", F.lower(F.try_element_at("metadata", F.lit("component")))),
    )
    return entries.withColumn("keywords", F.array_distinct(found))


def jaccard(a: Column, b: Column) -> Column:
    """Of arrays without repeated elements."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 0.0).otherwise(both / union)


#: Entries in a row of entries of one vector.
BUNCH = 4096


def similar_pairs(entries: DataFrame, threshold: float = 0.4, horizon_ms: int = 300_000) -> DataFrame:
    """Pairs of entries within the horizon whose keyword vectors are alike: ``(a, b, similarity)``, a before b.

    Entries of one vector and half a horizon are bunched, so vectors are compared once a pair of bunches; the entries of two bunches
    whose vectors are alike only have their times compared. Of two bunches of different halves, the earlier meets the later one.
    """
    half = max(1, math.ceil(horizon_ms / 2))
    words = F.coalesce(F.array_sort("keywords"), F.array().cast("array<string>"))  # no filter, which would find the words once more
    k = keywords(entries.filter("seq is not null and ms is not null")).select("seq", "ms", words.alias("words")).withColumn("slot", F.floor(F.col("ms") / half))
    place = F.row_number().over(Window.partitionBy("slot", "words").orderBy("ms"))
    placed = k.withColumn("bunch", F.floor((place - 1) / BUNCH))
    bunched = placed.groupBy("slot", "words", "bunch").agg(F.min("ms").alias("lo"), F.max("ms").alias("hi"), F.collect_list(F.struct("ms", "seq")).alias("rows"))
    bunches = cut_lineage(bunched)  # both sides read it
    # the pairs of a bunch are many for its bytes: tasks are not put together by size
    tasks = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = lambda name: [F.col(c).alias(f"{name}_{c}") for c in ("words", "lo", "hi", "rows")]
    left = bunches.select("slot", *side("x")).repartition(tasks, "slot")
    reach = F.sequence(F.col("slot") - 2, F.col("slot"))
    right = bunches.select(F.explode(reach).alias("met"), F.col("slot").alias("own"), *side("y")).withColumnRenamed("met", "slot").repartition(tasks, "slot")
    near = (F.col("y_lo") - F.col("x_hi") <= horizon_ms) & (F.col("x_lo") - F.col("y_hi") <= horizon_ms)
    met = left.join(right, "slot").filter(near).withColumn("similarity", jaccard(F.col("x_words"), F.col("y_words"))).filter(F.col("similarity") >= threshold)
    some = met.select("similarity", (F.col("own") == F.col("slot")).alias("same"), F.explode("x_rows").alias("x"), "y_rows").select("similarity", "same", "x", F.explode("y_rows").alias("y"))
    # in a slot both bunches meet either way round
    once = F.when(F.col("same"), F.col("x.seq") < F.col("y.seq")).otherwise(F.col("x.seq") != F.col("y.seq"))
    found = some.filter(once & (F.abs(F.col("x.ms") - F.col("y.ms")) <= horizon_ms))
    return found.select(F.least("x.seq", "y.seq").alias("a"), F.greatest("x.seq", "y.seq").alias("b"), "similarity")


def content_clusters(entries: DataFrame, threshold: float = 0.4, stricter: float = 0.6, horizon_ms: int = 300_000) -> DataFrame:
    """``(seq, cluster)`` of entries in a cluster of two or more; a cluster has the number of its first entry.

    In order of time, an entry joins the cluster whose keywords, those of all its entries, are the most similar to its own, the first of
    equal ones; it begins another where that one is not similar enough (``stricter`` for an entry with a component and a cluster without), or
    was last joined longer ago than the horizon. Nothing joins across a pause of that length, so islands of time are folded apart.
    """
    islands = time_islands(keywords(entries).select("seq", "ms", "keywords"), "ms", horizon_ms)
    ordered = islands.repartition("island").sortWithinPartitions("island", "ms", "seq")
    found = cut_lineage(ordered.mapInArrow(fold_lines(threshold, stricter, horizon_ms), "seq bigint, cluster bigint"))
    several = found.groupBy("cluster").agg(F.count("*").alias("n")).filter("n > 1").select("cluster")
    return found.join(several, "cluster").select("seq", "cluster")


def entity_merges(grouped: DataFrame, merge_ms: int = 600_000) -> DataFrame:
    """``(group_key, into)``: groups that become part of others with which they share an entity.

    Entities are taken in the order in which the groups, and the entries in them, mention them. Of an entity's groups that are not yet part of another,
    the first (groups by id, then by content, then by time) takes each following one that overlaps the span it has grown to, or is at most
    ``merge_ms`` away. Which groups are left depends on the entities before, so those that share groups, directly or over others, are folded
    together in their order.
    """
    ids = entity_ids(F.col("metadata"))
    mentioned = grouped.filter("group_key is not null").select("group_key", "seq", F.posexplode(ids).alias("pos", "entity"))
    members = mentioned.groupBy("group_key", "entity").agg(F.min(F.struct("seq", "pos")).alias("said"))
    kind = F.when(F.col("group_key").startswith("time:"), 2).when(F.col("group_key").startswith("infer"), 1).otherwise(0)
    bounds = grouped.filter("group_key is not null").groupBy("group_key").agg(F.min("ms").alias("start_ms"), F.max("ms").alias("end_ms"), F.min("seq").alias("first_seq"))
    ranked = bounds.withColumn("rank", F.struct(kind.alias("kind"), "first_seq", "group_key"))
    shared = members.groupBy("entity").agg(F.count("*").alias("n")).filter("n > 1").select("entity")
    held = cut_lineage(members.join(shared, "entity").join(ranked, "group_key"))
    if held.isEmpty():  # no two groups share an entity
        return held.select("group_key", F.col("group_key").alias("into"))
    turn = held.groupBy("entity").agg(F.min(F.struct("rank", "said")).alias("turn"))
    labels = connected_components(held.select(F.concat_ws(":", F.lit("entity"), "entity").alias("a"), F.concat_ws(":", F.lit("group"), "group_key").alias("b")))
    component = labels.filter("node like 'entity:%'").select(F.expr("substring(node, 8)").alias("entity"), "component")
    ordered = held.join(turn, "entity").join(component, "entity").select("component", "turn", "entity", "rank", "group_key", "start_ms", "end_ms")
    again = F.lead("entity").over(Window.partitionBy("component", "group_key").orderBy("turn", "entity")).isNotNull()
    rows = ordered.withColumn("more", again).repartition("component").sortWithinPartitions("component", "turn", "entity", "rank")
    found = cut_lineage(rows.select("component", "entity", "group_key", "start_ms", "end_ms", "more").mapInArrow(fold_entities(merge_ms), "group_key string, into string"))
    if found.isEmpty():
        return found
    # a group that took others can be taken itself: all go to the one that is left
    trees = connected_components(found.select(F.col("group_key").alias("a"), F.col("into").alias("b")))
    roots = trees.join(found.select(F.col("group_key").alias("node")), "node", "left_anti").select("component", F.col("node").alias("root"))
    return found.select(F.col("group_key").alias("node")).join(trees, "node").join(roots, "component").select(F.col("node").alias("group_key"), F.col("root").alias("into"))


def group_entries(entries: DataFrame, config: Grouping = Grouping()) -> DataFrame:
    """All strategies in order: ids, absorption, singletons, content, time, shared entities. Adds ``group_key``, ``strategy``."""
    assigned = assign_keys(entries, config.fields)
    keyed = merge_same_value(assigned.filter("group_key is not null"), config.fields, cut_lineage)
    keyed = split_by_gap(keyed, config.gap_ms, config.job_gap_ms, cut_lineage).drop("id_value", "id_field")
    loose = assigned.filter("group_key is null").drop("id_value", "id_field", "group_key")
    # what several strategies read is computed once
    keyed = cut_lineage(keyed)
    absorbed = cut_lineage(loose.join(absorb_scores(loose, group_bounds(keyed), keyed, config.window_ms).drop("score"), "seq"))
    by_id = keyed.unionByName(absorbed.select(keyed.columns))
    singles = cut_lineage(absorb_singletons(group_bounds(by_id)))
    by_id = by_id.join(singles, "group_key", "left").withColumn("group_key", F.coalesce("into", "group_key")).drop("into").withColumn("strategy", F.lit("id"))
    rest = loose.join(absorbed.select("seq"), "seq", "left_anti")
    rest = cut_lineage(rest)
    clusters = cut_lineage(content_clusters(rest, config.similarity))
    inferred = rest.join(clusters, "seq").withColumn("group_key", F.concat_ws("-", F.lit("inferred"), "cluster")).drop("cluster").withColumn("strategy", F.lit("inference"))
    timed = group_by_time(rest.join(clusters.select("seq"), "seq", "left_anti"), config.window_ms).withColumn("strategy", F.lit("time"))
    grouped = by_id.unionByName(inferred).unionByName(timed)
    grouped = cut_lineage(grouped)
    merges = entity_merges(grouped, config.merge_ms)
    merged = grouped.withColumn("part_key", F.col("group_key")).join(merges, "group_key", "left")
    return merged.withColumn("group_key", F.coalesce("into", "group_key")).drop("into")


def group_stats(grouped: DataFrame) -> DataFrame:
    """One row: groups by strategy before entities merged them, and all groups after."""
    count = lambda s: F.count_distinct(F.when(F.col("strategy") == s, F.col("part_key")))
    return grouped.agg(F.count_distinct("group_key").alias("total_groups"), count("id").alias("by_id"), count("time").alias("by_time"), count("inference").alias("by_inference"))
