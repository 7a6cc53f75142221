"""Causal chains of events and stories built from them.

Chains and merged stories are ordered folds (``folds``) over blocks that no rule crosses. The relations between two events or two stories
are operators of their own: pairs within a relation's horizon meet by band joins, those that may overlap by joins over the whole span of the earlier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has, in_order, truthy
from ..plans.graph import cut_lineage, time_band_join, time_reach_join
from .folds import Chain, Merged, first_fit
from .group import NOT_ENTITIES, looks_like_entity, metadata_user
from .narrate import narrate_stories

# fixed values: words of an escalation
ESCALATION = "support|ticket|escalat|alert|notify|incident"
# fixed values: families of work whose parts belong together, and the two sides of a database incident
FAMILIES = {
    "autoscale": (r"\b(scal(?:ing|e)|autoscale|launch(?:ing)?)\b", r"\binstance\s*#?\d+\b", r"\b(health.?check|load.?balancer|added to)\b"),
    "deploy": (r"\b(deploy|release|rolling)\b", r"\bv\d+\.\d+\.\d+\b", r"\b(active|started|running).*nodes?\b"),
    "backup": (r"\b(backup|pg_dump|dump)\b", r"\b(upload|s3|compress)\b"),
}
POOL, INCIDENT = r"pool\s*exhaust|connection\s*pool", r"\bp99\b|latency|scal(?:e|ing)|autoscale|incident|INC-|503|wait\s*timeout"


# fixed values: fields that name an entity whatever their value looks like; and those that never do when events are chained
ENTITIES = ("orderId", "cartId", "paymentId", "shipmentId", "orderTempId", "order_id", "cart_id", "payment_id", "shipment_id", "incident_id", "ticket_id", "connection_id", "conn_id")
NEVER_ENTITIES = tuple(n for n in NOT_ENTITIES if n not in ("reason", "action", "task"))


def entity_references(metadata: Column) -> Column:
    """Ids of entities in metadata and in objects one level below: known fields, and values that look like ids."""

    def of(pairs: Column) -> Column:
        meant = lambda e: F.coalesce((e["key"].isin(*ENTITIES) & (e["value"] != "")) | (~e["key"].isin(*NEVER_ENTITIES) & looks_like_entity(e["value"])), F.lit(False))
        return F.transform(F.filter(pairs, meant), lambda e: e["value"])

    pairs = F.map_entries(metadata)
    objects = F.filter(F.transform(pairs, lambda e: F.when(e["value"].startswith("{"), F.from_json(e["value"], "map<string,string>"))), lambda m: m.isNotNull())
    below = F.transform(objects, lambda m: of(F.map_entries(m)))
    return F.array_distinct(F.concat(of(pairs), F.flatten(below)))


def messages(entries: Column) -> Column:
    return F.transform(entries, lambda e: e["message"])


def user_chains(events: DataFrame, horizon_ms: int = 120_000) -> DataFrame:
    """Chain numbers per user: a new chain where an event starts ``horizon_ms`` or more after all before it have ended."""
    order = Window.partitionBy("user_id").orderBy("start_ms", "group_key")
    reach = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.coalesce(F.col("start_ms") - reach >= horizon_ms, F.lit(False)).cast("int")
    return events.withColumn("__cut", cut).withColumn("chain_no", F.sum("__cut").over(order)).drop("__cut")


def with_ties(events: DataFrame) -> DataFrame:
    """What the relations between events are decided by."""
    entities = F.array_distinct(F.flatten(F.transform("entries", lambda e: entity_references(e["metadata"]))))
    meta = lambda e: metadata_user(e["metadata"])
    lower = F.lower(F.array_join(messages(F.col("entries")), " "))
    return events.withColumns(
        {
            "entities": entities, "components": F.array_distinct(F.filter(F.transform("entries", lambda e: e["component"]), lambda c: c.isNotNull())),
            "meta_user": F.get(F.filter(F.transform("entries", meta), lambda u: u.isNotNull() & (u != "")), F.lit(0)), "action_types": F.array_join(F.transform("actions", lambda a: a["type"]), ","), "escalates": has(lower, ESCALATION),
        }
    )


def causal_pairs(events: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of events of which the later follows from the earlier."""
    columns = ["event_id", "group_key", "group_type", "start_ms", "end_ms", "user_id", "session_id", "entities", "components", "meta_user", "action_types", "outcome", "escalates"]
    tied = with_ties(events).select(*columns)
    a, b = tied.select(*[F.col(c).alias(f"a_{c}") for c in columns]), tied.select(*[F.col(c).alias(f"b_{c}") for c in columns])
    gap = F.col("b_start_ms") - F.col("a_end_ms")
    later = (F.col("b_start_ms") > F.col("a_start_ms")) | ((F.col("b_start_ms") == F.col("a_start_ms")) & (F.col("b_event_id") > F.col("a_event_id")))
    touching = (F.col("b_start_ms") >= F.col("a_start_ms")) & (gap <= 5000)
    follows = (F.col("a_outcome") == "failure") & ((F.col("a_action_types") == F.col("b_action_types")) | F.col("b_escalates"))

    def met(left: DataFrame, right: DataFrame, horizon: int, keys: list[str], where: Column, overlap: bool = True) -> DataFrame:
        if overlap:  # also where b starts long before a ends
            pairs = time_reach_join(left, right, "a_start_ms", "a_end_ms", "b_start_ms", horizon, keys, later & where)
        else:
            pairs = time_band_join(left, right, "a_end_ms", "b_start_ms", horizon, keys, later & where)
        return pairs.select(F.col("a_event_id").alias("a"), F.col("b_event_id").alias("b"))

    def keyed(name: str, horizon: int, where: Column, overlap: bool) -> DataFrame:
        return met(a.filter(f"a_{name} is not null").withColumn("k", F.col(f"a_{name}")), b.filter(f"b_{name} is not null").withColumn("k", F.col(f"b_{name}")), horizon, ["k"], where, overlap)

    exploded = lambda df, side, name: df.withColumn("k", F.explode(f"{side}_{name}"))
    near = (gap >= 0) & (gap < 60_000)
    same_user = keyed("user_id", 300_000, ((gap >= -1000) & (gap < 120_000)) | touching | ((gap >= 0) & (gap < 300_000) & follows), True)
    same_session = keyed("session_id", 300_000, (gap >= -1000) & (gap < 300_000), False)
    same_meta = keyed("meta_user", 60_000, near, False)
    shared = met(exploded(a, "a", "entities"), exploded(b, "b", "entities"), 60_000, ["k"], near | (touching & F.col("b_user_id").isNull() & (F.col("a_user_id").isNotNull() | ((F.col("a_group_type") == "request") & (F.col("b_group_type") != "request")))))
    nobody_a, nobody_b = a.filter("a_user_id is null and a_group_type <> 'request'"), b.filter("b_user_id is null")
    close = met(nobody_a.withColumn("k", F.lit(0)), nobody_b.withColumn("k", F.lit(0)), 5000, ["k"], touching & (gap <= 3000))
    parts = met(exploded(nobody_a, "a", "components"), exploded(nobody_b, "b", "components"), 5000, ["k"], touching)
    return same_user.union(same_session).union(same_meta).union(shared).union(close).union(parts).distinct()


def tied_by(items: DataFrame, **keys: tuple[Column, int]) -> DataFrame:
    """Rows ``(id, key, horizon_ms, start_ms, end_ms)``: what items can be tied by, arrays of values or single ones, each with its horizon."""
    found = None
    for name, (values, horizon) in keys.items():
        part = items.select("id", F.explode(values).alias("v"), "start_ms", "end_ms").filter("v is not null")
        part = part.select("id", F.concat_ws(":", F.lit(name), "v").alias("key"), F.lit(horizon).cast("bigint").alias("horizon_ms"), "start_ms", "end_ms")
        found = part if found is None else found.union(part)
    return found


def chain_events(events: DataFrame) -> DataFrame:
    """Events with the ``chain_id`` of the chain that takes them (the id of its first event; their own id if none does)."""
    tied = with_ties(events)
    sessions = F.transform("entries", lambda e: F.coalesce(truthy(F.try_element_at(e["metadata"], F.lit("sessionId"))), truthy(F.try_element_at(e["metadata"], F.lit("session_id")))))
    items = cut_lineage(
        tied.select(
            F.col("event_id").alias("id"), "start_ms", "end_ms", F.coalesce(truthy(F.col("user_id")), "meta_user").alias("user"), F.coalesce(truthy(F.col("session_id")), F.get(F.filter(sessions, lambda s: s.isNotNull()), F.lit(0))).alias("session"),
            "meta_user", "entities", "components", (F.col("group_type") == "request").alias("request"), "group_key", "action_types", "outcome", "escalates",
        )
    )
    nobody = F.array(F.when(F.col("user").isNull(), F.lit("any")))
    ties = tied_by(items, user=(F.array("user"), 300_000), session=(F.array("session"), 300_000), meta=(F.array("meta_user"), 60_000), entity=(F.col("entities"), 60_000), nobody=(nobody, 5000))
    chains = first_fit(items, ties, Chain, items.columns).select(F.col("id").alias("event_id"), F.col("chain").alias("chain_id"))
    return events.join(chains, "event_id", "left").withColumn("chain_id", F.coalesce("chain_id", "event_id"))


def chain_outcome(last: Column, failures: Column, successes: Column, partials: Column, n: Column, ends_well: Column) -> Column:
    return (
        F.when((last == "failure") & ends_well, "partial")
        .when(last == "failure", "failure")
        .when((failures > 0) & (successes > 0) & (last == "success"), "partial")
        .when((failures > 0) & (last != "success"), "failure")
        .when(partials > 0, "partial")
        .when((successes == n) | (last == "success"), "success")
        .otherwise("unknown")
    )


def relation(failures: Column, users: Column) -> Column:
    """What holds a chain together: a failure that the rest follows from, one user, or one request."""
    return F.when(failures > 0, "temporal_cause").when(F.size(users) == 1, "same_user_flow").otherwise("same_request")


def severity(outcome: Column, retried: Column, failures: Column) -> Column:
    return F.when(outcome == "failure", F.when(retried | (failures > 1), "critical").otherwise("warning")).when(outcome == "partial", "warning").otherwise("info")


def gather_events(chained: DataFrame, key: str) -> DataFrame:
    """One row per chain: its events in order, and what follows from them as they stand."""
    place = F.col("place") if "place" in chained.columns else F.lit(0).cast("bigint")
    row = F.struct("start_ms", "group_key", "event_id", "end_ms", "outcome", "user_id", "dependencies", "entries", "actions", place.alias("place"))
    ordered = in_order(F.collect_list(row), "start_ms", "group_key")
    count = lambda o: F.count_if(F.col("outcome") == o)
    base = chained.groupBy(F.col(key).alias("story_id")).agg(F.min("start_ms").alias("start_ms"), ordered.alias("events"), F.count("*").alias("n_events"), count("failure").alias("failures"), count("success").alias("successes"), count("partial").alias("partials"))
    last = F.element_at("events", -1)
    return base.withColumns(
        {
            "end_ms": last["end_ms"], "entries": F.flatten(F.transform("events", lambda e: e["entries"])), "actions": F.flatten(F.transform("events", lambda e: e["actions"])),
            "actors": F.array_distinct(F.filter(F.transform("events", lambda e: e["user_id"]), lambda u: u.isNotNull())), "services": F.array_distinct(F.flatten(F.transform("events", lambda e: e["dependencies"]))),
            "event_ids": F.transform("events", lambda e: e["event_id"]), "first_user": F.get("events", F.lit(0))["user_id"], "last_outcome": last["outcome"], "last_entry": F.element_at(last["entries"], -1),
            "causal_nodes": F.transform(in_order(F.col("events"), "place", "start_ms", "group_key"), lambda e: F.struct(e["event_id"].alias("id"), F.get(e["actions"], F.lit(0))["type"].alias("type"), e["outcome"].alias("outcome"))),
            "retried": F.exists(F.flatten(F.transform("events", lambda e: e["actions"])), lambda a: a["status"] == "retried"),
        }
    )


def build_stories(chained: DataFrame, key: str = "chain_id") -> DataFrame:
    """One row per chain: span, outcome, severity, actors, services, ordered entries and actions, and the texts."""
    base = gather_events(chained, key)
    ends_well = has(F.col("last_entry.message"), r"\b(success|succeeded|completed|ok|done|delivered|sent)\b") | F.coalesce(F.try_element_at("last_entry.metadata", F.lit("status")).rlike("(?i)^(ok|success|done|complete|completed)$"), F.lit(False))
    base = base.withColumn("outcome", chain_outcome(F.col("last_outcome"), F.col("failures"), F.col("successes"), F.col("partials"), F.col("n_events"), ends_well))
    told = narrate_stories(base)
    overridden = F.when((F.col("title") == "Worker Heartbeat – Errors Detected") & (F.col("outcome") != "failure"), "partial").otherwise(F.col("outcome"))
    return (
        told.withColumn("outcome", overridden)
        .withColumns({"severity": severity(F.col("outcome"), F.col("retried"), F.col("failures")), "duration_ms": F.col("end_ms") - F.col("start_ms"), "relation": relation(F.col("failures"), F.col("actors"))})
        .drop("last_outcome", "last_entry", "first_user")
    )


def story_marks(stories: DataFrame) -> DataFrame:
    """Which families of work and which sides of a database incident a story belongs to."""
    joined = F.lower(F.array_join(messages(F.col("entries")), " "))
    full = F.concat_ws(" ", joined, F.lower(F.array_join(F.transform("entries", lambda e: F.concat_ws(" ", F.try_element_at(e["metadata"], F.lit("error")), F.try_element_at(e["metadata"], F.lit("status")))), " ")))
    kinds = F.array_compact(F.array(*[F.when(has(joined, p[0], False) | (has(joined, p[1], False)) | (has(joined, p[-1], False)), name) for name, p in FAMILIES.items()]))
    return stories.withColumns({"families": kinds, "pool": has(full, POOL, False), "related": has(full, INCIDENT, False)})


def story_merges(stories: DataFrame, horizon_ms: int = 900_000) -> DataFrame:
    """Pairs ``(a, b)`` of stories that are one: database incidents, work of one family, shared actors or services."""
    columns = ["story_id", "start_ms", "end_ms", "actors", "services", "families", "pool", "related"]
    marked = story_marks(stories).select(*columns)
    a, b = marked.select(*[F.col(c).alias(f"a_{c}") for c in columns]), marked.select(*[F.col(c).alias(f"b_{c}") for c in columns])
    gap = F.col("b_start_ms") - F.col("a_end_ms")
    later = (F.col("b_start_ms") > F.col("a_start_ms")) | ((F.col("b_start_ms") == F.col("a_start_ms")) & (F.col("b_story_id") > F.col("a_story_id")))
    actors = F.arrays_overlap("a_actors", "b_actors")
    nobody = (F.size("a_actors") == 0) & (F.size("b_actors") == 0)
    services = F.arrays_overlap("a_services", "b_services")
    inside = (F.col("b_end_ms") <= F.col("a_end_ms")) | (F.col("b_start_ms") == F.col("a_start_ms"))

    def met(left: DataFrame, right: DataFrame, where: Column, horizon: int = horizon_ms, overlap: bool = False) -> DataFrame:
        if overlap:  # also where b starts long before a ends
            pairs = time_reach_join(left, right, "a_start_ms", "a_end_ms", "b_start_ms", horizon, ["k"], later & where)
        else:
            pairs = time_band_join(left, right, "a_end_ms", "b_start_ms", horizon, ["k"], later & where)
        return pairs.select(F.col("a_story_id").alias("a"), F.col("b_story_id").alias("b"))

    explode = lambda df, side, name: df.withColumn("k", F.explode(f"{side}_{name}"))
    one = lambda df: df.withColumn("k", F.lit(0))
    incident = (gap >= 0) & (gap <= 900_000) & ((F.col("a_pool") & (F.col("b_related") | F.col("b_pool"))) | (F.col("b_pool") & F.col("a_related")))
    in_incident_a, in_incident_b = a.filter("a_pool or a_related"), b.filter("b_pool or b_related")
    return (
        met(one(in_incident_a), one(in_incident_b), incident)
        .union(met(explode(a, "a", "families"), explode(b, "b", "families"), (gap >= 0) & (gap <= 120_000), 120_000))
        .union(met(explode(a, "a", "actors"), explode(b, "b", "actors"), actors & (gap <= 120_000), 900_000, True))
        .union(met(explode(a, "a", "services"), explode(b, "b", "services"), services & nobody & (((gap > 0) & (gap <= 30_000)) | (inside & (gap <= 0))), 900_000, True))
        .distinct()
    )


def story_folds(stories: DataFrame) -> DataFrame:
    """``(story_id, into, place, outcome, severity)`` of stories that can be one with others; the last two as the merged story has them by then."""
    marked = story_marks(stories).withColumnRenamed("story_id", "id")
    items = cut_lineage(marked.select("id", "start_ms", "end_ms", "actors", "services", "families", "pool", "related", "outcome", "severity"))
    alone = F.when(F.size("actors") == 0, F.col("services"))
    incident = F.array(F.when(F.col("pool") | F.col("related"), F.lit("any")))
    ties = tied_by(items, actor=(F.col("actors"), 120_000), service=(alone, 120_000), family=(F.col("families"), 120_000), incident=(incident, 900_000))
    return first_fit(items, ties, Merged, items.columns).withColumnsRenamed({"id": "story_id", "chain": "into"})


def merge_stories(chained: DataFrame, stories: DataFrame) -> DataFrame:
    """Stories with those that are one put together, in order: the first one's id, the span of all, the first cause, impact and advice that
    any of them has, the worst severity, outcomes added up one by one, and texts told anew of all events.
    """
    folds = story_folds(stories)
    parts = cut_lineage(folds.join(folds.groupBy("into").agg(F.count("*").alias("n")).filter("n > 1").select("into"), "into"))
    if parts.isEmpty():
        return stories
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("place"))).alias(c)
    told = stories.select("story_id", "end_ms", "root_cause", "impact", "recommendation").join(parts, "story_id")
    verdict = told.groupBy(F.col("into").alias("story_id")).agg(F.max_by("outcome", "place").alias("outcome"), F.max_by("severity", "place").alias("severity"), F.max("end_ms").alias("end_ms"), first("root_cause"), first("impact"), first("recommendation"))
    placed = chained.join(parts.select(F.col("story_id").alias("chain_id"), "into", "place"), "chain_id")
    base = gather_events(placed, "into").drop("end_ms", "last_outcome", "last_entry").join(verdict.select("story_id", "outcome", "end_ms"), "story_id")
    anew = narrate_stories(base).drop("first_user", "root_cause", "impact", "recommendation").join(verdict.drop("outcome", "end_ms"), "story_id")
    anew = anew.withColumns({"duration_ms": F.col("end_ms") - F.col("start_ms"), "relation": F.when(F.col("failures") > 0, "temporal_cause").otherwise("same_user_flow")})
    kept = stories.join(parts.select("story_id"), "story_id", "left_anti")
    return kept.unionByName(anew.select(kept.columns))
