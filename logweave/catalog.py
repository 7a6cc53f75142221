"""Registered queries of the log-narrative engine over the shared tables, and their DuckDB counterparts.

The ``events`` table is read as a log: its rows become entries with a level, a message and a user. Every query runs over whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.levels import normalize_level
from .functions.text import clock
from .operators import causal, events, group, insights, parse, redact
from .operators.filters import Filter, apply_filter
from .operators.narrate import CHECKOUT
from .operators.schema import as_entries
from .plans import providers, render
from .plans.analyzer import session_defaults
from .plans.graph import cut_lineage, shared_folder
from .streaming.stream import run_once, user_sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SIX_HOURS, FIVE_MINUTES = 21_600_000, 300_000


def query(name: str, sql: str | None = None):
    """Register a query, with the DuckDB text of the same rows where there is one."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            session_defaults(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


# --- the events table as a log, in both dialects

LEVEL = "CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'debug' WHEN 'click' THEN 'warn' ELSE 'info' END"
MESSAGE = (
    "CASE event_type WHEN 'error' THEN 'POST /checkout timeout provider=stripe' WHEN 'purchase' THEN 'payment success order_id=' || CAST(event_id AS {s}) "
    "WHEN 'signup' THEN 'signup completed' WHEN 'view' THEN 'GET /products 200' ELSE 'retry attempt ' || {k} END"
)
E_SQL = f"""e AS (SELECT event_id AS seq, epoch_us(ts) // 1000 AS ms, CAST(user_id AS VARCHAR) AS user_id, event_type, json_extract_string(props, '$.k') AS k, {LEVEL} AS level,
  {MESSAGE.format(s="VARCHAR", k="json_extract_string(props, '$.k')")} AS message FROM events)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "get_json_object(props, '$.k')"
    return as_entries(
        table(spark, sf_dir, "events").selectExpr(
            "event_id AS seq", "CAST(ts AS timestamp) AS ts", "CAST(user_id AS string) AS user_id", f"{LEVEL} AS level", f"{MESSAGE.format(s='STRING', k=k)} AS message",
            f"concat('req-', {k}) AS request_id", "concat('tr-', CAST(event_id % 97 AS string)) AS trace_id", f"map('event_type', event_type, 'k', {k}, 'attempt', {k}) AS metadata",
        )
    )


def by_user(spark: SparkSession, sf_dir: str, gap_ms: int = SIX_HOURS) -> DataFrame:
    """Entries under keys of their user, cut at pauses."""
    keyed = group.assign_keys(log(spark, sf_dir), ("userId",)).filter("group_key is not null")
    return group.split_by_gap(keyed, gap_ms, gap_ms)


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.build_events(by_user(spark, sf_dir))


def user_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories of chains of a user's events at most two minutes apart."""
    chained = causal.user_chains(user_events(spark, sf_dir)).withColumn("chain_id", F.concat_ws("/", "user_id", F.col("chain_no").cast("string")))
    return causal.build_stories(chained)


def fixed_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For readers that need the stories several times: built once, without texts that none of them reads."""
    told = user_stories(spark, sf_dir)
    return cut_lineage(told.drop("events", "narrative", "narrative_source", "causal_nodes", "recommendation", "impact"))


def re2(column: str, pattern: str, flags: str = "i") -> str:
    quoted = pattern.replace("'", "''")
    return f"regexp_matches({column}, '{quoted}'" + (f", '{flags}')" if flags else ")")


def groups_sql(gap_ms: int) -> str:
    return f"""g0 AS (SELECT *, CASE WHEN ms - lag(ms) OVER w > {gap_ms} THEN 1 ELSE 0 END AS cut FROM e WHERE user_id <> '' WINDOW w AS (PARTITION BY user_id ORDER BY ms, seq)),
g1 AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY user_id ORDER BY ms, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS part FROM g0),
g AS (SELECT *, 'userId:' || user_id || CASE WHEN max(part) OVER (PARTITION BY user_id) > 0 THEN ':' || part ELSE '' END AS group_key FROM g1)"""


def status_sql(states) -> str:
    return "CASE " + " ".join(f"WHEN {re2('message', words)} THEN '{name}'" for name, words in states) + " ELSE 'started' END"


TARGET_SQL = r"""coalesce(nullif(regexp_extract(message, '(?:GET|POST|PUT|DELETE|PATCH)\s+(/[^\s,]+)', 1, 'i'), ''), nullif(regexp_extract(message, '(?:calling|request to)\s+([^\s,]+)', 1, 'i'), ''))"""
ACTIONS_SQL = "a AS (" + " UNION ALL ".join(
    f"SELECT seq, {n} AS place, '{kind}' AS type, {status_sql(states)} AS status, {TARGET_SQL if kind == 'api_call' else 'NULL'} AS target FROM e WHERE {' OR '.join(re2('message', t) for t in triggers)}"
    for n, (kind, triggers, states) in enumerate(events.ACTIONS)
) + ")"
OUTCOME_SQL = f"""f AS (SELECT g.*, coalesce(x.failed, FALSE) AS failed, coalesce(x.done, FALSE) AS done, {re2('lower(message)', events.GOOD_WORDS, '')} AS good,
  {re2("regexp_replace(lower(message), '" + events.ZERO_COUNT + "', ' ', 'g')", events.BAD_WORDS, '')} AS bad
  FROM g LEFT JOIN (SELECT seq, bool_or(status = 'failed') AS failed, bool_or(status = 'completed') AS done FROM a GROUP BY seq) x USING (seq)),
ev AS (SELECT group_key, min(user_id) AS user_id, min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS n_entries, count(*) FILTER (level = 'error') AS n_errors,
  CASE WHEN bool_or(level = 'error' OR failed) THEN CASE WHEN bool_or(done) THEN 'partial' ELSE 'failure' END WHEN bool_or(done) THEN 'success' WHEN bool_or(bad) AND NOT bool_or(good) THEN 'failure' ELSE 'success' END AS outcome
  FROM f GROUP BY group_key)"""
EVENTS_SQL = f"WITH {E_SQL}, {groups_sql(SIX_HOURS)}, {ACTIONS_SQL}, {OUTCOME_SQL}"
CHAINS_SQL = EVENTS_SQL + """, c0 AS (SELECT *, CASE WHEN start_ms - max(end_ms) OVER (PARTITION BY user_id ORDER BY start_ms, group_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 120000 THEN 1 ELSE 0 END AS cut FROM ev),
c AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY user_id ORDER BY start_ms, group_key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chain_no FROM c0)"""
# what a story's texts are decided by, for the messages of this log
STORIES_SQL = CHAINS_SQL + f""", m AS (SELECT c.user_id || '/' || c.chain_no AS story_id, c.start_ms AS event_start, c.group_key, f.ms, f.seq, f.level, f.message FROM c JOIN f USING (group_key)),
t AS (SELECT story_id, bool_or({re2('message', CHECKOUT)}) AS sells, bool_or(message LIKE 'signup%') AS signs, bool_or(message LIKE '%timeout%') AS times_out, bool_or(message LIKE '%products%') AS browses,
  count(*) FILTER (level = 'error') AS n_errors, count(*) AS n_entries, arg_max(message, (event_start, group_key, ms, seq)) AS last_message FROM m GROUP BY story_id),
o AS (SELECT user_id || '/' || chain_no AS story_id, min(user_id) AS user_id, min(start_ms) AS start_ms, max(end_ms) AS max_end_ms, arg_max(end_ms, (start_ms, group_key)) AS end_ms, arg_max(outcome, (start_ms, group_key)) AS last_outcome, count(*) AS n_events,
  count(*) FILTER (outcome = 'failure') AS failures, count(*) FILTER (outcome = 'success') AS successes, count(*) FILTER (outcome = 'partial') AS partials FROM c GROUP BY user_id, chain_no),
s0 AS (SELECT *, CASE WHEN last_outcome = 'failure' AND {re2('last_message', r'\b(success|succeeded|completed|ok|done|delivered|sent)\b')} THEN 'partial' WHEN last_outcome = 'failure' THEN 'failure'
  WHEN failures > 0 AND successes > 0 AND last_outcome = 'success' THEN 'partial' WHEN failures > 0 AND last_outcome <> 'success' THEN 'failure' WHEN partials > 0 THEN 'partial' ELSE 'success' END AS outcome FROM o JOIN t USING (story_id)),
s AS (SELECT *, CASE WHEN sells THEN CASE outcome WHEN 'failure' THEN 'Failed Checkout' || CASE WHEN times_out THEN ' – Stripe Timeout' ELSE '' END WHEN 'partial' THEN 'Partial Checkout' || CASE WHEN times_out THEN ' – Stripe Timeout' ELSE '' END ELSE 'Successful Checkout' END
  WHEN signs THEN 'Successful Signup' WHEN browses THEN 'Request to /products' ELSE 'Operation Completed' END AS title,
  CASE outcome WHEN 'failure' THEN CASE WHEN failures > 1 THEN 'critical' ELSE 'warning' END WHEN 'partial' THEN 'warning' ELSE 'info' END AS severity FROM s0)"""


# --- filters

SHOWN = ("seq", "ms", "level", "message")


def _filter(name: str, wanted: Filter, where: str) -> None:
    @query(name, f"WITH {E_SQL} SELECT seq, ms, level, message FROM e WHERE {where}")
    def run(spark, sf_dir, wanted=wanted):
        return apply_filter(log(spark, sf_dir), wanted).select(*SHOWN)


_filter("filter_levels", Filter(levels=("error", "warn")), "level IN ('error', 'warn')")
_filter("filter_user", Filter(user_id="7"), "user_id = '7'")
_filter("filter_request_or_trace", Filter(request_id="req-5"), "k = '5' OR 'tr-' || (seq % 97) = 'req-5'")


@query("filter_time_range", f"WITH {E_SQL}, b AS (SELECT min(ms) + (max(ms) - min(ms)) // 4 AS lo, max(ms) - (max(ms) - min(ms)) // 4 AS hi FROM e) SELECT seq, ms, level, message FROM e, b WHERE ms BETWEEN lo AND hi")
def filter_time_range(spark, sf_dir):
    entries = log(spark, sf_dir)
    b = entries.agg(F.min("ms").alias("lo"), F.max("ms").alias("hi")).first()
    quarter = (b["hi"] - b["lo"]) // 4
    return apply_filter(entries, Filter(after_ms=b["lo"] + quarter, before_ms=b["hi"] - quarter)).select(*SHOWN)


# --- parsing: the log is rendered in each format and read back


def _lines(spark, sf_dir, sql: str) -> DataFrame:
    k = "get_json_object(props, '$.k')"
    base = table(spark, sf_dir, "events").selectExpr("event_id", "event_type", "CAST(user_id AS string) AS user", "CAST(ts AS timestamp) AS ts", "unix_millis(CAST(ts AS timestamp)) AS ms", f"{k} AS k", f"{LEVEL} AS level", f"{MESSAGE.format(s='STRING', k=k)} AS message")
    return base.selectExpr("event_id AS seq", f"{sql} AS raw")


STAMP_SQL = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")"
NUMBER = "CASE level WHEN 'error' THEN 50 WHEN 'warn' THEN 40 WHEN 'debug' THEN 20 ELSE 30 END"
LINES = {
    "winston": f"to_json(named_struct('level', level, 'message', message, 'timestamp', {STAMP_SQL}, 'userId', user, 'requestId', concat('req-', k)))",
    "pino": f"to_json(named_struct('level', {NUMBER}, 'msg', message, 'time', ms, 'userId', user, 'reqId', concat('req-', k)))",
    "bunyan": f"to_json(named_struct('v', 0, 'name', event_type, 'level', {NUMBER}, 'msg', message, 'time', {STAMP_SQL}, 'user', user, 'req_id', concat('req-', k)))",
}


def _round_trip(name: str, source: str) -> None:
    @query(f"parse_{name}", f"WITH {E_SQL} SELECT seq, ms, level, message, user_id, 'req-' || k AS request_id, {source} AS source, '{name}-json' AS format, FALSE AS ts_inferred FROM e")
    def run(spark, sf_dir):
        read = parse.parse_lines(_lines(spark, sf_dir, LINES[name]))
        return read.select("seq", F.unix_millis("ts").alias("ms"), "level", "message", "user_id", "request_id", "source", "format", "ts_inferred")


_round_trip("winston", "CAST(NULL AS VARCHAR)")
_round_trip("pino", "CAST(NULL AS VARCHAR)")
_round_trip("bunyan", "event_type")

STATUS = "CASE event_type WHEN 'error' THEN 500 WHEN 'click' THEN 404 WHEN 'signup' THEN 201 ELSE 200 END"
MORGAN_LINE = f"concat('::ffff:10.0.0.', CAST(event_id % 250 AS string), ' - - [', date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000] \"GET /', event_type, '/', k, ' HTTP/1.1\" ', {STATUS}, ' ', k)"


@query("parse_morgan", f"WITH {E_SQL} SELECT seq, ms // 1000 * 1000 AS ms, CASE WHEN {STATUS} >= 500 THEN 'error' WHEN {STATUS} >= 400 THEN 'warn' ELSE 'info' END AS level, 'GET /' || event_type || '/' || k || ' ' || {STATUS} AS message, '10.0.0.' || (seq % 250) AS remote, k AS bytes FROM e")
def parse_morgan(spark, sf_dir):
    read = parse.parse_lines(_lines(spark, sf_dir, MORGAN_LINE))
    return read.select("seq", F.unix_millis("ts").alias("ms"), "level", "message", F.col("metadata")["remoteAddr"].alias("remote"), F.col("metadata")["bytes"].alias("bytes"))


PLAIN_LINE = f"""CASE event_id % 4 WHEN 0 THEN concat('[', {STAMP_SQL}, '] ', upper(level), ': ', message) WHEN 1 THEN concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' [', upper(level), '] [svc-', k, '] ', message, ' user=', user)
  WHEN 2 THEN concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' [svc-', k, '] status=', CASE level WHEN 'error' THEN 'failed' WHEN 'warn' THEN 'warn' ELSE 'ok' END, ' user=', user) ELSE concat(date_format(ts, 'yyyy/MM/dd HH:mm:ss'), ' ', upper(level), ' ', message, ' user=', user) END"""


@query(
    "parse_plain",
    f"""WITH {E_SQL} SELECT seq, CASE seq % 4 WHEN 0 THEN ms ELSE ms // 1000 * 1000 END AS ms, CASE WHEN seq % 4 = 2 AND level = 'debug' THEN 'info' ELSE level END AS level,
  CASE seq % 4 WHEN 0 THEN message WHEN 2 THEN 'status=' || CASE level WHEN 'error' THEN 'failed' WHEN 'warn' THEN 'warn' ELSE 'ok' END || ' user=' || user_id ELSE message || ' user=' || user_id END AS message,
  CASE WHEN seq % 4 = 0 THEN NULL ELSE user_id END AS user_id, CASE WHEN seq % 4 IN (1, 2) THEN 'svc-' || k END AS source FROM e""",
)
def parse_plain(spark, sf_dir):
    return parse.parse_lines(_lines(spark, sf_dir, PLAIN_LINE)).select("seq", F.unix_millis("ts").alias("ms"), "level", "message", "user_id", "source")


@query("parse_clf_timestamp", f"WITH {E_SQL} SELECT seq, ms // 1000 * 1000 AS ms FROM e")
def parse_clf_timestamp(spark, sf_dir):
    return _lines(spark, sf_dir, "concat(date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000')").select("seq", F.unix_millis(parse.clf_time(F.col("raw"))).alias("ms"))


@query("kv_extract", f"WITH {E_SQL} SELECT seq, k AS k_value, user_id AS user_value, 2::BIGINT AS n FROM e")
def kv_extract(spark, sf_dir):
    pairs = parse.key_values(F.col("raw"))
    return _lines(spark, sf_dir, "concat('k=first, user=', user, '; k=', k, ' done')").select("seq", pairs["k"].alias("k_value"), pairs["user"].alias("user_value"), F.size(pairs).cast("bigint").alias("n"))


MIXED = f"CASE event_type WHEN 'error' THEN {LINES['winston']} WHEN 'view' THEN {LINES['pino']} WHEN 'click' THEN {MORGAN_LINE} WHEN 'signup' THEN {PLAIN_LINE} ELSE 'no log line at all' END"


@query(
    "detect_format",
    f"WITH {E_SQL} SELECT CASE event_type WHEN 'error' THEN 'winston-json' WHEN 'view' THEN 'pino-json' WHEN 'click' THEN 'morgan' WHEN 'signup' THEN CASE WHEN seq % 4 = 2 THEN 'unknown' ELSE 'plain' END ELSE 'unknown' END AS format, count(*) AS n FROM e GROUP BY 1",
)
def detect_format(spark, sf_dir):
    return _lines(spark, sf_dir, MIXED).groupBy(parse.line_format(F.col("raw")).alias("format")).agg(F.count("*").alias("n"))


@query("parse_counters", f"WITH {E_SQL} SELECT 0::BIGINT AS parse_errors, arg_min(CASE event_type WHEN 'error' THEN 'winston-json' WHEN 'view' THEN 'pino-json' WHEN 'click' THEN 'morgan' ELSE 'plain' END, seq) FILTER (event_type <> 'purchase') AS detected_format, count(*) AS total, count(*) FILTER (event_type <> 'purchase') AS parsed, count(*) FILTER (event_type = 'purchase') AS unparsed_lines, 0::BIGINT AS inferred_timestamps FROM e")
def parse_counters(spark, sf_dir):
    return parse.parse_counters(parse.parse_lines(_lines(spark, sf_dir, MIXED)))


@query("format_confidence", f"WITH {E_SQL}, x AS (SELECT * FROM e ORDER BY seq LIMIT 20) SELECT CAST(count(*) FILTER (event_type <> 'purchase' AND NOT (event_type = 'signup' AND seq % 4 = 2)) AS BIGINT) AS matched, count(*) AS sampled FROM x")
def format_confidence(spark, sf_dir):
    return parse.format_confidence(_lines(spark, sf_dir, MIXED)).select(F.round(F.col("confidence") * F.col("sampled")).cast("bigint").alias("matched"), "sampled")


@query("normalize_level", f"""WITH {E_SQL}, r AS (SELECT seq, CASE seq % 9 WHEN 0 THEN 'WARNING' WHEN 1 THEN 'Critical' WHEN 2 THEN '30' WHEN 3 THEN 'silly' WHEN 4 THEN 'payment' WHEN 5 THEN '0' WHEN 6 THEN ' Debug ' WHEN 7 THEN '60' ELSE event_type END AS raw FROM e)
SELECT seq, CASE seq % 9 WHEN 0 THEN 'warn' WHEN 1 THEN 'fatal' WHEN 5 THEN 'error' WHEN 6 THEN 'debug' WHEN 7 THEN 'fatal' WHEN 8 THEN CASE raw WHEN 'error' THEN 'error' ELSE 'info' END ELSE 'info' END AS level FROM r""")  # fmt: skip
def normalize_levels(spark, sf_dir):
    raw = F.expr("CASE event_id % 9 WHEN 0 THEN 'WARNING' WHEN 1 THEN 'Critical' WHEN 2 THEN '30' WHEN 3 THEN 'silly' WHEN 4 THEN 'payment' WHEN 5 THEN '0' WHEN 6 THEN ' Debug ' WHEN 7 THEN '60' ELSE event_type END")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), normalize_level(raw).alias("level"))


# --- redaction


def redact_sql(column: str) -> str:
    for pattern, ignore, mask, _ in redact.PATTERNS:
        column = f"regexp_replace({column}, '{pattern}', '{mask}', '{'gi' if ignore else 'g'}')"
    return column


PII_SQL = " OR ".join(re2("text", p, "i" if i else "") for p, i, _, _ in redact.PATTERNS)


@query("redact_documents", f"SELECT doc_id, {redact_sql('text')} AS redacted FROM documents")
def redact_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", redact.redact(F.col("text")).alias("redacted"))


@query("redact_pages", f"SELECT page_id, {redact_sql('html')} AS redacted FROM pages")
def redact_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", redact.redact(F.col("html")).alias("redacted"))


@query("contains_pii", f"SELECT doc_id, {PII_SQL} AS has_pii FROM documents")
def contains_pii(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", redact.contains_pii(F.col("text")).alias("has_pii"))


# --- grouping

GROUP_COLUMNS = "group_key, count(*) AS n, min(ms) AS start_ms, max(ms) AS end_ms"


def bounds(grouped: DataFrame) -> DataFrame:
    return grouped.groupBy("group_key").agg(F.count("*").alias("n"), F.min("ms").alias("start_ms"), F.max("ms").alias("end_ms"))


@query("group_by_id", f"WITH {E_SQL} SELECT 'traceId:tr-' || (seq % 97) AS group_key, count(*) AS n, min(ms) AS start_ms, max(ms) AS end_ms FROM e GROUP BY 1")
def group_by_id(spark, sf_dir):
    return bounds(group.assign_keys(log(spark, sf_dir), ("traceId", "requestId", "jobId", "userId")))


@query("merge_same_value_groups", f"""WITH {E_SQL}, x AS (SELECT *, CASE WHEN seq % 2 = 0 THEN 2 ELSE 1 END AS p FROM e), y AS (SELECT *, min(p) OVER (PARTITION BY user_id) AS best FROM x)
SELECT CASE best WHEN 1 THEN 'requestId:' ELSE 'userId:' END || user_id AS group_key, count(*) AS n, min(ms) AS start_ms, max(ms) AS end_ms FROM y GROUP BY 1""")  # fmt: skip
def merge_same_value_groups(spark, sf_dir):
    fields = ("requestId", "userId")
    entries = log(spark, sf_dir).withColumns({"request_id": F.when(F.col("seq") % 2 == 1, F.col("user_id")), "metadata": F.create_map().cast("map<string,string>")})
    return bounds(group.merge_same_value(group.assign_keys(entries, fields), fields))


@query("split_by_gap", f"WITH {E_SQL}, {groups_sql(FIVE_MINUTES)} SELECT {GROUP_COLUMNS} FROM g GROUP BY group_key")
def split_by_gap(spark, sf_dir):
    return bounds(by_user(spark, sf_dir, FIVE_MINUTES))


@query("split_by_gap_6h", f"WITH {E_SQL}, {groups_sql(SIX_HOURS)} SELECT {GROUP_COLUMNS} FROM g GROUP BY group_key")
def split_by_gap_6h(spark, sf_dir):
    return bounds(by_user(spark, sf_dir))


def time_sql(broken: str) -> str:
    return f"""WITH {E_SQL}, y AS (SELECT *, ms - lag(ms) OVER w AS gap, lag(event_type) OVER w AS before FROM e WINDOW w AS (ORDER BY ms, seq)),
z AS (SELECT *, sum(CASE WHEN gap > 5000 {broken} THEN 1 ELSE 0 END) OVER (ORDER BY ms, seq ROWS UNBOUNDED PRECEDING) AS no FROM y)
SELECT 'time:' || CAST(no AS BIGINT) AS group_key, count(*) AS n, min(ms) AS start_ms, max(ms) AS end_ms FROM z GROUP BY 1"""


@query("group_by_time", time_sql(""))
def group_by_time(spark, sf_dir):
    return bounds(group.group_by_time(log(spark, sf_dir), 5000))


@query("group_by_time_component_break", time_sql("OR (event_type <> before AND gap > 2000)"))
def group_by_time_component_break(spark, sf_dir):
    entries = log(spark, sf_dir).withColumn("source", F.col("metadata")["event_type"])
    return bounds(group.group_by_time(entries, 5000))


@query("entity_ids", f"""WITH {E_SQL} SELECT seq, CASE seq % 3 WHEN 0 THEN 'ord-' || user_id WHEN 1 THEN '507f1f77bcf86cd79943' || lpad(CAST(seq % 10000 AS VARCHAR), 4, '0') ELSE '' END AS entities FROM e""")
def entity_ids(spark, sf_dir):
    made = "map('status', 'ok-fine', 'note', 'free text', 'orderId', CASE seq % 3 WHEN 0 THEN concat('ord-', user_id) WHEN 1 THEN concat('507f1f77bcf86cd79943', lpad(CAST(seq % 10000 AS string), 4, '0')) ELSE 'x-' END)"
    return log(spark, sf_dir).withColumn("metadata", F.expr(made)).select("seq", F.array_join(group.entity_ids(F.col("metadata")), ",").alias("entities"))


WORDS_SQL = """kw AS (SELECT seq, ms, list_sort(list_distinct(list_concat(CASE event_type WHEN 'error' THEN ['post', 'timeout', 'path:/checkout'] WHEN 'purchase' THEN ['success'] WHEN 'view' THEN ['get', 'path:/products'] WHEN 'click' THEN ['retry'] ELSE [] END,
  ['level:' || level], list_transform(regexp_extract_all(message, '\\b([45]\\d{2})\\b', 1), lambda x: 'status:' || x)))) AS words FROM e)"""


@query("keyword_vectors", f"WITH {E_SQL}, {WORDS_SQL} SELECT seq, array_to_string(words, ',') AS keywords FROM kw")
def keyword_vectors(spark, sf_dir):
    return group.keywords(log(spark, sf_dir)).select("seq", F.array_join(F.sort_array("keywords"), ",").alias("keywords"))


@query(
    "jaccard_pairs",
    f"""WITH {E_SQL}, {WORDS_SQL}, p AS (SELECT a.seq AS a, b.seq AS b, len(list_intersect(a.words, b.words)) AS both_, len(list_distinct(list_concat(a.words, b.words))) AS either FROM kw a JOIN kw b ON a.seq < b.seq AND abs(a.ms - b.ms) <= 300000)
SELECT a, b, CAST(round(both_ * 100.0 / either) AS BIGINT) AS percent FROM p WHERE both_ >= 0.4 * either""",
)
def jaccard_pairs(spark, sf_dir):
    return group.similar_pairs(log(spark, sf_dir)).select("a", "b", F.round(F.col("similarity") * 100).cast("bigint").alias("percent"))


# --- events


@query("extract_actions", f"WITH {E_SQL}, {ACTIONS_SQL} SELECT seq, type, status, target FROM a")
def extract_actions(spark, sf_dir):
    found = events.actions(F.col("message"), F.col("level"))
    return log(spark, sf_dir).select("seq", F.explode(found).alias("a")).select("seq", "a.type", "a.status", "a.target")


@query("event_outcome", EVENTS_SQL + " SELECT group_key, start_ms, end_ms, end_ms - start_ms AS duration_ms, n_entries, n_errors, outcome FROM ev")
def event_outcome(spark, sf_dir):
    return user_events(spark, sf_dir).select("group_key", "start_ms", "end_ms", "duration_ms", "n_entries", "n_errors", "outcome")


@query("event_dependencies", EVENTS_SQL + ", d AS (SELECT group_key, target, min((ms, seq)) AS first FROM g JOIN a USING (seq) WHERE target IS NOT NULL GROUP BY group_key, target) SELECT group_key, string_agg(target, ',' ORDER BY first) AS dependencies FROM d GROUP BY group_key")
def event_dependencies(spark, sf_dir):
    return user_events(spark, sf_dir).filter(F.size("dependencies") > 0).select("group_key", F.array_join("dependencies", ",").alias("dependencies"))


ZERO = "CASE event_id % 4 WHEN 0 THEN 'run ended errors=0 failures: 0' WHEN 1 THEN 'run ended error=3' WHEN 2 THEN 'panic and error=0' ELSE 'all quiet' END"


@query("zero_count_failure", "SELECT event_id AS seq, event_id % 4 IN (1, 2) AS failed FROM events")
def zero_count_failure(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), events.real_failure(F.expr(ZERO)).alias("failed"))


@query("session_events", """WITH x AS (SELECT conv_id, turn, role, text FROM conversations) SELECT CAST(conv_id AS VARCHAR) AS session, count(*) AS n_turns, count(DISTINCT role) AS n_roles, min(turn) AS first_turn, max(turn) AS last_turn FROM x GROUP BY 1""")
def session_events(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").selectExpr("turn AS seq", "timestamp_millis(turn) AS ts", "CAST(conv_id AS string) AS session_id", "role AS source", "text AS message", "'info' AS level")
    keyed = group.assign_keys(as_entries(turns), ("sessionId",)).filter("group_key is not null")
    return keyed.groupBy(F.col("session_id").alias("session")).agg(F.count("*").alias("n_turns"), F.count_distinct(group.component()).alias("n_roles"), F.min("seq").alias("first_turn"), F.max("seq").alias("last_turn"))


# --- causality and stories


@query("causal_user_chain", CHAINS_SQL + " SELECT group_key, user_id, chain_no FROM c")
def causal_user_chain(spark, sf_dir):
    return causal.user_chains(user_events(spark, sf_dir)).select("group_key", "user_id", "chain_no")


@query("stories", STORIES_SQL + " SELECT story_id, title, outcome, severity, start_ms, end_ms, n_events FROM s")
def stories(spark, sf_dir):
    return user_stories(spark, sf_dir).select("story_id", "title", "outcome", "severity", "start_ms", "end_ms", "n_events")


@query("story_root_causes", STORIES_SQL + " SELECT story_id, 'Stripe timeout — not responding within SLA' AS root_cause FROM s WHERE outcome = 'failure'")
def story_root_causes(spark, sf_dir):
    return user_stories(spark, sf_dir).filter("outcome = 'failure'").select("story_id", "root_cause")


ADVICE_TEXT = "Consider implementing a circuit breaker pattern and checking upstream service health"


@query("story_recommendations", STORIES_SQL + f" SELECT story_id, CASE WHEN times_out THEN '{ADVICE_TEXT}' END AS recommendation FROM s WHERE outcome <> 'success'")
def story_recommendations(spark, sf_dir):
    return user_stories(spark, sf_dir).filter("outcome <> 'success'").select("story_id", "recommendation")


@query("story_impacts", STORIES_SQL + ", w AS (SELECT story_id, string_agg(message, ' ' ORDER BY event_start, group_key, ms, seq) AS joined FROM m GROUP BY story_id) SELECT s.story_id, CASE WHEN regexp_matches(lower(joined), '5\\d{2}|service.?unavailable|503') THEN 'Service degradation — requests returning errors to clients' WHEN times_out THEN 'Increased latency — downstream consumers may be affected' END AS impact FROM s JOIN w USING (story_id) WHERE outcome <> 'success'")
def story_impacts(spark, sf_dir):
    return user_stories(spark, sf_dir).filter("outcome <> 'success'").select("story_id", "impact")


# --- insights

FAILED_COUNT = "SELECT count(*) AS n FROM s WHERE outcome = 'failure'"


@query("recurring_failures", STORIES_SQL + " SELECT 'Recurring failure: Payment provider timeout' AS title, count(*) AS occurrences, CASE WHEN count(*) >= 3 THEN 'critical' ELSE 'high' END AS severity, min(start_ms) AS start_ms FROM s WHERE outcome = 'failure' HAVING count(*) >= 2")
def recurring_failures(spark, sf_dir):
    return insights.recurring_failures(user_stories(spark, sf_dir)).select("title", "occurrences", "severity", "start_ms")


@query("service_degradation", STORIES_SQL + ", d AS (SELECT DISTINCT c.user_id || '/' || c.chain_no AS story_id, target FROM c JOIN g USING (group_key) JOIN a USING (seq) WHERE target IS NOT NULL) SELECT 'Service degradation: ' || target AS title, count(*) AS occurrences, CASE WHEN count(*) >= 3 THEN 'critical' ELSE 'high' END AS severity FROM s JOIN d USING (story_id) WHERE outcome = 'failure' GROUP BY target HAVING count(*) >= 2")
def service_degradation(spark, sf_dir):
    return insights.service_degradation(fixed_stories(spark, sf_dir)).select("title", "occurrences", "severity")


SUMMARY_SQL = STORIES_SQL + """, n AS (SELECT count(*) AS total, count(*) FILTER (outcome = 'failure') AS failures, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (outcome = 'success') AS successes FROM s)
SELECT total, failures, critical, successes FROM n"""


@query("story_counts", SUMMARY_SQL)
def story_counts(spark, sf_dir):
    count: Callable[[Column], Column] = F.count_if
    return user_stories(spark, sf_dir).agg(F.count("*").alias("total"), count(F.col("outcome") == "failure").alias("failures"), count(F.col("severity") == "critical").alias("critical"), count(F.col("outcome") == "success").alias("successes"))


@query("run_stats", STORIES_SQL + " SELECT (SELECT count(*) FROM e) AS total_entries, (SELECT count(*) FROM e WHERE level IN ('error', 'fatal')) AS errors_detected, 0::BIGINT AS inferred_timestamps, (SELECT count(*) FROM ev) AS events_extracted, (SELECT count(*) FROM ev) AS groups_found, (SELECT count(*) FROM s) AS stories_generated, 0::BIGINT AS ai_calls_made, 0::DOUBLE AS estimated_cost")
def run_stats(spark, sf_dir):
    return insights.run_stats(log(spark, sf_dir), user_events(spark, sf_dir), user_stories(spark, sf_dir).select("story_id"))


# --- rendering, local texts, streaming


@query("timeline_lines", STORIES_SQL + """, p AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY event_start, group_key, ms, seq) AS pos, count(*) OVER (PARTITION BY story_id) AS n FROM m)
SELECT story_id, CAST(pos AS INTEGER) AS pos, strftime(make_timestamp(ms * 1000), '%H:%M:%S') || ' ' || CASE WHEN n = 1 THEN '── ' WHEN pos = 1 THEN '┬─ ' WHEN pos = n THEN '└─ ' ELSE '├─ ' END || message AS line FROM p UNION ALL SELECT story_id, 0, '● ' || title FROM s""")  # fmt: skip
def timeline_lines(spark, sf_dir):
    return render.timeline(user_stories(spark, sf_dir))


@query("slowest_stories_topk", STORIES_SQL + " SELECT story_id, end_ms - start_ms AS duration_ms FROM s ORDER BY duration_ms DESC, start_ms, story_id LIMIT 3")
def slowest_stories_topk(spark, sf_dir):
    return providers.slowest(user_stories(spark, sf_dir)).select("story_id", "duration_ms")


@query("clock_times", f"WITH {E_SQL} SELECT seq, strftime(make_timestamp(ms * 1000), '%H:%M:%S') AS clock FROM e")
def clock_times(spark, sf_dir):
    return log(spark, sf_dir).select("seq", clock(F.col("ms")).alias("clock"))


@query("user_sessions", f"WITH {E_SQL}, {groups_sql(FIVE_MINUTES)} SELECT user_id, min(ms) AS start_ms, max(ms) + 300000 AS end_ms, count(*) AS n_entries, count(*) FILTER (level = 'error') AS n_errors FROM g GROUP BY user_id, part")
def sessions(spark, sf_dir):
    return user_sessions(log(spark, sf_dir))


@query("stream_sessions_once", ORACLE_SQL["user_sessions"])
def stream_sessions_once(spark, sf_dir):
    """The same sessions through Structured Streaming over the event files."""
    path = f"{sf_dir}/events.parquet"
    fresh = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # a pattern, as the table may be one file
    entries = fresh.selectExpr("CAST(ts AS timestamp) AS ts", "CAST(user_id AS string) AS user_id", f"{LEVEL} AS level")
    return run_once(user_sessions(entries), f"{shared_folder(spark)}/sessions-{uuid.uuid4().hex}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories of the log with their texts."""
    session_defaults(spark)
    return user_stories(spark, sf_dir).select("story_id", "title", "outcome", "severity", "narrative", "root_cause", "impact", "recommendation", "start_ms", "end_ms", "duration_ms", "n_events")
