"""Parsers of log lines as one Column each: a line becomes an entry struct, or null if it is not of that format.

JSON lines are read once as VARIANT; the shape of each object decides its format. ``parse_lines`` dispatches per line and
falls back to plain text. Nothing here needs more than a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import level_from_message, level_from_status, normalize_level
from ..functions.text import has, js
from .schema import ENTRY

# fixed values: level words, time stamps, line shapes that count as a format, and those that parse
LEVELS = "DEBUG|INFO|WARN|WARNING|ERROR|FATAL|CRITICAL"
STAMP = r"\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}[^\s]*"
MORGAN = r'^(?:::ffff:)?(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}|[\w.-]+)\s+-\s+(?:\S+|-)\s+\[([^\]]+)\]\s+"(\w+)\s+([^\s"]+)\s+HTTP/[\d.]+"\s+(\d{3})\s+(\d+|-)'
PLAIN_SHAPES = (rf"^\[([^\]]+)\]\s*({LEVELS})[:\s]", rf"^{STAMP}\s+({LEVELS})\s", rf"^{STAMP}\s+\[({LEVELS})\]")
PLAIN_A = rf"^\[([^\]]+)\]\s*({LEVELS})[:\s]+(.+)"
PLAIN_B = rf"^({STAMP})\s+\[({LEVELS})\]\s+(?:\[([^\]]+)\]\s*)?(.+)"
PLAIN_C = rf"^({STAMP})\s+\[([^\]]+)\]\s+(.+)"
PLAIN_D = rf"^({STAMP})\s+({LEVELS}|REQUEST|PAYMENT|CACHE|DB)\s+(.+)"
PAIR = r"(\w+)=([^\s,;)}\]]+)"
# fixed values: aliases of the correlation ids, first wins
REQUEST = ("requestId", "request_id", "reqId", "req_id", "correlation_id", "x-request-id")
USER = ("userId", "user_id", "uid", "user", "actor", "sub", "account_id")
SESSION = ("sessionId", "session_id", "sessId")
TRACE = ("traceId", "trace_id")
JOB = ("jobId", "job_id", "job", "jid", "task_id")
TEXT_REQUEST = ("request_id", "requestId", "reqId", "correlation_id", "x-request-id")
TEXT_USER = ("user", "userId", "user_id", "uid", "actor", "sub", "account_id")
TEXT_JOB = ("job_id", "job", "jid", "task_id", "jobId")


def json_object(line: Column) -> Column:
    """The line as VARIANT if it is one whole JSON object."""
    text = F.trim(line)
    return F.when(text.rlike(r"^\{") & text.rlike(r"\}\s*$"), F.try_parse_json(text))


def field(v: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$['{name}']", kind)


def first_field(v: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[field(v, n) for n in names])


def kind_of(v: Column, name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, f"$['{name}']", "variant"))


def present(v: Column, name: str) -> Column:
    return kind_of(v, name).isNotNull()


def numeric(v: Column, name: str) -> Column:
    return F.coalesce(kind_of(v, name).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.lit(False))


def json_format(v: Column) -> Column:
    """bunyan-json, pino-json, winston-json, or unknown for other objects; null where there is no object."""
    stamped = present(v, "time") | present(v, "timestamp")
    return (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when(present(v, "v") & present(v, "name") & numeric(v, "level") & present(v, "msg"), "bunyan-json")
        .when(numeric(v, "level") & present(v, "msg") & stamped, "pino-json")
        .when((kind_of(v, "level") == "STRING") & present(v, "message"), "winston-json")
        .otherwise("unknown")
    )


def line_format(line: Column) -> Column:
    text = F.trim(line)
    plain = has(text, PLAIN_SHAPES[0]) | has(text, PLAIN_SHAPES[1]) | has(text, PLAIN_SHAPES[2])
    return F.coalesce(json_format(json_object(line)), F.when(has(text, MORGAN, False), "morgan").when(plain, "plain"), F.lit("unknown"))


def parsed_time(text: Column) -> Column:
    """A timestamp of date-time text (no offset: UTC), null if it is none."""
    return F.regexp_replace(text, r"^(\d{4})/(\d{2})/(\d{2})", "$1-$2-$3").try_cast("timestamp")


def clf_time(text: Column) -> Column:
    found = F.regexp_extract(text, r"(\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2})", 1)
    zone = F.coalesce(F.nullif(F.regexp_extract(text, r"\d{2}:\d{2}:\d{2}\s*([+-]\d{4})", 1), F.lit("")), F.lit("+0000"))
    return F.try_to_timestamp(F.concat_ws(" ", found, zone), F.lit("dd/MMM/yyyy:HH:mm:ss Z"))


def key_values(message: Column) -> Column:
    """All key=value pairs; of repeated keys the last counts (needs spark.sql.mapKeyDedupPolicy=LAST_WIN)."""
    return F.map_from_arrays(F.regexp_extract_all(message, F.lit(PAIR), F.lit(1)), F.regexp_extract_all(message, F.lit(PAIR), F.lit(2)))


def _entry(**given: Column) -> Column:
    """An entry struct without seq and raw; unnamed fields are null. An unreadable time becomes the query's time, flagged."""
    given["ts_inferred"] = given["ts"].isNull()
    given["ts"] = F.coalesce(given["ts"], F.current_timestamp())
    given["level"] = F.coalesce(given["level"], F.lit("info"))
    given.setdefault("metadata", F.create_map().cast("map<string,string>"))
    fields = [f for f in ENTRY.fields if f.name not in ("seq", "raw")]
    return F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def json_time(v: Column, *names: str) -> Column:
    at = [F.coalesce(F.when(numeric(v, n), F.timestamp_millis(field(v, n, "bigint"))), parsed_time(field(v, n))) for n in names]
    return F.coalesce(*at)


def _json_rest(v: Column, *gone: str) -> Column:
    rest = F.coalesce(v.try_cast("map<string,string>") if hasattr(v, "try_cast") else v.cast("map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.map_filter(rest, lambda k, _: ~k.isin(*gone))


def parse_winston(v: Column) -> Column:
    user = F.coalesce(first_field(v, ("userId", "user_id", "uid")), F.when(kind_of(v, "user").rlike("^OBJECT"), F.coalesce(F.try_variant_get(v, "$.user.id", "string"), F.try_variant_get(v, "$.user.userId", "string"))).otherwise(field(v, "user")), first_field(v, ("actor", "sub", "account_id")))
    return _entry(
        ts=json_time(v, "timestamp"), level=normalize_level(field(v, "level")), message=F.coalesce(field(v, "message"), F.lit("")), metadata=_json_rest(v, "level", "message", "timestamp"),
        request_id=first_field(v, REQUEST), user_id=user, session_id=first_field(v, SESSION), trace_id=first_field(v, (*TRACE, "spanId")), job_id=first_field(v, JOB), format=F.lit("winston-json"),
    )


def _numeric_level(v: Column) -> Column:
    n = field(v, "level", "bigint")
    return F.when(n.isin(10, 20), "debug").when(n == 30, "info").when(n == 40, "warn").when(n == 50, "error").when(n == 60, "fatal").otherwise(normalize_level(n))


def parse_pino(v: Column) -> Column:
    return _entry(
        ts=json_time(v, "time", "timestamp"), level=_numeric_level(v), message=F.coalesce(field(v, "msg"), F.lit("")), metadata=_json_rest(v, "level", "msg", "time", "timestamp"),
        request_id=F.coalesce(first_field(v, ("reqId", "requestId", "request_id", "req_id", "correlation_id", "x-request-id")), F.try_variant_get(v, "$.req.id", "string")),
        user_id=first_field(v, ("userId", "uid", "user", "actor", "sub", "account_id")), session_id=first_field(v, SESSION), trace_id=first_field(v, TRACE), job_id=first_field(v, JOB), format=F.lit("pino-json"),
    )


def parse_bunyan(v: Column) -> Column:
    service = F.create_map(F.lit("service"), field(v, "name"))
    return _entry(
        ts=json_time(v, "time"), level=_numeric_level(v), message=F.coalesce(field(v, "msg"), F.lit("")), metadata=F.map_concat(_json_rest(v, "level", "msg", "time", "v", "name", "service"), service), source=field(v, "name"),
        request_id=F.coalesce(first_field(v, ("reqId", "requestId", "request_id", "req_id", "correlation_id", "x-request-id")), F.try_variant_get(v, "$.req.id", "string")),
        user_id=first_field(v, USER), session_id=first_field(v, SESSION), trace_id=first_field(v, TRACE), job_id=first_field(v, JOB), format=F.lit("bunyan-json"),
    )


def parse_morgan(line: Column) -> Column:
    part = lambda k: F.regexp_extract(line, MORGAN, k)
    status = part(5).try_cast("int")
    given = F.create_map(F.lit("method"), part(3), F.lit("path"), part(4), F.lit("status"), part(5), F.lit("bytes"), F.regexp_replace(part(6), "^-$", "0"), F.lit("remoteAddr"), part(1))
    entry = _entry(ts=clf_time(part(2)), level=level_from_status(status), message=F.concat_ws(" ", part(3), part(4), part(5)), metadata=given, format=F.lit("morgan"))
    return F.when(line.rlike(MORGAN), entry.withField("ts_inferred", F.lit(False)))


def parse_plain(line: Column) -> Column:
    """The four plain shapes, tried in order."""

    def pick(pairs: Column, names: tuple[str, ...]) -> Column:
        return F.coalesce(*[F.try_element_at(pairs, F.lit(n)) for n in names])

    def with_pairs(shape: str, stamp: int, level, component: int | None, message: int, request: tuple[str, ...]) -> Column:
        text = F.trim(F.regexp_extract(line, js(shape, True), message))
        own = F.nullif(F.regexp_extract(line, js(shape, True), component), F.lit("")) if component else F.lit(None).cast("string")
        pairs = key_values(text)
        metadata = F.map_concat(pairs, F.when(own.isNotNull(), F.create_map(F.lit("component"), own)).otherwise(F.create_map().cast("map<string,string>"))) if component else pairs
        entry = _entry(
            ts=parsed_time(F.regexp_extract(line, js(shape, True), stamp)), level=level(text, pairs), message=text, metadata=metadata, source=own,
            request_id=pick(pairs, request), user_id=pick(pairs, TEXT_USER), job_id=pick(pairs, TEXT_JOB), format=F.lit("plain"),
        )
        return F.when(has(line, shape), entry)

    def named(shape: str, group: int):
        return lambda *_: normalize_level(F.regexp_extract(line, js(shape, True), group))

    def told(text: Column, pairs: Column) -> Column:
        status = F.lower(F.try_element_at(pairs, F.lit("status")))
        return F.when(status.isin("warn", "warning"), "warn").when(status.isin("error", "fail", "failed"), "error").otherwise(level_from_message(text))

    a = _entry(ts=parsed_time(F.regexp_extract(line, js(PLAIN_A, True), 1)), level=named(PLAIN_A, 2)(), message=F.trim(F.regexp_extract(line, js(PLAIN_A, True), 3)), format=F.lit("plain"))
    return F.coalesce(
        F.when(has(line, PLAIN_A), a),
        with_pairs(PLAIN_B, 1, named(PLAIN_B, 2), 3, 4, ("id", *TEXT_REQUEST)),
        with_pairs(PLAIN_C, 1, told, 2, 3, (*TEXT_REQUEST, "id")),
        with_pairs(PLAIN_D, 1, named(PLAIN_D, 2), None, 3, ("id", *TEXT_REQUEST)),
    )


def parse_object(v: Column) -> Column:
    """A JSON object that is a record whatever its shape: any of the formats' names for a field will do."""
    user = F.coalesce(first_field(v, ("userId", "user_id", "uid")), F.when(kind_of(v, "user").rlike("^OBJECT"), F.coalesce(F.try_variant_get(v, "$.user.id", "string"), F.try_variant_get(v, "$.user.userId", "string"))).otherwise(field(v, "user")), first_field(v, ("actor", "sub", "account_id")))
    request = F.coalesce(first_field(v, ("requestId", "request_id", "reqId")), F.try_variant_get(v, "$.req.id", "string"), first_field(v, ("req_id", "correlation_id", "x-request-id")))
    return _entry(
        ts=F.when(present(v, "timestamp"), json_time(v, "timestamp")).otherwise(json_time(v, "time")), level=normalize_level(field(v, "level")), message=F.coalesce(first_field(v, ("message", "msg")), F.lit("")),
        metadata=_json_rest(v, "level", "message", "msg", "timestamp", "time"), request_id=request, user_id=user, session_id=first_field(v, SESSION), trace_id=first_field(v, (*TRACE, "spanId")), job_id=first_field(v, JOB),
    )


def parse_objects(records: DataFrame) -> DataFrame:
    """JSON records ``(seq, raw)`` to entries; what is no object keeps ``parsed = false``.

    ``record_format`` is the format that a record looks like (the first parsed one's names that of all).
    """
    read = records.withColumn("__v", F.try_parse_json("raw")).withColumn("__v", F.when(F.schema_of_variant("__v").startswith("OBJECT"), F.col("__v")))
    v = F.col("__v")
    out = read.withColumn("__e", F.when(v.isNotNull(), parse_object(v)))
    fields = [f.name for f in ENTRY.fields if f.name not in ("seq", "raw")]
    kind = F.when(v.isNotNull(), F.when(present(v, "msg") & (present(v, "time") | present(v, "timestamp")), "pino-json").otherwise("winston-json"))
    return out.select("seq", *[F.col(f"__e.{n}").alias(n) for n in fields], "raw", F.col("__e").isNotNull().alias("parsed"), kind.alias("record_format"))


def parse_lines(lines: DataFrame, fmt: str | None = None) -> DataFrame:
    """Lines ``(seq, raw)`` to entries; unparsed lines keep ``parsed = false``. With ``fmt`` one parser takes all lines."""
    with_json = lines.filter(F.col("raw").rlike(r"\S")).withColumn("__v", json_object(F.col("raw")))
    v, raw = F.col("__v"), F.col("raw")
    by_format = {"winston-json": parse_winston(v), "pino-json": parse_pino(v), "bunyan-json": parse_bunyan(v), "morgan": parse_morgan(raw), "plain": parse_plain(raw)}
    if fmt:
        entry = F.when(v.isNotNull(), by_format[fmt]) if fmt.endswith("json") else by_format[fmt]
    else:
        kind = json_format(v)
        entry = F.coalesce(*[F.when(kind == name, by_format[name]) for name in ("bunyan-json", "pino-json", "winston-json")], by_format["morgan"], by_format["plain"])
    out = with_json.withColumn("__e", entry)
    fields = [f.name for f in ENTRY.fields if f.name not in ("seq", "raw")]
    return out.select("seq", *[F.col(f"__e.{n}").alias(n) for n in fields], "raw", F.col("__e").isNotNull().alias("parsed"))


def counter_columns(parsed: DataFrame) -> list[Column]:
    """Aggregates: total, parsed, unparsed_lines, inferred_timestamps, parse_errors, detected_format.

    Lines that fit no format are unparsed, records that are no objects are errors. The first parsed row names the format.
    """
    records = "record_format" in parsed.columns
    failed = F.count_if(~F.col("parsed"))
    first = F.min_by(F.col("record_format" if records else "format"), F.when(F.col("parsed"), F.col("seq")))
    return [
        (F.lit(0).cast("bigint") if not records else failed).alias("parse_errors"), F.coalesce(first, F.lit("unknown")).alias("detected_format"), F.count("*").alias("total"), F.count_if("parsed").alias("parsed"), (F.lit(0).cast("bigint") if records else failed).alias("unparsed_lines"), F.count_if(F.col("parsed") & F.col("ts_inferred")).alias("inferred_timestamps")
    ]


def parse_counters(parsed: DataFrame) -> DataFrame:
    """One row of the counters; what writes the parsed rows can observe them on the way instead."""
    return parsed.agg(*counter_columns(parsed))


def detect_format(lines: DataFrame, sample: int = 20) -> DataFrame:
    """One row ``(format)`` for a whole file: the first JSON or access line of the sample decides, else the first plain one."""
    some = lines.orderBy("seq").limit(sample).withColumn("raw_format", line_format(F.col("raw"))).withColumn("object", json_object(F.col("raw")).isNotNull())
    first = F.min_by("raw_format", F.when(F.col("object") | (F.col("raw_format") == "morgan"), F.col("seq")))
    plain = F.min_by("raw_format", F.when(F.col("raw_format") == "plain", F.col("seq")))
    return some.agg(F.coalesce(first, plain, F.lit("unknown")).alias("format"))


def format_confidence(lines: DataFrame, sample: int = 20) -> DataFrame:
    """One row ``(confidence, sampled, unmatched)``; blank lines count as matched, up to five unmatched lines are shown."""
    some = lines.orderBy("seq").limit(sample).withColumn("ok", ~F.col("raw").rlike(r"\S") | (line_format(F.col("raw")) != "unknown"))
    missed = F.slice(F.transform(F.sort_array(F.collect_list(F.when(~F.col("ok"), F.struct("seq", "raw")))), lambda x: x["raw"]), 1, 5)
    return some.agg(F.coalesce(F.avg(F.col("ok").cast("double")), F.lit(0.0)).alias("confidence"), F.count("*").alias("sampled"), missed.alias("unmatched"))
