"""Parsing and format detection on hand-written lines."""

import pytest
from pyspark.sql import functions as F

from logweave.operators import parse
from logweave.plans.analyzer import Analyzer, UnrecognisedFormat, session_defaults
from logweave.sources.lines import json_array_lines, json_array_records, text_lines


@pytest.fixture(autouse=True)
def _session(spark):
    session_defaults(spark)


def rows(spark, text):
    return parse.parse_lines(text_lines(spark, text)).orderBy("seq").collect()


def test_winston_and_pino_and_bunyan(spark):
    text = "\n".join(
        [
            '{"level":"error","message":"boom","timestamp":"2024-05-01T10:00:00.250Z","requestId":"r-1","user":{"id":"u7"},"extra":1}',
            '{"level":30,"msg":"hello","time":1714557600000,"reqId":"r-2"}',
            '{"v":0,"name":"billing","level":60,"msg":"gone","time":"2024-05-01T10:00:01Z","job_id":"j-1"}',
        ]
    )
    a, b, c = rows(spark, text)
    assert (a.level, a.message, a.request_id, a.user_id, a.format) == ("error", "boom", "r-1", "u7", "winston-json")
    assert a.metadata["extra"] == "1" and a.ts.microsecond == 250_000
    assert (b.level, b.message, b.request_id, b.format) == ("info", "hello", "r-2", "pino-json")
    assert (c.level, c.source, c.job_id, c.format, c.metadata["service"]) == ("fatal", "billing", "j-1", "bunyan-json", "billing")


def test_access_and_plain_lines(spark):
    text = "\n".join(
        [
            '::ffff:10.1.2.3 - - [01/May/2024:10:30:00 +0200] "GET /api/things HTTP/1.1" 503 -',
            "[2024-05-01T10:00:00Z] WARN: disk nearly full",
            "2024-05-01 10:00:00 [ERROR] [db] query failed user=u1 request_id=r9",
            "2024-05-01 10:00:01 [cron] task=prune status=failed",
            "2024/05/01 10:00:02 PAYMENT accepted id=p1",
            "nothing to see",
        ]
    )
    m, a, b, c, d, none = rows(spark, text)
    assert (m.level, m.message, m.metadata["bytes"], m.metadata["remoteAddr"]) == ("error", "GET /api/things 503", "0", "10.1.2.3")
    assert m.ts.hour == 8
    assert (a.level, a.message, dict(a.metadata)) == ("warn", "disk nearly full", {})
    assert (b.level, b.source, b.user_id, b.request_id) == ("error", "db", "u1", "r9")
    assert (c.level, c.source, c.metadata["task"]) == ("error", "cron", "prune")
    assert (d.level, d.request_id) == ("info", "p1")
    assert not none.parsed and none.raw == "nothing to see"


def test_empty_text_and_unreadable_time(spark):
    assert rows(spark, "") == []
    (r,) = rows(spark, '{"level":"info","message":"x","timestamp":"soon"}')
    assert r.ts_inferred


def test_later_pairs_win(spark):
    got = spark.range(1).select(parse.key_values(F.lit("a=1 b=2 a=3")).alias("m")).first()["m"]
    assert got == {"a": "3", "b": "2"}


def test_gate_and_array(spark):
    with pytest.raises(UnrecognisedFormat):
        Analyzer(spark).analyze("\n".join(f"line {k} of prose" for k in range(8)))
    assert json_array_lines(spark, '[{"level":"info","message":"a"}]').count() == 1
    assert json_array_lines(spark, "[2024-05-01T10:00:00Z] WARN: x") is None
    assert parse.detect_format(text_lines(spark, "junk\n[2024-05-01T10:00:00Z] WARN: x")).first()["format"] == "plain"


def test_records_of_several_arrays_have_numbers_of_their_own(spark):
    texts = spark.createDataFrame([('[{"a":1},{"a":2}]', 0), ('[{"a":3},{"a":4}]', 7), ("no array", 8)], "text string, n bigint")
    assert sorted((r.seq, r.raw) for r in json_array_records(texts, "n").collect()) == [(0, '{"a":1}'), (1, '{"a":2}'), (7 << 32, '{"a":3}'), ((7 << 32) + 1, '{"a":4}')]
