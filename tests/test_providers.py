"""Text services, their cache, the command line's choice of one, and what an analysis tells of their use."""

import argparse
import json

import pytest
from pyspark.sql import functions as F

from logweave.plans import cli, providers, render
from logweave.plans.analyzer import Analyzer, Config


class Busy(Exception):
    status = 429


@pytest.fixture(autouse=True)
def _fresh_cache():
    providers.clear_cache()


def test_cache_forgets_the_old_and_the_unused():
    now = [0.0]
    cache = providers.ResponseCache(size=2, seconds=10, clock=lambda: now[0])
    cache.put("a", "1")
    cache.put("b", "2")
    assert cache.get("a") == "1"
    cache.put("c", "3")
    assert cache.get("b") is None and cache.get("a") == "1" and len(cache) == 2
    now[0] = 11.0
    assert cache.get("a") is None and cache.get("c") is None and len(cache) == 0
    cache.put("e", "")
    assert cache.get("e") is None


def test_a_service_is_asked_once_tries_again_and_has_its_price():
    seen, pauses = [], []

    def send(request):
        seen.append(request)
        if len(seen) == 1:
            raise Busy
        return f" told {request['prompt']} "

    own = providers.get_provider("anthropic", send)
    own.sleep = pauses.append
    assert own.narrative("p") == "told p" == own.narrative("p") and len(seen) == 2 and len(pauses) == 1
    assert own.root_cause("p") == "told p" and seen[-1]["max_tokens"] == 100
    assert own.answer("why", "- x") == own.answer("why", "- x") and len(seen) == 5 and "Question: why" in seen[-1]["prompt"]
    assert own.cost(500) == pytest.approx(0.5 * (0.6 * 0.003 + 0.4 * 0.015)) and providers.get_provider("gemini", send).cost(1000) == pytest.approx(0.00015)
    assert providers.get_provider("local") is None
    with pytest.raises(ValueError, match="unknown provider"):
        providers.get_provider("other", send)


def test_the_command_line_chooses_a_provider(monkeypatch):
    monkeypatch.setattr(cli, "make_sender", lambda name, key: lambda request: f"{name} {key}")
    given = lambda **k: argparse.Namespace(**{"ai_provider": None, "no_ai": False, **k})
    assert cli.chosen_provider(given(), "sk-ant-1").name == "anthropic" and cli.chosen_provider(given(ai_provider="gemini"), "sk-1").name == "gemini"
    assert cli.chosen_provider(given(no_ai=True), "sk-1") is None and cli.chosen_provider(given(), None) is None
    asked = cli.parser().parse_args(["analyze", "f", "--no-ai", "--ai-provider", "openai", "--debug-parse", "-v"])
    assert (asked.no_ai, asked.ai_provider, asked.debug_parse, asked.verbose) == (True, "openai", True, True)


def test_analysis_counts_calls_and_unparsed_lines(spark):
    def answering(request):  # within the test, so that it is sent to the workers by value
        return "A TOLD STORY" if request["max_tokens"] == 200 else "A CAUSE"

    text = "\n".join(
        ['{"level":"error","message":"boom","timestamp":"2024-05-01T10:00:00Z","requestId":"r-1"}', '{"level":"info","message":"fine now","timestamp":"2024-05-01T12:00:00Z","requestId":"r-2"}', "no log line"]
    )
    result = Analyzer(spark, Config(provider=providers.get_provider("openai", answering))).analyze(text)
    stats = result.stats.first()
    assert (stats.total_entries, stats.unparsed_lines, stats.stories_generated, stats.errors_detected) == (2, 1, 2, 1)
    assert stats.ai_calls_made == 3 and stats.estimated_cost == pytest.approx(1.3 * (0.6 * 0.00015 + 0.4 * 0.0006)) and stats.processing_time_ms > 0
    told = {r.outcome: r for r in result.stories.collect()}
    assert told["failure"].narrative == "A TOLD STORY" and told["failure"].root_cause == "A CAUSE" and told["success"].root_cause is None
    assert [r.raw for r in result.rejects.collect()] == ["no log line"]


def test_reports_are_written_in_order(spark, tmp_path):
    text = "\n".join(f'{{"level":"info","message":"login success","timestamp":"2024-05-0{9 - k}T10:00:00Z","requestId":"r-{k}"}}' for k in range(3))
    result = Analyzer(spark).analyze(text)
    for style, lines in (("timeline", 7), ("json", 4)):
        render.write_report(result, f"{tmp_path}/{style}", style)
        written = "".join(part.read_text() for part in sorted((tmp_path / style).glob("part-*"))).splitlines()
        assert len(written) == lines and written[-1] == result.summary.first().summary
    assert [json.loads(line)["timeRange"]["start"][:10] for line in written[:3]] == ["2024-05-07", "2024-05-08", "2024-05-09"]


def test_json_records_of_any_shape(spark):
    result = Analyzer(spark).analyze_json([{"level": "error", "msg": "bare"}, {"message": 5, "time": 1714557600000, "req": {"id": "r9"}, "user": {"id": "u"}}, ["no", "object"]])
    got = sorted((r.message, r.level, r.request_id, r.user_id, r.ts_inferred) for r in result.entries.collect())
    assert got == [("5", "info", "r9", "u", False), ("bare", "error", None, None, True)]
    array = Analyzer(spark).analyze('[{"level":"warn","msg":"x","time":1714557600000}, {"level":"fatal","message":"y","time":1714567600000}]')
    assert sorted(r.level for r in array.entries.collect()) == ["fatal", "warn"] and array.stats.select(F.col("unparsed_lines")).first()[0] == 0
