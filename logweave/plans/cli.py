"""Command line: ``python -m logweave.plans.cli analyze|query|watch``."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

from ..operators.filters import build_filter
from ..operators.group import PRESETS
from ..sources.lines import load_config
from ..streaming.stream import watch
from .analyzer import Analyzer, Config
from .providers import SERVICES, Provider, get_provider, provider_of_key


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="logweave")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("analyze", "query", "watch"):
        one = commands.add_parser(name)
        one.add_argument("file" if name != "query" else "question", nargs="?" if name == "analyze" else None)
        one.add_argument("--format", choices=("cli", "json", "timeline"), default="cli")
        one.add_argument("--group-by", choices=tuple(PRESETS), default="auto")
        one.add_argument("--level")
        one.add_argument("--user")
        one.add_argument("--ai-provider", choices=(*SERVICES, "local"))
        one.add_argument("--no-ai", action="store_true")
        one.add_argument("--debug-parse", action="store_true")
        one.add_argument("-v", "--verbose", action="store_true")
        if name != "watch":
            for option in ("--after", "--before", "--request-id", "--context"):
                one.add_argument(option)
        else:
            one.add_argument("--interval", type=int, default=1000)
    return top


#: Makes the function that sends a provider's requests from the provider's name and a key; a deployment sets its own.
make_sender: Callable[[str, str], Callable[[dict], str]] | None = None


def chosen_provider(given: argparse.Namespace, key: str | None) -> Provider | None:
    """By the option, or by the key's prefix; none without a key, a sender, or where it is not wanted."""
    name = given.ai_provider or provider_of_key(key)
    if given.no_ai or not key or name == "local" or make_sender is None:
        return None
    return get_provider(name, make_sender(name, key))


def main(arguments: list[str] | None = None) -> int:
    given = parser().parse_args(arguments)
    chosen = load_config() | {k: v for k, v in vars(given).items() if v is not None}
    spark = SparkSession.builder.appName("logweave").getOrCreate()
    wanted = build_filter(chosen.get("level"), chosen.get("after"), chosen.get("before"), chosen.get("user"), chosen.get("request_id"))
    provider = chosen_provider(given, os.environ.get("LOGWEAVE_API_KEY"))
    analyzer = Analyzer(spark, Config(grouping=PRESETS[chosen["group_by"]], filter=wanted, provider=provider))
    if given.command == "watch":
        watch(spark, given.file, lambda result: print(analyzer.format(result, given.format)), analyzer.config, max(500, given.interval)).awaitTermination()
        return 0
    path = given.file if given.command == "analyze" else chosen.get("context")
    text = None if path and os.path.exists(path) else "" if sys.stdin.isatty() else sys.stdin.read()
    result = analyzer.analyze_file(path) if text is None else analyzer.analyze(text)
    if given.debug_parse:
        for row in result.rejects.orderBy("seq").toLocalIterator():
            print(f"unparsed line {row['seq']}: {row['raw']}", file=sys.stderr)
    if given.verbose:
        print(result.stats.first().asDict(), file=sys.stderr)
    print(analyzer.format(result, given.format) if given.command == "analyze" else analyzer.query(given.question, result))
    return 0


if __name__ == "__main__":
    sys.exit(main())
