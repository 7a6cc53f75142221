"""The whole analysis as one lazy plan: lines to entries, groups, events, stories, insights, summary and statistics."""

from __future__ import annotations

import time
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import causal, events, insights
from ..operators.filters import Filter, apply_filter
from ..operators.group import Grouping, group_entries
from ..operators.parse import counter_columns, format_confidence, parse_lines, parse_objects
from ..operators.redact import Redaction, redact_entries
from ..operators.schema import as_entries
from ..sources import lines as sources
from . import providers, render
from .graph import Tables

LEAST_CONFIDENCE, GATE_LINES = 0.7, 5
MOST_UNPARSED, UNPARSED_LINES = 0.9, 10


class UnrecognisedFormat(ValueError):
    """The input does not look like a supported log."""


@dataclass(frozen=True)
class Config:
    grouping: Grouping = field(default_factory=Grouping)
    filter: Filter = field(default_factory=Filter)
    redaction: Redaction = field(default_factory=lambda: Redaction(enabled=False))
    max_input_size: int | None = None
    provider: providers.Provider | None = None


@dataclass
class Analysis:
    """What is found, as tables in the shared folder that stay until ``drop``."""

    entries: DataFrame
    rejects: DataFrame
    grouped: DataFrame
    events: DataFrame
    stories: DataFrame
    insights: DataFrame
    insight_events: DataFrame
    summary: DataFrame
    stats: DataFrame
    tables: Tables

    def drop(self) -> None:
        """Delete the tables, once nothing reads the analysis any more."""
        self.tables.drop()


def session_defaults(spark: SparkSession) -> None:
    """UTC, the last of repeated keys in key=value text, and tables of nested rows read row by row."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    # a row can hold all entries of a group, and a batch of columns thousands of rows
    spark.conf.set("spark.sql.parquet.enableNestedColumnVectorizedReader", "false")


class Analyzer:
    def __init__(self, spark: SparkSession, config: Config | None = None):
        self.spark, self.config = spark, config or Config()
        session_defaults(spark)

    def analyze(self, source: str | DataFrame) -> Analysis:
        """A text, or lines ``(seq, raw)``. Raises ``UnrecognisedFormat`` for what is no log."""
        lines = source
        if isinstance(source, str):
            array = sources.json_array_lines(self.spark, source)
            if array is not None:
                return self._run(parse_objects(array))
            lines = sources.text_lines(self.spark, source)
        if self.config.max_input_size is not None:
            sources.check_size(lines, self.config.max_input_size)
        written = lines.filter(F.col("raw").rlike(r"\S"))
        gate = format_confidence(written).first()
        if gate["sampled"] >= GATE_LINES and gate["confidence"] < LEAST_CONFIDENCE:
            raise UnrecognisedFormat(f"only {gate['confidence']:.0%} of the first lines are of a known format, e.g. {gate['unmatched']}")
        tables = Tables(self.spark)
        parsed, counts = self._counted(parse_lines(written), tables)
        if counts["total"] >= UNPARSED_LINES and counts["unparsed_lines"] / counts["total"] >= MOST_UNPARSED:
            tables.drop()
            raise UnrecognisedFormat(f"{counts['unparsed_lines']} of {counts['total']} lines cannot be parsed")
        return self._run(parsed, counts, tables)

    @staticmethod
    def _counted(parsed: DataFrame, tables: Tables) -> tuple[DataFrame, dict]:
        """Parsed rows, written once, and the counters that were observed as they were."""
        seen = Observation()
        written = tables.put(parsed.observe(seen, *counter_columns(parsed)))
        return written, {"total": 0, "unparsed_lines": 0} | {k: v for k, v in seen.get.items() if v is not None}

    def analyze_file(self, path: str) -> Analysis:
        return self.analyze(sources.read_lines(self.spark, path))

    def analyze_json(self, records: Iterable[dict]) -> Analysis:
        """Records that are JSON objects already, of any shape; no gate, no guard."""
        return self._run(parse_objects(sources.record_lines(self.spark, records)))

    def analyze_entries(self, entries: DataFrame) -> Analysis:
        """Any DataFrame with some of the entry schema's columns, a table for instance."""
        return self._run(as_entries(entries).drop("ms").withColumn("parsed", F.lit(True)))

    def _run(self, parsed: DataFrame, counts: dict | None = None, tables: Tables | None = None) -> Analysis:
        began, tables = time.time(), tables or Tables(self.spark)
        if counts is None:
            parsed, counts = self._counted(parsed, tables)
        rejects = parsed.filter(~F.col("parsed")).select("seq", "raw")
        entries = as_entries(parsed.filter("parsed").drop("parsed"))
        if self.config.filter != Filter() or self.config.redaction.enabled:
            # what the query's time or several readers depend on is fixed once
            entries = tables.put(redact_entries(apply_filter(entries, self.config.filter), self.config.redaction))
        with Tables(self.spark):
            grouped = tables.put(group_entries(entries, self.config.grouping))
        with Tables(self.spark):
            built = tables.put(events.build_events(grouped))
        with Tables(self.spark) as chains:
            with Tables(self.spark):
                chained = chains.put(causal.chain_events(built))
            with Tables(self.spark):
                told = tables.put(causal.build_stories(chained))
                stories = causal.merge_stories(chained, told)
                if self.config.provider:
                    stories = providers.enhance(stories, self.config.provider)
                if stories is not told:
                    stories = tables.put(stories, told)
        with Tables(self.spark):
            found = tables.put(insights.insights(stories))
            about = tables.put(insights.insight_events(stories))
        stats = insights.run_stats(entries, built, stories).withColumn("unparsed_lines", F.lit(counts["unparsed_lines"]).cast("bigint"))
        stats = stats.withColumn("processing_time_ms", F.lit(int((time.time() - began) * 1000)).cast("bigint"))
        return Analysis(entries, rejects, grouped, built, stories, found, about, insights.system_summary(stories, found), stats, tables)

    def query(self, question: str, result: Analysis) -> str:
        return providers.answer(question, result.stories, self.config.provider)

    def format(self, result: Analysis, style: str = "cli") -> str:
        return render.format_result(result, style)


def analyze(spark: SparkSession, source: str | DataFrame, config: Config | None = None) -> Analysis:
    return Analyzer(spark, config).analyze(source)
