"""Live logs: micro-batches run the batch operators on the new entries and those carried over.

State is two tables in the checkpoint folder: entries younger than the horizon, and signatures of stories already told. Both
are pruned to the horizon, and of their folders the last two stay (a batch that runs again reads what the batch before it
left). Entries later than the watermark go to the ``late`` rows of the sink. Every micro-batch writes under its batch number, so
a batch that runs again after a failure replaces its own rows. A story that grows is told again, under another signature; for
insights and counts of the whole stream the last telling of a story counts.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import causal, events, insights
from ..operators.group import Grouping, group_entries
from ..operators.parse import parse_lines
from ..operators.schema import as_entries
from ..plans.graph import cut_lineage

HORIZON_MS = 900_000
#: A row a batch: what came in, what was told, and the latest time so far.
PROGRESS = "entries bigint, errors bigint, number bigint, stories bigint, newest bigint"
#: What is kept of a story that has been told: all that reports and insights read.
TOLD = ("story_id", "signature", "title", "outcome", "severity", "narrative", "narrative_source", "root_cause", "impact", "recommendation", "start_ms", "end_ms", "duration_ms", "retried", "actors", "services", "event_ids", "entries")


def story_signature(entries) -> F.Column:
    """Equal for stories with the same times and message heads."""
    return F.substring(F.sha2(F.array_join(F.sort_array(F.transform(entries, lambda e: F.concat_ws(":", e["ms"].cast("string"), F.substring(e["message"], 1, 40)))), "|"), 256), 1, 16)


def stories_of(entries: DataFrame, config: Grouping) -> DataFrame:
    grouped = cut_lineage(group_entries(cut_lineage(entries), config))
    built = cut_lineage(events.build_events(grouped))
    return causal.build_stories(cut_lineage(causal.chain_events(built)))


class StoryStream:
    """``foreachBatch`` callback; ``folder`` is a shared place for the state tables and the told stories."""

    def __init__(self, folder: str, config: Grouping | None = None, horizon_ms: int = HORIZON_MS):
        self.folder, self.config, self.horizon_ms = folder.rstrip("/"), config or Grouping(), horizon_ms

    def _table(self, spark: SparkSession, name: str, before: int, schema) -> DataFrame:
        """The state that the batch before left; empty at the start."""
        if not self._path(spark, name, before):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.folder}/{name}/batch={before}")

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        entries = as_entries(parse_lines(batch).filter("parsed").drop("parsed")) if "raw" in batch.columns and "message" not in batch.columns else as_entries(batch)
        left = self._table(spark, "progress", number - 1, PROGRESS).first()
        newest_before = left["newest"] if left else None
        timely = F.coalesce(F.col("ms") >= (newest_before - self.horizon_ms), F.lit(False)) if newest_before is not None else F.lit(True)
        # what a batch is counted by is observed as its rows are written, with no pass of its own
        came, tells = Observation(), Observation()
        fresh = cut_lineage(entries.observe(came, F.count_if(timely).alias("entries"), F.count_if(timely & F.col("level").isin("error", "fatal")).alias("errors"), F.max(F.when(timely, F.col("ms"))).alias("newest")))
        seen = {"entries": 0, "errors": 0, "newest": None} | came.get
        newest = max((n for n in (newest_before, seen["newest"]) if n is not None), default=None)
        both = self._table(spark, "carry", number - 1, fresh.schema).unionByName(fresh.filter(timely))
        stories = stories_of(both, self.config).withColumn("signature", story_signature(F.col("entries")))
        told = self._table(spark, "told", number - 1, "signature string, end_ms bigint")
        new = cut_lineage(stories.join(told, "signature", "left_anti").observe(tells, F.count("*").alias("stories")))
        new.select(*TOLD).write.mode("overwrite").parquet(f"{self.folder}/stories/batch={number}")
        fresh.filter(~timely).select("seq", "ms", "level", "message").write.mode("overwrite").parquet(f"{self.folder}/late/batch={number}")
        keep = F.lit(newest - self.horizon_ms if newest is not None else 0)
        both.filter(F.col("ms") >= keep).write.mode("overwrite").parquet(f"{self.folder}/carry/batch={number}")
        told.union(new.select("signature", "end_ms")).filter(F.col("end_ms") >= keep).write.mode("overwrite").parquet(f"{self.folder}/told/batch={number}")
        row = (seen["entries"], seen["errors"], number, ({"stories": 0} | tells.get)["stories"], newest)
        spark.createDataFrame([row], PROGRESS).write.mode("overwrite").parquet(f"{self.folder}/progress/batch={number}")
        for name in ("carry", "told"):
            self._path(spark, name, number - 2, delete=True)

    def _path(self, spark: SparkSession, name: str, number: int, delete: bool = False) -> bool:
        """Whether a batch has left the table; with ``delete`` it goes."""
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/batch={number}")
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return files.delete(path, True) if delete else files.exists(path)

    def start(self, lines: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return lines.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def user_sessions(entries: DataFrame, gap: str = "5 minutes", lateness: str = "15 minutes") -> DataFrame:
    """Event-time sessions per user on a stream (or a table): a watermark bounds the state."""
    timed = entries.withWatermark("ts", lateness) if entries.isStreaming else entries
    counted = timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_entries"), F.count_if(F.col("level").isin("error", "fatal")).alias("n_errors"))
    return counted.select("user_id", F.unix_millis("w.start").alias("start_ms"), (F.unix_millis("w.end")).alias("end_ms"), "n_entries", "n_errors")


def run_once(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Everything that a stream has now, through the streaming operators; its last result table."""
    rows = f"{folder.rstrip('/')}/rows"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(rows)

    writer = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder.rstrip('/')}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(rows)


def told_stories(spark: SparkSession, folder: str) -> DataFrame:
    """Every story that a stream has told, as it was told last."""
    told = spark.read.parquet(f"{folder.rstrip('/')}/stories")
    last = F.max_by(F.struct(*[c for c in told.columns if c != "story_id"]), F.struct("batch", "end_ms")).alias("last")
    return told.groupBy("story_id").agg(last).select("story_id", "last.*")


def final_insights(spark: SparkSession, folder: str) -> DataFrame:
    """Insights of all six kinds over all stories that a stream has told."""
    return insights.insights(told_stories(spark, folder))


def done_stats(spark: SparkSession, folder: str) -> DataFrame:
    """One row at the end of a stream: batches, entries, errors, and stories told; entries carried over count once."""
    progress = spark.read.parquet(f"{folder.rstrip('/')}/progress")
    return progress.agg(
        F.count("*").alias("batches"), F.coalesce(F.sum("entries"), F.lit(0)).alias("total_entries"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors_detected"), F.coalesce(F.sum("stories"), F.lit(0)).alias("stories_generated")
    )


def pass_through(lines: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """The lines that a transport takes in, kept as they are in a committed sink beside their analysis (``sources.tail.read_sink``)."""
    from ..sources.tail import LogSink

    lines.sparkSession.dataSource.register(LogSink)
    writer = lines.writeStream.format("log_sink").option("path", folder).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def tee(batch_function: Callable[[DataFrame, int], None], path: str) -> Callable[[DataFrame, int], None]:
    """Pass every batch on and keep its raw rows as well, as a logging transport does."""

    def run(batch: DataFrame, number: int) -> None:
        fixed = cut_lineage(batch)
        fixed.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")
        batch_function(fixed, number)

    return run


def transport(lines: DataFrame, checkpoint: str, on_stories: Callable[[DataFrame], None], on_insights: Callable[[DataFrame], None] | None = None, on_stats: Callable[[DataFrame], None] | None = None, seconds: float = 30, config=None) -> StreamingQuery:
    """A logging transport: what has come in ``seconds`` is analysed on its own and handed to the callbacks,
    whose tables go when they return.

    Sources bound a batch by count as well (``maxLines`` of growing files). A batch that is no log is reported and
    skipped, so that logging goes on.
    """
    from ..plans.analyzer import Analyzer, UnrecognisedFormat

    analyzer = Analyzer(lines.sparkSession, config)

    def run(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        try:
            result = analyzer.analyze(cut_lineage(batch.select("seq", "raw")))
        except UnrecognisedFormat as problem:
            print(f"batch {number} was not analysed: {problem}", file=sys.stderr)
            return
        try:
            on_stories(result.stories)
            for callback, rows in ((on_insights, result.insights), (on_stats, result.stats)):
                if callback:
                    callback(rows)
        finally:
            result.drop()

    return lines.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def watch(spark: SparkSession, path: str, report: Callable, config=None, interval_ms: int = 1000) -> StreamingQuery:
    """Analyse what is appended to a file, or to the files of a folder or a pattern, every micro-batch on its own."""
    from ..plans.analyzer import Analyzer
    from ..sources.tail import LogTail

    spark.dataSource.register(LogTail)
    analyzer = Analyzer(spark, config)

    def run(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            result = analyzer._run(parse_lines(batch.select("seq", "raw")))
            try:
                report(result)
            finally:
                result.drop()

    lines = spark.readStream.format("log_tail").load(path)
    return lines.writeStream.foreachBatch(run).trigger(processingTime=f"{interval_ms} milliseconds").start()
