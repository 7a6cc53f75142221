"""Micro-batches over growing files."""

from pyspark.sql import functions as F

from logweave.plans.analyzer import session_defaults
from logweave.sources.lines import GrowingFile
from logweave.streaming.stream import StoryStream, done_stats, final_insights, told_stories, transport, user_sessions


def line(second, user, message, level="info"):
    return f'{{"level":"{level}","message":"{message}","timestamp":"2024-05-01T10:00:{second:02d}Z","userId":"{user}"}}\n'


def test_stories_are_told_once_over_batches(spark, tmp_path):
    session_defaults(spark)
    spark.dataSource.register(GrowingFile)
    log, state = tmp_path / "app.log", str(tmp_path / "state")
    log.write_text(line(0, "u1", "login success"))
    stream = StoryStream(state)

    def once():
        lines = spark.readStream.format("growing_file").load(str(log))
        stream.start(lines, str(tmp_path / "checkpoint"), availableNow=True).awaitTermination()

    once()
    with log.open("a") as file:
        file.write(line(30, "u2", "upload failed", "error"))
        file.write('{"level":"info","message":"not yet')
    once()
    told = spark.read.parquet(f"{state}/stories").collect()
    assert sorted(r.actors[0] for r in told) == ["u1", "u2"]
    assert spark.read.parquet(f"{state}/progress").agg(F.sum("entries"), F.sum("errors")).first()[:] == (2, 1)


def test_sessions(spark):
    session_defaults(spark)
    rows = [("u", 0, "info"), ("u", 200_000, "error"), ("u", 900_000, "info")]
    df = spark.createDataFrame(rows, "user_id string, ms bigint, level string").withColumn("ts", F.timestamp_millis("ms"))
    got = sorted((r.start_ms, r.n_entries, r.n_errors) for r in user_sessions(df).collect())
    assert got == [(0, 2, 1), (900_000, 1, 0)]


def test_the_end_of_a_stream_tells_everything(spark, tmp_path):
    """Insights of all kinds and counts over all batches; a story that grew counts once; state folders do not pile up."""
    session_defaults(spark)
    spark.dataSource.register(GrowingFile)
    log, state = tmp_path / "app.log", str(tmp_path / "state")
    log.write_text("")
    stream = StoryStream(state)
    for k in range(4):
        with log.open("a") as file:
            file.write(line(2 * k, "u1", "GET /sync retrying", "warn") + line(2 * k + 1, f"v{k}", "support ticket timeout", "error"))
        lines = spark.readStream.format("growing_file").load(str(log))
        stream.start(lines, str(tmp_path / "checkpoint"), availableNow=True).awaitTermination()
    assert done_stats(spark, state).first().asDict()["total_entries"] == 8
    assert told_stories(spark, state).groupBy("story_id").count().filter("count > 1").count() == 0
    kinds = {r.title for r in final_insights(spark, state).collect()}
    assert {"Recurring failure: Payment provider timeout", "Customer escalations triggered"} <= kinds
    assert all(len(list((tmp_path / "state" / name).glob("batch=*"))) <= 2 for name in ("carry", "told"))


def test_growing_files_are_cut_by_count(tmp_path):
    from logweave.sources.lines import GrowingFileReader

    log = tmp_path / "app.log"
    log.write_text("".join(f"line {k}\n" for k in range(5)) + "unfinished")
    reader, at, sizes = GrowingFileReader(str(log), 2), {"at": 0}, []
    for _ in range(4):
        rows, end = reader.read(at)
        rows = list(rows)
        assert rows == list(reader.readBetweenOffsets(at, end))
        sizes.append(len(rows))
        at = end
    assert sizes == [2, 2, 1, 0] and at["at"] == 5 * len("line 0\n")


def test_transport_analyses_each_batch_and_goes_on(spark, tmp_path):
    session_defaults(spark)
    spark.dataSource.register(GrowingFile)
    log, stories, stats = tmp_path / "app.log", [], []
    log.write_text("".join(f"plain prose {k}\n" for k in range(6)))
    lines = spark.readStream.format("growing_file").option("maxLines", 6).load(str(log))
    query = transport(lines, str(tmp_path / "checkpoint"), lambda df: stories.extend(r.title for r in df.collect()), on_stats=lambda df: stats.append(df.first().total_entries), seconds=1)
    with log.open("a") as file:
        file.write(line(1, "u1", "login success") + line(2, "u1", "GET /products 200"))
    for _ in range(120):
        query.awaitTermination(1)
        if stats:
            break
    query.stop()
    assert stories == ["Successful Login & Product Browse"] and stats == [2]
