"""Growing logs over rotation and truncation, and a sink that keeps committed batches only."""

import os

import pytest
from pyspark.sql import functions as F

from logweave.sources import tail
from logweave.sources.tail import LogSink, LogSinkWriter, LogTail, LogTailReader, read_sink
from logweave.streaming.stream import pass_through


def lines_of(reader, start, end):
    return [row for piece in reader.partitions(start, end) for row in reader.read(piece)]


def test_rotation_truncation_and_unique_numbers(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "CHUNK", 40)
    a, b = tmp_path / "a.log", tmp_path / "b.log"
    a.write_text("".join(f"a line {k}\n" for k in range(30)))
    b.write_text("b one\nb two\nunfinished")
    reader = LogTailReader(str(tmp_path / "*.log"))
    at, seen = reader.initialOffset(), []

    def step():
        nonlocal at
        end = reader.latestOffset()
        rows = lines_of(reader, at, end)
        assert rows == lines_of(reader, at, end)
        at = end
        seen.extend(rows)
        return [raw for _, raw, _ in rows]

    assert step() == [f"a line {k}" for k in range(30)] + ["b one", "b two"]
    assert step() == []
    with a.open("a") as f:
        f.write("before it was renamed\n")
    os.rename(a, tmp_path / "a.log.1")  # beyond the pattern
    with (tmp_path / "a.log.1").open("a") as f:
        f.write("after it was renamed\n")
    a.write_text("a new file\n")
    assert sorted(step()) == ["a new file", "after it was renamed", "before it was renamed"]
    b.write_text("b cut short\n")  # smaller than before, then grown beyond it
    assert step() == ["b cut short"]
    b.write_text("b once more, and longer than what there was\n" * 3)
    assert step() == ["b once more, and longer than what there was"] * 3
    again = LogTailReader(str(tmp_path / "*.log"))  # a query that starts again learns from its checkpoint
    again.commit(at)
    with b.open("a") as f:
        f.write("and on\n")
    assert [raw for _, raw, _ in lines_of(again, at, again.latestOffset())] == ["and on"]
    numbers = [seq for seq, _, _ in seen]
    assert len(set(numbers)) == len(numbers) and len({n >> tail.POSITION for n in numbers}) == 5


def test_batches_are_bounded_by_lines_and_bytes(tmp_path):
    log = tmp_path / "x.log"
    log.write_text("".join(f"line {k}\n" for k in range(5)) + "y" * 300 + "\nunfinished")
    for reader, expected in ((LogTailReader(str(log), most_lines=2), [2, 2, 2, 0]), (LogTailReader(str(log), most_bytes=15), [2, 2, 1, 1, 0])):
        at, sizes = reader.initialOffset(), []
        for _ in expected:
            end = reader.latestOffset()
            sizes.append(len(lines_of(reader, at, end)))
            at = end
        assert sizes == expected


def test_a_stream_over_two_files_that_starts_again(spark, tmp_path):
    spark.dataSource.register(LogTail)
    logs, sink, checkpoint = tmp_path / "logs", str(tmp_path / "sink"), str(tmp_path / "checkpoint")
    logs.mkdir()
    for name in ("one.log", "two.log"):
        (logs / name).write_text(f"{name} first\n{name} second\n")

    def once():
        lines = spark.readStream.format("log_tail").load(str(logs))
        pass_through(lines, sink, checkpoint, availableNow=True).awaitTermination()

    once()
    (logs / "two.log").write_text("two.log cut\n")
    with (logs / "one.log").open("a") as f:
        f.write("one.log third é\n")
    once()
    got = read_sink(spark, sink, "seq bigint, raw string, source string").collect()
    assert sorted(r.raw for r in got) == ["one.log first", "one.log second", "one.log third é", "two.log cut", "two.log first", "two.log second"]
    assert len({r.seq for r in got}) == 6 and {r.batch for r in got} >= {0, 1}


def test_a_failed_batch_leaves_nothing_and_a_repeated_one_replaces_itself(spark, tmp_path):
    spark.dataSource.register(LogSink)
    source, sink, checkpoint = tmp_path / "in", str(tmp_path / "sink"), str(tmp_path / "checkpoint")
    source.mkdir()
    (source / "a.txt").write_text("good\nbad\n")
    stream = spark.readStream.text(str(source))
    failing = stream.select(F.when(F.col("value") == "bad", F.raise_error(F.lit("broken"))).otherwise(F.col("value")).cast("string").alias("raw"))
    with pytest.raises(Exception, match="broken"):
        failing.writeStream.format("log_sink").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    assert not os.path.exists(f"{sink}/commits")
    stream.select(F.col("value").alias("raw")).writeStream.format("log_sink").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.raw for r in read_sink(spark, sink, "raw string").collect()) == ["bad", "good"]
    writer = LogSinkWriter(sink)
    row = spark.createDataFrame([("once more",)], "raw string").first()
    writer.commit([writer.write(iter([row])), None], 0)
    lost = writer.write(iter([row]))
    writer.abort([lost, None], 1)
    assert [r.raw for r in read_sink(spark, sink, "raw string").collect()] == ["once more"]
    assert len(os.listdir(f"{sink}/parts")) == 1
