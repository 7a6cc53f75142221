"""Growing logs as a partitioned stream, and a sink that keeps what is committed.

``spark.readStream.format("log_tail").load(path)`` reads what is appended to a file, to the files of a folder or to those that a pattern names, on storage that driver and
executors share: ``(seq, raw, source)``. A file is known by what it is (device and inode), so one that is renamed is read on under its new name; one
that has shrunk, or begins otherwise than before, is read from its start as another source. Sources are numbered as they appear, and ``seq`` holds
the source's number above the line's byte position, so no line has the number of another, and those of a source keep their order. All of this
is in the offsets, so a query that starts again goes on where it was. Only whole lines are read; an unfinished last line waits for its end.

``df.writeStream.format("log_sink").option("path", folder)`` writes rows as JSON lines. Tasks write files of their own; a batch counts once its list
of files is in place, which is one rename, so a batch that fails leaves nothing and one that runs again replaces itself. ``read_sink`` reads what
is committed.
"""

from __future__ import annotations

import glob
import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

#: Bits of a line's byte position in its number; bytes a task reads; bytes that a file's beginning is known by; bytes looked through at once.
POSITION, CHUNK, HEAD, STEP = 40, 32 << 20, 256, 1 << 16


def identity(path: str) -> str | None:
    try:
        found = os.stat(path)
    except OSError:
        return None
    return f"{found.st_dev}:{found.st_ino}"


@dataclass
class Piece(InputPartition):
    """Lines of a file that begin in a range of bytes."""

    path: str
    file: str
    number: int
    start: int
    end: int
    first: bool


class LogTailReader(DataSourceStreamReader):
    def __init__(self, path: str, most_lines: int | None = None, most_bytes: int | None = None):
        self.path, self.most_lines, self.most_bytes = path, most_lines, most_bytes
        self.known: dict | None = None

    def initialOffset(self) -> dict:
        return {"next": 0, "files": {}}

    def _named(self) -> list[str]:
        """Files that the path names, in order of name."""
        if os.path.isdir(self.path):
            return sorted(e.path for e in os.scandir(self.path) if e.is_file())
        return sorted(p for p in glob.glob(self.path) if os.path.isfile(p))

    def _around(self) -> dict[str, str]:
        """All files beside the named ones, by identity: a renamed file is looked for there."""
        folder = self.path if os.path.isdir(self.path) else os.path.dirname(self.path) or "."
        try:
            return {found: e.path for e in os.scandir(folder) if e.is_file() and (found := identity(e.path))}
        except OSError:
            return {}

    def latestOffset(self) -> dict:
        before = self.known or self.initialOffset()
        following, files = before["next"], {}
        around = self._around()
        named = {found: p for p in self._named() if (found := identity(p))}
        left = self.most_lines
        for file, path in [*named.items(), *((f, around[f]) for f in before["files"] if f in around and f not in named)]:
            was = before["files"].get(file)
            with open(path, "rb") as f:
                size = f.seek(0, os.SEEK_END)
                if was is None or size < was["at"] or self._head(f, was["head"][0]) != was["head"][1]:
                    was = {"n": following, "at": 0}
                    following += 1
                end, lines = self._whole_lines(f, was["at"], size, left)
                left = None if left is None else left - lines
                length = min(end, HEAD)
                files[file] = {"n": was["n"], "at": end, "head": [length, self._head(f, length)]}
        self.known = {"next": following, "files": files}
        return self.known

    @staticmethod
    def _head(f, length: int) -> str:
        f.seek(0)
        return hashlib.sha256(f.read(length)).hexdigest()[:16]

    def _whole_lines(self, f, at: int, size: int, most: int | None) -> tuple[int, int]:
        """Where the last whole line to be read ends, and how many lines that is if they are counted."""
        if most is not None:
            f.seek(at)
            end, lines = at, 0
            while lines < most and end < size and (line := f.readline()).endswith(b"\n"):
                end, lines = end + len(line), lines + 1
            return end, lines
        limit = size if self.most_bytes is None else min(size, at + self.most_bytes)
        place = limit
        while place > at:  # the last line end before the limit
            begin = max(at, place - STEP)
            f.seek(begin)
            cut = f.read(place - begin).rfind(b"\n")
            if cut >= 0:
                return begin + cut + 1, 0
            place = begin
        f.seek(limit)  # one line is longer than the bound
        while block := f.read(STEP):
            cut = block.find(b"\n")
            if cut >= 0:
                return min(limit + cut + 1, size), 0
            limit += len(block)
        return at, 0

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        if self.known is None:  # a query that starts again
            self.known = end
        around, pieces = self._around(), []
        for file, now in end["files"].items():
            was = start["files"].get(file)
            begin = was["at"] if was and was["n"] == now["n"] else 0
            for a in range(begin, now["at"], CHUNK):
                pieces.append(Piece(around.get(file, ""), file, now["n"], a, min(a + CHUNK, now["at"]), a == begin))
        return pieces

    def read(self, piece: Piece) -> Iterator[tuple]:
        path = piece.path if identity(piece.path) == piece.file else self._around().get(piece.file)
        if path is None:
            raise FileNotFoundError(f"{piece.path} has gone before its lines were read")
        with open(path, "rb") as f:
            at = piece.start
            if not piece.first:  # the line before the range may reach into it
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            while at < piece.end and (line := f.readline()).endswith(b"\n"):
                yield piece.number << POSITION | at, line[:-1].decode("utf-8", "replace").rstrip("\r"), os.path.basename(path)
                at += len(line)

    def commit(self, end: dict) -> None:
        if self.known is None:
            self.known = end


class LogTail(DataSource):
    """The options ``maxLines`` and ``maxBytes`` (a file) bound a micro-batch."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "seq bigint, raw string, source string"

    def streamReader(self, schema: StructType) -> LogTailReader:
        number = lambda name: int(self.options[name]) if self.options.get(name) else None
        return LogTailReader(self.options["path"], number("maxLines"), number("maxBytes"))


@dataclass
class Written(WriterCommitMessage):
    file: str


class LogSinkWriter(DataSourceStreamWriter):
    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def write(self, iterator: Iterator[Row]) -> Written:
        os.makedirs(f"{self.folder}/parts", exist_ok=True)
        name = f"{uuid.uuid4().hex}.json"
        try:
            with open(f"{self.folder}/parts/{name}", "w", encoding="utf-8") as f:
                for row in iterator:
                    f.write(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str) + "\n")
        except BaseException:
            self._remove([name])  # a task that is lost leaves a file that no list names
            raise
        return Written(name)

    def commit(self, messages: list, batchId: int) -> None:
        os.makedirs(f"{self.folder}/commits", exist_ok=True)
        listed = f"{self.folder}/commits/{batchId:012d}.txt"
        before = open(listed).read().split() if os.path.exists(listed) else []
        with open(listed + ".new", "w") as f:
            f.write("".join(m.file + "\n" for m in messages if m is not None))
        os.replace(listed + ".new", listed)
        self._remove(before)

    def abort(self, messages: list, batchId: int) -> None:
        self._remove([m.file for m in messages if m is not None])

    def _remove(self, names: list[str]) -> None:
        for name in names:
            try:
                os.remove(f"{self.folder}/parts/{name}")
            except FileNotFoundError:
                pass


class LogSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_sink"

    def streamWriter(self, schema: StructType, overwrite: bool) -> LogSinkWriter:
        return LogSinkWriter(self.options["path"])


def read_sink(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """Rows of all committed batches, with ``batch``."""
    folder = folder.rstrip("/")
    base = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    committed = spark.read.text(f"{folder}/commits", pathGlobFilter="*.txt").select(F.col("value").alias("__file"), F.regexp_extract(F.input_file_name(), r"(\d+)\.txt$", 1).cast("bigint").alias("batch"))
    rows = spark.read.schema(schema).json(f"{folder}/parts").withColumn("__file", base(F.input_file_name()))
    return rows.join(committed, "__file").drop("__file")
