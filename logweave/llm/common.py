"""Helpers that the training-data operators share: staging, session limits, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Collection, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch handed to Python; they bound what a worker holds at once. One limit for all operators, so
#: that those whose DataFrames are held at the same time do not undo each other's.
BATCH_ROWS = 4096
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """What every operator with Python workers needs: this package on the executors, and bounded batches.

    Long texts make Spark's default of 10,000 rows a batch too many.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """At the start of a task in a reused worker: memory that earlier tasks have freed goes back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


class WordCache(dict):
    """What is known of words, between batches and tasks of a worker, within about ``most`` bytes."""

    #: Bytes of an entry besides what it is told to hold.
    ENTRY = 200

    def __init__(self, most: int):
        super().__init__()
        self.most, self.size = most, 0

    def make_room(self, fresh: Collection[str], using: Iterable[str]) -> bool:
        """Before ``fresh`` words are added: where they do not fit, only those that are being used stay; tells whether any went."""
        coming = sum(map(len, fresh)) * 6 + self.ENTRY * len(fresh)
        full = self.size + coming > self.most
        if full:
            kept = {w: self[w] for w in using if w in self}
            self.size = self.size * len(kept) // max(1, len(self))
            self.clear()
            self.update(kept)
        self.size += coming
        return full


def staging_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only in local mode, as in tests."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="logweave-"))
    return spark.sparkContext.getCheckpointDir()


#: Folders of the tables that this process has staged and not dropped.
_made: set[str] = set()
#: Those that the operators called in an ``owning`` block have staged.
_owner: ContextVar[list[str] | None] = ContextVar("owner", default=None)


@contextmanager
def owning(paths: list[str]) -> Iterator[list[str]]:
    """Collect the folders of all tables staged within the block, for ``drop_tables`` when nothing reads them any more."""
    before = _owner.set(paths)
    try:
        yield paths
    finally:
        _owner.reset(before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: its lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{staging_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.add(path)
    if (own := _owner.get()) is not None:
        own.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(*tables: DataFrame) -> None:
    """Delete the files of tables that ``staged`` returned once nothing reads them any more."""
    for df in tables:
        read = {name.rsplit("/", 2)[1] for name in df.inputFiles()}
        drop_tables(df.sparkSession, [path for path in _made if path.rsplit("/", 1)[1] in read])


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    for name in _made.intersection(paths):
        _made.remove(name)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges(a, b)`` as rows ``(node, component)``, component = smallest node.

    Each round points every node's neighbours at the smallest label around it (stars merging into stars), so the
    rounds grow with the logarithm of a component's diameter. Grouping is by aggregates and joins only: a node with
    a third of all edges is pre-aggregated before its shuffle and split by the adaptive skew join.
    """
    current = staged(
        edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).filter("lo <> hi").distinct(),
        "cc",
    )
    previous = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node links to the smallest node around it
        both = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            current.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # small star: a node's smaller neighbours and itself link to the smallest of them
        floor = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(floor, "hi")
            .select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))).alias("e"))
            .select("e.lo", "e.hi")
            .filter("lo <> hi")
            .distinct()
        )
        following = staged(small, "cc")
        same = following.agg(F.count("*").alias("n"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")).alias("h")).first()
        if previous is not None:
            drop_staged(current)
        current = following
        if same == previous:
            break
        previous = same
    else:
        raise RuntimeError("components did not settle")
    labels = current.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return labels.union(current.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a context, so that workers import the same code wherever they start."""
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if getattr(context, "_logweave_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="logweave-code-")) / "logweave_code.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    context.addPyFile(str(target))
    context._logweave_shipped = True
