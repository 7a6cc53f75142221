"""Band joins and connected components on DataFrames."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; one of our own only in local mode without a setting."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="logweave-checkpoints-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


class Tables:
    """Compressed tables in the shared folder, written in place of checkpoints by ``cut_lineage`` within a ``with`` block.

    They go when the block ends, so what is handed on from it is ``put`` into the tables of another. Tables that are used without a block
    stay until ``drop``. Shuffle files go as soon as a table is written.
    """

    #: Rows can hold all entries of a group: a writer looks at its size after every few, and holds no more than this.
    WRITER = {"compression": "zstd", "parquet.block.size": 32 << 20, "parquet.page.size.row.check.min": 4, "parquet.block.size.row.check.min": 4}

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, df: DataFrame, instead: DataFrame | None = None) -> DataFrame:
        """``df`` as a table; ``instead`` is one of these tables that nothing reads any more."""
        path = f"{shared_folder(self.spark)}/table-{uuid.uuid4().hex}"
        with _setting(self.spark, **{"spark.sql.constraintPropagation.enabled": "false", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
            df.write.options(**self.WRITER).parquet(path)
        written = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = written
        if instead is not None:
            self._delete([p for p, table in self.paths.items() if table is instead])
        return written

    def drop(self) -> None:
        self._delete(list(self.paths))

    def _delete(self, paths: list[str]) -> None:
        for name in paths:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            del self.paths[name]

    def __enter__(self) -> Tables:
        self._before = _tables.set(self)
        return self

    def __exit__(self, *_) -> None:
        _tables.reset(self._before)
        self.drop()


#: The tables of the block that is at work, by thread.
_tables: ContextVar[Tables | None] = ContextVar("tables", default=None)


@contextmanager
def _setting(spark: SparkSession, **values: str) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def cut_lineage(df: DataFrame, instead: DataFrame | None = None) -> DataFrame:
    """``df`` written into the shared folder: a lost executor costs no recomputation of what came before.

    A table of the ``Tables`` block at work, which can replace one that nothing reads any more; elsewhere a checkpoint, which Spark removes
    some time after its last use. Without constraints: a checkpoint keeps those of its plan, and over the rounds of a loop they multiply.
    """
    spark, tables = df.sparkSession, _tables.get()
    if tables is not None:
        return tables.put(df, instead)
    shared_folder(spark)
    with _setting(spark, **{"spark.sql.constraintPropagation.enabled": "false"}):
        return df.checkpoint()


def time_band_join(left: DataFrame, right: DataFrame, left_ms: str, right_ms: str, horizon_ms: int, keys: list[str], where: Column, how: str = "inner") -> DataFrame:
    """Rows whose times are at most ``horizon_ms`` apart and that satisfy ``where``.

    A pure range predicate would be a nested loop; here the right side goes to the neighbouring buckets of its own and
    meets the left side by equality on bucket and ``keys``.
    """
    bucket = lambda c: F.floor(F.col(c) / horizon_ms)
    near = right.withColumn("__b", F.explode(F.sequence(bucket(right_ms) - 1, bucket(right_ms) + 1)))
    return left.withColumn("__b", bucket(left_ms)).join(near, [*keys, "__b"], how).filter(where).drop("__b")


#: Buckets that a span is cut into at most, and how many widths of buckets there are; each is so many times the one before.
SPAN_BUCKETS, WIDTHS = 64, 5


def time_reach_join(left: DataFrame, right: DataFrame, left_start: str, left_end: str, right_ms: str, horizon_ms: int, keys: list[str], where: Column) -> DataFrame:
    """Rows where the right time is within the left span or at most ``horizon_ms`` after it, and that satisfy ``where``.

    The left side goes to all buckets from its start to its end plus the horizon. Long spans take wider buckets, so that each
    row is copied a bounded number of times; the right side has one bucket of every width, so a pair meets once.
    """
    ends = F.greatest(left_start, left_end) + horizon_ms
    widths = [horizon_ms * SPAN_BUCKETS**k for k in range(WIDTHS)]
    width = F.lit(widths[-1])
    for w in reversed(widths[:-1]):
        width = F.when(ends - F.col(left_start) <= SPAN_BUCKETS * w, F.lit(w)).otherwise(width)
    bucket = lambda ms, w: F.floor(ms / w).cast("bigint")
    reach = left.withColumn("__w", width.cast("bigint")).withColumn("__b", F.explode(F.sequence(bucket(F.col(left_start), F.col("__w")), bucket(ends, F.col("__w")))))
    at = right.withColumn("__w", F.explode(F.lit(widths).cast("array<bigint>"))).withColumn("__b", bucket(F.col(right_ms), F.col("__w")))
    return reach.join(at, [*keys, "__w", "__b"]).filter(F.col(right_ms).between(F.col(left_start), ends)).filter(where).drop("__w", "__b")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows ``(node, component)`` for edges ``(a, b)``; component is the smallest node.

    Alternates two star steps: the larger neighbours of a node, then its smaller ones, are tied to the smallest node around it. What is left in
    the end is a star a component, after a number of rounds that grows with the logarithm of its size. Only aggregates and joins.
    """
    current = cut_lineage(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct())
    loops = edges.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    if current.isEmpty():  # nothing is tied to anything else
        return loops.distinct()
    before = None
    for _ in range(rounds):
        both = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(current.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        floor = larger.groupBy("hi").agg(F.min("lo").alias("m"))
        pairs = larger.join(floor, "hi").select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))).alias("e"))
        current = cut_lineage(pairs.select("e.hi", "e.lo").filter("hi <> lo").distinct(), current)
        now = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    stars = current.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return stars.union(current.select(F.col("lo").alias("node"), F.col("lo").alias("component"))).union(loops.join(stars, "node", "left_anti")).distinct()


def in_slabs(df: DataFrame, *order: str) -> DataFrame:
    """``df`` cut along its whole order into slabs of about equal size, numbered in ``__slab``; no column needs to part it."""
    return cut_lineage(df.repartitionByRange(*order).withColumn("__slab", F.spark_partition_id()))


def time_islands(df: DataFrame, ms: str, horizon_ms: int) -> DataFrame:
    """``df`` with ``island``, which changes at pauses of more than the horizon.

    Rows of one stretch of the horizon are in one island, so what is put in order is a row a stretch.
    """
    stretch = F.floor(F.col(ms) / horizon_ms)
    rows = df.groupBy(stretch.alias("__stretch")).agg(F.min(ms).alias("lo"), F.max(ms).alias("hi"))
    along = Window.orderBy("__stretch")
    cut = F.coalesce(F.col("lo") - F.lag("hi").over(along) > horizon_ms, F.lit(False)).cast("int")
    numbered = rows.withColumn("cut", cut).select("__stretch", F.sum("cut").over(along).alias("island"))
    return df.withColumn("__stretch", stretch).join(numbered, "__stretch").drop("__stretch")


def tied_blocks(items: DataFrame, ties: DataFrame, rounds: int = 50) -> DataFrame:
    """Cut items into blocks that no tie crosses: rows ``(id, block)`` of the items that are in a block with others.

    ``items(id, start_ms, end_ms)`` are spans, ``ties(id, key, horizon_ms)`` what they can be tied by. Two blocks of the result that have a
    key in common are further apart than its horizon, each taken from its first start to its last end. So an ordered rule that ties an
    item only to what shares a key with it, and only near the span that this has grown to, works on each block by itself.

    Spans of one key in one stretch of its horizon always belong together, so a sweep along a key (a running maximum of the ends) has a row
    a stretch, and every item is linked once a key: to the first of its stretch, and stretches to the first of their island. The blocks
    then are spans with keys themselves, and the sweep is repeated until nothing is linked; that takes as many rounds as ties lead from key to key.
    """
    spans = ties.filter("key is not null")
    if "start_ms" not in ties.columns:  # ties can bring their items' spans along
        spans = spans.join(items, "id")
    # keys are numbers: two that share one at worst put two blocks together
    keyed = cut_lineage(spans.select(F.xxhash64("key").alias("key"), "horizon_ms", F.col("id").alias("block"), "start_ms", "end_ms"))
    blocks = None
    for _ in range(rounds):
        stretch = F.floor(F.col("start_ms") / F.col("horizon_ms"))
        here = keyed.withColumn("stretch", stretch)
        rows = here.groupBy("key", "horizon_ms", "stretch").agg(F.min("block").alias("rep"), F.max("block").alias("other"), F.min("start_ms").alias("lo"), F.max("end_ms").alias("hi"))
        along = Window.partitionBy("key", "horizon_ms").orderBy("stretch")
        reach = F.max("hi").over(along.rowsBetween(Window.unboundedPreceding, -1))
        islands = rows.withColumn("cut", F.coalesce(F.col("lo") - reach > F.col("horizon_ms"), F.lit(False)).cast("int")).withColumn("island", F.sum("cut").over(along))
        head = F.first("rep").over(Window.partitionBy("key", "horizon_ms", "island").orderBy("stretch"))
        # only what links something is joined, which can be little of it all
        linking = cut_lineage(islands.withColumn("head", head).filter("rep <> other or rep <> head").select("key", "horizon_ms", "stretch", "rep", "other", "head"))
        of_items = here.join(linking.filter("rep <> other"), ["key", "horizon_ms", "stretch"]).select(F.col("block").alias("a"), F.col("rep").alias("b"))
        links = cut_lineage(of_items.union(linking.select(F.col("rep").alias("a"), F.col("head").alias("b"))).filter("a <> b").distinct())
        if links.isEmpty():
            break
        labels = connected_components(links).select(F.col("node").alias("block"), "component")
        grown = keyed.join(labels, "block", "left").withColumn("block", F.coalesce("component", "block")).drop("component")
        spans = grown.groupBy("block").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
        keyed = cut_lineage(grown.select("block", "key", "horizon_ms").distinct().join(spans, "block").select("key", "horizon_ms", "block", "start_ms", "end_ms"))
        if blocks is None:
            blocks = labels.select(F.col("block").alias("id"), F.col("component").alias("block"))
        else:
            blocks = blocks.join(labels, "block", "full_outer").select(F.coalesce("id", "block").alias("id"), F.coalesce("component", "block").alias("block"))
        blocks = cut_lineage(blocks)
    else:
        raise RuntimeError("blocks did not settle")
    return blocks if blocks is not None else keyed.select(F.col("block").alias("id"), "block").limit(0)
