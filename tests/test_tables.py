"""What an analysis leaves in the shared folder."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from logweave.plans.analyzer import Analyzer, Config
from logweave.plans.graph import Tables, cut_lineage, shared_folder, tied_blocks
from logweave.operators.filters import Filter
from logweave.operators.group import Grouping, merge_same_value, split_by_gap

LINES = "\n".join(f'{{"level":"{"error" if k % 3 else "info"}","message":"upload {k} failed","timestamp":"2024-05-01T10:{k:02d}:00Z","userId":"u{k % 4}","requestId":"r{k // 2}"}}' for k in range(24))


def written(spark) -> set[str]:
    """Tables, and checkpoints with files."""
    top = Path(shared_folder(spark).removeprefix("file:"))
    return {str(p) for p in top.rglob("table-*")} | {str(p) for p in top.rglob("rdd-*") if any(p.iterdir())}


def test_an_analysis_leaves_its_results_only_and_drops_them(spark):
    before = written(spark)
    result = Analyzer(spark).analyze(LINES)
    left = written(spark) - before
    assert left == {p.removeprefix("file:") for p in result.tables.paths} and 4 <= len(left) <= 6
    assert result.entries.count() == 24 and result.stories.selectExpr("sum(size(entries)) as n").first().n == 24
    result.drop()
    assert not written(spark) - before


def test_filtered_entries_are_written_too(spark):
    result = Analyzer(spark, Config(filter=Filter(levels=("error",)))).analyze(LINES)
    assert result.entries.count() == 16 and result.grouped.count() == 16
    result.drop()


def test_tables_replace_one_another_and_go_when_a_block_fails(spark):
    before, name = written(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(name)
    with pytest.raises(KeyError), Tables(spark) as outer:
        with Tables(spark):
            inner = cut_lineage(spark.range(10))
            second = cut_lineage(inner.filter("id > 3"), inner)
            assert len(written(spark) - before) == 1 and second.count() == 6
            third = outer.put(second)
        assert len(written(spark) - before) == 1 and third.count() == 6
        raise KeyError
    assert not written(spark) - before and spark.conf.get(name) == kept


def test_ties_with_their_spans_give_the_same_blocks(spark):
    items = spark.createDataFrame([(f"i{k:03d}", k * 7000, k * 7000 + (k % 5) * 3000) for k in range(120)], "id string, start_ms bigint, end_ms bigint")
    ties = items.select("id", F.concat(F.lit("k"), (F.crc32("id") % 9).cast("string")).alias("key"), F.lit(40_000).cast("bigint").alias("horizon_ms"))
    bare = {(r.id, r.block) for r in tied_blocks(items, ties).collect()}
    with Tables(spark):
        spans = {(r.id, r.block) for r in tied_blocks(items, ties.join(items, "id")).collect()}
    assert bare == spans and len(bare) > 20


def test_settled_joins_give_the_same_keys(spark):
    rows = [(k, k * 200_000 * (k % 3), f"v{k % 7}", k % 2) for k in range(60)]
    keyed = spark.createDataFrame(rows, "seq bigint, ms bigint, id_value string, id_field int").withColumn("group_key", F.concat_ws(":", F.col("id_field").cast("string"), "id_value"))
    fields = Grouping().fields
    plain = {tuple(r) for r in split_by_gap(merge_same_value(keyed, fields)).collect()}
    assert plain == {tuple(r) for r in split_by_gap(merge_same_value(keyed, fields, cut_lineage), settle=cut_lineage).collect()} and len({r[4] for r in plain}) > 14
