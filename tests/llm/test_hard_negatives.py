"""Hard negatives against a plain re-computation with Python integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.llm import hard_negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, rank string"


def plain(rows, scale=256, n_positives=5, k=10, lowest=30, highest=90):
    """``rows`` (id, vector, label) of one length and different ids; whole integers throughout."""
    whole = [(i, [math.floor(scale * float(np.float32(x))) for x in v], lab) for i, v, lab in rows]
    out = []
    for a, v, lab in whole:
        if a % 100:
            continue
        ranked = sorted(((-sum(p * q for p, q in zip(v, w)), i, other) for i, w, other in whole if i != a))
        for s, p, _ in [r for r in ranked if r[2] == lab][:n_positives]:
            within = [(i, -t) for t, i, other in ranked if other != lab and lowest * -s <= 100 * -t <= highest * -s][:k]
            out += [(a, p, n, i, -s, t) for n, (i, t) in enumerate(within, 1)]
    return out


def got_of(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("factor", [1.0, 3e6])
def test_equal_to_whole_numbers(spark, monkeypatch, factor):
    """Blocks and lots smaller than the table; ties; with the factor, sums that doubles do not hold."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 100)
    monkeypatch.setattr(hard_negatives, "LOT_BYTES", 600)
    monkeypatch.setattr(hard_negatives, "AT_ONCE", 2)
    rng = random.Random(6)
    base = [[rng.choice((-1.0, -0.25, 0.1, 0.5, 1.0)) * factor for _ in range(6)] for _ in range(40)]
    rows = [(i, rng.choice(base), rng.randrange(3)) for i in range(900)]
    rows[5] = (5, [0.0] * 6, 1)
    table = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(5)
    mined = hard_negatives.mine(table, table.filter("vec_id % 100 = 0"))
    expected = sorted(plain(rows))
    assert len(expected) > 200 and got_of(mined) == expected


def test_rows_that_take_no_part_and_repeated_rows(spark):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], i % 2) for i in range(60)]
    odd = [(None, [1.0] * 4, 0), (61, None, 0), (62, [1.0] * 4, None), (63, [float("nan")] + [1.0] * 3, 1), (64, [None] + [1.0] * 3, 1), (65, [float("inf")] * 4, 1), (66, [9.0] * 5, 1), (67, [], 1)]
    many = rows + odd + [rows[0], rows[7], rows[7], rows[8]]
    table = spark.createDataFrame([(*r, "clash") for r in many], SCHEMA)
    assert got_of(hard_negatives.mine(table, table.filter("vec_id % 100 = 0"))) == sorted(plain(rows))
    assert got_of(hard_negatives.mine(table.limit(0), table.limit(0))) == []
    assert got_of(hard_negatives.mine(table, table.filter("vec_id = 62"))) == []
    few = table.filter("vec_id in (0, 1, 2)").dropDuplicates(["vec_id"]).withColumn("more", F.lit(1))
    assert got_of(hard_negatives.mine(few, few.filter("vec_id = 0"))) == sorted(plain(rows[:3]))
