"""Vector operators against brute force."""

import numpy as np
from pyspark.sql import functions as F

from logweave.llm import cap_filters, pivot_index
from logweave.llm.common import components

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(ids, x, labels, threshold):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= threshold) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    root = dict(zip(ids, ids))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in zip(*np.nonzero(near)):
        p, q = find(ids[a]), find(ids[b])
        root[max(p, q)] = min(p, q)
    return {i: (int(near[k].sum()), find(i)) for k, i in enumerate(ids)}


def planted(rng, bases, copies, dim=64, spread=0.045):
    rows = []
    for _ in range(bases):
        base = rng.normal(size=dim)
        base /= np.linalg.norm(base)
        rows += [base + spread * rng.normal(size=dim) for _ in range(rng.integers(*copies))]
    return np.array(rows, dtype=np.float32)


def test_cap_filters_find_all_links(spark, monkeypatch):
    monkeypatch.setattr(cap_filters, "BLOCK", 32)
    rng = np.random.default_rng(2)
    x = np.concatenate([planted(rng, 150, (1, 6)), planted(rng, 1, (120, 121), spread=0.02), planted(rng, 300, (1, 2))])
    x = np.concatenate([x, x[:7], x[:7] * 3])
    labels = rng.integers(0, 3, len(x))
    labels[150:] = 1
    ids = list(range(len(x)))
    odd = [(9001, None, 1), (9002, [0.0] * 64, 1), (9003, [float("nan")] + [1.0] * 63, 1), (9004, x[0].tolist(), None), (9005, [], 1), (9006, [1.0, 0.0], 1), (9007, [1.0] + [None] * 63, 1)]
    rows = [(i, v.tolist(), int(lab)) for i, v, lab in zip(ids, x, labels)] + odd
    table = spark.createDataFrame(rows, SCHEMA).withColumn("component_id", F.lit("clash"))
    got = {r.vec_id: r for r in cap_filters.near_duplicates(table).collect()}
    expected = brute(ids, x.astype(np.float64), labels, 0.93)
    assert sum(n for n, _ in expected.values()) > 10_000
    assert {i: (got[i].n_links, got[i].component_id) for i in ids} == expected
    assert all(got[i].kept == (got[i].component_id == i) for i in ids)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, _, _ in odd)
    assert cap_filters.near_duplicates(table.limit(0)).count() == 0


def exact(ids, x, k=10):
    out = {}
    for q, i in enumerate(ids):
        if i % 100 == 0:
            distance = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
            distance[q] = np.inf
            order = np.lexsort((ids, distance))[:k]
            out[i] = [(int(ids[o]), float(distance[o])) for o in order if distance[o] < np.inf]
    return out


def search(table):
    rows = pivot_index.search(table, table.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def test_small_tables_are_searched_in_full(spark):
    """A small table has few pivots, so that a query's files hold nearly all of it."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(350, 16)).astype(np.float32)
    x[7] = x[8]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(400, None, 0), (500, [0.0] * 16, 0), (None, x[0].tolist(), 0), (600, [1.0, 2.0], 0)]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("clash"))
    expected, got = exact(np.arange(350), x.astype(np.float64)), search(table)
    assert {q: [v for v, _ in r] for q, r in got.items()} == {q: [v for v, _ in r] for q, r in expected.items()}
    assert all(abs(a - b) < 1e-9 for q in got for (_, a), (_, b) in zip(got[q], expected[q]))
    few = search(spark.createDataFrame(rows[:4], SCHEMA))
    assert [v for v, _ in few[0]] == [v for v, _ in exact(np.arange(4), x[:4].astype(np.float64))[0]]
    assert search(table.limit(0)) == {}


def test_recall_of_the_index(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    expected, got = exact(np.arange(6000), x.astype(np.float64)), search(table)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in expected[q]}) for q in expected)
    assert hits >= 0.9 * 10 * len(expected) and all(len(r) == 10 for r in got.values())


def test_footrule_is_the_sum_of_displacements():
    rng = np.random.default_rng(8)
    orders = np.stack([rng.permutation(40)[:12] for _ in range(50)])
    place = lambda o: [list(o).index(p) if p in o else 12 for p in range(40)]
    for k in range(5):
        assert pivot_index.footrule(orders[k], orders, 40).tolist() == [sum(abs(a - b) for a, b in zip(place(orders[k]), place(o))) for o in orders]


def test_search_of_copies_repeated_ids_and_heaps(spark, monkeypatch):
    """Ties among copies go to the smaller ids, also beyond what is reranked; heaps smaller than k are answered in full."""
    monkeypatch.setattr(pivot_index, "CHUNK", 64)
    monkeypatch.setattr(pivot_index, "LOT", 2)
    rng = np.random.default_rng(9)
    x = np.concatenate([np.repeat(rng.normal(size=(1, 8)), 700, axis=0), np.repeat(40 * rng.normal(size=(300, 8)), 3, axis=0) + 0.01 * rng.normal(size=(900, 8))]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    again = [(1500, x[0].tolist(), 0), (1500, x[1599].tolist(), 0), (1599, x[1599].tolist(), 0)]
    got = search(spark.createDataFrame(rows + again, SCHEMA))
    expected = exact(np.arange(1600), x.astype(np.float64))
    for q in range(0, 700, 100):
        others = [i for i in range(700) if i != q][:10]
        assert [v for v, _ in got[q]] == others and all(d == 0 for _, d in got[q])
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in expected[q]}) for q in expected if q >= 700 and q != 1500)  # 1500 has two vectors
    assert hits >= 0.9 * 10 * 8 and all(len(r) == 10 for r in got.values())


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(edges).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[k] == 100 for k in range(100, 160)) and len(got) == 101


def test_pairs_at_the_threshold_do_not_depend_on_the_size_of_their_bucket():
    """Copies of pairs within rounding of 0.93, compared one by one and as matrices."""
    rng = np.random.default_rng(12)
    pairs = []
    for _ in range(400):
        a, b = (x / np.linalg.norm(x) for x in rng.normal(size=(2, 64)))
        b = b - (a @ b) * a
        b /= np.linalg.norm(b)
        near = 0.93 * a + np.sqrt(1 - 0.93**2) * b
        pairs.append((a, near / np.linalg.norm(near)))
    unit = np.array([v for p in pairs for v in p])
    filters, offsets = np.full(len(unit), 5, dtype=np.int64), np.arange(len(unit) + 1)
    one = np.array([0]), np.array([-1]), np.array([len(unit)])
    many = np.arange(0, len(unit), 2), np.full(len(pairs), -1), np.arange(2, len(unit) + 1, 2)
    found = []
    for starts, middles, ends in (one, many):
        met = cap_filters._near_pairs(unit, starts, middles, ends, 0.93, np.full(len(unit), 5), filters, offsets)
        found.append({(int(a), int(b)) for i, j in met for a, b in zip(i, j) if b == a + 1 and a % 2 == 0})
    assert found[0] == found[1] and 20 < len(found[0]) < 380
