import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemora.llm.permutation_index import permutation_search
from mnemora.llm.pivot_table import exact_search

SHAPE = "vec_id long, embedding array<float>, label int, id string, score string"
EVERY_20 = "id % 20 = 0"
NAN, INF = float("nan"), float("inf")


def vectors(seed=0, n=600, dim=8):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[n // 3 : n // 2] = x[0]  # many equal ones
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    o = 20 * n  # the odd ones have ids of their own
    rows += [(o, None), (o + 20, [0.0] * dim), (o + 40, [NAN] + [1.0] * (dim - 1)), (o + 60, [INF] * dim), (o + 1, [None] + [1.0] * (dim - 1)), (None, [1.0] * dim), (o + 80, [1.0, 2.0]), (o + 81, [2.0, 1.0]), (o + 100, [])]
    rows += [rows[5], rows[40]]  # repeated rows
    return rows


def brute(rows, measure, k, zero):
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and (zero or any(v))}
    want = set()
    for i, q in ok:
        if i % 20 == 0:
            found = sorted((-measure(q, v), j) for j, v in ok if j != i and len(v) == len(q))[:k]
            want |= {(i, r, j, -s) for r, (s, j) in enumerate(found, 1)}
    return want


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "x") for i, v in rows], SHAPE).repartition(3)


@pytest.mark.parametrize("block", [64, 8192])
def test_exact_search_equals_brute_force(spark, block):
    rows = vectors()
    whole = lambda a, b: int(sum(np.floor(64 * np.float64(x)) * np.floor(64 * np.float64(y)) for x, y in zip(a, b)))
    got = {tuple(r) for r in exact_search(frame(spark, rows), F.expr(EVERY_20), k=20, pivots=6, block=block).collect()}
    assert got == brute(rows, whole, 20, True)


def test_products_beyond_doubles_are_exact(spark):
    rows = [(0, [3e7, 1.0]), (1, [3e7, 5.0]), (2, [3e7, 4.0])]
    got = [(r.vec_id, r.score) for r in exact_search(frame(spark, rows), F.expr(EVERY_20), k=2).orderBy("rank").collect()]
    big = (64 * int(np.float32(3e7))) ** 2
    assert got == [(1, big + 64 * 320), (2, big + 64 * 256)]


def test_index_finds_at_least_nine_of_ten(spark):
    rows = vectors(n=3000, dim=16)
    exact = brute(rows, lambda a, b: float(np.dot(np.float64(a), np.float64(b))), 20, False)
    found = permutation_search(frame(spark, rows), F.expr(EVERY_20), k=20, pivots=128, keep=48, block=500).collect()
    pairs = {(r.query_id, r.vec_id) for r in found}
    assert len(pairs & {(q, j) for q, _, j, _ in exact}) >= 0.9 * len(exact)
    value = {i: np.float64(v) for i, v in rows if i is not None and v is not None and None not in v}
    assert all(r.score == pytest.approx(float(value[r.query_id] @ value[r.vec_id]), rel=1e-12, abs=1e-12) for r in found)
    for q in {r.query_id for r in found}:
        mine = sorted((r["rank"], -r.score, r.vec_id) for r in found if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1)) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)


def test_few_candidates_and_empty_tables(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5])]
    assert [tuple(r) for r in permutation_search(frame(spark, rows), F.expr(EVERY_20)).collect()] == [(0, 1, 1, 0.5)]
    none = spark.createDataFrame([], SHAPE)
    assert permutation_search(none, F.expr(EVERY_20)).count() == exact_search(none, F.expr(EVERY_20)).count() == 0


def test_groups_of_vectors_are_searched_in_few_cells(spark):
    """Vectors in groups: both searches leave most pairs out, and the exact one finds what brute force finds."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(40, 16))
    rows = [(i, (centre[i % 40] + 0.05 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(4000)]
    seen = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    whole = lambda a, b: int(np.floor(64 * np.float64(a)) @ np.floor(64 * np.float64(b)))
    got = {tuple(r) for r in exact_search(frame(spark, rows), F.expr(EVERY_20), k=20, block=100, seen=seen).collect()}
    assert got == brute(rows, whole, 20, True)
    pairs = 200 * 4000
    assert seen[0].value < 0.05 * pairs and seen[1].value < 0.5 * pairs
    exact = brute(rows, lambda a, b: float(np.dot(np.float64(a), np.float64(b))), 20, False)
    found = permutation_search(frame(spark, rows), F.expr(EVERY_20), k=20, block=100).collect()
    assert len({(r.query_id, r.vec_id) for r in found} & {(q, j) for q, _, j, _ in exact}) >= 0.9 * len(exact)


@pytest.mark.parametrize("big", [1e15, 1e200, 1.7e308])
def test_components_beyond_longs_keep_their_order(spark, big):
    rows = [(0, [1.0, 0.0]), (1, [big, 5.0]), (2, [-big, 4.0]), (3, [2.0, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in exact_search(d, F.expr("id = 0"), k=3).orderBy("rank").collect()]
    top = min(int(min(64 * big, 1.7976931348623157e308)) * 64, 2**63 - 1)
    assert got == [(1, top), (3, 64 * 128), (2, -top - (top == 2**63 - 1))]
