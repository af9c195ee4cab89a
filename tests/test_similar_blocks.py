"""Similar rows by blocks that are written once: no row is sent to all blocks, and all ways of cutting blocks give the same pairs."""

import random

from pyspark.sql import functions as F

from mnemora.operators import joins


def rows_of(seed, n):
    r = random.Random(seed)
    common, rare = [f"w{i}" for i in range(12)], [f"r{i}" for i in range(300)]
    return [(f"k{i}", r.sample(common, r.choice([0, 1, 5, 9])) + r.sample(rare, r.choice([0, 2, 20]))) for i in range(n)]


def pairs_of(rows, threshold):
    sets = [(i, set(s)) for i, s in rows if s]
    out = [(*sorted((a, b)), len(s & t) / len(s | t)) for k, (a, s) in enumerate(sets) for b, t in sets[:k] if a != b]
    return sorted(x for x in out if x[2] >= threshold - 1e-9)


def test_blocks_are_not_sent_by_exchange(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK", 40)
    d = spark.createDataFrame(rows_of(1, 200), "id string, s array<string>")
    plan = joins.similar_pairs(d, "id", "s", 0.2)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan and "Generate" not in plan


def test_all_ways_of_cutting(spark, monkeypatch):
    rows = [*rows_of(2, 160), ("k1", ["w1", "r1"]), ("k1", ["w1", "r1"]), ("k900", ["w1", "r1"])]  # an id three times
    d = spark.createDataFrame([*rows, (None, ["w1"]), ("k901", None), ("k902", [None])], "id string, s array<string>")
    for threshold, block, terms, tile, frequent, columns in ((0.2, 8192, 2**20, 1024, 48, 512), (0.2, 30, 100, 8, 1, 512), (0.5, 64, 2**20, 16, 2, 3), (0.1, 50, 1, 7, 100, 5)):
        for k, v in {"BLOCK": block, "TERMS": terms, "TILE": tile, "FREQUENT": frequent, "COLUMNS": columns}.items():
            monkeypatch.setattr(joins, k, v)
        got = sorted(tuple(r) for r in joins.similar_pairs(d, "id", "s", threshold).collect())
        assert got == pairs_of(rows, threshold)


def test_terms_with_one_number_are_told_apart(spark, monkeypatch):
    number = joins._number
    monkeypatch.setattr(joins, "_number", lambda seed: number(seed) if seed else lambda t: F.length(t).cast("long"))
    rows = rows_of(3, 60)
    got = sorted(tuple(r) for r in joins.similar_pairs(spark.createDataFrame(rows, "id string, s array<string>"), "id", "s", 0.2).collect())
    assert got == pairs_of(rows, 0.2)
