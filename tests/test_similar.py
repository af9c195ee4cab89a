"""Pairs of similar rows by blocks, against all pairs."""

import random

from mnemora.operators import joins


def test_similar_pairs_in_blocks(spark, monkeypatch):
    r = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, r.choices(words, k=r.choice([1, 3, 12]))) for i in range(150)] + [(500, []), (501, None), (502, ["w1", "w1"])]
    sets = {i: set(s) for i, s in rows if s}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.2 * len(sets[a] | sets[b])}
    d = spark.createDataFrame(rows, "id long, s array<string>")
    for block, frequent in ((2048, 64), (40, 5)):
        monkeypatch.setattr(joins, "BLOCK", block)
        monkeypatch.setattr(joins, "FREQUENT", frequent)
        got = joins.similar_pairs(d, "id", "s", 0.2)
        assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()  # no exchange of pairs that share a term
        assert {(x.a, x.b) for x in got.collect()} == want and got.count() == len(want)
