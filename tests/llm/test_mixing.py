from collections import defaultdict

import pytest
from conftest import words_of

from mnemora.llm.mixing import mix_sources, mixture


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """By rounds: fill, stop at the caps, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full = share * sum(sizes.values()), {}
    while True:
        left, heavy = total - sum(full.values()), sum(weight[s] for s in order if s not in full)
        t = {s: full[s] if s in full else left * weight[s] / heavy for s in order}
        over = [s for s in order if s not in full and t[s] > most * sizes[s] + 1e-9]
        if not over:
            return t
        full |= {s: most * sizes[s] for s in over}


def check(mixed, rows):
    got = mixed.collect()
    assert len(got) == len(rows)
    sizes, taken, largest, target = defaultdict(int), defaultdict(int), defaultdict(int), {}
    for r in got:
        n = len(words_of(r.text))
        assert r["size"] == n and r.taken in (0, n, 2 * n)
        sizes[r.source] += n
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], n)
        target[r.source] = r.target
    want = targets(dict(sizes))
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    return {(r.doc_id, r.text): r.taken for r in got}


def test_targets_and_takes(spark, docs, rows):
    first = check(mix_sources(docs), rows)
    assert first == check(mix_sources(docs.repartition(7)), rows)  # reruns agree


def test_a_source_of_a_third_of_all_rows(spark):
    rows = [(i, "a b c " * (i % 7 + 1), "hot" if i % 3 == 0 else f"s{i % 17}") for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(mix_sources(d), rows)


def test_rows_are_repeated_as_taken(spark, docs):
    got, mixed = mixture(docs), mix_sources(docs).collect()
    assert got.columns == docs.columns and {r.taken for r in got.collect()} == {"x"}  # a column that clashes stays
    assert sum(len(words_of(r.text)) for r in got.collect()) == sum(r.taken for r in mixed)


def test_very_many_sources(spark):
    rows = [(i, "a b c " * (i % 5 + 1), f"site{i // 2}") for i in range(1200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(mix_sources(d), rows)


def test_empty_tables_and_no_words(spark, empty):
    assert mix_sources(empty).count() == 0
    d = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.target, r.taken) for r in mix_sources(d).collect()) == [(1, 0.0, 0), (2, 0.0, 0)]
