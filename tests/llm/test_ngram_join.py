import random

import pytest
from conftest import documents, frame, words_of

from mnemora.llm.components import connected_components
from mnemora.llm.ngram_join import first_of_each, jaccard_components


def grams(text, n):
    w = words_of(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, percent):
    sets, root = [grams(r[1], n) for r in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    own = lambda i: rows[i][0] if not sets[i] else low.get(find(i))
    return sorted(((r[0] is None, r[0] or 0, len(sets[i]), own(i) is None, own(i) or 0) for i, r in enumerate(rows))), [find(i) for i in range(len(rows))], sets


@pytest.mark.parametrize(("n", "percent", "block"), [(3, 90, 512), (5, 80, 2), (1, 50, 3), (2, 70, 512)])
def test_components_equal_brute_force(spark, n, percent, block):
    rows = documents(seed=n, n=150)
    got = jaccard_components(frame(spark, rows).repartition(4), n, percent, block=block, buckets=5).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id is None, r.component_id or 0) for r in got) == brute(rows, n, percent)[0]


def test_many_near_copies_in_small_blocks(spark):
    r = random.Random(3)
    base = [f"w{r.randrange(10**6)}" for _ in range(100)]
    rows = []
    for i in range(80):
        w = list(base)
        for _ in range(r.randrange(3)):
            w[r.randrange(100)] = f"v{r.randrange(10**6)}"
        rows.append((i, " ".join(w), "s"))
    got = jaccard_components(frame(spark, rows), 3, 90, block=10).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_shingles, False, r.component_id) for r in got) == brute(rows, 3, 90)[0]


def test_one_of_each_group_stays(spark, docs, rows):
    kept = first_of_each(docs, 5, 80)
    assert set(kept.columns) == set(docs.columns)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect())
    _, group, sets = brute(rows, 5, 80)
    want, seen = [], set()
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0)):
        if not sets[i] or group[i] not in seen:
            want.append((rows[i][0] is None, rows[i][0] or 0, rows[i][1] or ""))
            seen.add(group[i])
    assert got == sorted(want)


def test_empty_table(spark, empty):
    assert jaccard_components(empty).count() == 0
    assert first_of_each(empty).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_connected_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
