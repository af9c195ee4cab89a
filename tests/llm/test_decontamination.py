import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemora.llm.decontamination import Automaton, find_contamination

OWN = ["n_words", "n_hit", "spans", "items"]


def words_at(text):
    """(word in plain form, start, end) by the contract's pattern."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [(m.group(), *m.span()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]


def brute(text, items, size):
    w = words_at(text)
    plain, hit, cover = [x[0] for x in w], set(), {}
    for item, t in items:
        iw = [x[0] for x in words_at(t)]
        k = min(size, len(iw))
        windows = {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)} if k else set()
        for i in range(len(plain) - k + 1):
            if k and tuple(plain[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                cover.setdefault(item, set()).update(range(i, i + k))
    spans = []
    for item, c in cover.items():
        for i in sorted(c):
            if i - 1 not in c:
                j = i
                while j + 1 in c:
                    j += 1
                spans.append((item, i, j, w[i][1], w[j][2]))
    return len(w), len(hit), sorted(spans, key=lambda s: (s[1], s[2], s[0] or "")), sorted(i for i in cover if i is not None)


def shown(r):
    return r.n_words, r.n_hit, [tuple(s) for s in r.spans], r["items"]


def cases():
    r = random.Random(3)
    vocabulary = ["a", "b", "Cé", "d1", "漢字", "e🙂", "ſ"]
    say = lambda k: "".join(r.choice(vocabulary) + r.choice([" ", "-", "\n", ". ", "@"]) for _ in range(k))
    items = [(str(i), say(r.choice([2, 3, 5, 8, 14]))) for i in range(12)]
    items += [("7", "again an item of that id"), (None, "item without any id here"), ("n", None), ("e", ""), ("p", "..!"), ("twin", items[0][1])]
    texts = [say(r.choice([1, 4, 30, 80])) for _ in range(40)]
    texts += [f"x {t or ''} y {(t or '').upper()} {t or ''}" for _, t in items] + [None, "", " . ", say(30000), "İtem wİthout ANY id here"]
    return items, texts


@pytest.mark.parametrize("size,states", [(4, 10**6), (4, 40), (10, 10**6), (1, 30)])
def test_equals_brute_force(spark, size, states):
    items, texts = cases()
    d = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0], texts[0]])], "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: r for r in find_contamination(d, b, size, states=states).collect()}
    assert len(got) == len(texts) + 2
    for i, t in enumerate(texts):
        want = brute(t, items, size)
        assert shown(got[i]) == want, t
        for s in got[i].spans[:5]:
            assert [x[0] for x in words_at(t[s.start : s.end])] == [x[0] for x in words_at(t)][s.first_word : s.last_word + 1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=5), max_size=8), st.lists(st.sampled_from("abcx"), max_size=40))
def test_the_automaton_finds_every_window(windows, text):
    windows = sorted(set(map(tuple, windows)))
    found = {(a, b, i) for a, b, items in Automaton([(w, [str(k)]) for k, w in enumerate(windows)]).matches([c.encode() for c in text]) for i in items}
    assert found == {(i, i + len(w) - 1, str(k)) for k, w in enumerate(windows) for i in range(len(text) - len(w) + 1) if tuple(text[i : i + len(w)]) == w}


def test_odd_tables(spark, docs, rows, empty):
    items = spark.createDataFrame([(1, "twice the same row"), (None, "no id here"), (2, None)], "item_id long, text string")
    d = docs.withColumns({"n_words": F.lit("mine"), "spans": F.lit(1), "_found": F.lit(2), "_key": F.lit(3)})
    got = find_contamination(d, items).collect()
    assert len(got) == len(rows) and all(r._found == 2 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert sorted((r.n_hit, r["items"]) for r in by[904]) == [(0, []), (4, ["1"]), (4, ["1"])]
    assert any(r.n_hit == 3 and r["items"] == [] and r.spans[0]["item"] is None for r in by[None])
    assert find_contamination(empty, items).count() == 0
    assert all(r.n_hit == 0 and r.spans == [] for r in find_contamination(docs, items.limit(0)).collect())
