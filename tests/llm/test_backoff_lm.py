import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from conftest import crc, words_of
from pyspark.sql import functions as F

from mnemora.llm.backoff_lm import _answer, _short, answered, score_texts
from mnemora.llm.common import crc_of_id


def model(rows, order, mass):
    """The formula in plain Python: (n_tokens, n_known, N, base, score) of a text."""
    grams = [Counter() for _ in range(order + 1)]
    for i, t in rows:
        if i is not None and crc(i) % 5 != 1:
            w = ["<s>"] * (order - 1) + words_of(t) + ["</s>"]
            for k in range(order - 1, len(w)):
                for n in range(1, order + 1):
                    grams[n][tuple(w[k - n + 1 : k + 1])] += 1
    total, distinct = sum(grams[1].values()), len(grams[1])
    history = [Counter() for _ in range(order + 1)]
    for n in range(2, order + 1):
        for g, c in grams[n].items():
            history[n][g[:-1]] += c

    def score(t):
        w = ["<s>"] * (order - 1) + words_of(t) + ["</s>"]
        base = full = known = 0
        for k in range(order - 1, len(w)):
            c = grams[1][(w[k],)]
            p = (c + 0.5) / (total + 0.5 * (distinct + 1))
            base, known = base + math.log10(p), known + (c > 0)
            for n in range(2, order + 1):
                g = tuple(w[k - n + 1 : k + 1])
                p = (grams[n][g] + mass * p) / (history[n][g[:-1]] + mass)
            full += math.log10(p)
        return len(w) - order + 1, known, total, base, full

    return score


@pytest.mark.parametrize(("order", "mass"), [(1, 4.0), (2, 4.0), (3, 2.5)])
def test_scores_equal_the_formula(spark, docs, rows, order, mass):
    score = model([(i, t) for i, t, _ in rows], order, mass)
    train = crc_of_id(F.col("doc_id")) % 5 != 1
    got = score_texts(docs, train, order=order, mass=mass, buckets=7).collect()
    assert len(got) == len(rows)
    want = sorted(((i is None, i or 0, *score(t)) for i, t, _ in rows))
    mine = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    for a, b in zip(mine, want):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def test_no_training_rows_and_empty_tables(spark, docs, empty):
    got = score_texts(docs, F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens, r.score) for r in got} == {(0, 0, 0.0)}
    assert score_texts(empty, F.lit(True)).count() == 0



def test_counts_beyond_32_bits_are_summed():
    """Two blocks that have a word three thousand million times each, and one that does not."""
    keys, n = np.arange(1, 4, dtype=np.uint64), 3_000_000_000
    rows = [(7, 1, 1, _short(keys), np.array([n, 5, 0], np.uint32).tobytes()), (7, 2, 1, _short(keys[:2]), np.array([n, 1], np.uint32).tobytes()), (7, 3, 1, _short(keys[1:]), np.array([2, 1], np.uint32).tobytes())]
    out = _answer(pd.DataFrame(rows, columns=["bucket", "block", "size", "keys", "counts"]))
    by = {b: part for b, part in out.groupby("block")}
    assert answered(by[1]).tolist() == [2 * n, 8, 1] and answered(by[2]).tolist() == [2 * n, 8] and answered(by[3]).tolist() == [8, 1]
    assert np.frombuffer(by[-1]["counts"].iloc[0], np.float64).tolist() == [2 * n + 9, 3]
