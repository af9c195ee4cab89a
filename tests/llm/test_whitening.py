import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemora.llm.whitening import whiten

SHAPE = "vec_id long, embedding array<double>"


def brute(vectors, components=32):
    """(n, deviations, eigenvalues, covariance of x, centred x) in Python's integers where it must be exact."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x)]
    dev = [sum((n * c - t) ** 2 for c, t in zip(v, s)) for v in x]
    centred = np.array([[(n * c - t) / n for c, t in zip(v, s)] for v in x])
    v = centred.T @ centred / n
    return n, dev, np.linalg.eigvalsh(v)[::-1][:components], v, centred


def check(got, vectors, components=32, rank=None):
    ids = sorted(vectors)
    n, dev, e, v, centred = brute([vectors[i] for i in ids], components)
    by = {r.vec_id: r for r in got}
    assert sorted(by) == ids and {r.n for r in got} == {n}
    assert [int(by[i].deviation) for i in ids] == dev
    z = np.array([by[i].whitened for i in ids])
    k = z.shape[1]
    assert k == min(components, v.shape[0])
    real = k if rank is None else rank
    assert np.allclose(by[ids[0]].explained[:real], e[:real] / np.trace(v), rtol=1e-9) and not np.any(by[ids[0]].explained[real:])
    error = np.abs(z.T @ z / n - np.outer(z.mean(0), z.mean(0)) - np.eye(k))
    assert error[:real, :real].max() < 1e-9 and by[ids[0]].identity_error == pytest.approx(error.max(), abs=1e-9)
    assert not z[:, real:].any()
    # each component is one unit eigenvector for all rows: centred rows are mapped by one matrix
    w = np.linalg.lstsq(centred, z, rcond=None)[0][:, :real] * np.sqrt(e[:real])
    assert np.allclose(v @ w, w * e[:real], atol=1e-6 * e[0])


def test_the_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    vectors = {r.vec_id: r.embedding for r in rows.collect()}
    check(whiten(rows).collect(), vectors)


def test_odd_rows(spark):
    r = np.random.default_rng(0)
    good = {i: [float(c) for c in r.normal(size=5) * [1, 5, 0.2, 3, 9]] for i in range(60)}
    bad = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [float("nan")] * 5), (103, [float("inf")] * 5)]
    rows = [*good.items(), *bad, (3, good[3]), (None, good[4])]
    d = spark.createDataFrame(rows, SHAPE).select("*", F.lit(1).alias("id"), F.lit(2).alias("n"), F.lit("x").alias("whitened"))
    got = whiten(d).collect()
    assert len(got) == 62 and {x.n for x in got} == {62} and all(x.length == 5 and x.identity_error < 1e-9 for x in got)
    assert len({str(x.whitened) for x in got if x.vec_id == 3}) == 1 and sum(x.vec_id is None for x in got) == 1
    check(whiten(d.where("vec_id is not null").dropDuplicates(["vec_id"]), components=3).collect(), good, components=3)
    assert whiten(d.limit(0)).collect() == []


def test_no_variance_and_few_rows(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(4)], SHAPE)
    assert all((r.deviation, r.whitened, r.identity_error) == (0, [0.0] * 3, 1.0) for r in whiten(same).collect())
    few = {0: [0.0, 1.0, 2.0, 5.0], 1: [3.0, 0.0, 1.0, 1.0], 2: [1.0, 1.0, 4.0, 0.5]}
    check(whiten(spark.createDataFrame(list(few.items()), SHAPE)).collect(), few, rank=2)
    (r,) = whiten(spark.createDataFrame([(1, [5.0])], SHAPE)).collect()
    assert (r.n, r.deviation, r.whitened, r.identity_error) == (1, 0, [0.0], 1.0)


def test_lengths_are_spaces_of_their_own_and_large_entries_are_exact(spark):
    a = {i: [float(i % 7), float(i * i % 11)] for i in range(40)}
    b = {100 + i: [float(10**8 * i), -1.5 * i * i, 0.25 * (i % 3)] for i in range(30)}
    d = spark.createDataFrame([*a.items(), *b.items(), (500, []), (501, [])], SHAPE)
    got = whiten(d).collect()
    check([r for r in got if r.length == 2], a)
    assert [int(r.deviation) for r in sorted((r for r in got if r.length == 3), key=lambda r: r.vec_id)] == brute(list(b.values()))[1]
    assert [(r.n, r.whitened, r.explained) for r in got if r.length == 0] == [(2, [], [])] * 2
    far = whiten(spark.createDataFrame([(0, [1e300]), (1, [-1e300]), (2, [0.0])], SHAPE)).collect()
    assert {int(r.deviation) for r in far} == {9 * 2**80, 0}
