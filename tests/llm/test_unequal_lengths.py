import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemora.llm.permutation_index import permutation_search


@pytest.mark.parametrize("spread,outlier", [(0.5, 1), (1.0, 1), (0.25, 100)])
def test_defaults_find_nine_of_ten_among_unequal_lengths(spark, spread, outlier):
    """Directions without clusters, one full block, the production defaults."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(8192, 64))
    x *= np.exp(spread * rng.normal(size=(8192, 1))) / np.linalg.norm(x, axis=1, keepdims=True)
    x[1] *= outlier
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {(r.query_id, r.vec_id) for r in permutation_search(d, F.expr("id % 200 = 0"), k=20).collect()}
    want = set()
    for i in range(0, len(x), 200):
        score = x @ x[i]
        score[i] = -np.inf
        want |= {(i, int(j)) for j in np.argsort(-score)[:20]}
    assert len(found & want) >= 0.9 * len(want)


def test_very_long_vectors_are_found(spark):
    rows = [(0, [1.0, 0.0]), (1, [1e308, 1e308]), (2, [-1e308, 1e308]), (3, [1e-300, 0.0])]
    found = permutation_search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.expr("id = 0"), k=3).collect()
    assert [r.vec_id for r in sorted(found, key=lambda r: r["rank"])] == [1, 3, 2]
