"""Rows of a stream's key are held as numbers, and worked on in steps."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from mnemora.operators import retrieval
from mnemora.streaming import jobs


def test_rows_in_order_step_by_step(monkeypatch):
    monkeypatch.setattr(jobs, "STEP", 3)
    at = pd.to_datetime(["2024-01-01", "2024-01-01", "2023-01-01", "2025-01-01"])
    pieces = [pd.DataFrame({"ts": at, "id": [5, 2, 9, 1], "t": ["a", None, "b", "a"]}), pd.DataFrame({"ts": at[:1], "id": [3], "t": ["c"]})]
    got = list(jobs.in_order(iter(pieces), ["ts", "id"]))
    assert [len(x) for x in got] == [3, 2]
    d = pd.concat(got)
    assert d["id"].tolist() == [9, 2, 3, 5, 1] and d["t"].tolist() == ["b", None, "c", "a", "a"]
    assert d["ts"].iloc[0] == pd.Timestamp("2023-01-01").value // 1000
    assert list(jobs.in_order(iter([]), ["ts"])) == []


def test_cosine_of_few_scores_at_once(spark, monkeypatch):
    v = np.random.default_rng(1).normal(size=(60, 4)).round(1)
    d = spark.createDataFrame([(i, v[i % 50].tolist()) for i in range(60)], "vec_id long, embedding array<float>")
    rows = lambda: sorted(map(tuple, retrieval.nearest_by_cosine(d, F.col("id") % 3 == 0, 5).collect()))
    whole = rows()
    monkeypatch.setattr(retrieval, "SCORES", 100)
    assert rows() == whole and len(whole) == 100
