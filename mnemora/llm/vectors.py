"""What the two vector searches share: valid vectors, cells of near vectors, blocks of bounded size, and the merge of their answers.

Vectors are dealt into cells, each vector once. A query goes only to the cells that its search names, so where vectors
lie in groups the work of a query does not grow with the table. A cell is cut by a hash into blocks of bounded size, and
the queries that open it into groups of bounded size, so tasks are bounded whatever the vectors, equal ones too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Candidates, and queries, that meet in a task, and the most cells.
BLOCK, QUERIES, CELLS = 8192, 8192, 4096

PLACED = "id long, length int, asks boolean, cell int, far double, vector binary, extra binary"
ROUTED = "id long, length int, vector binary, least double, cells array<int>"
_PLACED = pa.schema([("id", pa.int64()), ("length", pa.int32()), ("asks", pa.bool_()), ("cell", pa.int32()), ("far", pa.float64()), ("vector", pa.binary()), ("extra", pa.binary())])
_ROUTED = pa.schema([("id", pa.int64()), ("length", pa.int32()), ("vector", pa.binary()), ("least", pa.float64()), ("cells", pa.list_(pa.int32()))])


def finite_rows(vectors: DataFrame, id_col: str, vector_col: str, zero: bool) -> DataFrame:
    """(id, vector array<double>) of the rows that take part: id and vector known, and all components finite.

    zero: whether vectors of zeros, and empty ones, take part.
    """
    x = F.col("vector")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    d = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    d = d.where("id is not null and vector is not null").where(~bad)
    return d if zero else d.where(F.exists(x, lambda v: v != 0))


def sampled(rows: DataFrame, many: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors the ids and vectors of a sample: of all rows, the `many` with the smallest hashes."""
    found: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vector", "id"), "id").limit(many).collect():
        found.setdefault(len(r.vector), []).append(r)
    return {n: (np.array([r.id for r in rs], np.int64), np.array([r.vector for r in rs], np.float64).reshape(len(rs), n)) for n, rs in found.items()}


def cells_for(rows: int, block: int) -> int:
    """How many cells a table of so many rows has: about a block each, and CELLS at most."""
    return int(min(max(-(-rows // block), 1), CELLS))


def stacked(cells, length: int) -> np.ndarray:
    """Packed vectors of one length as the rows of a matrix."""
    return np.frombuffer(b"".join(cells), np.float64).reshape(len(cells), length) if length else np.zeros((len(cells), 0))


def placed_rows(rows: DataFrame, is_query: Column, place: Callable[[int, np.ndarray], tuple[np.ndarray, np.ndarray, list[bytes]]]) -> DataFrame:
    """Every row of (id, vector) with its cell, as PLACED. place(length, vectors): cells, distances to their centres, more bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, flat = b["vector"].value_lengths().to_numpy(), b["vector"].flatten().to_numpy()
            start = np.cumsum(size) - size
            for n in np.unique(size):
                mine = np.flatnonzero(size == n)
                x = flat[start[mine][:, None] + np.arange(n)]
                cell, far, extra = place(int(n), x)
                at = pa.array(mine)
                columns = [b["id"].take(at), pa.array(np.full(len(mine), n, np.int32)), b["asks"].take(at), pa.array(cell.astype(np.int32)), pa.array(far.astype(np.float64)), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(extra, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=_PLACED)

    return written(rows.select("id", "vector", F.coalesce(is_query, F.lit(False)).alias("asks")).mapInArrow(run, PLACED), "vectors-placed")


def routed_queries(placed: DataFrame, route: Callable[[int, np.ndarray, np.ndarray], tuple[np.ndarray, list[np.ndarray]]]) -> DataFrame:
    """The queries of placed with the cells that they open, as ROUTED. route(length, ids, vectors): a score to beat, and the cells, for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b["length"].to_numpy()
            for n in np.unique(lengths):
                at = pa.array(np.flatnonzero(lengths == n))
                vectors, ids = b["vector"].take(at), b["id"].take(at)
                least, cells = route(int(n), ids.to_numpy(), stacked(vectors.to_pylist(), int(n)))
                yield pa.RecordBatch.from_arrays([ids, b["length"].take(at), vectors, pa.array(least.astype(np.float64)), pa.array([c.astype(np.int32) for c in cells], pa.list_(pa.int32()))], schema=_ROUTED)

    return written(placed.where("asks").select("id", "length", "vector").mapInArrow(run, ROUTED), "vectors-routed")


def search_cells(placed: DataFrame, routed: DataFrame, k: int, search: Callable[..., pd.DataFrame], score_type: str, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """The k best candidates of each query: (query_id, rank, vec_id, score), ties to the smaller vec_id.

    A group of queries meets a block of a cell in one task. search(cell, query ids, queries, least scores, ids, vectors,
    more bytes) returns (query_id, vec_id, score), k rows at most for a query, its own id left out. Vectors of other
    lengths do not meet. An id with several vectors is several candidates, and several queries whose answers count as
    one query's.
    """
    up = lambda n, size: F.ceil(n / size).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    opened = routed.select("*", F.explode("cells").alias("cell")).drop("cells")
    held = placed.groupBy("length", "cell").agg(up(F.count("*"), block).alias("blocks"))
    asked = opened.groupBy("length", "cell").agg(up(F.count("*"), queries).alias("groups"))
    plan = written(held.join(asked, ["length", "cell"]), "vectors-plan")  # a row for each cell
    deal = F.xxhash64("id", "vector")
    data = placed.join(plan, ["length", "cell"]).select("length", "cell", F.pmod(deal, "blocks").alias("block"), every(F.col("groups")).alias("set"), "id", "vector", "extra")
    ask = opened.join(plan, ["length", "cell"]).select("length", "cell", every(F.col("blocks")).alias("block"), F.pmod(F.xxhash64(deal), "groups").alias("set"), "id", "vector", "least")

    def run(key: tuple, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return search(int(key[1]), q["id"].to_numpy(), stacked(q["vector"].tolist(), int(key[0])), q["least"].to_numpy(), x["id"].to_numpy(), stacked(x["vector"].tolist(), int(key[0])), x["extra"].tolist())

    keys = ["length", "cell", "block", "set"]
    found = ask.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(run, f"query_id long, vec_id long, score {score_type}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, highest first, ties to smaller ids."""
    if len(ids) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        few = np.flatnonzero(scores >= cut)
    else:
        few = np.arange(len(ids))
    return few[np.lexsort((ids[few], -scores[few]))][:k]


def answers(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """(query_id, vec_id, score) from each query's id, found ids and scores."""
    return pd.DataFrame({"query_id": np.repeat([q for q, _, _ in parts], [len(i) for _, i, _ in parts]), "vec_id": np.concatenate([i for _, i, _ in parts]), "score": np.concatenate([s for _, _, s in parts])})
