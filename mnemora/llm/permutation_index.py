"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. Vectors are dealt into cells by the nearest of some centres; a
query opens the cells nearest to it. In a cell, every pivot has an inverted file of the vectors that have it among
their nearest, with its place in their order. A query opens the files of its own nearest pivots and ranks what it finds
there by the footrule distance between the two orders, where a pivot that is not among a vector's nearest counts as the
place after them. Candidates within a distance are compared by their inner products, in double precision.

How many cells are opened, and the distance, are not given but measured: for a bounded sample of the queries, the true
nearest of all rows are found by brute force, and both are set so that the sample finds the wanted share of them. So
vectors in groups cost little and recall holds at every size; vectors without any structure cost a share of all pairs.

The largest inner product becomes the nearest direction by one more component: sqrt(M^2 - |x|^2) for a vector, and 0 for
a query. All vectors then have the length M, and their products with the queries stay the same. Pivots are of that
space, so a vector's length counts in its order. M is the length that one in a hundred exceeds, as a few very long
vectors would else make all others alike; those longer than M have a cell of their own, which all queries open, and
are all compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import BLOCK, answers, best, cells_for, finite_rows, placed_rows, routed_queries, sampled, search_cells, stacked

#: Lengths are held in units of this, so that they do not overflow.
UNIT = 2.0**64
#: The cell of vectors longer than M.
LONGER = -1


@dataclass(frozen=True)
class Index:
    """What fits the vectors of one length: M, the pivots and the centres of the cells, all lifted."""

    long: float
    pivots: np.ndarray
    centres: np.ndarray


def long_lengths(rows: DataFrame) -> dict[int, tuple[float, int]]:
    """The length M, in UNITs, and the number of rows, for the vectors of each number of components."""
    x = F.col("vector")
    most = F.array_max(F.transform(x, F.abs))
    length = most / UNIT * F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.pow(v / F.col("_most"), 2)))
    d = rows.withColumn("_most", most).groupBy(F.size("vector")).agg(F.percentile_approx(length, 0.99).alias("_length"), F.count("*"))
    return {n: (max(m, 5e-324), many) for n, m, many in d.collect()}


def lifted(x: np.ndarray, long: float) -> np.ndarray:
    """Vectors over the length M, with the component that gives each the length 1; longer ones are made shorter."""
    y = np.clip(x / UNIT / long, -1e150, 1e150)  # the squares do not overflow
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1)
    return np.c_[y, np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", y, y), 0))]


def level(q: np.ndarray) -> np.ndarray:
    """Queries in the lifted space: their directions alone, without overflow."""
    return np.c_[q / np.abs(q).max(axis=1, keepdims=True), np.zeros(len(q))]


def is_longer(x: np.ndarray, long: float) -> np.ndarray:
    return np.linalg.norm(np.clip(x / UNIT / long, -1e150, 1e150), axis=1) > 1 + 1e-9


def fit_index(rows: DataFrame, pivots: int, block: int, sample: int = 4096, seed: int = 2) -> dict[int, Index]:
    """An index for each length of vectors, with `pivots` distinct pivots and a centre for each cell.

    Both are lifted vectors of the sample, the `sample` rows whose vectors have the smallest hashes, so the same rows
    give the same index. Where there are too few different pivots, random directions from `seed` make up the number.
    """
    long, out = long_lengths(rows), {}
    for n, (_, x) in sampled(rows, sample).items():
        m, many = long[n]
        x = np.unique(lifted(x, m), axis=0)
        rng = np.random.default_rng(seed)
        mine, centres = (x[rng.permutation(len(x))[:k]] for k in (pivots, cells_for(many, block)))
        more = rng.normal(size=(pivots - len(mine), n + 1))
        out[n] = Index(m, np.concatenate([mine, more / np.linalg.norm(more, axis=1, keepdims=True)]), centres)
    for n, (m, _) in long.items():
        if n not in out:  # vectors of a length that the sample does not hold
            more = np.random.default_rng(seed).normal(size=(pivots, n + 1))
            more /= np.linalg.norm(more, axis=1, keepdims=True)
            out[n] = Index(m, more, more[:1])
    return out


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, keep: int) -> np.ndarray:
    """The numbers of the nearest pivots of each lifted vector, nearest first: those of largest cosine."""
    near = x @ pivots.T
    top = np.argpartition(-near, min(keep, near.shape[1] - 1), axis=1)[:, :keep]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1).astype(np.uint8)


def inverted_files(orders: np.ndarray, pivots: int, keep: int) -> np.ndarray:
    """For each pivot, of every vector how far its place is from the end of the vector's order; 0 where it is not in it."""
    files = np.zeros((pivots, len(orders)), np.uint8)
    files[orders, np.arange(len(orders))[:, None]] = keep - np.arange(orders.shape[1])
    return files


def nearness(files: np.ndarray, asked: np.ndarray, keep: int) -> np.ndarray:
    """keep * (keep + 1) / 2 less half the footrule distance, of the vectors to a query with the order `asked`.

    A pivot at the places a and b of two orders takes a + b + |a - b| = 2 * max(a, b) off the 2 * keep that it adds
    where only one order has it, and nothing where none has; so the distance falls by 2 * min(keep - a, keep - b).
    """
    return np.minimum(files[asked], (keep - np.arange(len(asked), dtype=np.uint8))[:, None]).sum(axis=0, dtype=np.uint16)


def measured(placed: DataFrame, index: dict[int, Index], k: int, keep: int, recall: float, queries: int) -> dict[int, tuple[int, int]]:
    """For each length of vectors: how many cells to open, and the least nearness to compare.

    The sample are the `queries` queries with the smallest hashes; the pass over all rows keeps the k best of each in
    each partition. Of the true nearest of the sample, 1 - (1 - recall) / 2 lie in the cells that are opened, and as
    many are within the distance.
    """
    asks = placed.where("asks").select("id", "length", "vector").orderBy(F.xxhash64("id", "vector"), "id").limit(queries).collect()
    by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for n in {r.length for r in asks}:
        mine = [r for r in asks if r.length == n]
        by[n] = (np.array([r.id for r in mine], np.int64), stacked([bytes(r.vector) for r in mine], n))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for b in batches:
            for n, part in b.groupby("length"):
                if n not in by:
                    continue
                ids, q = by[n]
                x, own = stacked(part["vector"].tolist(), n), part["id"].to_numpy()
                score = q @ x.T
                score[ids[:, None] == own[None, :]] = -np.inf
                top = np.argpartition(-score, min(k, len(own) - 1), axis=1)[:, :k]
                got = np.take_along_axis(score, top, 1)
                cell, orders = part["cell"].to_numpy()[top], np.array([np.frombuffer(e, np.uint8) for e in part["extra"]])[top]
                old = held.get(n)
                if old:
                    got, cell, orders = (np.concatenate(p, axis=1) for p in zip(old, (got, cell, orders)))
                    top = np.argsort(-got, axis=1)[:, :k]
                    got, cell, orders = np.take_along_axis(got, top, 1), np.take_along_axis(cell, top, 1), np.take_along_axis(orders, top[:, :, None], 1)
                held[n] = [got, cell, orders]
        for n, (got, cell, orders) in held.items():
            q = level(by[n][1])
            asked = nearest_pivots(q, index[n].pivots, keep)
            turn = np.argsort(np.argsort(-(q @ index[n].centres.T), axis=1, kind="stable"), axis=1)
            for i in range(len(q)):
                ok = np.isfinite(got[i])
                near = nearness(inverted_files(orders[i], len(index[n].pivots), keep), asked[i], keep)
                place = np.where(cell[i] == LONGER, -1, turn[i][np.maximum(cell[i], 0)])
                yield pd.DataFrame({"length": n, "i": i, "score": got[i][ok], "place": place[ok], "near": near[ok].astype(np.int64)})

    kinds = "length int, i int, score double, place int, near long"
    true = placed.select("id", "length", "cell", "vector", "extra").mapInPandas(run, kinds)
    rank = F.row_number().over(Window.partitionBy("length", "i").orderBy(F.desc("score")))
    true = true.withColumn("rank", rank).where((F.col("rank") <= k) & (F.col("place") >= 0)).toPandas()  # queries * k rows
    lost = (1 - recall) / 2
    out = {}
    for n in index:
        t = true[true["length"] == n]
        out[n] = (int(np.quantile(t["place"], 1 - lost, method="higher")) + 1, int(np.quantile(t["near"], lost, method="lower"))) if len(t) else (1, 0)
    return out


def search_files(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, orders: np.ndarray, pivots: np.ndarray, keep: int, least: int, k: int) -> pd.DataFrame:
    """The answers of one block's inverted files: of vectors that are near enough, and of the k nearest at least."""
    asked, parts = nearest_pivots(level(q), pivots, keep), []
    files = inverted_files(orders, len(pivots), keep)
    for i in range(len(q)):
        near = nearness(files, asked[i], keep) if least else None
        rows = np.flatnonzero(near >= least) if least else np.arange(len(ids))
        if len(rows) <= k < len(ids):
            rows = np.argpartition(-near.astype(np.int64), k)[: k + 1]
        rows = rows[ids[rows] != q_ids[i]]
        score = x[rows] @ q[i]
        top = best(ids[rows], score, k)
        parts.append((q_ids[i], ids[rows][top], score[top]))
    return answers(parts)


def permutation_search(vectors: DataFrame, is_query: Column, k: int = 20, pivots: int = 256, keep: int = 64, recall: float = 0.95, sample: int = 256, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of largest inner product that each query finds.

    is_query is over the column id. Candidates are all rows but those with the query's id. recall: the share of the true
    nearest that is aimed at; it is met on a sample of `sample` queries. pivots: 256 at most. A cell of about `block`
    vectors, or a block of it, is searched at once. A query opens further cells until they hold more than k vectors.

    Vectors that are null, zero, empty, or hold null or non-finite components, and rows without an id take no part.
    Ties go to the smaller vec_id; a query with fewer candidates than k has all of them; vectors of other lengths
    than the query's are no candidates; repeated rows count once; an empty table has an empty answer; other columns
    are not read.
    """
    if not (0 < keep <= pivots <= 256 and keep < 256):
        raise ValueError("keep <= pivots <= 256, and keep < 256, as places and pivots are held in bytes")
    rows = written(finite_rows(vectors, id_col, vector_col, zero=False).distinct(), "vectors")
    index = fit_index(rows, pivots, block)  # for each length of vectors, pivots + CELLS vectors at most
    sent = vectors.sparkSession.sparkContext.broadcast(index)

    def place(n: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        own, y = sent.value[n], lifted(x, sent.value[n].long)
        cell = np.where(is_longer(x, own.long), LONGER, np.argmax(y @ own.centres.T, axis=1))
        return cell, np.zeros(len(x)), [o.tobytes() for o in nearest_pivots(y, own.pivots, keep)]

    placed = placed_rows(rows, is_query, place)
    held = {(r[0], r[1]): r[2] for r in placed.groupBy("length", "cell").count().collect()}  # a row for each cell
    found = measured(placed, index, k, keep, recall, sample)

    def route(n: int, ids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        turn = np.argsort(-(level(q) @ sent.value[n].centres.T), axis=1, kind="stable")
        many = np.array([held.get((n, c), 0) for c in range(turn.shape[1])])
        first = 1 + np.argmax(np.cumsum(many[turn], axis=1) > min(k, many.sum() - 1), axis=1)
        return np.zeros(len(q)), [np.r_[LONGER, t[: max(f, found[n][0])]] for t, f in zip(turn, first)]

    def run(cell: int, q_ids: np.ndarray, q: np.ndarray, _: np.ndarray, ids: np.ndarray, x: np.ndarray, extra: list[bytes]) -> pd.DataFrame:
        n = x.shape[1]
        return search_files(q_ids, q, ids, x, stacked_orders(extra), sent.value[n].pivots, keep, 0 if cell == LONGER else found[n][1], k)

    return search_cells(placed, routed_queries(placed, route), k, run, "double", block)


def stacked_orders(extra: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(extra), np.uint8).reshape(len(extra), -1)
