"""Exact top-k search by pivot-table elimination.

The table holds the distances of every vector to many pivots. What distances a vector x and a query q can have to each
other, given those to the pivots and to the origin, has a least value, the maximum lower bound: the distances fix the
parts of x and q inside the span of the pivots, and the lengths of their parts outside it, whose directions are open.
So with the parts inside called u and v and the lengths outside called a and b, d(q, x)^2 >= |u - v|^2 + (a - b)^2,
never less than a pivot's own triangle bound |d(q, p) - d(x, p)|, and the inner product is at most <u, v> + a * b.
Candidates are evaluated in the order of this limit, in batches, until the next limit is below the k-th best score.

Vectors lie in cells, by their nearest centre, with the largest distance r to it. Every query has a first score to
beat, the k-th best of a bounded sample of the rows, and opens the cells where <q, centre> + |q| * r reaches it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import answers, best, cells_for, finite_rows, placed_rows, routed_queries, sampled, search_cells

#: Products of whole numbers below this are exact in double precision.
EXACT = 2.0**53
#: Candidates that meet a group of queries in a task.
BLOCK = 16384


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as doubles that hold whole numbers, within the range of doubles."""
    most = 1.7976931348623157e308
    # doubles from 2^52 on are whole, and floor() would force them into a long
    whole = lambda y: F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(F.greatest(F.least(y, F.lit(most)), F.lit(-most)))
    return F.transform(vector, lambda x: whole(x * scale))


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whole inner products: exact in doubles where all sums are small enough, else in long integers of Python."""
    if _exact(x, q):
        return (x @ q).astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(row, q)) for row in x]
    return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in whole], np.int64)


def _exact(x: np.ndarray, q: np.ndarray) -> bool:
    return x.shape[1] * max(np.abs(x).max(initial=0), 1) * max(np.abs(q).max(initial=0), 1) < EXACT


def pivot_basis(x: np.ndarray, pivots: int, sample: int = 512) -> np.ndarray:
    """Orthogonal directions of length 1 that span `pivots` vectors of x, or fewer where these span less.

    Each pivot is the vector, of the first `sample`, farthest from the span of those before it.
    """
    left, out = x[:sample].astype(np.float64), []
    size = np.einsum("ij,ij->i", left, left)
    floor = 1e-9 * max(size.max(initial=0), 1)
    for _ in range(min(pivots, x.shape[1], len(left))):
        far = int(np.argmax(size))
        if size[far] <= floor:
            break
        u = left[far]
        for e in out:  # again, as the first pass leaves rounding errors
            u = u - (u @ e) * e
        out.append(u / np.linalg.norm(u))
        left = left - np.outer(left @ out[-1], out[-1])
        size = np.einsum("ij,ij->i", left, left)
    return np.array(out).reshape(len(out), x.shape[1])


def search_table(q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, ids: np.ndarray, x: np.ndarray, pivots: int, k: int, batch: int = 64, seen: tuple[Accumulator, Accumulator] | None = None) -> pd.DataFrame:
    """The exact k best of one block for each query, of those that reach its least score."""
    parts, evaluated, bounded = [], 0, _exact(x, q)
    if bounded:
        basis = pivot_basis(x, pivots)
        size, q_size = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", q, q)
        inside, q_inside = x @ basis.T, q @ basis.T
        outside = np.sqrt(np.maximum(size - np.einsum("ij,ij->i", inside, inside), 0))
        q_outside = np.sqrt(np.maximum(q_size - np.einsum("ij,ij->i", q_inside, q_inside), 0))
        # lengths outside may be off by the root of rounding errors, and sums in their last digits
        off = 1e-7 * (1 + np.sqrt(size.max(initial=0)))
        q_off = 1e-7 * (1 + np.sqrt(q_size))
        table = np.c_[inside, outside + off].T
    for s in range(0, len(q), 256):
        limits = np.c_[q_inside[s : s + 256], q_outside[s : s + 256] + q_off[s : s + 256]] @ table + q_off[s : s + 256, None] * off if bounded else None
        for i in range(s, min(s + 256, len(q))):
            limit = limits[i - s] if bounded else np.full(len(ids), np.inf)
            rows = np.flatnonzero((limit >= least[i]) & (ids != q_ids[i]))
            got_ids, got, at, step = np.empty(0, np.int64), np.empty(0, np.int64), 0, batch
            rows = rows[np.argsort(-limit[rows], kind="stable")]
            while at < len(rows) and not (len(got) >= k and limit[rows[at]] < got[-1]):
                more = rows[at : at + step]
                at, step = at + len(more), step * 2
                both_ids, both = np.r_[got_ids, ids[more]], np.r_[got, _products(x[more], q[i])]
                top = best(both_ids, both, k)
                got_ids, got = both_ids[top], both[top]
            evaluated += at
            parts.append((q_ids[i], got_ids, got))
    if seen is not None:
        seen[0].add(evaluated)
        seen[1].add(len(q) * len(x))
    return answers(parts)


def exact_search(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, pivots: int | None = None, block: int = BLOCK, sample: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", seen: tuple[Accumulator, Accumulator] | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest whole inner products of floor(scale * x).

    is_query is over the column id. Candidates are all rows but those with the query's id; a score that a long
    does not hold is the nearest long. pivots: of each block; by default 7 for every 8 components. sample: rows, those
    with the smallest hashes, that give the centres of the cells and each query's first score to beat. seen: two
    accumulators, to which the numbers of pairs that were evaluated, and of those that met in a block, are added.

    Blocks with components so large that sums of their products are not exact in doubles are evaluated whole, in whole
    numbers of any size. Vectors that are null or hold null or non-finite components and rows without an id take no
    part; zero and empty vectors do. Ties go to the smaller vec_id; a query with fewer candidates than k has all of
    them; vectors of other lengths than the query's are no candidates; repeated rows count once; an empty table has an
    empty answer; other columns are not read.
    """
    rows = finite_rows(vectors, id_col, vector_col, zero=True).select("id", quantised(F.col("vector"), scale).alias("vector"))
    rows = written(rows.distinct(), "vectors")
    many = dict(rows.groupBy(F.size("vector")).count().collect())
    known = sampled(rows, sample)
    sent = vectors.sparkSession.sparkContext.broadcast({n: (ids, x, np.unique(x, axis=0)) for n, (ids, x) in known.items()})

    def centres(n: int) -> np.ndarray:
        """Spread over the sample's different vectors; a length that it does not hold has the origin."""
        if n not in sent.value:
            return np.zeros((1, n))
        x = sent.value[n][2]
        return x[np.random.default_rng(9).permutation(len(x))[: cells_for(many[n], block)]]

    def place(n: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        with np.errstate(all="ignore"):
            c = centres(n)
            d2 = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", c, c)[None, :] - 2 * (x @ c.T)
            d2 = np.where(np.isnan(d2), np.inf, d2)
            cell = np.argmin(d2, axis=1)
            far = np.sqrt(np.maximum(d2[np.arange(len(x)), cell], 0))
        return cell, far, [b""] * len(x)

    placed = placed_rows(rows, is_query, place)
    reach = {(r[0], r[1]): r[2] for r in placed.groupBy("length", "cell").agg(F.max("far")).collect()}  # a row for each cell

    def route(n: int, ids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        with np.errstate(all="ignore"):
            least = np.full(len(q), -np.inf)
            own, x, _ = sent.value.get(n, (np.empty(0, np.int64), np.zeros((0, n)), None))
            if len(x) > k and _exact(x, q):
                score = np.where(ids[:, None] == own[None, :], -np.inf, q @ x.T)
                least = np.partition(score, len(x) - k, axis=1)[:, len(x) - k]
            c = centres(n)
            r = np.array([reach.get((n, j), -np.inf) for j in range(len(c))])
            size = np.sqrt(np.einsum("ij,ij->i", q, q))
            limit = q @ c.T + size[:, None] * r[None, :]
            limit += 1e-6 * (1 + size[:, None]) * (1 + np.abs(r)[None, :] + np.sqrt(np.einsum("ij,ij->i", c, c))[None, :])
            opens = (np.isnan(limit) | (limit >= least[:, None])) & np.isin(np.arange(len(c)), [j for m, j in reach if m == n])[None, :]
        return least, [np.flatnonzero(o) for o in opens]

    def run(_: int, q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, ids: np.ndarray, x: np.ndarray, __: list[bytes]) -> pd.DataFrame:
        return search_table(q_ids, q, least, ids, x, pivots or max(1, x.shape[1] * 7 // 8), k, seen=seen)

    return search_cells(placed, routed_queries(placed, route), k, run, "long", block)
