"""Word search in documents that are as long as they like: BM25 and shared words of many queries in one pass.

The queries of a pass are bounded (ASKED, ASKED_TERMS) and go to every worker; documents stay where they are. A worker scores
its documents against all of them and gives only those that may be among the best, so what is exchanged grows with the
queries and not with the documents' words or with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.functions.text import tokens
from mnemora.storage import written

K1, B = 1.5, 0.75
#: Queries, and different words of each summed up, that one pass over the documents has: what the driver and a worker hold.
ASKED, ASKED_TERMS = 1024, 1 << 20
#: Scores of documents and queries, and their parts, that a worker has at once.
CELLS, PARTS = 1 << 21, 1 << 22
#: Documents whose words a worker has as arrays at once.
ROWS = 2048
#: Scores are rounded to six places by Spark, after this; what is nearer to the last one than this may be its equal.
NEAR = 2e-6


@dataclass(frozen=True)
class Asked:
    """Queries by number; the queries of term t are who[start[t] : start[t + 1]]."""

    terms: pa.Array
    ids: pa.Array
    start: np.ndarray
    who: np.ndarray

    def found(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, tf) of the batch's words that are asked for, by row and term."""
        lists = batch["_t"]
        rows = np.repeat(np.arange(len(lists)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
        at = np.asarray(pc.fill_null(pc.index_in(lists.flatten(), value_set=self.terms), -1))
        both, tf = np.unique((rows * max(1, len(self.terms)) + at)[at >= 0], return_counts=True)
        return both // max(1, len(self.terms)), both % max(1, len(self.terms)), tf


def _asked(q: DataFrame) -> Asked:
    """Of (_q, term), which is bounded. Sorted, so that the same queries give the same sums."""
    t = q.toArrow().combine_chunks()
    terms, ids = pc.unique(t["term"]).sort(), pc.unique(t["_q"])
    term, who = np.asarray(pc.index_in(t["term"], value_set=terms)), np.asarray(pc.index_in(t["_q"], value_set=ids))
    order = np.lexsort((who, term))
    return Asked(terms, ids, np.searchsorted(term[order], np.arange(len(terms) + 1)), who[order])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from (b.slice(i, ROWS) for i in range(0, len(b), ROWS))


def _first(group: np.ndarray, most: int) -> np.ndarray:
    """Which of sorted rows are among the first `most` of their group."""
    begins = np.r_[True, (group[1:] != group[:-1]).any(axis=1)] if len(group) else np.empty(0, bool)
    begin = np.flatnonzero(begins)
    return np.arange(len(group)) - begin[np.cumsum(begins) - 1] < most if len(group) else begins


def _pass(split: DataFrame, twice: DataFrame | None, q: DataFrame, n: int, by_hits: bool, kinds: tuple[str, str]) -> DataFrame:
    """(_q, _d, score, hits) of one bounded set of queries."""
    spark = split.sparkSession
    asked = _asked(q)
    if not len(asked.ids):
        return spark.createDataFrame([], f"_q {kinds[0]}, _d {kinds[1]}, score double, hits long")
    sent = spark.sparkContext.broadcast(asked)  # ASKED queries and ASKED_TERMS words at most
    once = split if twice is None else split.join(twice, F.col("_d").eqNullSafe(F.col("_again")), "left_anti")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(sent.value.terms), np.int64)
        for b in _slices(batches):
            df += np.bincount(sent.value.found(b)[1], minlength=len(df))
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(df[hit], pa.int64())], ["t", "df"])

    rows, mean = split.agg(F.count("*"), F.avg("dl")).first()
    df = np.zeros(len(asked.terms), np.int64)
    for r in once.select("_t").mapInArrow(count, "t long, df long").groupBy("t").agg(F.sum("df").alias("df")).collect():  # a row for each word asked for
        df[r.t] = r.df
    tf = None
    if twice is not None:
        wanted = spark.createDataFrame(pa.table({"term": asked.terms.cast(pa.string()), "t": np.arange(len(df))}))
        more = split.join(twice, F.col("_d").eqNullSafe(F.col("_again")), "left_semi").select("_d", "dl", F.explode("_t").alias("term"))
        tf = written(more.join(wanted, "term").groupBy("_d", "dl", "t").agg(F.count("*").alias("tf")), "search-again")
        for r in tf.groupBy("t").agg(F.count("*").alias("df")).collect():
            df[r.t] += r.df
    idf = np.log(1 + (rows - df + 0.5) / (df + 0.5))
    weights = spark.sparkContext.broadcast((idf, float(mean or 1.0)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, (idf, mean) = sent.value, weights.value
        width, per = len(a.ids), np.diff(a.start)
        best, most = np.full((n, width), -np.inf), np.zeros((n, width))
        for b in _slices(batches):
            row, term, tf = a.found(b)
            dl, place = np.asarray(b["dl"])[row], np.asarray(pc.rank(b["_d"], null_placement="at_start", tiebreaker="first"))
            part = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))
            end = np.searchsorted(row, np.arange(len(b) + 1))  # where each row's words are
            work = np.r_[0, np.cumsum(per[term])][end]
            lo = 0
            while lo < len(b):
                hi = max(lo + 1, min(lo + max(1, CELLS // width), int(np.searchsorted(work, work[lo] + PARTS, "right")) - 1))
                at = slice(end[lo], end[hi])
                times = per[term[at]]
                ask = a.who[np.repeat(a.start[term[at]] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
                cell = np.repeat((row[at] - lo) * width, times) + ask
                s = np.bincount(cell, np.repeat(part[at], times), (hi - lo) * width).reshape(-1, width)
                h = np.bincount(cell, minlength=(hi - lo) * width).reshape(-1, width) if by_hits else None
                best = np.partition(np.concatenate([best, s]), -n, axis=0)[-n:]
                i, j = np.nonzero((s >= best.min(axis=0) - NEAR) & (s > 0))
                order = np.lexsort((place[lo + i], s[i, j], j))
                i, j = i[order], j[order]
                kept = _first(np.stack([j.astype(float), s[i, j]], axis=1), n)  # of equal ones, the smallest ids
                chosen = i[kept] * width + j[kept]
                if by_hits:
                    most = np.partition(np.concatenate([most, h]), -n, axis=0)[-n:]
                    i, j = np.nonzero((h >= most.min(axis=0)) & (h > 0))
                    order = np.lexsort((place[lo + i], -h[i, j], j))
                    i, j = i[order], j[order]
                    kept = _first(j[:, None], n)
                    chosen = np.union1d(chosen, i[kept] * width + j[kept])
                i, j = chosen // width, chosen % width
                hits = h[i, j] if by_hits else np.zeros(len(i), np.int64)
                yield pa.RecordBatch.from_arrays([a.ids.take(pa.array(j)), b["_d"].take(pa.array(lo + i)), pa.array(s[i, j]), pa.array(hits, pa.int64())], ["_q", "_d", "score", "hits"])
                lo = hi

    found = once.select("_d", "_t", "dl").mapInArrow(score, f"_q {kinds[0]}, _d {kinds[1]}, score double, hits long")
    if tf is None:
        return found
    each = spark.createDataFrame(pa.table({"_q": asked.ids.take(pa.array(asked.who)), "t": np.repeat(np.arange(len(df)), np.diff(asked.start)), "idf": np.repeat(idf, np.diff(asked.start))}))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(float(mean or 1.0))))
    rest = tf.join(each, "t").groupBy("_q", "_d").agg(F.sum(part).alias("score"), F.count("*").alias("hits"))
    return found.unionByName(rest.select(F.col("_q").cast(kinds[0]).alias("_q"), "_d", "score", "hits"))


def best(split: DataFrame, queries: DataFrame, n: int, id_col: str = "doc_id", query_id: str = "item_id", query_text: str = "text", by_hits: bool = False) -> DataFrame:
    """(query id, doc id, score, hits): of the documents of `split`, which is `tokenised`, at least the n best of each query.

    score is BM25 as `retrieval.bm25` gives it, hits the number of a query's words that a document has (with by_hits, else 0).
    All documents that may be among the n best by score rounded to six places, or by hits, are there, ties by the smaller
    id included; rank them after. The rows are written, as they are few: they can be read often.

    Rows of one document id are one document, scored by the sums over them; they are joined, as they can lie anywhere.
    """
    q = written(queries.select(F.col(query_id).alias("_q"), F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term")).distinct(), "search-asked")
    asked, terms = q.agg(F.countDistinct(F.struct("_q")), F.count("*")).first()
    groups = max(1, -(-asked // ASKED), -(-terms // ASKED_TERMS))
    kinds = dict(q.dtypes)["_q"], dict(split.dtypes)["_d"]
    again = written(split.groupBy(F.col("_d").alias("_again")).agg(F.count("*").alias("n")).where("n > 1").select("_again"), "search-twice")
    twice = None if again.isEmpty() else again
    out = None
    for g in range(groups):
        part: Column = F.pmod(F.xxhash64("_q"), F.lit(groups)) == g
        one: Any = _pass(split, twice, q.where(part), n, by_hits, kinds)
        out = one if out is None else out.unionByName(one)
    return written(out.select(F.col("_q").alias(query_id), F.col("_d").alias(id_col), "score", "hits"), "search-best")
