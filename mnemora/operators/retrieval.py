"""Retrieval: BM25, rank fusion, diversity, and the bundle of them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions.text import tokens
from mnemora.operators.search import K1, B, best
from mnemora.storage import written

#: Vectors, and queries, that meet in a task, and the scores of them that it has at once.
BLOCK, QUERIES, SCORES = 8192, 4096, 1 << 20


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_d, _t, dl): each document's tokens and their number. Write it, and all that searches words reads it."""
    return docs.select(F.col(id_col).alias("_d"), tokens(F.col(text_col)).alias("_t")).withColumn("dl", F.size("_t"))


def bm25(split: DataFrame, queries: DataFrame, id_col: str = "doc_id", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(query id, doc id, score) of every document of `split`, which is `tokenised`, that has a term of a query.

    Document frequencies are counted over the documents as given, so filter by visibility first. Only the queries'
    terms are kept, before anything is exchanged; the lengths need no exchange at all.
    """
    q = queries.select(F.col(query_id).alias("_q"), F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term"))
    wanted = q.select("term").distinct()
    total = split.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    # explode_outer: explode would have every text split once more, to filter out those without terms
    tf = split.select("_d", "dl", F.explode_outer("_t").alias("term")).join(wanted, "term", "left_semi").groupBy("_d", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.sum(F.least("tf", F.lit(1))).alias("df"))  # needs all of tf, so its exchange is reused
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = tf.join(df, "term").join(q, "term").join(F.broadcast(total), how="cross")  # one row
    return scored.groupBy("_q", "_d").agg(F.sum(part).alias("score")).select(F.col("_q").alias(query_id), F.col("_d").alias(id_col), "score")


def ranked(scores: DataFrame, key: str, tie: str, n: int, score: str = "score") -> DataFrame:
    """The n best of each key, with `rank`."""
    w = Window.partitionBy(key).orderBy(F.desc(score), tie)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def navigate(docs: DataFrame, queries: DataFrame, steps: int = 3, each: int = 6, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(query id, step, rank, doc id): BM25 in several rounds; a round's first new hit is the next round's query.

    A query sees no document twice: a round has the `each` best that no round before it had. Earlier
    rounds saw each * (step - 1) of them at most, so each * step candidates are enough. A query without new hits ends.
    """
    split = written(tokenised(docs, id_col, text_col), "tokens")
    now, seen = queries.select(F.col(query_id).alias("_query"), F.col(query_text).alias("_asked")), None
    for step in range(1, steps + 1):
        found = best(split, now, each * step, id_col, "_query", "_asked").select("_query", id_col, F.round("score", 6).alias("score"))
        found = ranked(found, "_query", id_col, each * step)
        if seen is not None:
            found = found.drop("rank").join(seen.select("_query", id_col), ["_query", id_col], "left_anti")
            found = ranked(found, "_query", id_col, each)
        hits = written(found.select("_query", F.lit(step).alias("step"), "rank", id_col), "hits")  # the rounds after it read these few rows often
        seen = hits if seen is None else seen.unionByName(hits)
        texts = docs.select(id_col, F.col(text_col).alias("_asked"))
        now = hits.where("rank = 1").join(texts, id_col).select("_query", "_asked")
    return seen.withColumnRenamed("_query", query_id)


def nearest_by_cosine(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, group: int = QUERIES) -> DataFrame:
    """(query_id, vec_id, score, rank): each query's k rows of largest cosine, itself too, ties to the smaller id.

    Every query meets every row, as it must for all scores to be known, in products of blocks: rows are dealt into
    blocks and queries into groups by hashes, a task holds one of each, and gives k rows a query. 0 for null, empty
    and zero vectors, and for vectors of other lengths than the query's.
    """
    d = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("_asks"))
    n, asked = d.agg(F.count("*"), F.count(F.when(F.col("_asks"), 1))).first()
    blocks, groups = max(1, -(-n // block)), max(1, -(-asked // group))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    deal = F.xxhash64("id", "v")
    rows = d.select("id", "v", F.pmod(deal, F.lit(blocks)).alias("block"), every(groups).alias("set"))
    asks = d.where("_asks").select("id", "v", every(blocks).alias("block"), F.pmod(F.xxhash64(deal), F.lit(groups)).alias("set"))

    def unit(v: pd.Series, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Which vectors have this length, and these scaled to 1; what has no direction is 0."""
        mine = np.array([x is not None and len(x) == length for x in v], bool)
        x = np.array(v[mine].tolist(), np.float64).reshape(int(mine.sum()), length)
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return mine, np.divide(x, size, out=np.zeros_like(x), where=size > 0)

    def run(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x = x.sort_values("id", kind="stable")  # a stable order of scores leaves ties by id
        ids, units = x["id"].to_numpy(), {n: unit(x["v"], n) for n in {len(v) for v in q["v"] if v is not None and len(v)}}
        step, out = max(1, SCORES // len(x)), []
        for lo in range(0, len(q), step):
            some = q.iloc[lo : lo + step]
            score = np.zeros((len(some), len(x)))
            for length, (b, right) in units.items():
                a, left = unit(some["v"], length)
                score[np.ix_(np.flatnonzero(a), np.flatnonzero(b))] = left @ right.T
            score = np.round(score, 6)
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            out.append(pd.DataFrame({"query_id": np.repeat(some["id"].to_numpy(), top.shape[1]), "vec_id": ids[top].ravel(), "score": np.take_along_axis(score, top, 1).ravel()}))
        return pd.concat(out)

    kind = dict(d.dtypes)["id"]
    found = asks.groupBy("block", "set").cogroup(rows.groupBy("block", "set")).applyInPandas(run, f"query_id {kind}, vec_id {kind}, score double")
    return ranked(found, "query_id", "vec_id", k)


def rrf(lists: Sequence[DataFrame], key: str, item: str, k: int = 60) -> DataFrame:
    """(key, item, rrf): the sum over ranked lists (key, item, rank) of 1 / (k + rank)."""
    union = lists[0].select(key, item, "rank")
    for other in lists[1:]:
        union = union.unionByName(other.select(key, item, "rank"))
    return union.groupBy(key, item).agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"))


def mmr(candidates: DataFrame, key: str, item: str, terms: str, score: str, k: int, balance: float = 0.7) -> DataFrame:
    """(key, item, position): k items of each key that score well and differ from those taken before.

    Next is the item with the most balance * score - (1 - balance) * its largest Jaccard similarity to one taken;
    the first is the best. A key's candidates are few (a ranked list), so each key is one small group.
    """

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([score, item], ascending=[False, True])
        items, scores, sets = group[item].tolist(), group[score].tolist(), [set(t) for t in group[terms]]
        if len(items) <= k:
            order = list(range(len(items)))
        else:
            order, near = [0], [0.0] * len(items)
            while len(order) < k:
                for i in range(len(items)):
                    union = len(sets[i] | sets[order[-1]])
                    near[i] = max(near[i], len(sets[i] & sets[order[-1]]) / union if union else 0.0)
                left = [i for i in range(len(items)) if i not in order]
                order.append(max(left, key=lambda i: (balance * scores[i] - (1 - balance) * near[i], -i)))
        return pd.DataFrame({key: group[key].iloc[0], item: [items[i] for i in order], "position": range(1, len(order) + 1)})

    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema.fields}
    return candidates.groupBy(key).applyInPandas(pick, f"{key} {kinds[key]}, {item} {kinds[item]}, position int")


def slots(hits: DataFrame, key: str, core: Column, uncertain: Column, order: Sequence[Column], quotas: tuple[int, int, int] = (4, 6, 3)) -> DataFrame:
    """hits with `bucket`: core ones up to their quota, what is over joins the related, uncertain ones apart; rest dropped."""
    w = lambda *c: Window.partitionBy(key, *c).orderBy(*order)
    kind = F.when(uncertain, "uncertain").when(core, "core").otherwise("related")
    d = hits.withColumn("_kind", kind).withColumn("_n", F.row_number().over(w("_kind")))
    d = d.withColumn("bucket", F.when((F.col("_kind") == "core") & (F.col("_n") > quotas[0]), "related").otherwise(F.col("_kind")))
    d = d.withColumn("position", F.row_number().over(w("bucket")))
    most = F.when(F.col("bucket") == "core", quotas[0]).when(F.col("bucket") == "related", quotas[1]).otherwise(quotas[2])
    return d.where(F.col("position") <= most).drop("_kind", "_n")
