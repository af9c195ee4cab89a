"""Word search in one pass against the join of all words, with equal rows, ids that repeat, and few queries at once."""

import random

from pyspark.sql import functions as F

from mnemora.operators import retrieval, search


def corpus(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(r.choices(words, k=r.choice([1, 5, 30])))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + [(5, "w1 w2 w2"), (5, "w1"), (6, docs[6][1]), (None, "w3 w4"), (None, "w3"), (2000, None), (2001, "")]
    asks = [(i, " ".join(r.choices(words, k=6))) for i in range(9)] + [(20, "nothing here"), (21, None), (22, docs[7][1])]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(asks, "item_id int, text string")


def tops(found, n):
    d = retrieval.ranked(found.withColumn("score", F.round("score", 6)), "item_id", "doc_id", n)
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in d.collect()), key=repr)


def test_one_pass_gives_what_the_join_gives(spark, monkeypatch):
    docs, asks = corpus(spark)
    split = retrieval.tokenised(docs)
    full = retrieval.bm25(split, asks)
    hits = split.select(F.col("_d").alias("doc_id"), "dl", F.explode("_t").alias("term")).distinct().join(asks.select("item_id", F.explode(F.array_distinct(retrieval.tokens(F.col("text")))).alias("term")), "term").groupBy("item_id", "doc_id").agg(F.count("*").alias("score"))
    for cells, asked in ((1 << 21, 1024), (50, 4)):  # few documents, and few queries, at once
        monkeypatch.setattr(search, "CELLS", cells)
        monkeypatch.setattr(search, "ASKED", asked)
        got = search.best(split, asks, 7, by_hits=True)
        assert tops(got, 7) == tops(full, 7)
        assert tops(got.withColumn("score", F.col("hits")), 7) == tops(hits, 7)
    alone = search.best(split.where("_d >= 1000"), asks, 3)
    assert alone.count() < full.where("doc_id >= 1000").count() / 3  # of forty equal rows, no more than asked for are exchanged


def test_search_of_nothing(spark):
    docs, asks = corpus(spark)
    split = retrieval.tokenised(docs)
    assert search.best(split.limit(0), asks, 5).count() == 0 and search.best(split, asks.limit(0), 5).count() == 0
