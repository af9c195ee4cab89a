"""A training corpus from raw documents: toxic ones go, near copies go, sources are mixed, the rest is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All stages but the last return the columns of docs as they are, whatever their names.

Null ids and texts, empty and very long texts, repeated rows and empty tables pass every stage: a null or empty text is
scored, has no near copies, stays once in the mix, and has no ids; a row without an id is a row like any other, but a
group of near copies keeps one that has an id if there is one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.llm.bpe import round_trip
from mnemora.llm.common import crc_of_id, written
from mnemora.llm.mixing import mixture
from mnemora.llm.ngram_join import first_of_each
from mnemora.llm.toxicity import train_classifier, without_toxic

#: Documents with this toxicity score or more are rejected, as in the operator's own query.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is TOXIC or more go; all others stay, empty texts too.

    The classifier learns from the labelled rows of docs, without those that are held out for measuring it.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train_classifier(docs, labels, crc_of_id(F.col("doc_id")) % 3 != 1)
    return without_toxic(docs, model, TOXIC)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 80 % of their five-word shingles, directly or through others, the smallest id stays."""
    return first_of_each(docs, n=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix of sources takes it: once, twice or not at all. Rows without words stay once."""
    return mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The byte-level BPE ids of every text, as counts and digests, checked by decoding them; encode_frame gives the ids."""
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("near-copies", drop_near_copies), ("mix", mix), ("encode", encode)]

#: SQL cannot express the classifier; tests/llm/test_llm_queries.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
