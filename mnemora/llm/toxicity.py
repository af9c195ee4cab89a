"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams of its characters (A-Z lower-cased, runs of ASCII white space as one space, a
space at either end), hashed. Over all labelled texts the log-count ratio of a feature
is log of its share among toxic over its share among other texts; logistic regressions are fitted to the features
scaled by their ratios, one for each part of the labelled texts, and each coefficient is the mean over the parts that have
its feature. Scoring multiplies both back into one table of coefficients, of fixed size.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import with_own, written

#: Features are hashed to this many bits: the model is a table of 2**BITS numbers, whatever the corpus.
BITS = 20
SIZES = (3, 4, 5, 6)
#: Characters that are turned into n-grams at once; a longer text is taken in overlapping stretches.
STRETCH = 1 << 20
#: Characters of each kind of texts that are learned from together, about; and the least such texts, if there are as many.
CHARACTERS, LEAST = 1 << 24, 256
#: A table of the model's size is added up in this many stretches; coefficients are added as whole numbers of 1 / UNIT.
STRETCHES, UNIT = 16, float(1 << 32)


def _clean(text: str | None) -> np.ndarray:
    """The code points of the characters."""
    raw = np.frombuffer(f" {text or ''} ".encode("utf-32-le", "surrogatepass"), "<u4")
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    raw = np.where(space, np.uint32(32), raw + np.uint32(32) * ((raw >= 65) & (raw <= 90)))
    return raw[~(space & np.r_[False, space[:-1]])]


def _grams(clean: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The hashed n-grams of a text, with repeats, stretch by stretch."""
    for s in range(0, max(1, len(clean) - max(SIZES) + 1), STRETCH):
        part = clean[s : s + STRETCH + max(SIZES) - 1]
        h, done = np.zeros(len(part), np.uint32), 0
        for n in range(1, max(SIZES) + 1):
            if len(part) < n:
                break
            h = h[: len(part) - n + 1] * np.uint32(0x01000193) + part[n - 1 :] + np.uint32(n - done)
            if n in SIZES:
                yield (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """The sorted distinct features of a text."""
    return np.unique(np.concatenate([*_grams(_clean(text), bits), np.empty(0, np.uint32)]))


def packed(found: np.ndarray) -> bytes:
    """Sorted features in about a byte each."""
    return zlib.compress(np.diff(found.astype(np.uint32), prepend=np.uint32(0)).astype("<u4").tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<u4"), dtype=np.uint32)


@dataclass(frozen=True)
class Model:
    """score = 1 / (1 + exp(-(bias + the sum of weight over the distinct features)))."""

    bias: float
    weight: np.ndarray
    bits: int

    def score(self, text: str | None) -> float:
        hit = [g[self.weight[g] != 0] for g in _grams(_clean(text), self.bits)]
        z = self.bias + float(self.weight[np.unique(np.concatenate(hit))].sum(dtype=np.float64)) if hit else self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _ratios(p: np.ndarray, q: np.ndarray, toxic: int, other: int, least: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Which features are used, and the log-count ratios of all; p, q: how many toxic and other texts have each.

    Features in fewer than `least` of the texts, and those whose ratio says little, have no coefficient.
    """
    ratio = np.log((p + 1) / (toxic + 2)) - np.log((q + 1) / (other + 2))
    return (p + q >= least) & (np.abs(ratio) >= 1.0), ratio


def _fitted(kept: list[np.ndarray], toxic: np.ndarray, r: np.ndarray, strength: float, rounds: int) -> tuple[float, np.ndarray]:
    """The bias and the weights (times r, the coefficients) of texts, given by the numbers of their used features."""
    owner, column = np.repeat(np.arange(len(kept), dtype=np.int32), [len(k) for k in kept]), np.concatenate(kept)
    count = len(r)
    # longer texts have more features: each counts by its ratio alone, so the step is set by the largest row
    row = np.bincount(owner, r[column] ** 2, len(kept))
    step = 4 / (np.mean(row) + np.max(row) * 0.25 + 4)
    y, w, old, bias, old_bias = toxic.astype(float), np.zeros(count), np.zeros(count), 0.0, 0.0
    balance = np.where(toxic, 0.5 / toxic.mean(), 0.5 / (~toxic).mean())
    for k in range(rounds):
        ahead = w + k / (k + 3) * (w - old)
        ahead_bias = bias + k / (k + 3) * (bias - old_bias)
        z = ahead_bias + np.bincount(owner, (r * ahead)[column], len(kept))
        error = balance * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / len(kept)
        grad = r * np.bincount(column, error[owner], count) + strength / len(kept) * ahead
        old, old_bias = w, bias
        w, bias = ahead - step * grad, ahead_bias - step * error.sum()
    return float(bias), w


def _prior(prior: float, bits: int) -> Model:
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    return Model(float(np.log(prior / (1 - prior))), np.zeros(2**bits, np.float32), bits)


def fit_model(texts: list[bytes], toxic: np.ndarray, prior: float, bits: int = BITS, least: int = 4, strength: float = 0.05, rounds: int = 300) -> Model:
    """A model from the packed features of texts and their labels, in one part.

    Both kinds of
    texts count alike, whatever their shares; prior, the share of toxic texts among all labelled ones, is the score only
    where there is nothing to learn from. Fitted by accelerated gradient steps
    on the mean log loss plus strength / 2 times the mean square of the coefficients, from zero: the same texts
    give the same model. With labels of one kind only, or none, every score is the prior.
    """
    if not len(texts) or toxic.all() or not toxic.any():
        return _prior(prior, bits)
    p, q = np.zeros(2**bits, np.int32), np.zeros(2**bits, np.int32)
    for t, bad in zip(texts, toxic):
        (p if bad else q)[unpacked(t)] += 1
    use, ratio = _ratios(p, q, int(toxic.sum()), int((~toxic).sum()), least)
    if not use.any():
        return _prior(prior, bits)
    number = (np.cumsum(use) - 1).astype(np.int32)
    bias, w = _fitted([number[f[use[f]]] for f in map(unpacked, texts)], toxic, ratio[use], strength, rounds)
    weight = np.zeros(2**bits, np.float32)
    weight[use] = ratio[use] * w
    weight[np.abs(weight) < 1e-3] = 0
    return Model(bias, weight, bits)


def _stretches(table: np.ndarray) -> list[bytes]:
    """A table of two rows of whole numbers, in STRETCHES of its columns."""
    return [zlib.compress(np.ascontiguousarray(x).tobytes(), 1) for x in np.split(table.astype("<i8"), STRETCHES, axis=1)]


def _summed(parts: DataFrame, bits: int) -> np.ndarray:
    """The sum of tables (stretch, data): each stretch is added up in one task, and the driver gets one table."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((2, 2**bits // STRETCHES), "<i8")
        for x in rows["data"]:
            total += np.frombuffer(zlib.decompress(x), "<i8").reshape(total.shape)
        return pd.DataFrame({"stretch": [rows["stretch"].iloc[0]], "data": [total.tobytes()]})

    table = np.zeros((2, 2**bits), np.int64)
    for r in parts.groupBy("stretch").applyInPandas(add, "stretch int, data binary").collect():  # STRETCHES rows
        table[:, r.stretch * (2**bits // STRETCHES) : (r.stretch + 1) * (2**bits // STRETCHES)] = np.frombuffer(r.data, "<i8").reshape(2, -1)
    return table


def _parts(rows: int, characters: int, sample: int) -> int:
    return max(1, min(max(-(-rows // sample), -(-characters // CHARACTERS)), rows // LEAST))


def train_classifier(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 2000) -> Model:
    """A model learned from all rows of labels where `train` (over the id) holds, and all features of their texts.

    Ratios are counted over all of them. The coefficients are fitted in parts of about `sample` toxic and `sample` other rows, dealt by
    hashes of ids, side by side; of the rarer kind, if there are few, a part shares rows with others, so that all have
    LEAST of them. A coefficient is the mean over the parts that have its feature. What reaches the driver are tables of
    the model's size. Labels that are null are left out; an id with several labels counts as toxic if one says
    so, and one with several texts is learned from by the first of them in string order. An id without text, or without
    a document, gives nothing or an empty text; other columns are not read.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(train)
    marked = marked.groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("_toxic"))
    share = marked.agg(F.avg("_toxic")).first()[0] or 0.0
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text")).join(marked, id_col)
    rows = rows.groupBy(id_col, "_toxic").agg(F.min("_text").alias("_text")).where("_toxic in (0, 1)")
    rows = written(rows.select(F.col(id_col).cast("string").alias("id"), F.col("_toxic").alias("toxic"), F.col("_text").alias("text")), "toxicity-train")
    kinds = {r.toxic: (r.n, r.size or 0) for r in rows.groupBy("toxic").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size")).collect()}
    if len(kinds) < 2:
        return _prior(share, BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, 2**BITS), np.int64)
        for b in batches:
            for bad, text in zip(b["toxic"].to_pylist(), b["text"]):
                table[0 if bad else 1, features(text.as_py())] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(STRETCHES), pa.int32()), pa.array(_stretches(table), pa.binary())], ["stretch", "data"])

    use, ratio = _ratios(*_summed(rows.select("toxic", "text").mapInArrow(count, "stretch int, data binary"), BITS), kinds[1][0], kinds[0][0])
    if not use.any():
        return _prior(share, BITS)
    number = np.where(use, np.cumsum(use) - 1, -1).astype(np.int32)
    sent = docs.sparkSession.sparkContext.broadcast((number, ratio[use]))  # tables of 2**BITS numbers
    parts = max(_parts(*x, sample) for x in kinds.values())
    own = {bad: max(1, min(parts, n // LEAST)) for bad, (n, _) in kinds.items()}
    of = F.when(F.col("toxic") == 1, own[1]).otherwise(own[0])
    dealt = rows.withColumn("part", F.explode(F.sequence(F.pmod(F.xxhash64("id", F.lit(8)), of).cast("int"), F.lit(parts - 1), of)))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        number, r = sent.value
        part = part.sort_values("id")
        toxic, kept = part["toxic"].to_numpy() == 1, []
        for text in part["text"]:
            has = number[features(text)]
            kept.append(has[has >= 0])
        table, column = np.zeros((2, 2**BITS), np.int64), np.concatenate(kept)
        bias = 0.0
        if toxic.any() and not toxic.all() and len(column):
            bias, w = _fitted(kept, toxic, r, 0.05, 300)
            at, seen = np.flatnonzero(number >= 0), np.bincount(column, minlength=len(r)) > 0
            table[:, at] = np.rint(r * w * UNIT), seen
        return pd.DataFrame({"stretch": [*range(STRETCHES), -1], "data": [*_stretches(table), np.array([np.rint(bias * UNIT)], "<i8").tobytes()]})

    fitted = written(dealt.groupBy("part").applyInPandas(fit, "stretch int, data binary"), "toxicity-parts")
    biases = [int(np.frombuffer(r.data, "<i8")[0]) / UNIT for r in fitted.where("stretch = -1").collect()]  # a number for each part
    total, seen = _summed(fitted.where("stretch >= 0"), BITS)
    weight = (total / UNIT / np.maximum(seen, 1)).astype(np.float32)
    return Model(float(np.mean(sorted(biases))), weight, BITS)


def scorer(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """From a column of texts to a column of scores, 0 to 1. A null text counts as empty."""
    sent = spark.sparkContext.broadcast(model)  # a table of 2**BITS numbers

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        for t in texts:
            yield pd.Series([m.score(x) for x in t], dtype="float64")

    return score


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with `score`, 0 to 1. A null text counts as empty; an empty text has the model's score for no features.

    All rows are scored, whole and row by row; an empty table gives an empty table; a column score is replaced.
    """
    return with_own(docs, {"score": scorer(docs.sparkSession, model)(F.col(text_col))})


def without_toxic(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is below the threshold, as they are: no column is added or replaced."""
    return docs.where(scorer(docs.sparkSession, model)(F.col(text_col)) < threshold)
