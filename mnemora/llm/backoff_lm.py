"""Language-model scores by a weighted backoff automaton.

A state of the automaton is a history of up to order - 1 words, an arc a word after it. An arc's weight is the
log10 probability of the smoothed n-gram; a state without the wanted arc falls, by its failure arc, to the state of
the next shorter history at the cost log10 of the probability it left over. With c the training counts, m the
smoothing mass and h' the history without its first word:

    p(w | h) = (c(hw) + m * p(w | h')) / (c(h) + m),    failure weight of h: m / (c(h) + m)

down to the base p(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)). An arc exists where c(hw) > 0; where it does not, p is the
failure weight times p(w | h'), so falling gives the same number. After an arc the state is the longest end of hw that
training texts hold. The automaton grows with the corpus, so it is never in one place: texts are packed into blocks as
numbers into the block's own word list; each block asks, once for each of its distinct n-grams, for its counts over
all blocks; of the answers it builds the states and arcs that its texts can reach, and walks every text from left to
right once, with the state carried from word to word and the weights added up.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, with_own, written
from .ngram_join import _batch, mixed

#: Words that a block holds before it is closed; a longer text is a block of its own.
BLOCK_WORDS = 600_000
#: Words whose n-grams share a bucket, at most on average: the number of buckets grows with the corpus.
BUCKET_WORDS = 2_000_000
#: Blocks of a task in which texts are scored.
BLOCKS_EACH = 4
#: Bytes by which n-grams of a bucket are told apart.
KEY = 6
#: Stand for the end of a text and for what lies before its start; no word has these, as words are hashed to odd numbers.
END, START = np.uint64(2), np.uint64(4)

BLOCKS = "block long, row binary, known binary, train binary, length binary, words binary, stream binary"
BLOCK_SCHEMA = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("row", "known", "train", "length", "words", "stream"))])
ASKED = "bucket int, block long, size int, keys binary, counts binary"
SCORED = "row long, n_tokens long, n_known long, base double, n_base long, score double"


def _tokens(text: str | None) -> np.ndarray:
    """The words of a text as odd numbers, and the end."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    out = np.full(len(words) + 1, END)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) | np.uint64(1)
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as blocks: the distinct words of a block, and for each text the numbers of its words, the end last."""
    rows: list[int] = []
    known: list[bool] = []
    train: list[bool] = []
    texts: list[np.ndarray] = []
    held = made = 0

    def close() -> pa.RecordBatch:
        length = np.array([len(t) for t in texts], np.uint32)
        words, stream = np.unique(np.concatenate(texts), return_inverse=True)
        nonlocal made
        made += 1
        name = (TaskContext.get().partitionId() << 32) + made
        cells = [np.array(rows, np.int64), np.array(known), np.array(train), length, words, stream.astype(np.uint32)]
        return _batch([(name, *(c.tobytes() for c in cells))], BLOCK_SCHEMA)

    for b in batches:
        for r, t, x in zip(b["row"].to_pylist(), b["train"].to_pylist(), b["text"].to_pylist()):
            rows.append(r if r is not None else 0)
            known.append(r is not None)
            train.append(bool(t))
            texts.append(_tokens(x))
            held += len(texts[-1])
            if held >= BLOCK_WORDS:
                yield close()
                rows, known, train, texts, held = [], [], [], [], 0
    if rows:
        yield close()


def _grams(words: np.ndarray, stream: np.ndarray, length: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """The keys of the n-grams that end at each token, for n = 1 .. order; before a text lie START tokens."""
    out = words[stream]
    yield out
    first = np.cumsum(length, dtype=np.int64) - length
    place = np.arange(len(stream)) - np.repeat(first, length)
    for n in range(2, order + 1):
        back = words[stream]
        back[n - 1 :] = back[: len(stream) - n + 1].copy()
        back[place < n - 1] = START
        out = mixed(mixed(back, n) + out)
        yield out


def _ask(batches: Iterator[pa.RecordBatch], order: int, buckets: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("size", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
    for b in batches:
        for i in range(b.num_rows):  # a block is large: one at a time
            r = b.slice(i, 1).to_pylist()[0]
            length, words, stream = _parts(r)
            used = np.repeat(np.frombuffer(r["train"], bool), length)
            for n, g in enumerate(_grams(words, stream, length, order), 1):
                rows = []
                keys = np.unique(g)
                mine, counts = np.unique(g[used], return_counts=True)
                all_ = np.zeros(len(keys), np.uint32)
                all_[np.searchsorted(keys, mine)] = counts
                to = (mixed(keys) % np.uint64(buckets)).astype(np.int64)
                o = np.argsort(to, kind="stable")
                keys, all_, to = keys[o], all_[o], to[o]
                starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])  # of the buckets that occur
                for lo, hi in zip(starts, np.r_[starts[1:], len(to)]):
                    rows.append((int(to[lo]), r["block"], n, _short(keys[lo:hi]), all_[lo:hi].tobytes()))
                yield _batch(rows, schema)


def _short(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY].tobytes()


def _long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEY, 8), np.uint8)
    out[:, :KEY] = np.frombuffer(data, np.uint8).reshape(-1, KEY)
    return out.view("<u8").reshape(-1)


def _parts(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(r["length"], np.uint32), np.frombuffer(r["words"], np.uint64), np.frombuffer(r["stream"], np.uint32)


def _answer(asked: pd.DataFrame) -> pd.DataFrame:
    """Sums the counts of every n-gram of a bucket over all blocks; answers each question in its own order.

    Answers have 32 bits each, or 64 where one of them needs more: the size is then negative.
    """
    out = []
    for n, part in asked.groupby("size"):
        keys, counts = [_long(x) for x in part["keys"]], [np.frombuffer(x, np.uint32) for x in part["counts"]]
        value, index = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(index, np.concatenate(counts), len(value))
        answer, at = total.astype(np.uint64)[index], 0
        for block, k, i in zip(part["block"], keys, part.index):
            mine = answer[at : at + len(k)]
            wide = len(mine) > 0 and int(mine.max()) >= 2**32
            out.append((asked.at[i, "bucket"], block, -n if wide else n, None, (mine if wide else mine.astype(np.uint32)).tobytes()))
            at += len(k)
        known = value[total > 0]
        if n == 1:  # training tokens and distinct words of this bucket
            out.append((asked["bucket"].iloc[0], -1, 0, None, np.array([total.sum(), len(known)], np.float64).tobytes()))
    return pd.DataFrame(out, columns=["bucket", "block", "size", "keys", "counts"])


@dataclass(frozen=True)
class Automaton:
    """What a block's texts can reach of the automaton: the states, with the length of their history, their failure
    arc and its cost, and the arcs, with their weight and the state after them. wanted[d] has for each token of the
    block the number of its arc from a history of d words, -1 where there is none."""

    start: int
    depth: array
    failure: array
    cost: array
    weight: array
    after: array
    wanted: list[np.ndarray]

    def walk(self, begin: int, end: int) -> float:
        """The log10 probability of the text of these tokens: one pass from left to right that carries the state."""
        state, total = self.start, 0.0
        depth, failure, cost, weight, after = self.depth, self.failure, self.cost, self.weight, self.after
        for arcs in zip(*(w[begin:end].tolist() for w in self.wanted)):
            arc = arcs[depth[state]]
            while arc < 0:
                total += cost[state]
                state = failure[state]
                arc = arcs[depth[state]]
            total += weight[arc]
            state = after[arc]
        return total


def build_automaton(words: np.ndarray, stream: np.ndarray, length: np.ndarray, counted: Callable[[int, np.ndarray], np.ndarray], order: int, mass: float, n_train: float, n_words: float, n_texts: float) -> Automaton:
    """The automaton over the n-grams of a block; counted(n, keys): the training counts of its distinct n-grams, by key.

    States are numbered: 0 for no history, 1 .. order - 1 for texts' starts, then the histories that training texts
    hold. The n-gram that ends at a token has the one that ends before it as its history.
    """
    first = np.cumsum(length, dtype=np.int64) - length
    starts = np.zeros(len(stream), bool)
    starts[first] = True
    failure, cost = [np.r_[0, np.arange(order - 1)]], [np.r_[0.0, np.full(order - 1, np.log10(mass / (n_texts + mass)))]]
    depth, states, arcs, wanted, made = [np.arange(order)], order, 0, [], []
    before = old_home = old_p = old_count = None
    for n, g in enumerate(_grams(words, stream, length, order), 1):
        keys, gram = (words, stream) if n == 1 else np.unique(g, return_inverse=True)
        c, at = counted(n, keys).astype(np.float64), np.empty(len(keys), np.int64)
        at[gram] = np.arange(len(gram))  # a token that each ends at
        if n == 1:
            p, shorter, there = (c + 0.5) / (n_train + 0.5 * (n_words + 1)), np.zeros(len(c), np.int64), np.ones(len(c), bool)
        else:
            history = np.where(starts[at], n_texts, old_count[before[np.maximum(at - 1, 0)]])
            p, shorter, there = (c + mass * old_p[before[at]]) / (history + mass), old_home[before[at]], c > 0
        home = shorter
        if n < order:
            held = c > 0
            home = np.where(held, states + np.cumsum(held) - 1, shorter)
            failure.append(shorter[held])
            cost.append(np.log10(mass / (c[held] + mass)))
            depth.append(np.full(int(held.sum()), n))
            states += int(held.sum())
        wanted.append(np.where(there, arcs + np.cumsum(there) - 1, -1)[gram].astype(np.int32))
        arcs += int(there.sum())
        made.append((np.log10(p[there]), home[there]))
        before, old_home, old_p, old_count = gram, home, p, c
    weight, after = (np.concatenate(x) for x in zip(*made))
    whole, real = (lambda x: array("l", np.concatenate(x).astype(np.int64).tobytes())), (lambda x: array("d", np.concatenate(x).tobytes()))
    return Automaton(order - 1, whole(depth), whole(failure), real(cost), real([weight]), whole([after]), wanted)


def answered(part: pd.DataFrame) -> np.ndarray:
    """The counts of rows of `_answer`, one after the other."""
    return np.concatenate([np.frombuffer(x, np.uint64 if n < 0 else np.uint32).astype(np.uint64) for x, n in zip(part["counts"], part["size"])] or [np.empty(0, np.uint64)])


def _traverse(rows: pd.DataFrame, answers: pd.DataFrame, order: int, mass: float, n_train: float, n_words: float, n_texts: float, buckets: int) -> pd.DataFrame:
    parts = []
    for r in rows.to_dict("records"):
        length, words, stream = _parts(r)
        ends = np.cumsum(length, dtype=np.int64)
        mine = answers[answers["block"] == r["block"]]

        def counted(n: int, keys: np.ndarray) -> np.ndarray:
            out = np.zeros(len(keys), np.uint64)
            o = np.argsort((mixed(keys) % np.uint64(buckets)).astype(np.int64), kind="stable")
            out[o] = answered(mine[mine["size"].abs() == n].sort_values("bucket"))
            return out

        automaton = build_automaton(words, stream, length, counted, order, mass, n_train, n_words, n_texts)
        of_word = counted(1, words)
        base, seen = np.log10(of_word + 0.5)[stream], (of_word > 0)[stream]
        n_base, n_seen, score = [], [], []
        for a, b in zip(ends - length, ends):
            n_base.append(np.sum(base[a:b]))
            n_seen.append(int(np.sum(seen[a:b])))
            score.append(automaton.walk(a, b))
        known = np.frombuffer(r["known"], bool)
        parts.append(pd.DataFrame({"row": pd.arrays.IntegerArray(np.frombuffer(r["row"], np.int64).copy(), ~known), "n_tokens": length.astype(np.int64), "n_known": n_seen, "base": n_base, "n_base": length.astype(np.int64), "score": score}))
    return pd.concat(parts)


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 2, mass: float = 4.0, buckets: int | None = None) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    Tokens: the words of the text, A-Z lower-cased, then one end. train tells which rows are learned from (null:
    not). n_known: tokens that the training texts hold; train_tokens: N; base_score: the base model's log10
    probability of the text, score: the automaton's of the given order. Each history's probabilities sum to 1 over
    the V training words and one for all others.

    A null text counts as empty, which is one end token. Null and repeated ids and repeated rows are scored row by
    row. Without training rows N and V are 0 and every token has probability 1. An empty table gives an empty
    table. Other columns are not read. N-grams are told apart by their bucket and hashes of 48 bits. A block's part of
    the automaton is bounded by BLOCK_WORDS or its one text; a very common n-gram is asked for once by each block, and
    a block asks in one row for all of its n-grams of a bucket, so there are at most as many rows as n-grams.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("row"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    blocks = written(d.mapInArrow(_blocks, BLOCKS), "lm-blocks")
    n_blocks, words = blocks.agg(F.count("*"), F.sum(F.octet_length("stream") / 4)).first()
    k = buckets or max(partitions(spark), int(order * (words or 0)) // BUCKET_WORDS)  # n-grams of a bucket are in memory together
    # as many tasks as buckets, and one for every few blocks: a task's rows are in memory together too
    by_block = max(partitions(spark), n_blocks // BLOCKS_EACH)
    asked = blocks.mapInArrow(lambda b: _ask(b, order, k), ASKED)
    answers = written(asked.repartition(k, "bucket").groupBy("bucket").applyInPandas(_answer, ASKED), "lm-answers")

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = [np.frombuffer(c, np.float64) for c in b["counts"]]
            yield pd.DataFrame(x, columns=["n", "v"]).astype("float64")

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"t": [float(np.frombuffer(x, bool).sum()) for x in b["train"]]})

    n_train, n_distinct = answers.where("block = -1").select("counts").mapInPandas(totals, "n double, v double").agg(F.sum("n"), F.sum("v")).first()
    n_texts = blocks.select("train").mapInPandas(texts, "t double").agg(F.sum("t")).first()[0]
    n_train, n_distinct, n_texts = n_train or 0.0, n_distinct or 0.0, n_texts or 0.0
    both = [d.repartition(by_block, "block").groupBy("block") for d in (blocks, answers.where("block >= 0"))]
    scored = both[0].cogroup(both[1]).applyInPandas(lambda a, b: _traverse(a, b, order, mass, n_train, n_distinct, n_texts, k), SCORED)
    total = np.log10(n_train + 0.5 * (n_distinct + 1))
    own = {"train_tokens": F.lit(int(n_train)).cast("long"), "base_score": F.col("base") - F.col("n_base") * F.lit(float(total))}
    return with_own(scored, own).select(F.col("row").alias(id_col), "n_tokens", "n_known", "train_tokens", "base_score", "score")
