"""Joins: containment, chains, identities, as-of lookups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions.text import normalize_slot, tokens
from mnemora.storage import written

#: Rows and terms of a block, and rows of a tile of it.
BLOCK, TERMS, TILE = 8192, 2**20, 1024
#: Terms that so many rows of two tiles have are met by a product of matrices, so many terms at most; others by lists.
FREQUENT, COLUMNS = 48, 512
#: So many of the commonest terms tell which rows lie together.
COMMON = 32


def with_count(left: DataFrame, right: DataFrame, on: tuple[str, str], name: str) -> DataFrame:
    """left with the number of its rows in right; 0 where there are none."""
    n = right.groupBy(F.col(on[1]).alias("_key")).agg(F.count("*").alias("_n"))
    return left.join(n, F.col(on[0]) == F.col("_key"), "left").withColumn(name, F.coalesce("_n", F.lit(0))).drop("_key", "_n")


def mentions(texts: DataFrame, names: DataFrame, id_col: str, text_col: str, name_col: str) -> DataFrame:
    """(id, name): names of one token that a text has as a token.

    An equality join on tokens: each text's distinct tokens meet the distinct names, without comparing every text
    with every name.
    """
    t = texts.select(id_col, F.explode_outer(F.array_distinct(tokens(F.col(text_col)))).alias("_token"))
    n = names.select(F.lower(name_col).alias("_token"), F.col(name_col).alias("name")).distinct()
    return t.join(n, "_token").select(id_col, "name")


def names_within(texts: DataFrame, names: DataFrame, id_col: str, text_col: str, name_col: str) -> DataFrame:
    """(id, name): names of two characters or more that occur anywhere in a text, in normal form, within words too.

    A name's first two characters are its key: each text's distinct pairs of characters meet the names by equality, and
    only those that meet are looked for in the text. Names of several words or ideographs are found like any other.
    """
    n = names.select(F.col(name_col).alias("name"), normalize_slot(F.col(name_col)).alias("_n")).where(F.length("_n") >= 2).distinct().withColumn("_key", F.substring("_n", 1, 2))
    t = texts.select(id_col, normalize_slot(F.col(text_col)).alias("_t")).where(F.length("_t") >= 2)
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_t") - 1), lambda i: F.substr("_t", i, F.lit(2))))
    return t.withColumn("_key", F.explode(pairs)).join(n, "_key").where(F.contains("_t", "_n")).select(id_col, "name")


def similar_pairs(rows: DataFrame, id_col: str, terms_col: str, threshold: float) -> DataFrame:
    """(a, b, similarity): pairs of rows whose sets of terms have this Jaccard similarity or more, a before b.

    A low threshold rules out few pairs by single terms, so every two blocks of rows meet, and a task counts what the rows
    of two blocks share. Blocks are written once, as numbers; tasks read them from there, so disk grows with the rows
    and only work with their square. Memory is that of a few blocks. Blocks hold rows of like words and sizes, and rows
    that have too few words in common with all of a block are left out of its product. Rows without terms have no partner.
    """
    d = written(rows.select(F.col(id_col).alias("_i"), F.array_distinct(F.array_compact(terms_col)).alias("_s")), "similar").where((F.size("_s") > 0) & F.col("_i").isNotNull())
    words = written(d.select(F.explode("_s").alias("_t")).groupBy("_t").agg(F.count("*").alias("_df")), "words")
    number = next(h for h in map(_number, range(64)) if words.groupBy(h("_t")).count().where("count > 1").isEmpty())  # no two terms have one number
    common = F.array(*[F.lit(r[0]) for r in words.orderBy(F.desc("_df"), "_t").limit(COMMON).select(number("_t")).collect()]).cast("array<bigint>")
    kind, blocks = dict(d.dtypes)["_i"], max(1, -(-d.count() // (BLOCK * 3 // 4)))
    d = d.select("_i", F.transform("_s", number).alias("_h"))
    like = {"_x": F.get(F.array_intersect(common, "_h"), F.lit(0)), "_y": F.size("_h"), "_z": F.xxhash64("_i")}
    dealt = d.withColumns(like).repartitionByRange(blocks, *like).sortWithinPartitions(*like).select("_i", "_h")
    held = f"ids array<{kind}>, sizes array<int>, terms array<bigint>, at array<int>"
    block = written(dealt.mapInArrow(_blocks_of(BLOCK), held).withColumn("n", F.monotonically_increasing_id()), "blocks")
    x, y = ([F.col(c).alias(f"{side}_{c}") for c in block.columns] for side in "xy")
    once = F.when((F.col("x_n") + F.col("y_n")) % 2 == 0, F.col("x_n") <= F.col("y_n")).otherwise(F.col("x_n") > F.col("y_n"))  # half of each block's pairs in each order
    both = block.select(*x).join(block.select(*y).hint("shuffle_replicate_nl"), once)
    found = both.mapInArrow(_met(threshold, TILE, FREQUENT), f"a {kind}, b {kind}, similarity double").where(F.col("a") != F.col("b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def _number(seed: int) -> Callable[[Column | str], Column]:
    return lambda t: F.xxhash64(F.lit(seed), t)


def _blocks_of(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, numbers of terms) as blocks of `most` rows and TERMS terms at most, or of one row: a block's terms once, and where each row has them."""

    def packed(ids: list[pa.Array], lists: list[pa.Array]) -> pa.RecordBatch:
        sizes = np.concatenate([x.value_lengths().to_numpy(zero_copy_only=False) for x in lists]).astype(np.int32)
        terms, at = np.unique(np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in lists]), return_inverse=True)
        one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
        return pa.RecordBatch.from_arrays([one(v) for v in (pa.concat_arrays(ids), pa.array(sizes), pa.array(terms), pa.array(at.astype(np.int32)))], ["ids", "sizes", "terms", "at"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lists, n, terms = [], [], 0, 0
        for batch in batches:
            start, ends = 0, np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
            while start < batch.num_rows:
                before = ends[start - 1] if start else 0
                fit = int(np.searchsorted(ends, before + TERMS - terms, "right"))
                end = min(start + most - n, fit)
                if end <= start and not n:
                    end = start + 1
                if end > start:
                    ids.append(batch.column(0).slice(start, end - start))
                    lists.append(batch.column(1).slice(start, end - start))
                    n, terms, start = n + end - start, terms + int(ends[end - 1] - before), end
                if start < batch.num_rows:
                    yield packed(ids, lists)
                    ids, lists, n, terms = [], [], 0, 0
        if n:
            yield packed(ids, lists)

    return pack


def _met(threshold: float, tile: int, frequent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Two blocks a row: the pairs of their rows that are similar. Terms that many rows have meet by a product of matrices, others by lists."""
    share = threshold / (1 + threshold)  # of both sizes, that a similar pair has in common

    class Side:
        """Rows of a block that may have a partner, with those of their terms that both blocks have."""

        def __init__(self, sizes: np.ndarray, at: np.ndarray, to: np.ndarray, other: np.ndarray) -> None:
            owner, term = np.repeat(np.arange(len(sizes)), sizes), to[at]
            owner, term = owner[term >= 0], term[term >= 0]
            most = np.minimum(np.bincount(owner, minlength=len(sizes)), other.max())
            self.rows = np.flatnonzero(most + 1e-6 >= share * (sizes + float(other.min())))
            place = np.full(len(sizes), -1)
            place[self.rows] = np.arange(len(self.rows))
            kept = place[owner] >= 0
            self.owner, self.term, self.sizes = place[owner[kept]], term[kept], sizes[self.rows].astype(np.float32)

        def cut(self, column: np.ndarray, columns: int) -> None:
            often = column[self.term] >= 0
            self.table = np.zeros((len(self.rows), columns), np.float32)
            self.table[self.owner[often], column[self.term[often]]] = 1
            self.owner, self.term = self.owner[~often], self.term[~often]
            edges = np.searchsorted(self.owner, np.arange(0, len(self.rows) + tile, tile))
            self.lists = [(self.owner[a:b] - k * tile, self.term[a:b]) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
            self.tiles = [slice(k, k + tile) for k in range(0, len(self.rows), tile)]

    def by_term(rows: np.ndarray, term: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray]:
        return rows[np.argsort(term, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(term, minlength=terms))])

    def add_lists(both: np.ndarray, mine: tuple[np.ndarray, np.ndarray], rows: np.ndarray, starts: np.ndarray) -> None:
        owner, times = mine[0], starts[mine[1] + 1] - starts[mine[1]]
        some = times > 0
        owner, times, start = owner[some], times[some], starts[mine[1][some]]
        done = np.cumsum(times)
        at = 0
        while at < len(owner):  # 2^21 at once
            end = max(at + 1, int(np.searchsorted(done, done[at] - times[at] + 2**21, "right")))
            t = times[at:end]
            which = np.repeat(start[at:end] - (np.cumsum(t) - t), t) + np.arange(t.sum())
            np.add.at(both.reshape(-1), np.repeat(owner[at:end] * both.shape[1], t) + rows[which], np.float32(1))
            at = end

    def pairs(x: dict[str, np.ndarray], y: dict[str, np.ndarray], same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        shared, ix, iy = np.intersect1d(x["terms"], y["terms"], assume_unique=True, return_indices=True)
        sides = []
        for side, i, other in ((x, ix, y), (y, iy, x)):
            to = np.full(len(side["terms"]), -1)
            to[i] = np.arange(len(shared))
            sides.append(Side(side["sizes"], side["at"], to, other["sizes"]))
        a, b = sides
        if not len(a.rows) or not len(b.rows):
            return
        count = [np.bincount(s.term, minlength=len(shared)) * (tile / max(tile, len(s.rows))) for s in sides]
        often = np.flatnonzero(count[0] * count[1] >= frequent**2)
        often = often[np.argsort(-(count[0] * count[1])[often], kind="stable")[:COLUMNS]]
        column = np.full(len(shared), -1)
        column[often] = np.arange(len(often))
        for s in sides:
            s.cut(column, len(often))
        ordered = [by_term(*mine, len(shared)) for mine in b.lists[: len(b.tiles)]]
        for i, p in enumerate(a.tiles):
            for j, q in enumerate(b.tiles):
                if same and j < i or share * (a.sizes[p].min() + b.sizes[q].min()) > min(a.sizes[p].max(), b.sizes[q].max()) + 1e-3:
                    continue
                both = a.table[p] @ b.table[q].T
                add_lists(both, a.lists[i], *ordered[j])
                both -= a.sizes[p][:, None] * np.float32(share) - np.float32(1e-3)
                r, c = np.divmod(np.flatnonzero(both >= b.sizes[q] * np.float32(share)), both.shape[1])
                n = np.rint(both[r, c] + a.sizes[p][r] * share)
                s = n / (a.sizes[p][r].astype(np.float64) + b.sizes[q][c] - n)
                kept = (s >= threshold - 1e-9) & ((i != j) | (r < c) if same else True)
                if kept.any():
                    yield a.rows[p][r[kept]], b.rows[q][c[kept]], s[kept]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                value = lambda c: batch.column(batch.schema.get_field_index(c))[k]  # noqa: B023, E731
                x, y = ({c: value(f"{side}_{c}").values.to_numpy() for c in ("sizes", "terms", "at")} for side in "xy")
                for i, j, s in pairs(x, y, value("x_n") == value("y_n")):
                    yield pa.RecordBatch.from_arrays([value("x_ids").values.take(pa.array(i)), value("y_ids").values.take(pa.array(j)), pa.array(s)], ["a", "b", "similarity"])

    return meet


def resolve_chain(links: DataFrame, key: str, target: str, hops: int) -> DataFrame:
    """(key, resolved, hops): follows key -> target up to `hops` times and stops where the chain ends.

    A link to itself ends its chain. Each hop is an equality join; with few links Spark broadcasts them by itself.
    """
    step = links.where(F.col(key) != F.col(target)).select(F.col(key).alias("_from"), F.col(target).alias("_to"))
    d = links.select(F.col(key), F.col(key).alias("resolved"), F.lit(0).alias("hops"))
    for _ in range(hops):
        d = d.join(step, F.col("resolved") == F.col("_from"), "left")
        d = d.select(key, F.coalesce("_to", "resolved").alias("resolved"), (F.col("hops") + F.col("_to").isNotNull().cast("int")).alias("hops"))
    return d


def closure(links: DataFrame, key: str, target: str, depth: int) -> DataFrame:
    """(key, reached, depth): all that is reached by 1 to depth links, with the fewest.

    Each round joins what the last one found with the links, and keeps what is new: distinct pairs, however many ways
    lead there. A round's pairs are written, so the plan does not grow.
    """
    step = written(links.select(F.col(key).alias("k"), F.col(target).alias("t")).distinct(), "links")
    front = reached = step.select("k", "t", F.lit(1).alias("d"))
    onward = step.select(F.col("k").alias("t"), F.col("t").alias("u"))
    for d in range(2, depth + 1):
        more = front.join(onward, "t").select("k", F.col("u").alias("t")).distinct()
        front = written(more.join(reached.select("k", "t"), ["k", "t"], "left_anti").select("k", "t", F.lit(d).alias("d")), "closure")
        reached = reached.unionByName(front)
    return reached.select(F.col("k").alias(key), F.col("t").alias("reached"), F.col("d").alias("depth"))


def last_before(rows: DataFrame, other: DataFrame, keys: list[str], ts: str, other_ts: str, other_id: str, within: int) -> DataFrame:
    """rows with `found`: the id of other's last row at or before theirs, at most `within` seconds ago; else null.

    As-of join by one window over the union of both sides, so nothing is compared pair by pair.
    """
    a = rows.select("*", F.lit(None).cast("long").alias("_id"), F.lit(None).cast("long").alias("_ts"), F.col(ts).alias("_at"), F.lit(1).alias("_side"))
    b = other.select(*keys, F.col(other_id).cast("long").alias("_id"), F.col(other_ts).cast("long").alias("_ts"), F.col(other_ts).alias("_at"), F.lit(0).alias("_side"))
    w = Window.partitionBy(*keys).orderBy("_at", "_side", F.col("_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("_side") == 0, F.struct("_id", "_ts")), ignorenulls=True).over(w)
    d = a.unionByName(b, allowMissingColumns=True).withColumn("_last", last).where("_side = 1")
    return d.withColumn("found", F.when(F.col(ts) - F.col("_last._ts") <= within, F.col("_last._id"))).drop("_id", "_ts", "_at", "_side", "_last")
