"""Operators over ordered rows: sessions, chunks, slots, quotas, budgets, pairs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Seconds of a slice of time: a key with very many rows is ordered slice by slice, in as many tasks.
SLICE = 86400


def _with_heads(rows: DataFrame, heads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with what heads has for their key and slice; null keys meet null keys."""
    by = [*keys, "_slice"]
    named = heads.withColumnsRenamed({k: f"_h{i}" for i, k in enumerate(by)})
    same = [F.col(k).eqNullSafe(F.col(f"_h{i}")) for i, k in enumerate(by)]
    return rows.join(named, same).drop(*[f"_h{i}" for i in range(len(by))])


def sessions_by_gap(rows: DataFrame, keys: Sequence[str], gap: int, ts: str = "ts", tie: str = "id") -> DataFrame:
    """rows with `session`, from 1 in each key: a new one starts where more than `gap` seconds passed.

    A key's rows are ordered within slices of time; what a slice starts with comes from the ends of those before it,
    a row for each slice.
    """
    d = rows.withColumn("_slice", F.floor(F.col(ts) / SLICE))
    w = Window.partitionBy(*keys, "_slice").orderBy(ts, tie)
    d = d.withColumn("_new", F.coalesce((F.col(ts) - F.lag(ts).over(w) > gap).cast("int"), F.lit(0)))
    ends = d.groupBy(*keys, "_slice").agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.sum("_new").alias("_more"))
    k = Window.partitionBy(*keys).orderBy("_slice")
    opens = F.coalesce((F.col("_first") - F.lag("_last").over(k) > gap).cast("int"), F.lit(1))
    heads = ends.withColumn("_opens", opens).withColumn("_base", F.sum(F.col("_opens") + F.col("_more")).over(k) - F.col("_more"))
    out = _with_heads(d, heads.select(*keys, "_slice", "_base"), keys)
    return out.withColumn("session", F.col("_base") + F.sum("_new").over(w)).drop("_new", "_slice", "_base")


def with_previous(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], ts: str = "ts", tie: str = "id") -> DataFrame:
    """rows with `previous`, a struct of these columns of the row before in the key, by (ts, tie); slice by slice."""
    d = rows.withColumn("_slice", F.floor(F.col(ts) / SLICE))
    kept = F.struct(*columns)
    inner = F.lag(kept).over(Window.partitionBy(*keys, "_slice").orderBy(ts, tie))
    ends = d.groupBy(*keys, "_slice").agg(F.max(F.struct(F.col(ts).alias("_t"), F.col(tie).alias("_i"), kept.alias("_kept"))).alias("_end"))
    heads = ends.withColumn("_before", F.lag("_end._kept").over(Window.partitionBy(*keys).orderBy("_slice"))).drop("_end")
    out = _with_heads(d.withColumn("_inner", inner), heads, keys)
    return out.withColumn("previous", F.coalesce("_inner", "_before")).drop("_inner", "_before", "_slice")


def numbered(rows: DataFrame, keys: Sequence[str], flag: str, name: str, ts: str = "ts", tie: str = "id") -> DataFrame:
    """rows with `name`: the running sum of a 0/1 column in each key, by (ts, tie). Slices are summed, then offset."""
    d = rows.withColumn("_slice", F.floor(F.col(ts) / SLICE))
    sums = d.groupBy(*keys, "_slice").agg(F.sum(flag).alias("_sum"))
    heads = sums.withColumn("_base", F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_slice")) - F.col("_sum"))
    within = F.sum(flag).over(Window.partitionBy(*keys, "_slice").orderBy(ts, tie))
    return _with_heads(d.withColumn("_in", within), heads.drop("_sum"), keys).withColumn(name, F.col("_base") + F.col("_in")).drop("_base", "_in", "_slice")


def sessions_by_gap_and_span(rows: DataFrame, keys: Sequence[str], gap: int, span: int, ts: str = "ts", tie: str = "id") -> DataFrame:
    """As sessions_by_gap, and no session lasts longer than `span` from its first row.

    Where a session ends depends on where it began, so this is a fold. The gaps alone cut the rows into pieces
    that do not depend on each other; only pieces longer than the span go through the fold: their rows stream by in
    order, and one time is held.
    """
    pieces = sessions_by_gap(rows, keys, gap, ts, tie).withColumnRenamed("session", "_piece")
    by = [*keys, "_piece"]
    w = Window.partitionBy(*by)
    pieces = pieces.withColumn("_long", F.max(ts).over(w) - F.min(ts).over(w) > span)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, start = 0, 0
        for batch in batches:
            out = []
            for t, opens in zip(batch[ts], batch["_opens"]):
                if opens or t - start > span:
                    part, start = 1 if opens else part + 1, t
                out.append(part)
            yield batch.drop(columns="_opens").assign(_part=out)

    shape = T.StructType([*pieces.schema.fields, T.StructField("_part", T.LongType())])
    opens = F.row_number().over(w.orderBy(ts, tie)) == 1
    ordered = pieces.where("_long").withColumn("_opens", opens).repartition(*by).sortWithinPartitions(*by, ts, tie)
    long = ordered.mapInPandas(fold, shape)
    both = pieces.where("not _long").withColumn("_part", F.lit(1).cast("long")).unionByName(long)
    order = Window.partitionBy(*keys).orderBy("_piece", "_part")
    return both.withColumn("session", F.dense_rank().over(order).cast("long")).drop("_piece", "_part", "_long")


def chunks(rows: DataFrame, keys: Sequence[str], size: int, ts: str = "ts", tie: str = "id") -> DataFrame:
    """rows with `chunk`: every `size` rows of a key, in order."""
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    return rows.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def chunks_within(rows: DataFrame, keys: Sequence[str], most_rows: int, most_size: int, size: Column, ts: str = "ts", tie: str = "id") -> DataFrame:
    """(keys, tie, chunk): a chunk, from 0 in each key, ends before the row that would be one too many or too large.

    A row that is too large by itself is a chunk of its own. Sizes of null count as 0. Where a chunk starts depends
    on those before it, so this is a fold: rows stream by in order, key after key, and two numbers are held.
    """
    d = rows.select(*keys, ts, tie, F.coalesce(size, F.lit(0)).cast("long").alias("_size"))
    shape = T.StructType([*d.select(*keys, tie).schema.fields, T.StructField("chunk", T.IntegerType())])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, chunk, n, used = None, 0, 0, 0
        for batch in batches:
            out = []
            for *mine, more in batch[[*keys, "_size"]].itertuples(index=False):
                if key != mine:
                    key, chunk, n, used = mine, 0, 0, 0
                if n and (n >= most_rows or used + more > most_size):
                    chunk, n, used = chunk + 1, 0, 0
                n, used = n + 1, used + more
                out.append(chunk)
            yield batch[[*keys, tie]].assign(chunk=out)

    return d.repartition(*keys).sortWithinPartitions(*keys, ts, tie).mapInPandas(fold, shape)


def slot_keepers(facts: DataFrame) -> DataFrame:
    """facts with `keep`: of a slot's facts the pinned, newest, surest stays, and pinned ones stay beside a pinned one."""
    w = Window.partitionBy("slot_key").orderBy(F.desc("pinned"), F.desc("updated_at"), F.desc("confidence"), "id")
    first = F.row_number().over(w) == 1
    return facts.withColumn("keep", first | (F.col("pinned") & F.first("pinned").over(w)))


def versions(facts: DataFrame) -> DataFrame:
    """facts with valid_from, valid_to (null: open), supersedes and superseded_by, by slot in order of creation.

    A fact that repeats the value before it in its slot opens no version; it is left out.
    """
    w = Window.partitionBy("slot_key").orderBy("created_at", "id")
    before = F.lag(F.struct("value")).over(w)  # null for the first row alone
    changed = facts.withColumn("_before", before).where(F.col("_before").isNull() | ~F.col("value").eqNullSafe(F.col("_before.value"))).drop("_before")
    return changed.withColumns({"valid_from": F.col("created_at"), "valid_to": F.lead("created_at").over(w), "supersedes": F.lag("id").over(w), "superseded_by": F.lead("id").over(w)})


def top_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each key, with their rank."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def newest_of_newest_windows(rows: DataFrame, windows: int, each: int, window: str = "window_tag", ts: str = "ts", tie: str = "id") -> DataFrame:
    """The `each` newest rows of the `windows` windows that were active last."""
    last = rows.groupBy(window).agg(F.max(ts).alias("_last")).orderBy(F.desc("_last"), window).limit(windows)
    return top_per_key(rows.join(F.broadcast(last), window), [window], [F.desc(ts), F.desc(tie)], each).drop("_last")  # `windows` rows


def within_budget(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], size: Column, budget: int) -> DataFrame:
    """Rows of each key, in order, as long as their sizes add up to the budget at most: cut at the first overflow."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def packed(lines: Column, budget: int | Column) -> Column:
    """The lines of an array that fit a budget of characters, a newline between: one too long is skipped, not the rest."""

    def add(done: Column, line: Column) -> Column:
        more = done["used"] + F.length(line) + F.when(F.size(done["kept"]) > 0, 1).otherwise(0)
        return F.when(more <= budget, F.struct(F.array_append(done["kept"], line).alias("kept"), more.alias("used"))).otherwise(done)

    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"))
    return F.aggregate(lines, start, add)["kept"]


def answered_pairs(rows: DataFrame, window: str = "window_tag", gap: int = 90, ts: str = "ts", tie: str = "id") -> DataFrame:
    """(user_id, bot_id, wait): each reply and the user's message right before it in its window, at most gap seconds ago.

    A reply uses up the message before it: a second reply pairs with nothing.
    """
    w = Window.partitionBy(window).orderBy(ts, tie)
    before = lambda c: F.lag(c).over(w)
    talk = rows.where(F.col("role").isin("user", "assistant"))
    d = talk.withColumns({"_role": before("role"), "_id": before(tie), "_ts": before(ts)})
    d = d.where((F.col("role") == "assistant") & (F.col("_role") == "user") & (F.col(ts) - F.col("_ts") <= gap))
    return d.select(window, F.col("_id").alias("user_id"), F.col(tie).alias("bot_id"), (F.col(ts) - F.col("_ts")).alias("wait"))


def unanswered(rows: DataFrame, wait: int, window: str = "window_tag", speaker: str = "speaker_id", ts: str = "ts", tie: str = "id") -> DataFrame:
    """Rows after which nobody else spoke in their window within `wait` seconds."""
    before = with_previous(rows, [window], [speaker], ts, tie)
    turn = F.coalesce((F.col(speaker) != F.col(f"previous.{speaker}")).cast("int"), F.lit(0))
    d = numbered(before.withColumn("_turn", turn).drop("previous"), [window], "_turn", "_run", ts, tie).drop("_turn")
    # the next row by another speaker is the first row of the next run
    starts = d.groupBy(window, "_run").agg(F.min(ts).alias("_next")).withColumn("_run", F.col("_run") - 1)
    joined = d.join(starts, [window, "_run"], "left")
    return joined.where(F.col("_next").isNull() | (F.col("_next") - F.col(ts) > wait)).drop("_run", "_next")
