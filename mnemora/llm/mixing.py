"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only.

Every row has a hash. What a source shall give is some whole passes over its rows and a rest; the rows whose hash
lies below the source's threshold give the rest. The threshold is found by summing words by source and hash
bucket: running sums show the bucket that holds the budget, only that bucket is cut finer, and so on. Budgets of
one source are nested: a larger budget has a higher threshold, so its rows include those of a smaller one.
Nothing is sorted but sums, at most 2**BITS for each source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, partitions, restored, sheltered, written

#: Bits of the hash by which each round refines.
BITS = 12
ROUNDS = 5


def ranked_sources(by: DataFrame) -> DataFrame:
    """by (source, ...) with _rank from 0, by code point, null last; no task holds all sources.

    Sources are dealt by ranges of their order; a source's rank is the number of those in the ranges before its own,
    of which there are as many as partitions, and its place in its range.
    """
    order = F.col("source").asc_nulls_last()
    dealt = by.repartitionByRange(partitions(by.sparkSession), order).withColumn("_range", F.spark_partition_id())
    dealt = written(dealt, "mix-ranges")
    before, table = 0, []
    for part, n in sorted(dealt.groupBy("_range").count().collect()):
        table.append((part, before))
        before += n
    bases = F.broadcast(by.sparkSession.createDataFrame(table, "_range int, _base long"))  # a row for each partition
    place = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return dealt.withColumn("_place", place).join(bases, "_range").withColumn("_rank", F.col("_base") + F.col("_place") - 1).drop("_range", "_place", "_base")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (source, size) -> (source, source_size, target).

    Sources by code point, null last, weigh `weights`, repeated. Targets share `share` of all sizes by weight; none
    is above `most` times its source's size, and the excess is shared again by weight. So every target is
    min(most * size, level * weight) for one level. Each round sums the caps of the sources that the level fills and
    the weights of the others, which gives the next, higher level, until no more are filled.
    """
    d = ranked_sources(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    d = written(d.select("source", "source_size", weight.alias("_weight"), (most * F.col("source_size")).alias("_cap")), "mix-weights")
    level, filled = 0.0, -1
    while True:
        full = F.col("_cap") <= F.lit(level) * F.col("_weight")
        n, total, caps, heavy = d.agg(F.count(F.when(full, 1)), F.sum("source_size"), F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("_weight")))).first()
        if n == filled or not heavy:
            break
        level, filled = (share * total - (caps or 0.0)) / heavy, n
    return d.select("source", "source_size", F.least(F.col("_cap"), F.lit(level) * F.col("_weight")).alias("target") if heavy else F.col("_cap").alias("target"))


def _bits(n: int) -> Column:
    """The highest n bits of the hash."""
    return F.shiftrightunsigned(F.col("_hash"), 64 - n)


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """rows (source, size, _hash), budgets (source, _rest): budgets with _bound, of ROUNDS * BITS bits.

    The rows of a source whose hash's high bits are below _bound sum to its _rest, to within half of the sum of
    the rows that share all ROUNDS * BITS bits at the bound: one row, as a rule.
    """
    open_ = budgets.select("source", "_rest", F.lit(0).cast("long").alias("_cell"), F.lit(0).cast("long").alias("_under"))
    for k in range(1, ROUNDS + 1):
        n = k * BITS
        sums = rows if k == 1 else rows.join(open_.select(F.col("source").alias("_s"), "_cell"), F.col("source").eqNullSafe(F.col("_s")) & (_bits(n - BITS) == F.col("_cell"))).drop("_s", "_cell")
        sums = sums.groupBy("source", _bits(n).alias("_fine")).agg(F.sum("size").alias("_sum"))
        upto = F.sum("_sum").over(Window.partitionBy("source").orderBy("_fine"))
        cut = sums.withColumn("_upto", upto).join(open_.select(F.col("source").alias("_s"), "_rest", "_under"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        # the first cell whose end reaches the rest
        reach = F.when(F.col("_under") + F.col("_upto") >= F.col("_rest"), F.struct("_fine", (F.col("_under") + F.col("_upto") - F.col("_sum")).alias("_under"), "_sum"))
        open_ = cut.groupBy("source").agg(F.first("_rest").alias("_rest"), F.min(reach).alias("_at"))
        open_ = written(open_.select("source", "_rest", F.col("_at._fine").alias("_cell"), F.col("_at._under").alias("_under"), F.col("_at._sum").alias("_sum")), f"mix-cells-{k}")
    nearer = F.col("_rest") - F.col("_under") > F.col("_under") + F.col("_sum") - F.col("_rest")
    return open_.select("source", (F.col("_cell") + nearer.cast("long")).alias("_bound"))


def _planned(docs: DataFrame, weights: Sequence[float], share: float, most: float, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """docs, sheltered, with size, source_size, target, and _passes: how often a row is taken."""
    d, (doc_id, text, origin) = sheltered(docs, id_col, text_col, source_col)
    source, size = F.col(origin), n_words(F.col(text))
    hashed = F.xxhash64(F.col(doc_id), F.col(text), F.lit(5))
    rows = written(d.select(source.alias("source"), size.alias("size"), hashed.alias("_hash")), "mix-sizes")
    targets = written(source_targets(rows, weights, share, most), "mix-targets")
    times = F.floor(F.col("target") / F.col("source_size")).cast("int")
    plan = targets.select("source", F.when(F.col("source_size") > 0, times).otherwise(0).alias("_times"), "source_size", "target")
    plan = plan.withColumn("_rest", F.col("target") - F.col("_times") * F.col("source_size"))
    bounds = thresholds(rows, plan.where("source_size > 0").select("source", "_rest"))
    plan = plan.join(bounds.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
    plan = written(plan.select(F.col("source").alias("_s"), "_times", "_bound", "source_size", "target"), "mix-plan")
    joined = d.withColumns({"size": size, "_hash": hashed}).join(plan, source.eqNullSafe(F.col("_s")))
    below = F.coalesce(_bits(ROUNDS * BITS) < F.col("_bound"), F.lit(False)).cast("int")
    return joined.withColumn("_passes", F.col("_times") + below)


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with `size`, `source_size`, `target` and `taken`: how many of a row's words the mix takes.

    size: words of the text, 0 for null. A row is taken whole, some times: target / source_size times rounded
    down, and once more if its hash is below its source's threshold; never above `most`, rounded up. The hash is
    of id and text, so reruns agree, rows equal in both are taken alike, and a null id is like any other. A null
    source is a source. A source without words has target 0. A very long text is taken whole or not, so a source misses
    its target by half of it at most. An empty table gives an empty table. Columns named size, source_size, target or
    taken are replaced.
    """
    planned = _planned(docs, weights, share, most, id_col, text_col, source_col)
    own = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "taken": F.col("size") * F.col("_passes")}
    return restored(planned, docs.columns, own)


def mixture(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, each as often as the mix takes it; rows without words once, as no budget counts them.

    Columns stay as they are, whatever their names; all else as mix_sources.
    """
    planned = _planned(docs, weights, share, most, id_col, text_col, source_col)
    times = F.when(F.col("size") > 0, F.col("_passes")).otherwise(1)
    return restored(planned.select("*", F.explode(F.array_repeat(F.lit(1), times)).alias("_copy")), docs.columns, {})
