"""Histogram sort into shards of near equal bytes, with DataFrame functions only.

The sort key of a row is a pair of 64-bit hashes, of the text and of the id, so that copies of a text lie side
by side. Splitters are found by counting: the exact bytes below many candidate boundaries are summed over all
partitions at once, the cell that holds a wanted splitter is cut into finer cells, and so on until every splitter
is within the tolerance. Only then are the rows exchanged, once, straight to their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, restored, sheltered, utf8_bytes, written

#: Bytes that each row takes besides its text.
ROW_BYTES = 16
#: The 128 bits of a key are read in digits of this many bits; the first cells have two digits.
DIGIT = 8
DIGITS, FIRST = 128 // DIGIT, 2
#: Parts for each shuffle partition at least, so that tasks are of like size.
PARTS_EACH = 8


def _prefix(n: int) -> Column:
    """The first n digits as one hexadecimal string: string order is key order."""
    whole = F.concat(*[F.lpad(F.lower(F.hex(F.col(c))), 16, "0") for c in ("_k1", "_k2")])
    return F.substring(whole, 1, n * DIGIT // 4)


def find_splitters(keys: DataFrame, sums: dict[str, int], parts: int, per_shard: int, tolerance: float) -> list[str]:
    """parts - 1 ascending keys that cut the rows of keys (_k1, _k2, size) into near equal parts.

    sums: the bytes in each first cell. A row belongs above a splitter if its key is not less.

    A splitter between shards, which is every per_shard-th, may be off by `tolerance` of a shard's share, one inside a
    shard by half of a part's. Each round sums the bytes of the cells that still hold a wanted splitter, at most
    2**DIGIT sums for each, whatever the number of rows; a cell that no digit is
    left to cut holds one row, or rows equal in text and id, and is taken at its nearer edge. An edge between
    different texts is preferred where it is within the tolerance, so nearly all copies stay together; a group
    of copies that is too large for that is cut inside.
    """
    total = sum(sums.values())
    wanted = [total * i / parts for i in range(1, parts)]
    slack = [tolerance * total * per_shard / parts if i % per_shard == 0 else total / parts / 2 for i in range(1, parts)]
    found: dict[int, str] = {}
    # every open splitter: the cell that holds it and the bytes below that cell
    cells: dict[str, int] = {}
    where: dict[int, str] = {}

    def place(ordered: list[tuple[str, int]], base: int, targets: list[int], last: bool) -> None:
        edge, at = base, iter(targets)
        i = next(at, None)
        for p, b in ordered:
            while i is not None and wanted[i] <= edge + b:
                low, high = wanted[i] - edge, edge + b - wanted[i]
                if min(low, high) <= slack[i] or last:
                    found[i] = p if low <= high else p + "~"
                else:
                    where[i], cells[p] = p, edge
                i = next(at, None)
            edge += b
        while i is not None:  # nothing above
            found[i], i = "~", next(at, None)

    place(sorted(sums.items()), 0, list(range(len(wanted))), False)
    for n in range(FIRST + 1, DIGITS + 1):
        if not cells:
            break
        old, open_, cells, where = cells, where, {}, {}
        inner = keys.where(_prefix(n - 1).isin(list(old)))
        finer = inner.groupBy(_prefix(n).alias("p")).agg(F.sum("size").alias("b")).collect()
        below: dict[str, list[tuple[str, int]]] = {}
        for p, b in finer:
            below.setdefault(p[: (n - 1) * DIGIT // 4], []).append((p, b))
        for cell, base in old.items():
            place(sorted(below[cell]), base, [i for i, c in open_.items() if c == cell], n == DIGITS)
    return sorted(found.values())


def histogram_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.01, part_bytes: int = 128 << 20, most_parts: int = 16384) -> DataFrame:
    """docs with `size`, `shard` (0 to shards - 1, near equal in bytes) and `slot` (gapless in a shard, from 0).

    A row's size is the UTF-8 bytes of its text (null: none) plus ROW_BYTES. Shards follow the order of the keys,
    and so do the slots inside a shard. A shard is cut into parts of about part_bytes (more, where all shards
    would have over most_parts parts; less, so that there are PARTS_EACH parts for each shuffle partition), which are
    what the one exchange deals; a slot is the rows of the shard's parts before it plus the rank inside the part.

    A very long text is one row, and its shard is off by half of it at most. Null texts count as empty; null ids hash like any value; rows that are equal in text and id get neighbouring
    slots in no set order; an empty table gives an empty table; columns named size, shard or slot are replaced.
    """
    spark = docs.sparkSession
    d, (doc_id, text) = sheltered(docs, id_col, text_col)
    k1, k2 = F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.xxhash64(F.col(doc_id), F.lit(1))
    keyed = d.withColumns({"_k1": k1, "_k2": k2, "size": utf8_bytes(F.col(text)) + ROW_BYTES})
    keys = written(keyed.select("_k1", "_k2", "size"), "shard-keys")
    cells = dict(keys.groupBy(_prefix(FIRST).alias("p")).agg(F.sum("size")).collect())
    total = sum(cells.values())
    wanted = max(-(-total // (shards * part_bytes)), -(-PARTS_EACH * partitions(spark) // shards))
    per_shard = max(1, min(wanted, most_parts // shards))
    cuts = find_splitters(keys, cells, shards * per_shard, per_shard, tolerance)
    # by first cell: the splitters below it, and those inside it
    width, inside = FIRST * DIGIT // 4, {}
    for c in cuts:
        inside.setdefault(c[:width], []).append(c)
    table, below = [], 0
    for cell in sorted({*cells, *inside}):
        table.append((cell, below, inside.get(cell, [])))
        below += len(inside.get(cell, []))
    lookup = F.broadcast(spark.createDataFrame(table, "_cell string, _below int, _cuts array<string>"))  # at most 2**(FIRST * DIGIT) rows

    def with_part(df: DataFrame) -> DataFrame:
        whole = df.withColumn("_key", _prefix(DIGITS)).withColumn("_cell", _prefix(FIRST)).join(lookup, "_cell")
        inner = F.when(F.size("_cuts") == 0, 0).otherwise(F.size(F.filter("_cuts", lambda c: c <= F.col("_key"))))
        return whole.withColumn("_part", F.col("_below") + inner)

    counts = sorted(with_part(keys).groupBy("_part").count().collect())
    bases, shard, rows = [], 0, 0
    for part, n in counts:
        if part // per_shard != shard:
            shard, rows = part // per_shard, 0
        bases.append((part, rows))
        rows += n
    base = F.broadcast(spark.createDataFrame(bases, "_part int, _base long"))  # at most most_parts rows
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("_key"))
    placed = with_part(keyed).withColumn("_rank", rank).join(base, "_part")
    own = {"size": F.col("size"), "shard": F.floor(F.col("_part") / per_shard).cast("int"), "slot": F.col("_base") + F.col("_rank") - 1}
    return restored(placed, docs.columns, own)
