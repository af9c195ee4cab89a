"""A Merkle manifest of a data set: every row is a leaf, every group of rows a tree, and the groups' roots a tree again.

Leaves are put in order by ranges and numbered without a task that holds a group; ARITY ** HEIGHT leaves that follow each
other are a block. A treehash stack gives each block's root; blocks' roots are the leaves of the next layer, until a
group has one node. Then, from the top down, each block is walked leaf by leaf: a treehash stack for each level builds the
siblings that the next run of nodes needs while the present run is used, so a step costs a few hashes and the walk holds
ARITY nodes a level and stack; the path from the block's root upwards is the same for all its leaves, and is appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written

#: Nodes of a run, and levels of a block.
ARITY, HEIGHT = 8, 4
PATH = "array<struct<left:string,right:string>>"
_STEP = pa.struct([("left", pa.string()), ("right", pa.string())])


def leaf_digest(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of the fields in order: `-` for null, else its number of UTF-8 bytes, `:` and the value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]).cast("binary"), 256)


def folded_root(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give: each level's nodes are joined from left to right and hashed."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]).cast("binary"), 256))


def path_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, level by level upwards, from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def _hash(nodes: Sequence[bytes]) -> bytes:
    return hashlib.sha256(b"".join(nodes)).hexdigest().encode()


class Treehash:
    """Nodes that wait for their run to be full, less than `arity` a level: push leaves, take nodes of one height."""

    def __init__(self, arity: int, height: int):
        self.arity, self.height = arity, height
        self.waiting: list[list[bytes]] = [[] for _ in range(height)]
        self.done: list[bytes] = []

    def _add(self, level: int, node: bytes) -> None:
        while level < self.height:
            run = self.waiting[level]
            run.append(node)
            if len(run) < self.arity:
                return
            node = _hash(run)
            run.clear()
            level += 1
        self.done.append(node)

    def push(self, leaf: bytes) -> None:
        self._add(0, leaf)

    def take(self) -> list[bytes]:
        """The nodes that are done; last runs, shorter ones and those of one node too, end here."""
        for level in range(self.height):
            if run := self.waiting[level]:
                node = _hash(run)
                run.clear()
                self._add(level + 1, node)
        done, self.done = self.done, []
        return done


def block_root(leaves: Sequence[bytes], arity: int, height: int) -> bytes:
    stack = Treehash(arity, height)
    for leaf in leaves:
        stack.push(leaf)
    return stack.take()[0]


def walk(leaves: Sequence[bytes], arity: int, height: int) -> Iterator[list[tuple[bytes, bytes]]]:
    """For each leaf of a block, in order, its (left, right) siblings at each level.

    At each level the present run is held, and a stack that builds the next one: after leaf i it takes the leaf that
    stands where i stands, one run further. So all nodes of a run are done when the walk gets there.
    """
    n = len(leaves)
    width = [arity ** (level + 1) for level in range(height)]  # leaves under a run
    stacks = [Treehash(arity, level) for level in range(height)]
    runs: list[list[bytes]] = []
    for level, stack in enumerate(stacks):
        for leaf in leaves[: width[level]]:
            stack.push(leaf)
        runs.append(stack.take())
    sides: list[tuple[bytes, bytes]] = [(b"", b"")] * height
    for i in range(n):
        for level in range(height):
            if i % (width[level] // arity):
                break  # no node of this level, or of those above, ends between the last leaf and this one
            if i and i % width[level] == 0:
                runs[level] = stacks[level].take()
            place = i // (width[level] // arity) % arity
            sides[level] = (b"".join(runs[level][:place]), b"".join(runs[level][place + 1 :]))
        yield list(sides)
        for level in range(height):
            ahead = i + width[level]
            if ahead < n:
                stacks[level].push(leaves[ahead])


def levels(count: int, arity: int) -> int:
    """Levels of a tree over so many leaves."""
    n = 0
    while count > 1:
        count, n = -(-count // arity), n + 1
    return n


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows (tree string, ...) with `index` from 0 and `count` in each tree, by `order`; both long.

    Rows are dealt by ranges of (tree, order), counted in their ranges in one pass, and the ranges' counts are summed:
    a tree with all rows is as many tasks as there are ranges. The rows that are equal in order may stand either way.
    """
    keys = [F.col("tree"), *order]
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            codes = b["tree"].dictionary_encode().indices.to_numpy()
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            at = np.arange(b.num_rows) - np.repeat(starts, np.diff(np.r_[starts, b.num_rows]))
            first = b["tree"][0].as_py()
            if first == last:
                at[: starts[1] if len(starts) > 1 else None] += seen
            last, seen = b["tree"][b.num_rows - 1].as_py(), int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(at)], [*b.schema.names, "_range", "_at"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    dealt = written(dealt.mapInArrow(run, f"{schema}, _range int, _at long"), "merkle-ranges")
    sizes = dealt.groupBy("tree", "_range").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy("tree")  # a row for each range
    before = F.sum("_n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    bases = written(sizes.select("tree", "_range", before.alias("_before"), F.sum("_n").over(whole).alias("count")), "merkle-bases")
    return dealt.join(bases, ["tree", "_range"]).withColumn("index", F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")


def _hexes(digests: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [d.hex().encode() for d in digests.to_pylist()]


def _climb(nodes: DataFrame, top: Callable[[DataFrame], DataFrame], arity: int, height: int) -> DataFrame:
    """nodes (tree, index, count, digest binary, ...) with path, subroot and root.

    top: from the trees' roots (tree, index, count, digest) to the same with path, subroot and root.
    """
    block = arity**height
    nodes = written(nodes.withColumn("_block", F.floor(F.col("index") / block).cast("long")), "merkle-nodes")

    def root_of(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("index")
        count = rows["count"][0].as_py()
        high = min(height, levels(count, arity))
        root = bytes.fromhex(block_root(_hexes(rows["digest"]), arity, high).decode())
        return pa.table({"tree": rows["tree"][:1], "index": rows["_block"][:1], "count": pa.array([-(-count // arity**high)], pa.int64()), "digest": pa.array([root], pa.binary())})

    few = nodes.select("tree", "_block", "index", "count", "digest")
    roots = written(few.groupBy("tree", "_block").applyInArrow(root_of, "tree string, index long, count long, digest binary"), "merkle-roots")
    upper = top(roots) if roots.where("count > 1").isEmpty() else _climb(roots, top, arity, height)
    upper = upper.select("tree", F.col("index").alias("_block"), "path", "subroot", "root")

    names = [c for c in nodes.columns if c != "_block"]

    def paths_of(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = rows.sort_by("index")
        high = min(height, levels(rows["count"][0].as_py(), arity))
        shared = [(s["left"].encode(), s["right"].encode()) for s in above["path"][0].as_py()]
        left, right = [], []
        for own in walk(_hexes(rows["digest"]), arity, high):
            for a, b in own + shared:
                left.append(a)
                right.append(b)
        n = rows.num_rows
        steps = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], fields=list(_STEP))
        path = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (high + len(shared))), steps)
        out = rows.select(names).append_column("path", path)
        for c in ("subroot", "root"):
            out = out.append_column(c, pa.array(above[c].to_pylist() * n, pa.string()))
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema if f.name != "_block")
    both = nodes.groupBy("tree", "_block").cogroup(upper.groupBy("tree", "_block"))
    return both.applyInArrow(paths_of, f"{schema}, path {PATH}, subroot string, root string")


def merkle_manifest(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), tree_col: str = "lang", order_col: str = "doc_id", carry: dict[str, Column] | None = None, arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """(order_col, tree_col, index, leaf, path, subroot, root, and the columns of carry) of every row of docs.

    leaf: leaf_digest of the fields. In each tree the leaves ascend by order_col, null first; while a tree has several
    nodes, `arity` that follow each other become the hash of them, the last ones too if they are fewer, even one.
    What is left is the tree's subroot; subroots, by tree_col (null first, by UTF-8 bytes), give the root likewise.
    path: for each level upwards to the root the nodes to the left and to the right of one's own in its run.

    carry: more columns over docs, computed beside the leaf, so rows need not be found again. A null tree is a tree and
    a null field has its own mark; rows equal in all fields are leaves beside each other, and rows of one id with other
    fields stand by their leaves; a very long text is hashed whole, in the JVM. An empty table gives an empty table;
    columns that are not named are not read. What travels is 80 bytes a row, and a path is made where it is used.
    """
    c, carried = F.col, {f"_c{k}": v for k, v in enumerate((carry or {}).values())}
    tree = F.when(c(tree_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), c(tree_col).cast("string")))
    own = docs.select(tree.alias("tree"), c(order_col).alias("_id"), F.unhex(leaf_digest(*map(c, fields))).alias("digest"), F.monotonically_increasing_id().alias("_row"), *[v.alias(k) for k, v in carried.items()])
    # written before they are dealt: texts are hashed once, and rows that are equal in all keep their numbers
    leaves = numbered(written(own, "merkle-leaves"), [c("_id").asc_nulls_first(), c("digest"), c("_row")]).drop("_row")

    def top(subroots: DataFrame) -> DataFrame:
        named = subroots.select(F.lit("").alias("tree"), c("tree").alias("_name"), "digest")
        hexed = F.lower(F.hex("digest"))
        end = lambda d: d.withColumns({"path": F.array().cast(PATH), "subroot": hexed, "root": hexed})
        found = _climb(numbered(named, [c("_name")]), end, arity, height)
        return found.select(c("_name").alias("tree"), F.lit(0).cast("long").alias("index"), "path", hexed.alias("subroot"), "root")

    found = _climb(leaves, top, arity, height)
    named = F.when(c("tree") != "", F.substr("tree", F.lit(2))).cast(docs.schema[tree_col].dataType)
    more = [c(f"_c{k}").alias(name) for k, name in enumerate(carry or {})]
    return found.select(c("_id").alias(order_col), named.alias(tree_col), "index", F.lower(F.hex("digest")).alias("leaf"), "path", "subroot", "root", *more)
