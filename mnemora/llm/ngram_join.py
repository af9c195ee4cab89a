"""N-gram Jaccard join by multiple-global-order filtering.

Documents are sets of word n-grams ("shingles", as 64-bit hashes). Documents with equal sets form a class, which is
compared once. If two sets have a Jaccard similarity of t or more, then under any one order of all shingles the
first n - ceil(t * n) + 1 shingles of each ("prefix") have one in common. The orders used here all begin with the
rarest shingles and differ in how they rank shingles of like rarity; a pair must meet under each of them before its
sets are compared.

Flow: (1) shingles go to buckets by hash, packed, and are counted exactly; rows of documents are dealt by id and text,
so that a class of very many copies has them everywhere; (2) shingles in two classes or more return to their class's
bucket, where prefixes are cut; classes whose prefix holds only shingles of their own can have no partner; (3) in rounds,
every prefix shingle of the first order names a hub among its classes, and its other classes are compared with the hub:
as many pairs as prefix shingles at most, which join most near copies into groups; (4) what is left are pairs of classes
of different groups that share such a shingle, are of similar size, and differ by no more than the threshold allows in
a bitmap that holds, for every class of shingle hashes, whether the set has an odd number of them (each shingle that one
set alone has changes one bit): these are found by an equality join, salted where a shingle has many classes, and each is
compared once. Pairs inside one group, which can add nothing, are never made.
(5) Star joins over the links give the components. A comparison first asks for a common shingle under the second and
third order, and then counts the whole sets' common shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, n_words, partitions, restored, sheltered, written
from .components import connected_components

#: Classes that are compared with one hub in a task.
BLOCK = 512
#: Shingles of the sets in one task of comparisons, on average, and bytes of text whose shingles share a bucket.
BUNDLE, BUCKET_BYTES = 2_000_000, 32 << 20
#: Rounds of hubs at most; they end when the pairs left are no more than PAIRS for each prefix shingle.
ROUNDS, PAIRS = 6, 4
#: Rows of documents whose shingles are in memory at once.
ROWS = 4096
#: Bits of a set's bitmap.
BITMAP = 512
_MIX = (0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix finaliser)."""
    x = x + np.uint64((seed + 1) * _MIX[0] % 2**64)
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of the n-grams of the words of a text, A-Z lower-cased.

    With fewer than n words all of them are one shingle; without words or text there is none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(n, len(words))
    out = h[: len(h) - width + 1]
    for k in range(1, width):
        out = mixed(out) + h[k : len(h) - width + 1 + k]
    return np.unique(mixed(out, width))


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """For each class of shingles whether there is an odd number of them, in BITMAP bits."""
    return np.packbits((np.bincount((tokens & np.uint64(BITMAP - 1)).astype(np.int64), minlength=BITMAP) & 1).astype(np.uint8))


def prefix_length(n: np.ndarray | int, percent: int):
    """How many first shingles of n must meet those of a set that is similar by `percent` of 100 or more."""
    return n - (percent * n + 99) // 100 + 1


def _pack(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values in sorted keys."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return starts, np.diff(np.r_[starts, len(keys)])


#: kind 0: rows of documents (ids and text hashes, n, class, whether the id is known); kind 1: shingles (class, count of its shingles here, shingles[, df]); kind 2: classes (class, n, bitmap).
PACKED = "bucket int, kind int, a binary, b binary, c binary, d binary"
PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in "abcd")])
MEMBERS = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.int64())])


def _read(batches: Iterator[pa.RecordBatch], n: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(s, ROWS) for b in batches for s in range(0, b.num_rows, ROWS)):
        ids, known = batch["id"].fill_null(0).to_numpy(), batch["id"].is_valid().to_numpy(zero_copy_only=False)
        keys = batch["key"].to_numpy()
        sets = [shingles(t, n) for t in batch["text"].to_pylist()]
        size = np.array([len(s) for s in sets], np.int64)
        # the class of a set: a hash of its shingles; 0 for documents without any
        fp = np.array([xxhash.xxh3_64_intdigest(s.tobytes(), len(s)) | 1 if len(s) else 0 for s in sets], np.uint64)
        rows = []
        deal = (mixed(ids.astype(np.uint64) ^ mixed(keys.astype(np.uint64))) % np.uint64(buckets)).astype(np.int64)
        for b in np.unique(deal):
            m = deal == b
            rows.append((int(b), 0, *_pack(np.stack([ids[m], keys[m]]), size[m].astype(np.int32), fp[m], known[m])))
        _, first = np.unique(fp, return_index=True)
        first = first[size[first] > 0]
        if len(first):
            home = (fp[first] % np.uint64(buckets)).astype(np.int64)
            for b in np.unique(home):
                m = first[home == b]
                maps = np.stack([bitmap(sets[i]) for i in m])
                rows.append((int(b), 2, *_pack(fp[m], size[m].astype(np.int32), maps), None))
            tokens = np.concatenate([sets[i] for i in first])
            owner = np.repeat(np.arange(len(first)), size[first])
            to = (tokens >> np.uint64(40)) % np.uint64(buckets)
            order = np.argsort(to.astype(np.uint32), kind="stable")
            tokens, owner, to = tokens[order], owner[order], to[order]
            for s, k in zip(*_grouped(to)):
                at, count = _grouped(owner[s : s + k])
                rows.append((int(to[s]), 1, *_pack(fp[first][owner[s : s + k][at]], count.astype(np.uint32), tokens[s : s + k]), None))
        yield _batch(rows, PACKED_ARROW)
        del sets, rows, batch
        give_back()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _unpack(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle rows as flat arrays: class, shingle, df (1 where not yet counted)."""
    fp = np.frombuffer(b"".join(rows["a"]), np.uint64)
    count = np.frombuffer(b"".join(rows["b"]), np.uint32)
    tokens = np.frombuffer(b"".join(rows["c"]), np.uint64)
    df = np.frombuffer(b"".join(x for x in rows["d"] if x is not None), np.uint32)
    return np.repeat(fp, count), tokens, df


def _count(rows: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Counts the classes of every shingle of a bucket; keeps shingles of two or more, for the classes' buckets."""
    out = [tuple(r) for r in rows[rows["kind"] != 1].itertuples(index=False)]
    part = rows[rows["kind"] == 1]
    if len(part):
        fp, tokens, _ = _unpack(part)
        order = np.lexsort((fp, tokens))
        fp, tokens = fp[order], tokens[order]
        new = np.r_[True, (tokens[1:] != tokens[:-1]) | (fp[1:] != fp[:-1])]  # a class may come from many batches
        fp, tokens = fp[new], tokens[new]
        _, count = _grouped(tokens)
        df = np.repeat(count, count)
        shared = df > 1
        fp, tokens, df = fp[shared], tokens[shared], df[shared]
        to = fp % np.uint64(buckets)
        order = np.lexsort((tokens, fp, to))
        fp, tokens, df, to = fp[order], tokens[order], df[order], to[order]
        for s, k in zip(*_grouped(to)):
            at, count = _grouped(fp[s : s + k])
            out.append((int(to[s]), 1, *_pack(fp[s : s + k][at], count.astype(np.uint32), tokens[s : s + k], df[s : s + k].astype(np.uint32))))
    return pd.DataFrame(out, columns=["bucket", "kind", "a", "b", "c", "d"])


#: Rows of documents pass; every class that may have a partner gives one row.
CLASSES = "kind int, a binary, b binary, c binary, d binary, fp long, n int, own int, bits array<long>, tokens binary, p1 binary, p2 binary, p3 binary"


def _prefixes(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    docs = rows[rows["kind"] == 0]
    out = [(0, r.a, r.b, r.c, r.d, 0, 0, 0, None, None, None, None, None) for r in docs.itertuples()]
    part = rows[rows["kind"] == 1]
    if len(part):
        known = rows[rows["kind"] == 2]
        sizes = dict(zip(np.frombuffer(b"".join(known["a"]), np.uint64).tolist(), zip(np.frombuffer(b"".join(known["b"]), np.int32).tolist(), np.frombuffer(b"".join(known["c"]), np.int64).reshape(-1, BITMAP // 64))))
        fp, tokens, df = _unpack(part)
        order = np.lexsort((tokens, fp))
        fp, tokens, df = fp[order], tokens[order], df[order]
        for s, k in zip(*_grouped(fp)):
            n, bits = sizes[int(fp[s])]
            take = prefix_length(n, percent) - (n - k)  # shingles of its own come first
            if take > 0:
                t, d = tokens[s : s + k], df[s : s + k]
                orders = (np.lexsort((t, d)), np.lexsort((mixed(t, 1), d)), np.lexsort((mixed(t, 2), np.frexp(d)[1])))
                out.append((1, None, None, None, None, int(fp[s].astype(np.int64)), n, n - int(k), bits.tolist(), t.tobytes(), *(t[o[:take]].tobytes() for o in orders)))
    return pd.DataFrame(out, columns=[c.split()[0] for c in CLASSES.split(", ")])


def _common(sets: list[bytes], hub: bytes) -> np.ndarray:
    """How many values of each set the hub's set has."""
    mine, flat = np.sort(np.frombuffer(hub, np.uint64)), np.frombuffer(b"".join(sets), np.uint64)
    hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
    return np.bincount(np.repeat(np.arange(len(sets)), [len(x) // 8 for x in sets]), hit, len(sets)).astype(np.int64)


def _links(hubs: pd.DataFrame, members: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Of the members of each hub those that link with it."""
    own = {(h.hub, h.block): h for h in hubs.itertuples()}
    out = []
    for key, part in members.groupby(["hub", "block"]):
        h, n = own[key], part["n"].to_numpy().astype(np.int64)
        maybe = 100 * np.minimum(n, h.n) >= percent * np.maximum(n, h.n)
        for p in ("p1", "p2", "p3"):  # a pair must meet under each order
            at = np.flatnonzero(maybe)
            if len(at):
                maybe[at] = _common(part[p].iloc[at].tolist(), getattr(h, p)) > 0
        at = np.flatnonzero(maybe)
        if len(at):
            common = _common(part["tokens"].iloc[at].tolist(), h.tokens)
            at = at[100 * common >= percent * (n[at] + h.n - common)]
            out.append(pd.DataFrame({"a": part["fp"].to_numpy()[at], "b": h.hub}))
    return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []}, dtype="int64")


def similar(pairs: DataFrame, classes: DataFrame, percent: int, block: int) -> DataFrame:
    """Of the distinct pairs (hub, fp) of classes those that link, as (a, b).

    The members of a hub are cut into blocks, so a hub of very many has many tasks; small hubs share a task.
    """
    pairs = written(pairs, "join-pairs")
    many = pairs.groupBy("hub").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).toDF("hub", "blocks")
    total = pairs.join(classes.select("fp", "n"), "fp").agg(F.sum("n")).first()[0] or 0
    bundle = F.pmod(F.xxhash64("hub", "block"), F.lit(1 + total // BUNDLE)).alias("bundle")
    sets = classes.select("fp", "n", "tokens", "p1", "p2", "p3")
    members = pairs.join(many, "hub").select("hub", "fp", F.pmod(F.xxhash64("fp"), "blocks").cast("int").alias("block")).join(sets, "fp").select("*", bundle)
    hubs = many.toDF("hub", "blocks").select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(sets.toDF("hub", "n", "tokens", "p1", "p2", "p3"), "hub").select("*", bundle)

    def run(h: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        out = _links(h, m, percent)
        give_back()
        return out

    return written(hubs.groupBy("bundle").cogroup(members.groupBy("bundle")).applyInPandas(run, "a long, b long"), "join-links")


def class_links(classes: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """(node, component) of the classes that links connect. classes: (fp, n, own, bits, tokens, p1, p2, p3)."""

    def posted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = [np.frombuffer(x, np.int64) for x in b["p1"]]
            many = [len(x) for x in p]
            yield pd.DataFrame({"token": np.concatenate(p) if p else [], **{c: np.repeat(b[c].to_numpy(), many) for c in ("fp", "n", "own")}}).astype("int64")

    posts = classes.select("fp", "n", "own", "p1").mapInPandas(posted, "token long, fp long, n long, own long")
    shared = posts.groupBy("token").agg(F.count("*").alias("many")).where("many > 1").select("token")
    posts = written(posts.join(shared, "token"), "join-posts")
    active = written(posts.select("fp").distinct(), "join-active-ids")  # written first, so that Spark knows its size when it plans the join
    classes = written(classes.join(active, "fp", "left_semi"), "join-active")
    links = parts = None
    for turn in range(ROUNDS):
        label = F.col("fp") if parts is None else F.coalesce("component", "fp")
        d = posts if parts is None else posts.join(parts.withColumnRenamed("node", "fp"), "fp", "left")
        d = d.select("token", "fp", "n", "own", label.alias("label"))
        # what a shingle's classes would give in pairs across groups: the square of all less the squares of each
        sizes = d.groupBy("token", "label").agg(F.count("*").cast("double").alias("k")).groupBy("token").agg(F.sum("k").alias("many"), F.sum(F.col("k") * F.col("k")).alias("same"), F.count("*").alias("labels"))
        open_ = written(sizes.where("labels > 1").select("token", "many", ((F.col("many") * F.col("many") - F.col("same")) / 2).alias("across")), "join-open")
        rows, across = open_.agg(F.sum("many"), F.sum("across")).first()
        d = d.join(open_, "token")
        if not rows and parts is not None:
            return parts
        if not rows or (turn and across <= PAIRS * rows):
            break
        # the first hub is the class with the fewest shingles of its own; later ones are drawn
        order = F.struct("own", "fp", "label") if not turn else F.struct(F.xxhash64("fp", F.lit(turn)).alias("own"), "fp", "label")
        hubs = d.groupBy("token").agg(F.min(order).alias("hub")).select("token", F.col("hub.fp").alias("hub"), F.col("hub.label").alias("hub_label"))
        found = similar(d.join(hubs, "token").where("label != hub_label").select("hub", "fp").distinct(), classes, percent, block)
        if found.isEmpty():
            break
        links = found if links is None else links.union(found)
        parts = connected_components(links)
    # pairs across groups: of two sizes within the threshold the larger is in the same or the next band of sizes
    unit = max(math.log(100 / percent) * (1 + 1e-9), 1e-3)
    band = F.floor(F.log("n") / F.lit(unit))
    bits = written(classes.select("fp", "bits"), "join-bits")  # a slim table, whose size Spark knows
    d = d.join(bits, "fp").select("token", "fp", "n", "label", "bits", band.alias("band"), F.ceil(F.col("many") / F.lit(block)).cast("int").alias("salts"))
    a = d.select("token", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"), F.pmod(F.xxhash64("fp"), "salts").cast("int").alias("salt"), F.col("fp").alias("hub"), F.col("n").alias("hub_n"), F.col("label").alias("hub_label"), F.col("bits").alias("hub_bits"))
    b = d.select("token", "band", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "fp", "n", "label", "bits")
    near = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    apart = sum((F.bit_count(F.get("bits", F.lit(i)).bitwiseXOR(F.get("hub_bits", F.lit(i)))) for i in range(BITMAP // 64)), F.lit(0))
    near &= apart * (100 + percent) <= (F.col("n") + F.col("hub_n")) * (100 - percent)  # of shingles that one set alone has
    pairs = a.join(b, ["token", "band", "salt"]).where((F.struct("hub_n", "hub") < F.struct(F.col("n").alias("hub_n"), F.col("fp").alias("hub"))) & (F.col("hub_label") != F.col("label")) & near).select("hub", "fp").distinct()
    found = similar(pairs, classes, percent, block)
    if links is None:
        return connected_components(found)
    return parts if found.isEmpty() else connected_components(links.union(found))


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, buckets: int | None = None) -> DataFrame:
    """(id, n_shingles, class, component_id, component, text_key) for every row of docs; ids are whole numbers.

    Two rows link when 100 * intersection >= percent * union of their sets of n-word shingles; component_id is the
    smallest id that links reach, the row's own included; component is a class that stands for it. Rows with equal sets share a class (a hash of the set);
    text_key is xxhash64 of the text.

    Null and empty texts and texts without words have no shingles, no class and no links: component_id is their own
    id. A text of fewer than n words is one shingle. Null ids take part but give no component its id: a component
    with null ids only has a null id. Rows with the same id and other texts are rows of their own. An empty table
    gives an empty table. Columns besides id and text are not read. Shingles and classes are told apart by 64-bit
    hashes. A very long text is one set. One very common shingle is one run in one bucket, without pairs; a very large
    class is one row.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    k = buckets or max(partitions(spark), size // BUCKET_BYTES)  # the shingles of a bucket are in memory together
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    packed = d.mapInArrow(lambda b: _read(b, n, k), PACKED)

    def count(g: pd.DataFrame) -> pd.DataFrame:
        out = _count(g, k)
        give_back()
        return out

    counted = packed.groupBy("bucket").applyInPandas(count, PACKED)

    def cut(g: pd.DataFrame) -> pd.DataFrame:
        out = _prefixes(g, percent)
        give_back()
        return out

    both = written(counted.groupBy("bucket").applyInPandas(cut, CLASSES), "join-classes")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, keys = np.frombuffer(r["a"], np.int64).reshape(2, -1)
                n, fp = np.frombuffer(r["b"], np.int32), np.frombuffer(r["c"], np.uint64).astype(np.int64)
                own = [pa.array(ids, mask=~np.frombuffer(r["d"], bool)), pa.array(keys), pa.array(n.astype(np.int64)), pa.array(fp, mask=fp == 0)]
                yield pa.RecordBatch.from_arrays(own, schema=MEMBERS)

    members = both.where("kind = 0").select("a", "b", "c", "d").mapInArrow(rows, "id long, key long, n_shingles long, class long")
    classes = both.where("kind = 1").select("fp", "n", "own", "bits", "tokens", "p1", "p2", "p3")
    linked = class_links(classes, percent, block)
    # by class, of which a very large one is one row: its component, and the smallest id in that
    own = members.where("class is not null").groupBy("class").agg(F.min("id").alias("_own"))
    own = own.join(linked.withColumnRenamed("node", "class"), "class", "left").select("class", "_own", F.coalesce("component", "class").alias("component"))
    own = written(own, "join-components")
    lowest = own.groupBy("component").agg(F.min("_own").alias("_low"))
    known = own.select("class", "component").join(lowest, "component")
    out = members.join(known, "class", "left")  # a skewed side that Spark can split
    component_id = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("_low"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "class", component_id.alias("component_id"), "component", F.col("key").alias("text_key"))


def first_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near copies: of each component the row with the smallest id stays, with all its columns.

    Rows without words all stay. Of several rows with that id, and of rows with null ids only, the one with the
    smallest text hash stays, and one alone of rows that are equal.
    """
    found = jaccard_components(docs, n, percent, id_col, text_col)
    first = F.min(F.struct(F.col(id_col).isNull(), F.col(id_col), F.col("text_key"))).alias("_first")
    kept = found.where("component is not null").groupBy("component").agg(first)
    kept = kept.select(F.col(f"_first.{id_col}").alias("_id"), F.col("_first.text_key").alias("_key"))
    single = found.where("component is null").select(F.col(id_col).alias("_id"), F.col("text_key").alias("_key")).distinct()
    kept = kept.union(single)
    d, (doc_id, text) = sheltered(docs, id_col, text_col)
    keyed = d.withColumn("_text_key", F.xxhash64(text))
    stay = keyed.join(kept, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left_semi")
    copy = F.row_number().over(Window.partitionBy(doc_id, "_text_key").orderBy(F.lit(1)))
    once = stay.withColumn("_copy", F.when(n_words(F.col(text)) > 0, copy).otherwise(1)).where("_copy = 1")
    return restored(once, docs.columns, {})
