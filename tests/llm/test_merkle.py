import hashlib
from collections import defaultdict

import pytest
from conftest import documents, frame
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemora.llm.merkle import block_root, folded_root, leaf_digest, levels, merkle_manifest, path_digest, walk

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(*xs):
    return hashlib.sha256("".join(xs).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[f] for f in FIELDS)])


def tree(leaves, arity):
    """All levels, and each leaf's siblings."""
    levels_ = [leaves]
    while len(levels_[-1]) > 1:
        d = levels_[-1]
        levels_.append([sha(*d[i : i + arity]) for i in range(0, len(d), arity)])
    paths = []
    for i in range(len(leaves)):
        path = []
        for d in levels_[:-1]:
            start = i // arity * arity
            path.append(("".join(d[start:i]), "".join(d[i + 1 : start + arity])))
            i //= arity
        paths.append(path)
    return levels_[-1][0], paths


def brute(rows, arity=8):
    """(doc_id, leaf, path, subroot, root) of every row."""
    by = defaultdict(list)
    for r in rows:
        by[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: tree([x[2] for x in sorted(by[k])], arity) for k in names}
    root, tops = tree([trees[k][0] for k in names], arity)
    return [(i if known else None, h, tuple(p + tops[n]), trees[k][0], root) for n, k in enumerate(names) for (known, i, h), p in zip(sorted(by[k]), trees[k][1])]


def got(found):
    return [(r.doc_id, r.leaf, tuple((s.left, s.right) for s in r.path), r.subroot, r.root) for r in found.collect()]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(2, 9))
def test_a_walk_gives_every_path(n, arity):
    leaves = [sha(str(i)) for i in range(n)]
    root, paths = tree(leaves, arity)
    raw = [x.encode() for x in leaves]
    high = levels(n, arity)
    assert block_root(raw, arity, high).decode() == root
    assert [[(a.decode(), b.decode()) for a, b in p] for p in walk(raw, arity, high)] == paths


@pytest.mark.parametrize("arity,height", [(8, 4), (3, 2)])
def test_every_odd_row(spark, docs, rows, arity, height):
    """Null ids, texts and trees, equal rows, one id with several texts; several layers of blocks, and as many trees."""
    d = docs.withColumn("lang", F.when(F.col("doc_id") % 4 == 0, None).when(F.col("doc_id") % 4 == 1, "").when(F.col("doc_id") % 50 == 2, F.concat(F.lit("é"), F.col("doc_id"))).otherwise("en"))
    want = brute([r.asDict() for r in d.collect()], arity)
    found = merkle_manifest(d, arity=arity, height=height)
    assert sorted(got(found), key=repr) == sorted(want, key=repr)
    shown = found.select("path", "root", "leaf", folded_root(F.col("leaf"), F.col("path")).alias("again"), folded_root(F.lit("x"), F.col("path")).alias("other"), path_digest(F.col("path")).alias("proof")).collect()
    assert all(r.again == r.root != r.other and r.proof == sha(*[s.left + s.right for s in r.path]) for r in shown)


def test_one_tree_holds_nearly_all_and_rows_are_equal(spark):
    """A tree with all rows but one is dealt over all ranges; a third of the rows are one row."""
    rows = [(i if i % 3 else 7, "t" if i % 3 == 0 else f"t{i}", "en" if i else "fr", "s", 1) for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = merkle_manifest(d, height=2)
    assert sorted(got(found), key=repr) == sorted(brute([r.asDict() for r in d.collect()]), key=repr)


def test_empty_single_and_carried(spark, docs, empty):
    assert merkle_manifest(empty).collect() == []
    one = merkle_manifest(docs.where("doc_id = 900"), carry={"changed": F.lit("x"), "path_": F.col("size")}).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root and one[0].path == [] and (one[0].changed, one[0].path_) == ("x", "x")
    clash = frame(spark, documents(n=5)).withColumn("tree", F.lit(1)).withColumn("digest", F.lit(2)).withColumn("index", F.lit(3))
    assert merkle_manifest(clash).count() == clash.count()


def test_leaf_digest_marks_nulls(spark):
    r = spark.sql("select 12L a, cast(null as string) b, 'é' c").select(leaf_digest(F.col("a"), F.col("b"), F.col("c")).alias("h")).first()
    assert r.h == sha("2:12", "-", "2:é")
