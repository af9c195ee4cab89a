import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from mnemora.llm.sharding import histogram_shards


def check(spark, placed, rows, shards, slack):
    got = placed.select("doc_id", "text", "size", "shard", "slot").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got) == sorted((i is None, i or 0, t or "") for i, t in rows)
    by = defaultdict(list)
    for r in got:
        assert r.size == len((r.text or "").encode()) + 16
        by[r.shard].append(r)
    assert set(by) <= set(range(shards))
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    sums = [sum(r.size for r in by[k]) for k in range(shards)]
    share, largest = sum(sums) / shards, max(len((t or "").encode()) + 16 for _, t in rows)
    assert max(abs(s - share) for s in sums) <= slack * share + largest
    return by


def test_odd_rows_all_land_once(spark, docs, rows):
    check(spark, histogram_shards(docs, shards=4), [(i, t) for i, t, _ in rows], 4, 0.02)


def test_shards_are_near_equal_and_copies_lie_together(spark):
    r = random.Random(1)
    rows = [(i, "x" * r.randrange(200) + str(r.randrange(500))) for i in range(4000)]
    by = check(spark, histogram_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards=10, part_bytes=20_000), rows, 10, 0.02)
    homes = defaultdict(set)
    for k, rs in by.items():
        for x in rs:
            homes[x.text].add(k)
    assert sum(len(h) > 1 for h in homes.values()) <= 9  # at most one text is cut at each splitter


def test_a_text_of_a_third_of_all_rows_is_split(spark):
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    by = check(spark, histogram_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards=10), rows, 10, 0.02)
    assert sum(any(x.text == "hot text" for x in rs) for rs in by.values()) >= 3


def test_equal_rows_and_empty_tables(spark, empty):
    same = [(1, "same")] * 500
    check(spark, histogram_shards(spark.createDataFrame(same, "doc_id long, text string"), shards=1), same, 1, 0)
    out = histogram_shards(empty)
    assert out.count() == 0 and {"size", "shard", "slot", "source"} <= set(out.columns)


def test_checksum_is_that_of_utf8(spark):
    d = spark.createDataFrame([("é漢",)], ["t"]).select(F.crc32(F.col("t").cast("binary")).alias("c"))
    assert d.first().c == zlib.crc32("é漢".encode())
