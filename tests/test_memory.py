"""What turns show against a plain loop over all that was shown, in batch and as a stream; and after the read path."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mnemora.operators import memory, requests
from mnemora.plans.requests import AS_OF, asked
from mnemora.sources.tables import memory_facts
from mnemora.streaming import decisions, jobs

SHAPE = "window_tag string, turn_id long, ts long, place int, fact_id long, kind string, always boolean"
DATA = "/root/testdata/sf0.001"


def turns(seed, n=300):
    r = random.Random(seed)
    out = []
    for i in range(n):
        w, ts = "hot" if i % 3 == 0 else f"w{r.randrange(4)}", r.randrange(4000)
        for place, f in enumerate(r.sample(range(25), r.randrange(1, 9))):
            out.append((w, i, ts, place, f, ("core", "related", "uncertain")[f % 3], r.random() < 0.1))
    return out


def loop(rows, window, places):
    by, log, out = {}, [], set()
    for r in rows:
        by.setdefault((r[0], r[2], r[1]), []).append(r)
    for (w, ts, i), found in sorted(by.items()):
        used = dict.fromkeys(places, 0)
        shown = []
        for _, _, _, _, f, kind, always in sorted(found, key=lambda r: r[3]):
            if not always and any(x == w and y == f and ts - t <= window for x, y, t in log):
                continue
            kind = "related" if kind == "core" and used["core"] == places["core"] else kind
            if used[kind] < places[kind]:
                used[kind] += 1
                shown.append((w, i, ts, kind, used[kind], f))
        log += [(w, f, ts) for *_, f in shown]
        out |= set(shown)
    return out


@pytest.mark.parametrize("seed,window,places", [(0, 600, memory.PLACES), (1, 100, {"core": 1, "related": 1, "uncertain": 1}), (2, 0, {"core": 2, "related": 0, "uncertain": 1})])
def test_turns_equal_a_loop(spark, seed, window, places):
    rows = turns(seed)
    got = memory.remembered(spark.createDataFrame(rows, SHAPE).repartition(5), window, places)
    assert {tuple(r) for r in got.collect()} == loop(rows, window, places)


def test_a_turn_over_two_batches(spark):
    rows = turns(3, 60)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert {tuple(r) for r in memory.remembered(spark.createDataFrame(rows, SHAPE), 600).collect()} == loop(rows, 600, memory.PLACES)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_stream_equals_the_loop(spark, tmp_path):
    rows = sorted(turns(4), key=lambda r: (r[2], r[1], r[3]))
    cut = [k for k in range(1, len(rows)) if rows[k][1] != rows[k - 1][1]]
    for a, b in ((0, cut[99]), (cut[99], cut[199]), (cut[199], len(rows))):
        spark.createDataFrame(rows[a:b], SHAPE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/t")
    stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/t")
    got = jobs.drained(decisions.remembered(stream, 600), "append")
    assert {tuple(r) for r in got.collect()} == loop(rows, 600, memory.PLACES)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_the_same_requests_again_show_other_facts(spark):
    """Six requests, then the same a minute and an hour later: a minute later only what may be said again is shown."""
    found = requests.bundles(asked(spark), memory_facts(spark, DATA), AS_OF).cache()
    asks = asked(spark).select("request_id", "window_tag", F.explode(F.array(*map(F.lit, (0, 60, 3700)))).alias("ts"))
    rows = memory.as_candidates(found, asks).withColumn("turn_id", F.col("turn_id") * 10000 + F.col("ts"))
    shown = {}
    for r in memory.remembered(rows.withColumn("window_tag", F.col("turn_id").cast("string").substr(1, 1))).collect():
        shown.setdefault(r.turn_id % 10000, set()).add((r.window_tag, r.fact_id))
    again = {(str(r.request_id), r.id) for r in found.collect() if r.pinned or r.matched or r.route not in ("long_term", "current_status", "history")}
    assert shown[0] == shown[3700] and shown.get(60, set()) == shown[0] & again and shown[0] - again
