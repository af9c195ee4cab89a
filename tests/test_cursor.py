"""Rounds behind cursors against one run over all rows: failures, limits, streams that are stopped, replays, silence."""

import random
import time

import pytest
from pyspark.sql import functions as F

from mnemora.streaming.cursor import Consumer, idle_keys

SHAPE = "w string, id long, ts long, role string"
GAP, SPAN = 50, 300


def messages(seed, n=400):
    """A hot key with a third of all rows, four others, a null one; ids in order of time."""
    r, t, out = random.Random(seed), 0, []
    for i in range(n):
        t += r.choice((1, 3, 10, 60))
        w = "hot" if i % 3 == 0 else r.choice(("a", "b", "c", "d", None))
        out.append((w, i, t, r.choice(("user", "user", "assistant"))))
    return out


def sessions(rows, least=2):
    """(key, first id, last id, messages) of each session with enough messages of users, by a plain loop."""
    held, out = {}, []
    for w, i, t, role in sorted(rows, key=lambda r: (r[2], r[1])):
        s = held.get(w)
        if s and (t - s[-1][1] > GAP or t - s[0][1] > SPAN):
            out.append((w, s))
            s = None
        held[w] = [*(s or []), (i, t, role)]
    out += held.items()
    return sorted((str(w), s[0][0], max(x[0] for x in s), len(s)) for w, s in out if sum(x[2] == "user" for x in s) >= least)


def result(c):
    return sorted((str(r.w), r.start_id, r.last_id, r.messages) for r in c.done().collect())


def parts(spark, rows, k):
    size = -(-len(rows) // k)
    return [spark.createDataFrame(rows[i : i + size], SHAPE) for i in range(0, len(rows), size)]


@pytest.mark.parametrize("seed,k", [(0, 1), (1, 3)])
def test_rounds_equal_one_run(spark, tmp_path, seed, k):
    rows = messages(seed)
    c = Consumer(spark, f"file://{tmp_path}", "w", GAP, SPAN, least=2)
    for p in parts(spark, rows, k):
        c.step(p)
    before = result(c)
    assert set(before) <= set(sessions(rows)) and (k == 1 or c.left().count() > 0)
    end = c.step(force=True)
    assert result(c) == sessions(rows) and end.waiting == 0 and c.left().count() == 0
    assert {(r.w, r.cursor) for r in c.cursors().collect()} == {(w, max(i for x, i, *_ in rows if x == w)) for w in {r[0] for r in rows}}


def test_a_failure_stops_its_key_and_no_other(spark, tmp_path):
    rows, failing = messages(2), [True]

    def work(d):
        g = d.groupBy("w", "session").agg(F.min("id").alias("first"))
        bad = F.coalesce((F.col("w") == "hot") & (F.col("first") > 60), F.lit(False)) & F.lit(failing[0])
        return g.where(~(bad & (F.col("first") % 2 == 0))).select("w", "session", (~bad).alias("ok"))  # no row is a failure too

    c = Consumer(spark, f"file://{tmp_path}", "w", GAP, SPAN, work, least=2)
    one = c.step(spark.createDataFrame(rows, SHAPE), force=True)
    whole = sessions(rows)
    first = min(s[1] for s in whole if s[0] == "hot" and s[1] > 60)
    assert one.failed > 0 and result(c) == [s for s in whole if s[0] != "hot" or s[1] < first]
    assert {r.w for r in c.left().collect()} == {"hot"} and min(r.id for r in c.left().collect()) <= first
    again = c.step(spark.createDataFrame(rows, SHAPE), force=True)  # all rows come once more
    assert result(c) == [s for s in whole if s[0] != "hot" or s[1] < first] and again.created == 0
    failing[0] = False
    c.step(force=True)
    assert result(c) == whole


def test_a_round_does_so_many_sessions_of_a_key(spark, tmp_path):
    rows = messages(3, 60)
    c = Consumer(spark, f"file://{tmp_path}", "w", GAP, SPAN, least=2, most=1)
    c.step(spark.createDataFrame(rows, SHAPE), force=True)
    firsts = {}
    for s in sessions(rows):
        firsts.setdefault(s[0], s)
    assert result(c) == sorted(firsts.values())
    for _ in range(30):
        if c.step(force=True).waiting == 0:
            break
    assert result(c) == sessions(rows)


def test_a_stream_stopped_on_the_way_equals_one_run(spark, tmp_path):
    rows, lost = messages(4), [2]
    inbox, at = tmp_path / "inbox", f"file://{tmp_path}/c"
    for n, p in enumerate(parts(spark, rows, 3)):
        p.coalesce(1).write.mode("append").parquet(str(inbox))
        time.sleep(0.02)

    def work(d):
        lost[0] -= 1
        if lost[0] == 0:
            raise RuntimeError("lost")
        return d.select("w", "session").distinct().withColumn("ok", F.lit(True))

    def run():
        stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(str(inbox))
        Consumer(spark, at, "w", GAP, SPAN, work, least=2).follow(stream).awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run()
    c = Consumer(spark, at, "w", GAP, SPAN, work, least=2)
    assert c.last()["batch"] == 0  # the second was not committed
    run()
    assert c.last()["batch"] == 2 and c.step(spark.createDataFrame(rows, SHAPE), batch=2) is None
    c.step(force=True)
    assert result(c) == sessions(rows)


def test_nothing_and_nulls(spark, tmp_path):
    c = Consumer(spark, f"file://{tmp_path}", "w", GAP, SPAN, least=1)
    assert c.step() is None and c.done() is None and c.left() is None and c.idle(0, 1) is None
    assert c.step(spark.createDataFrame([], SHAPE)).closed == 0
    rows = [("a", None, 1, "user"), ("a", 1, None, "user"), (None, 2, 5, "user"), (None, 2, 5, "user"), ("a", 3, 5, None)]
    c.step(spark.createDataFrame(rows, SHAPE), force=True)
    assert result(c) == [("None", 2, 2, 1)]


def test_silent_keys_are_closed_by_name(spark, tmp_path):
    c = Consumer(spark, f"file://{tmp_path}", "w", GAP, SPAN, least=1)
    c.step(spark.createDataFrame([("a", 1, 100, "user"), ("b", 2, 120, "user")], SHAPE))
    assert result(c) == [] and [r.w for r in c.idle(140, 40).collect()] == ["a"]
    c.step(force=c.idle(140, 40))
    assert result(c) == [("a", 1, 1, 1)] and [r.w for r in c.left().collect()] == ["b"]


def test_a_timer_of_the_wall_clock_tells_of_silence(spark, tmp_path):
    inbox = tmp_path / "inbox"
    spark.createDataFrame([("a", 1, 100, "user"), ("a", 2, 130, "user"), ("b", 3, 120, "user")], SHAPE).coalesce(1).write.parquet(str(inbox))
    told = idle_keys(spark.readStream.schema(SHAPE).parquet(str(inbox)), "w", 1)
    q = told.writeStream.outputMode("append").format("memory").queryName("silent").option("checkpointLocation", f"{tmp_path}/s").trigger(processingTime="500 milliseconds").start()
    try:
        end = time.time() + 60
        while time.time() < end and spark.table("silent").count() < 2:
            time.sleep(0.5)
        assert sorted(tuple(r) for r in spark.table("silent").collect()) == [("a", 130, 2), ("b", 120, 1)]
    finally:
        q.stop()
