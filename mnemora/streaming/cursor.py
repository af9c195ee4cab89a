"""Episodes from a timeline behind cursors: what is done is committed once; what fails stays, and is tried again.

A consumer works in rounds. A round takes the rows that the last one left and new ones, cuts each key's rows into sessions,
works on those that are closed, and commits up to each key's first session that is not done. All that a round writes lies
in folders named by its number, its commit last: a round that is lost on the way is overwritten by the next one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from mnemora.operators.windows import sessions_by_gap_and_span
from mnemora.storage import existing

#: What is known of a session before it is worked on.
SESSION = ("session", "start_id", "last_id", "start_ts", "end_ts", "messages", "user_messages")
COMMIT = "round long, batch long, clock long, closed long, created long, dropped long, failed long, waiting long"
Work = Callable[[DataFrame], DataFrame]


def always_done(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, "session").distinct().withColumn("ok", F.lit(True))


class Consumer:
    """Rounds over messages (key, id, ts, role, and more), with one writer at a time.

    at: a folder that the driver and all executors share. work: rows of sessions, with `session`, to one row (key, session,
    ok, and more) a session; a session without a row, or whose ok is not true, has failed, and stops its key. An error in
    work ends the round, and nothing of it counts. Work may be done more than once; each session is committed once.

    A session ends after `gap` seconds of silence or `span` seconds after its start. It is closed when another one of its
    key follows, or the clock (the newest time of all rows so far) is more than `gap` past it. Sessions with fewer messages
    of users than `least` are passed over. Of each key, `most` sessions are worked on in a round (None: all).

    Ids grow in order of arrival: a new row that is not past its key's cursor came before, and is left out, as is a row
    that is there already. Rows with a null key are one key. Rows whose id or time is null take no part.
    """

    def __init__(self, spark: SparkSession, at: str, key: str, gap: int, span: int, work: Work | None = None, least: int = 4, most: int | None = None):
        self.spark, self.at, self.key, self.gap, self.span, self.least, self.most = spark, at.rstrip("/"), key, gap, span, least, most
        self.work = work or (lambda rows: always_done(rows, key))

    def _read(self, name: str) -> DataFrame | None:
        return existing(self.spark, f"{self.at}/{name}")

    def _kept(self, df: DataFrame, name: str, number: int) -> DataFrame:
        path = f"{self.at}/{name}-{number}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def commits(self) -> DataFrame:
        """COMMIT, a row a round."""
        found = self._read("commits/*")
        return self.spark.createDataFrame([], COMMIT) if found is None else found

    def last(self) -> Any:
        """The last committed round, with the newest batch and clock of all; None before the first."""
        d = self.commits().agg(F.max("round").alias("round"), F.max("batch").alias("batch"), F.max("clock").alias("clock")).first()
        return None if d["round"] is None else d

    def cursors(self) -> DataFrame | None:
        """(key, cursor): the last id that is done; None before the first round."""
        last = self.last()
        return None if last is None else self._read(f"cursors-{last['round']}")

    def left(self) -> DataFrame | None:
        """The rows that wait: what is not closed, and each key's rows from its first session that is not done."""
        last = self.last()
        return None if last is None else self._read(f"left-{last['round']}")

    def done(self) -> DataFrame | None:
        """What work gave for the sessions that are committed, with SESSION's times, ids and counts and the round."""
        rounds = [r["round"] for r in self.commits().select("round").collect()]  # a row a round
        if not rounds:
            return None
        return self.spark.read.parquet(*[f"{self.at}/done-{n}" for n in rounds])

    def idle(self, now: int, seconds: int) -> DataFrame | None:
        """(key, newest): keys with rows that wait, the newest `seconds` old or more."""
        left = self.left()
        return None if left is None else left.groupBy(self.key).agg(F.max("ts").alias("newest")).where(F.lit(now) - F.col("newest") >= seconds)

    def _same(self, a: str, b: str) -> Column:
        return F.col(a).eqNullSafe(F.col(b))

    def _fresh(self, rows: DataFrame | None) -> DataFrame | None:
        """New rows past their keys' cursors, with those that were left; each id of a key once."""
        left, cursors = self.left(), self.cursors()
        if rows is not None:
            rows = rows.where("id is not null and ts is not null")
            if cursors is not None:
                seen = cursors.select(F.col(self.key).alias("_key"), "cursor")
                rows = rows.join(seen, self._same(self.key, "_key"), "left").where(F.coalesce(F.col("id") > F.col("cursor"), F.lit(True))).drop("_key", "cursor")
        both = left if rows is None else rows if left is None else left.unionByName(rows, allowMissingColumns=True)
        return None if both is None else both.dropDuplicates([self.key, "id"])

    def step(self, rows: DataFrame | None = None, batch: int | None = None, force: bool | DataFrame = False) -> Any:
        """One round over new rows (None: only what was left), and its commit; None where there is nothing to do.

        batch: the number of a micro-batch; one that is committed already does nothing. force: whether all sessions are
        closed, or a table of the keys whose sessions are.
        """
        last = self.last()
        if batch is not None and last is not None and last["batch"] is not None and batch <= last["batch"]:
            return None
        fresh = self._fresh(rows)
        if fresh is None:
            return None
        key, n = self.key, 0 if last is None else last["round"] + 1
        cut = self._kept(sessions_by_gap_and_span(fresh, [key], self.gap, self.span), "rows", n)
        newest = cut.agg(F.max("ts")).first()[0]
        clock = max((t for t in (newest, last and last["clock"]) if t is not None), default=None)
        sessions = self._kept(self._states(cut, clock, force), "sessions", n)
        due = sessions.where("due").select(F.col(key).alias("_key"), F.col("session").alias("_session"))
        results = self._kept(self.work(cut.join(due, self._same(key, "_key") & (F.col("session") == F.col("_session")), "left_semi")), "results", n)
        ok = results.select(F.col(key).alias("_key"), F.col("session").alias("_session"), "ok")
        told = sessions.join(ok, self._same(key, "_key") & (F.col("session") == F.col("_session")), "left").drop("_key", "_session")
        stops = ~F.col("closed") | F.col("over") | (F.col("due") & ~F.coalesce("ok", F.lit(False)))
        stop = F.min(F.when(stops, F.col("session"))).over(Window.partitionBy(key))
        told = self._kept(told.withColumn("committed", F.coalesce(F.col("session") < stop, F.lit(True))), "told", n)
        self._kept(self._finished(results, told, n), "done", n)
        waits = told.where("not committed").select(F.col(key).alias("_key"), F.col("session").alias("_session"))
        self._kept(cut.join(waits, self._same(key, "_key") & (F.col("session") == F.col("_session")), "left_semi").drop("session"), "left", n)
        self._kept(self._moved(told), "cursors", n)
        count = lambda c: F.count_if(c)
        c = F.col
        row = told.agg(
            F.lit(n).cast("long").alias("round"), F.lit(batch).cast("long").alias("batch"), F.lit(clock).cast("long").alias("clock"), count(c("closed")).alias("closed"), count(c("committed") & c("due")).alias("created"),
            count(c("committed") & ~c("due")).alias("dropped"), count(c("due") & ~F.coalesce("ok", F.lit(False))).alias("failed"), count(~c("committed")).alias("waiting"),
        )
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.at}/commits/{n}")
        return self.spark.read.parquet(f"{self.at}/commits/{n}").first()

    def _states(self, cut: DataFrame, clock: int | None, force: bool | DataFrame) -> DataFrame:
        """A row a session: SESSION, and whether it is closed, due in this round, or over what a round does."""
        key, c = self.key, F.col
        at = F.struct("ts", "id")
        g = cut.groupBy(key, "session").agg(
            F.min(at)["id"].alias("start_id"), F.max("id").alias("last_id"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("messages"), F.count_if(c("role") == "user").alias("user_messages"),
        )
        closed = (c("session") < F.max("session").over(Window.partitionBy(key))) | (F.lit(clock) - c("end_ts") > self.gap)
        if isinstance(force, DataFrame):
            g = g.join(force.select(c(key).alias("_key"), F.lit(True).alias("_forced")).distinct(), self._same(key, "_key"), "left").drop("_key")
            closed = closed | F.coalesce("_forced", F.lit(False))
        elif force:
            closed = F.lit(True)
        d = g.withColumn("closed", closed).withColumn("_worth", c("closed") & (c("user_messages") >= self.least))
        place = F.count_if("_worth").over(Window.partitionBy(key).orderBy("session"))
        over = c("_worth") & (place > self.most) if self.most is not None else F.lit(False)
        d = d.withColumn("over", over).withColumn("due", c("_worth") & ~c("over"))
        return d.select(key, *SESSION, "closed", "over", "due")

    def _finished(self, results: DataFrame, told: DataFrame, n: int) -> DataFrame:
        more = told.where("committed and due").select(F.col(self.key).alias("_key"), *[F.col(x).alias(f"_{x}") for x in SESSION])
        met = results.join(more, self._same(self.key, "_key") & (F.col("session") == F.col("_session")))
        own = {x: F.col(f"_{x}") for x in SESSION if x != "session"}
        return met.withColumns(own | {"round": F.lit(n).cast("long")}).drop("session", "ok", "_key", *[f"_{x}" for x in SESSION])

    def _moved(self, told: DataFrame) -> DataFrame:
        new = told.where("committed").select(self.key, F.col("last_id").alias("cursor"))
        old = self.cursors()
        return (new if old is None else new.unionByName(old)).groupBy(self.key).agg(F.max("cursor").alias("cursor"))

    def follow(self, stream: DataFrame, **trigger: Any) -> StreamingQuery:
        """Starts a stream whose micro-batches are rounds; started again, it goes on after the last committed one."""
        out = stream.writeStream.option("checkpointLocation", f"{self.at}/state").trigger(**(trigger or {"availableNow": True}))
        return out.foreachBatch(lambda rows, number: self.step(rows, number)).start()


class Idle(StatefulProcessor):
    """When a key last spoke; a timer of the wall clock tells that it has been silent since."""

    OUT = "key string, newest long, waiting long"

    def __init__(self, seconds: float):
        self.wait = int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "newest long, waiting long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        newest, waiting = self.held.get() if self.held.exists() else (None, 0)
        for batch in rows:
            top = int(batch["ts"].max())
            newest, waiting = top if newest is None else max(newest, top), waiting + len(batch)
        self.held.update((newest, waiting))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)
        yield pd.DataFrame([], columns=["key", "newest", "waiting"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            held = self.held.get()
            self.held.clear()
            yield pd.DataFrame([(key[0], *held)], columns=["key", "newest", "waiting"])

    def close(self) -> None:
        pass


def idle_keys(messages: DataFrame, key: str, seconds: float = 300) -> DataFrame:
    """(key, newest, waiting) of a stream (ts in seconds): keys that said nothing for `seconds` of the wall clock, with the time
    of their newest message and how many came since they were told of last. State needs the RocksDB provider."""
    d = messages.select(F.col(key).cast("string").alias("key"), F.col("ts").cast("long").alias("ts")).where("ts is not null")
    return d.groupBy("key").transformWithStateInPandas(Idle(seconds), Idle.OUT, "Append", "ProcessingTime")
