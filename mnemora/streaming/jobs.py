"""Streams over the message tables: the batch functions on unbounded input, with watermarks and state.

Each job maps a streaming frame to a streaming frame; `drained` runs one over what is there now and returns the
sink's table, so that a job can be queried and compared with its batch twin.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mnemora.functions.text import terms
from mnemora.storage import shared_dir


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files. A stream reads a folder: the table's own, or that of its one file."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    single = any(f.endswith(f"/{name}.parquet") for f in table.inputFiles())
    source = spark.readStream.schema(table.schema)
    return source.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if single else source.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, with their times as UTC, whatever the session's zone."""
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return stream_of(spark, sf_dir, "events").withColumn("ts", F.timestamp_micros(micros))


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream until its present input is used up, and returns what the sink holds.

    append goes to a Parquet sink. In update each batch has a folder named by its number, in complete all batches have
    one: it is overwritten, so a batch that runs again changes nothing. In update a key has a row for each batch.
    """
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/mnemora/stream-{uuid.uuid4().hex}"
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    if mode == "append":
        out.format("parquet").start(f"{at}/rows").awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/rows")

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/{'all' if mode == 'complete' else f'batch-{number}'}")

    out.foreachBatch(replace).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows/*")


def deduplicated(rows: DataFrame, keys: list[str], within: str = "10 minutes") -> DataFrame:
    """The first of the rows that are equal in keys and come within the watermark; state older than that goes."""
    return rows.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def closed_sessions(rows: DataFrame, key: str, gap_seconds: int, late: str = "0 seconds") -> DataFrame:
    """Sessions of each key that silence has closed: a row exactly gap_seconds after the last still belongs to it."""
    window = F.session_window("ts", f"{gap_seconds * 1000 + 1} milliseconds")
    d = rows.withWatermark("ts", late).groupBy(key, window.alias("w")).agg(F.count("*").alias("messages"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    return d.select(key, "messages", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("end_ts").alias("end_us"))


def over_limit(rows: DataFrame, key: str, limit: int, window: str = "1 minute") -> DataFrame:
    """Tumbling windows in which a key had more than `limit` rows."""
    d = rows.withWatermark("ts", "0 seconds").groupBy(key, F.window("ts", window).alias("w")).agg(F.count("*").alias("n"))
    return d.where(F.col("n") > limit).select(key, F.unix_seconds("w.start").alias("minute"), "n")


def running_term_counts(rows: DataFrame, text_col: str = "text") -> DataFrame:
    return rows.select(F.explode(terms(F.lower(text_col))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


#: Rows of a key that are worked on, and given, at once.
STEP = 8192


def in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """A key's rows of one batch in order, STEP at a time, with times as microseconds.

    Until all have come they are held as numbers, texts as numbers of their different values: some bytes a column.
    """
    held: dict[str, list[np.ndarray]] = {}
    values: dict[str, dict[Any, int]] = {}
    for piece in rows:
        for c in piece.columns:
            x = piece[c]
            if pd.api.types.is_datetime64_any_dtype(x.dtype):
                x = pd.DatetimeIndex(x).as_unit("us").asi8
            elif not isinstance(x.dtype, np.dtype) or x.dtype == object:
                known = values.setdefault(c, {})
                x = np.fromiter((known.setdefault(None if v is None or v is pd.NA or v != v else v, len(known)) for v in x), np.int32, len(x))
            held.setdefault(c, []).append(np.asarray(x))
    if not held:
        return
    columns = {c: np.concatenate(held.pop(c)) for c in list(held)}
    order = np.lexsort([columns[c] for c in reversed(by)])
    texts = {c: np.array([*known, None], object)[:-1] for c, known in values.items()}
    for lo in range(0, len(order), STEP):
        at = order[lo : lo + STEP]
        yield pd.DataFrame({c: texts[c][x[at]] if c in texts else x[at] for c, x in columns.items()})


class Debounce(StatefulProcessor):
    """Joins what a key says in quick succession: until `gap` seconds pass, `span` from the first, or `most` rows.

    The held rows are one value of state; an event-time timer flushes them when nothing more comes.
    """

    OUT = "key string, first_us long, last_us long, fragments int, merged string"

    def __init__(self, gap: float, span: float, most: int):
        self.gap, self.span, self.most = int(gap * 1e6), int(span * 1e6), most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "first_us long, last_us long, fragments int, merged string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = self.held.exists()
        held = self.held.get() if before else None
        for batch in in_order(rows, ["ts", "id"]):
            out = []
            for at, piece in zip(batch["ts"].tolist(), batch["piece"].tolist()):
                if held and (at - held[1] > self.gap or at - held[0] > self.span or held[2] >= self.most):
                    out.append((key[0], *held))
                    held = None
                held = (held[0], at, held[2] + 1, f"{held[3]} {piece}") if held else (at, at, 1, piece)
            if out:
                yield pd.DataFrame(out, columns=["key", "first_us", "last_us", "fragments", "merged"])
        self.held.update(held)
        for t in self.handle.listTimers() if before else ():  # what holds nothing has no timer
            self.handle.deleteTimer(t)
        self.handle.registerTimer((held[1] + self.gap) // 1000 + 1)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            held = self.held.get()
            self.held.clear()
            yield pd.DataFrame([(key[0], *held)], columns=["key", "first_us", "last_us", "fragments", "merged"])

    def close(self) -> None:
        pass


def debounced(rows: DataFrame, key: str, piece: str, id_col: str, gap: float = 2.5, span: float = 8.0, most: int = 4) -> DataFrame:
    """rows (ts, key, piece) -> joined messages of each key; state needs the RocksDB provider."""
    d = rows.select(F.col(key).cast("string").alias("key"), "ts", F.col(id_col).alias("id"), F.col(piece).alias("piece")).withWatermark("ts", "0 seconds")
    return d.groupBy("key").transformWithStateInPandas(Debounce(gap, span, most), Debounce.OUT, "Append", "EventTime")


class Unanswered(StatefulProcessor):
    """Emits a window's question when `wait` seconds pass without a row of another speaker; the newest question counts."""

    OUT = "key string, id long, asked_us long"

    def __init__(self, wait: float):
        self.wait = int(wait * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.asked = handle.getValueState("asked", "id long, speaker long, asked_us long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        asked = self.asked.get() if self.asked.exists() else None
        for batch in in_order(rows, ["ts", "id"]):
            out = []
            for r in batch.itertuples():
                at = int(r.ts)
                if asked and at - asked[2] > self.wait:
                    out.append((key[0], asked[0], asked[2]))
                    asked = None
                if r.question:
                    asked = (int(r.id), int(r.speaker), at)
                elif asked and r.speaker != asked[1]:
                    asked = None
            yield pd.DataFrame(out, columns=["key", "id", "asked_us"])
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if asked:
            self.asked.update(asked)
            self.handle.registerTimer((asked[2] + self.wait) // 1000 + 1)
        elif self.asked.exists():
            self.asked.clear()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.asked.exists():
            asked = self.asked.get()
            self.asked.clear()
            yield pd.DataFrame([(key[0], asked[0], asked[2])], columns=["key", "id", "asked_us"])

    def close(self) -> None:
        pass


def unanswered_questions(rows: DataFrame, key: str, speaker: str, question: Column, id_col: str, wait: float) -> DataFrame:
    d = rows.select(F.col(key).cast("string").alias("key"), "ts", F.col(id_col).alias("id"), F.col(speaker).alias("speaker"), question.alias("question")).withWatermark("ts", "0 seconds")
    return d.groupBy("key").transformWithStateInPandas(Unanswered(wait), Unanswered.OUT, "Append", "EventTime")
