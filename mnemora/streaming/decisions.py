"""Streams that decide with state: guarded ingest by groups of slots, and the reply gate by windows.

Each has the same fold as its batch twin, and keeps between batches what the fold holds. A key's rows of one batch are put in
order first; rows that come in a later batch than later ones are decided when they come.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mnemora.operators.ingest import LOG, Slots, logged
from mnemora.operators.memory import PLACES, SHOWN, Shown, shown_rows, turns_of
from mnemora.operators.replies import OUT, Gate
from mnemora.streaming.jobs import in_order


class Ingest(StatefulProcessor):
    """The live facts of a group of slots, by last change, as a list of state."""

    STATE = "id long, slot_key string, persona_id string, value string, norm string, about string, confidence double, importance double, access_count long, pinned boolean, topic string, guess string, updated long, version long"

    def __init__(self, high: float):
        self.high = high

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.facts = handle.getListState("facts", self.STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        slots = Slots(self.high, list(self.facts.get()) if self.facts.exists() else [])
        batch = pd.concat(list(rows)).sort_values(["ts", "id"])
        yield logged([slots.log(c) for c in batch.itertuples()])
        left = slots.state()
        if left:
            self.facts.put(left)
        else:
            self.facts.clear()

    def close(self) -> None:
        pass


def ingested(claims: DataFrame, high: float = 0.8) -> DataFrame:
    """LOG of a stream of open claims (see operators.ingest.open_claims), by their groups; state needs the RocksDB provider."""
    return claims.groupBy("group").transformWithStateInPandas(Ingest(high), LOG, "Append", "None")


class Replies(StatefulProcessor):
    """A window's last answer and its day's number of answers, as one value of state."""

    def __init__(self, cooldown: int, min_interval: int, daily: int, offset: int):
        self.gate = (cooldown, min_interval, daily, offset)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "last long, day long, n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        gate = Gate(*self.gate)
        if self.held.exists():
            gate.start(*self.held.get())
        for batch in in_order(rows, ["ts", "id"]):
            out = [(key[0], r.id, r.ts, *((r.rule, False) if r.rule else gate.decide(int(r.ts), r.reason, r.fires))) for r in batch.itertuples()]
            yield pd.DataFrame(out, columns=["key", "id", "ts", "outcome", "fired"])
        self.held.update((gate.last, gate.day, gate.n))

    def close(self) -> None:
        pass


def replies(messages: DataFrame, key: str, cooldown: int = 90, min_interval: int = 60, daily: int = 30, offset: int = 0) -> DataFrame:
    """operators.replies.gated_replies over a stream."""
    d = messages.select(F.col(key).cast("string").alias("key"), "id", "ts", F.coalesce("rule", F.lit("")).alias("rule"), F.coalesce("fires", F.lit(False)).alias("fires"), "reason")
    return d.groupBy("key").transformWithStateInPandas(Replies(cooldown, min_interval, daily, offset), OUT, "Append", "None")


class Remembered(StatefulProcessor):
    """When each fact was shown last in a window, as a map; what no longer counts is removed as turns come, and all of it by a
    timer when none come for as long as anything counts."""

    def __init__(self, window: int, places: dict[str, int]):
        self.window, self.places = window, places

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", "fact_id long", "ts long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = {k[0]: v[0] for k, v in self.last.iterator()} if self.last.exists() else {}
        held = Shown(self.window, self.places)
        for fact, ts in sorted(before.items(), key=lambda x: x[1]):
            held.put(fact, ts)
        rest = None
        for batch in in_order((r.drop(columns="_at", errors="ignore") for r in rows), ["ts", "turn_id", "place"]):
            batch = batch if rest is None else pd.concat([rest, batch])
            last = (batch["turn_id"] == batch["turn_id"].iloc[-1]) & (batch["ts"] == batch["ts"].iloc[-1])  # may go on in the next step
            batch, rest = batch[~last], batch[last]
            yield shown_rows([(w, turn, ts, *x) for (w, ts, turn), found in turns_of(batch) for x in held.turn(ts, found)])
        if rest is not None:
            yield shown_rows([(w, turn, ts, *x) for (w, ts, turn), found in turns_of(rest) for x in held.turn(ts, found)])
        for fact in before.keys() - held.last.keys():
            self.last.removeKey((fact,))
        for fact, ts in held.last.items():
            if before.get(fact) != ts:
                self.last.updateValue((fact,), (ts,))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if held.last:
            self.handle.registerTimer((max(held.last.values()) + self.window) * 1000 + 1)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield shown_rows([])

    def close(self) -> None:
        pass


def remembered(turns: DataFrame, window: int = 600, places: dict[str, int] | None = None, late: str = "0 seconds") -> DataFrame:
    """operators.memory.remembered over a stream; turns that come later than `late` are left out, as time has passed them."""
    d = turns.withColumn("_at", F.timestamp_seconds("ts")).withWatermark("_at", late)
    return d.groupBy("window_tag").transformWithStateInPandas(Remembered(window, PLACES | (places or {})), SHOWN, "Append", "EventTime")
