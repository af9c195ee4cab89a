"""The reply gate with its state: how long ago a window was answered unasked, and how often on a day.

Whether a message may be answered depends on the messages that were, so it is a greedy choice in order of time. A window's
messages are cut into slices of whole days, folded side by side as if nothing came before; what a slice leaves matters to the
next only within the longest pause after its end, so few slices are folded again, until all start from what they should.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions import gates
from mnemora.storage import written

OUT = "key string, id long, ts long, outcome string, fired boolean"
DAY = 86400


def standing_rule(enabled: Column, tag: Column, handled: Column, is_self: Column, quiet_now: Column, targets: list[str], text: Column, least: int = 2) -> Column:
    """'' where a message gets as far as the pauses, else the first rule against it, which no state changes."""
    usable = gates.text_usable(text, least)
    return (
        F.when(~enabled, "disabled").when(gates.window_kind(tag) != "group", "not_group").when(handled, "already_handled").when(is_self, "bot_self")
        .when(quiet_now, "quiet_hours").when(~gates.in_targets(tag, targets), "group_not_allowed").otherwise(usable)
    )


def wish(name_hit: Column, forced: Column, turn_open: Column, mode_hit: Column, mode_reason: Column) -> Column:
    """struct<fires, reason>: what a message would do if no pause holds it back: a name or a forced word goes before the turn."""
    reason = F.when(name_hit, "name_hit").when(forced, "keyword_force").when(~turn_open, "turn_not_open").when(mode_hit, F.coalesce(F.nullif(mode_reason, F.lit("")), F.lit("hit"))).otherwise(F.coalesce(F.nullif(mode_reason, F.lit("")), F.lit("mode_miss")))
    return F.struct((name_hit | forced | (turn_open & mode_hit)).alias("fires"), reason.alias("reason"))


class Gate:
    """Last answer, and answers of the day, of one window."""

    def __init__(self, cooldown: int, min_interval: int, daily: int, offset: int = 0):
        self.cooldown, self.min_interval, self.daily, self.offset = cooldown, min_interval, daily, offset
        self.start(None)

    def start(self, last: int | None, day: int | None = None, n: int = 0) -> None:
        self.last, self.day, self.n = last, day, n

    def decide(self, ts: int, reason: str, fires: bool) -> tuple[str, bool]:
        day = (ts + self.offset) // DAY
        if day != self.day:
            self.day, self.n = day, 0
        since = None if self.last is None else ts - self.last
        if since is not None and since < self.cooldown:
            return "cooldown", False
        if since is not None and since < self.min_interval:
            return "min_interval", False
        if self.daily and self.n >= self.daily:
            return "daily_limit", False
        if fires:
            self.last, self.n = ts, self.n + 1
        return reason, bool(fires)


def gated_replies(messages: DataFrame, key: str, cooldown: int = 90, min_interval: int = 60, daily: int = 30, offset: int = 0) -> DataFrame:
    """OUT: every message with its outcome, and whether it was answered.

    messages: key, id, ts (seconds), rule (see standing_rule; null counts as ''), fires and reason (see wish). In each
    window, in order of (ts, id): a message that a rule holds back has that outcome; one within `cooldown`, then
    `min_interval`, seconds of the last answer has theirs; one after `daily` answers of its day has `daily_limit` (0: no
    limit); else its reason, and if it fires it is answered. Days change at midnight, `offset` seconds east of UTC.

    Only a slice's end is carried: rows travel twice, and a window with a third of all messages is as many tasks as it
    has slices, of a day, or of eight of the longest pauses where that is more.
    """
    gap = max(cooldown, min_interval, 0)
    length = DAY * max(1, -(-8 * gap // DAY))
    c = F.col
    d = messages.select(c(key).cast("string").alias("key"), "id", "ts", F.coalesce("rule", F.lit("")).alias("rule"), F.coalesce("fires", F.lit(False)).alias("fires"), "reason")
    held = d.where("rule <> ''").select("key", "id", "ts", c("rule").alias("outcome"), F.lit(False).alias("fired"))
    open_ = written(d.where("rule = ''").withColumn("slice", F.floor((c("ts") + offset) / length).cast("long")).drop("rule"), "replies-open")
    start = c("slice") * length - offset
    marks = open_.select("key", "slice").distinct().select("key", "slice", start.alias("ts"), F.lit(None).cast("long").alias("id"), F.lit(False).alias("fires"))
    steps = written(open_.where("fires").select("key", "slice", "ts", "id", "fires").unionByName(marks), "replies-steps")

    def ends(rows: DataFrame) -> DataFrame:
        """(key, slice, carry, last): what a slice leaves if it starts from carry."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            gate, at, carry = Gate(cooldown, min_interval, daily, offset), None, None
            for b in batches:
                out = []
                for r in b.itertuples():
                    if (r.key, r.slice) != at:
                        if at:
                            out.append((*at, carry, gate.last))
                        at, carry = (r.key, r.slice), None if pd.isna(r.carry) else int(r.carry)
                        gate.start(carry)
                    if r.fires:
                        gate.decide(int(r.ts), "", True)
                yield _ended(out)
            if at:
                yield _ended([(*at, carry, gate.last)])

        return _dealt(rows.withColumn("id", F.coalesce("id", F.lit(-(2**63))))).mapInPandas(run, "key string, slice long, carry long, last long")

    state = written(ends(steps.withColumn("carry", F.lit(None).cast("long"))), "replies-ends")
    before = F.lag("last").over(Window.partitionBy("key").orderBy("slice"))  # a row for each slice
    while True:
        due = state.withColumn("_due", before).withColumn("_due", F.when(c("_due") + gap > start, c("_due")))
        due = written(due, "replies-due")
        wrong = due.where(~c("_due").eqNullSafe(c("carry"))).select("key", "slice", c("_due").alias("carry"))
        if wrong.isEmpty():
            break
        again = ends(steps.join(wrong, ["key", "slice"]))
        state = written(due.where(c("_due").eqNullSafe(c("carry"))).select("key", "slice", "carry", "last").unionByName(again), "replies-ends")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gate, at = Gate(cooldown, min_interval, daily, offset), None
        for b in batches:
            out = []
            for r in b.itertuples():
                if (r.key, r.slice) != at:
                    at = (r.key, r.slice)
                    gate.start(None if pd.isna(r.carry) else int(r.carry))
                out.append((r.key, r.id, r.ts, *gate.decide(int(r.ts), r.reason, r.fires)))
            yield pd.DataFrame(out, columns=["key", "id", "ts", "outcome", "fired"])

    decided = _dealt(open_.join(state.select("key", "slice", "carry"), ["key", "slice"])).mapInPandas(fold, OUT)
    return held.unionByName(decided)


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "slice").sortWithinPartitions("key", "slice", "ts", "id")


def _ended(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["key", "slice", "carry", "last"]).astype({"carry": "Int64", "last": "Int64"})
