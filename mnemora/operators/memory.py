"""What a window was shown lately: facts that were injected in a turn stay out of its next ones for a while.

What a turn shows depends on what earlier turns of its window showed, and what they showed on the places that were left in
their buckets; so a window is a fold over its turns, and what it holds is what was shown within the time that counts.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHOWN = "window_tag string, turn_id long, ts long, bucket string, position int, fact_id long"
_COLUMNS = ["window_tag", "turn_id", "ts", "place", "fact_id", "kind", "always"]
#: Places of a turn's buckets.
PLACES = {"core": 4, "related": 6, "uncertain": 3}


class Shown:
    """Facts by when they were shown last; those from before the time that counts are dropped as turns go by."""

    def __init__(self, window: int, places: dict[str, int]):
        self.window, self.places = window, places
        self.last: dict[int, int] = {}
        self.queue: deque[tuple[int, int]] = deque()

    def put(self, fact: int, ts: int) -> None:
        self.last[fact] = ts
        self.queue.append((ts, fact))

    def turn(self, ts: int, candidates: list[tuple[int, str, bool]]) -> list[tuple[str, int, int]]:
        """(bucket, position, fact) of a turn's candidates (fact, kind, always), which are in order: what it shows."""
        while self.queue and self.queue[0][0] < ts - self.window:
            at, fact = self.queue.popleft()
            if self.last.get(fact) == at:
                del self.last[fact]
        taken = {bucket: 0 for bucket in self.places}
        out = []
        for fact, kind, always in candidates:
            if fact in self.last and not always:
                continue
            bucket = "related" if kind == "core" and taken["core"] >= self.places["core"] else kind
            if taken[bucket] < self.places[bucket]:
                taken[bucket] += 1
                out.append((bucket, taken[bucket], fact))
        for _, _, fact in out:
            self.put(fact, ts)
        return out


def turns_of(rows: pd.DataFrame) -> Iterator[tuple[tuple, list[tuple[int, str, bool]]]]:
    """Turns of rows in order: (window_tag, ts, turn_id) and candidates."""
    at, found = None, []
    for r in rows.itertuples():
        key = (r.window_tag, int(r.ts), int(r.turn_id))
        if key != at:
            if at:
                yield at, found
            at, found = key, []
        found.append((int(r.fact_id), r.kind, bool(r.always)))
    if at:
        yield at, found


def shown_rows(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=[x.split()[0] for x in SHOWN.split(", ")])


def remembered(turns: DataFrame, window: int = 600, places: dict[str, int] | None = None) -> DataFrame:
    """SHOWN: what every turn shows, if a fact that its window was shown within `window` seconds stays out.

    turns: window_tag, turn_id, ts, place, fact_id, kind (core, related, uncertain), always (pinned or named: shown again).
    In each window, in order of (ts, turn_id), candidates by place: each kind has its places, and a core fact without one
    goes among the related. Only what is shown is remembered; what is shown again counts from then. window 0: what is of
    the same second stays out.

    Windows are side by side; the turns of one stream by in order, and a worker holds what was shown within the time.
    """
    places = PLACES | (places or {})

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tag, held, rest = None, Shown(window, places), None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b])
            # the last turn may go on in the next batch
            last = (b["window_tag"] == b["window_tag"].iloc[-1]) & (b["turn_id"] == b["turn_id"].iloc[-1]) & (b["ts"] == b["ts"].iloc[-1]) if len(b) else None
            b, rest = (b[~last], b[last]) if len(b) else (b, None)
            out = []
            for (w, ts, turn), found in turns_of(b):
                if w != tag:
                    tag, held = w, Shown(window, places)
                out += [(w, turn, ts, *x) for x in held.turn(ts, found)]
            yield shown_rows(out)
        if rest is not None:
            out = []
            for (w, ts, turn), found in turns_of(rest):
                held = held if w == tag else Shown(window, places)
                out += [(w, turn, ts, *x) for x in held.turn(ts, found)]
            yield shown_rows(out)

    d = turns.select(*[F.col(c) for c in _COLUMNS])
    return d.repartition("window_tag").sortWithinPartitions("window_tag", "ts", "turn_id", "place").mapInPandas(fold, SHOWN)


def as_candidates(bundles: DataFrame, requests: DataFrame) -> DataFrame:
    """The turns that `remembered` reads, from requests (request_id, window_tag, ts) and their bundles as operators.requests gives
    them: pinned and named facts, and those of routes that ask for what was said, are shown again."""
    order = F.when(F.col("bucket") == "core", 0).when(F.col("bucket") == "related", 1000).otherwise(2000)
    again = ~F.col("route").isin("long_term", "current_status", "history") | F.col("pinned") | F.col("matched")
    d = bundles.join(requests.select("request_id", F.col("window_tag").alias("_window"), F.col("ts").alias("_ts")), "request_id")
    return d.select(F.col("_window").alias("window_tag"), F.col("request_id").cast("long").alias("turn_id"), F.col("_ts").cast("long").alias("ts"), (order + F.col("position")).alias("place"), F.col("id").cast("long").alias("fact_id"), F.col("bucket").alias("kind"), again.alias("always"))
