"""What was said elsewhere: lines of other windows that a window may see, within numbers and characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions import gates
from mnemora.functions.text import clip, window_label


def _stamp(c):
    return F.date_format(F.timestamp_seconds(c), "MM-dd HH:mm")


def cross_windows(asks: DataFrame, timeline: DataFrame, minutes: int = 30, items: int = 6, chars: int = 320, head: int = 0, private_to_group: bool = False, group_to_group: bool = False) -> DataFrame:
    """(ask_id, id, place, line): what an asker said elsewhere of late, oldest first, within `chars` with `head` of them used.

    asks: ask_id, speaker_id, window_tag, now. The newest items * 4 of a speaker are looked at, `items` kept; each line is
    counted with a line end, and what comes after the first line that does not fit goes. Speakers meet by equality.
    """
    c = F.col
    t = timeline.where("role = 'user'").select("id", "ts", "speaker_id", c("window_tag").alias("_from"), "content")
    d = asks.select("ask_id", "speaker_id", "window_tag", "now").join(t, "speaker_id").where((c("_from") != c("window_tag")) & (c("ts") >= c("now") - max(1, minutes) * 60) & (c("ts") <= c("now")))
    newest = Window.partitionBy("ask_id").orderBy(F.desc("ts"), F.desc("id"))
    d = d.withColumn("_n", F.row_number().over(newest)).where(c("_n") <= items * 4)
    source, target = gates.window_kind(c("_from")), gates.window_kind(c("window_tag"))
    d = d.where(gates.direction_allowed(source, target, private_to_group, group_to_group) & (gates.text_usable(c("content")) == ""))
    d = d.withColumn("_n", F.row_number().over(newest)).where(c("_n") <= items)
    where = F.when(source == "group", "群里").otherwise("私聊里")
    line = F.concat(F.lit("- "), _stamp(c("ts")), F.lit(" 在"), where, F.lit("说过："), clip(c("content"), 60))
    up = Window.partitionBy("ask_id").orderBy("ts", "id")
    d = d.withColumn("line", line).withColumn("_used", head + F.sum(F.length("line") + 1).over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return d.where(c("_used") <= chars).withColumn("place", F.row_number().over(up)).select("ask_id", "id", "place", "line")


def window_flow(timeline: DataFrame, current: str, now: int, hours: int = 24, items: int = 150, chars: int = 6000, windows: int = 3, head: int = 0, message_chars: int = 200, private_to_group: bool = True, group_to_private: bool = True, isolation: str = "shared") -> DataFrame:
    """(id, window_tag, label, place, line): the newest lines of the newest other windows, oldest first.

    Of the newest items * 4 messages, those that the current window may see; of the `windows` newest windows each gets
    max(4, items / windows found) newest lines, `items` in all; where they are too long together, the oldest go.
    """
    c = F.col
    target = F.lit(current)
    kind, mine = gates.window_kind(c("window_tag")), gates.window_kind(target)
    into_group = private_to_group and isolation not in ("strict", "owner")
    late = timeline.where((c("window_tag") != target) & (c("ts") >= now - max(1, hours) * 3600) & (c("ts") <= now)).orderBy(F.desc("ts"), F.desc("id")).limit(items * 4)
    shown = late.where((kind != "unknown") & (mine != "unknown") & ~((kind == "private") & (mine == "group") & F.lit(not into_group)) & ~((kind == "group") & (mine == "private") & F.lit(not group_to_private)))
    shown = shown.where(c("role").isin("user", "assistant") & (gates.text_usable(c("content")) == ""))
    tops = shown.groupBy("window_tag").agg(F.max("ts").alias("_last")).orderBy(F.desc("_last"), "window_tag").limit(max(1, windows))
    tops = tops.withColumn("_windows", F.count("*").over(Window.partitionBy()))  # `windows` rows
    d = shown.join(F.broadcast(tops), "window_tag")
    each = F.greatest(F.lit(4), F.floor(F.lit(items) / c("_windows")))
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy("window_tag").orderBy(F.desc("ts"), F.desc("id")))).where(c("_n") <= each)
    who = F.when(c("role") == "assistant", "我(Bot)").otherwise(F.coalesce(F.nullif(c("speaker_id"), F.lit("")), F.lit("某人")))
    line = F.concat(F.lit("["), _stamp(c("ts")), F.lit("] "), who, F.lit(": "), clip(F.translate("content", "\n", " "), max(20, message_chars)))
    # at most items * 4 rows are left: one task holds them
    down = Window.partitionBy().orderBy(F.desc("ts"), F.desc("id"))
    d = d.withColumn("line", line).withColumn("_n", F.row_number().over(down)).where(c("_n") <= items)
    d = d.withColumn("_used", head + F.sum(F.length("line") + 1).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(c("_used") <= chars)
    return d.withColumn("place", F.row_number().over(Window.partitionBy().orderBy("ts", "id"))).select("id", "window_tag", window_label(c("window_tag")).alias("label"), "place", "line")
