"""The reply gate's state against a plain loop, in batch over slices and as a stream."""

import random

import pytest
from pyspark.sql import functions as F

from mnemora.operators import replies
from mnemora.streaming import decisions, jobs

SHAPE = "window_tag string, id long, ts long, rule string, fires boolean, reason string"


def messages(seed, n=600, days=9, windows=("g1", "g2", "g3"), hot=0.34):
    """Crowded around midnight, so that what a day leaves matters to the next."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = "hot" if r.random() < hot else r.choice(windows)
        ts = r.randrange(days) * 86400 + r.choice([r.randrange(86400), r.randrange(3000), 86400 - r.randrange(1, 3000)])
        rule, fires = r.choice([None, "", "", "", "quiet_hours"]), r.random() < 0.6
        out.append((w, i, ts, rule, fires, "hit" if fires else "mode_miss"))
    return out


def loop(rows, cooldown, min_interval, daily, offset):
    last, count, out = {}, {}, {}
    for w, i, ts, rule, fires, reason in sorted(rows, key=lambda m: (m[0], m[2], m[1])):
        day = (w, (ts + offset) // 86400)
        if rule:
            out[i] = (rule, False)
        elif w in last and ts - last[w] < cooldown:
            out[i] = ("cooldown", False)
        elif w in last and ts - last[w] < min_interval:
            out[i] = ("min_interval", False)
        elif daily and count.get(day, 0) >= daily:
            out[i] = ("daily_limit", False)
        else:
            out[i] = (reason, fires)
            if fires:
                last[w], count[day] = ts, count.get(day, 0) + 1
    return out


@pytest.mark.parametrize("seed,pauses", [(0, (90, 60, 30, 0)), (1, (3000, 4000, 3, 8 * 3600)), (2, (0, 0, 2, 0)), (3, (40000, 0, 0, -5 * 3600)), (4, (0, 5000, 1, 0))])
def test_slices_equal_a_loop(spark, seed, pauses):
    rows = messages(seed)
    got = replies.gated_replies(spark.createDataFrame(rows, SHAPE), "window_tag", *pauses)
    assert {r.id: (r.outcome, r.fired) for r in got.collect()} == loop(rows, *pauses)


def test_a_chain_over_every_midnight(spark):
    """A message every 50 minutes and a pause of 45: each day starts from what the one before left, ten days on."""
    rows = [("w", i, i * 3000, "", True, "hit") for i in range(300)]
    got = replies.gated_replies(spark.createDataFrame(rows, SHAPE), "window_tag", 4000, 0, 0)
    assert {r.id: (r.outcome, r.fired) for r in got.collect()} == loop(rows, 4000, 0, 0, 0)


def test_a_stream_equals_the_loop(spark, tmp_path):
    rows = sorted(messages(7, n=300), key=lambda m: (m[2], m[1]))
    for k in range(3):
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], SHAPE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/m")
    stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/m")
    got = jobs.drained(decisions.replies(stream, "window_tag", 3000, 4000, 3), "append")
    assert {r.id: (r.outcome, r.fired) for r in got.collect()} == loop(rows, 3000, 4000, 3, 0)


def test_rules_and_wishes(spark):
    rows = [
        (False, "qq:GroupMessage:1", False, False, False, "hello", "disabled"), (True, "qq:FriendMessage:1", False, False, False, "hello", "not_group"), (True, "qq:GroupMessage:1", True, False, False, "hello", "already_handled"),
        (True, "qq:GroupMessage:1", False, True, False, "hello", "bot_self"), (True, "qq:GroupMessage:1", False, False, True, "hello", "quiet_hours"), (True, "qq:GroupMessage:2", False, False, False, "hello", "group_not_allowed"),
        (True, "qq:GroupMessage:1", False, False, False, "x", "too_short"), (True, "qq:GroupMessage:1", False, False, False, "/stype status", "command"), (True, "qq:GroupMessage:1", False, False, False, "...", "no_content"), (True, "qq:GroupMessage:1", False, False, False, "在吗各位", ""),
    ]
    d = spark.createDataFrame(rows, "enabled boolean, tag string, handled boolean, own boolean, quiet boolean, text string, want string")
    c = F.col
    assert all(r.got == r.want for r in d.select("want", replies.standing_rule(c("enabled"), c("tag"), c("handled"), c("own"), c("quiet"), ["Message:1"], c("text")).alias("got")).collect())
    wishes = [(True, False, False, False, "", True, "name_hit"), (False, True, False, False, "", True, "keyword_force"), (False, False, False, True, "keyword", False, "turn_not_open"), (False, False, True, True, "", True, "hit"), (False, False, True, True, "judge_pass", True, "judge_pass"), (False, False, True, False, "", False, "mode_miss")]
    d = spark.createDataFrame(wishes, "name boolean, force boolean, turn boolean, mode boolean, why string, fires boolean, want string")
    assert all((r.w.fires, r.w.reason) == (r.fires, r.want) for r in d.select("*", replies.wish(c("name"), c("force"), c("turn"), c("mode"), c("why")).alias("w")).collect())
