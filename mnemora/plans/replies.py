"""Queries over turns that the events make: the reply gate with its pauses, and what a window was shown lately; batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions import gates, timeparse
from mnemora.operators import memory, replies
from mnemora.sources.tables import EPOCH_SQL, table
from mnemora.streaming import decisions, jobs

from .catalogue import query
from .ingest import _list, _pick
from .streams import _stateful

_TEXTS = ("小萌在吗", "买什么好", "/help", "哈", "今天天气不错", "找客服", "……！", "你们看看这个")
#: Pauses and limits that all come into play over the month of the events table.
PAUSES = {"cooldown": 2 * 3600, "min_interval": 3 * 3600, "daily": 4, "offset": 8 * 3600}


def event_messages(rows: DataFrame) -> DataFrame:
    """Events as messages of a window for each type; what is said, and to whom, is spliced by the event's number."""
    i, tag = F.col("event_id"), F.concat(F.when(F.col("user_id") % 9 == 0, "qq:FriendMessage:").otherwise("qq:GroupMessage:"), "event_type")
    ts, text = F.expr(EPOCH_SQL), _pick(_TEXTS, F.floor(i / 2))
    at_night = gates.quiet(F.timestamp_seconds(ts), timeparse.quiet_ranges("1:00-3:30"))
    rule = replies.standing_rule(i % 97 != 0, tag, i % 23 == 0, i % 31 == 0, at_night, ["c", "e"], text)
    said = replies.wish(F.contains(text, F.lit("小萌")), F.contains(text, F.lit("客服")), i % 5 != 0, text.rlike("天气|买"), F.when(text.rlike("天气|买"), "keyword").otherwise("keyword_miss"))
    return rows.select(tag.alias("window_tag"), i.alias("id"), ts.alias("ts"), rule.alias("rule"), said.alias("said")).select("window_tag", "id", "ts", "rule", F.col("said.fires").alias("fires"), F.col("said.reason").alias("reason"))


_GAP, _LIMIT, _OFF = max(PAUSES["cooldown"], PAUSES["min_interval"]), PAUSES["daily"], PAUSES["offset"]
REPLIES_SQL = f"""WITH RECURSIVE raw AS (
  SELECT event_id AS id, epoch_us(ts) // 1000000 AS ts, CASE WHEN user_id % 9 = 0 THEN 'qq:FriendMessage:' ELSE 'qq:GroupMessage:' END || event_type AS w, {_list(_TEXTS, "event_id // 2")} AS t, hour(ts) * 60 + minute(ts) AS minute FROM events),
m AS (
  SELECT id, ts, w, (ts + {_OFF}) // 86400 AS day, CASE WHEN id % 97 = 0 THEN 'disabled' WHEN w LIKE '%Friend%' THEN 'not_group' WHEN id % 23 = 0 THEN 'already_handled' WHEN id % 31 = 0 THEN 'bot_self' WHEN minute >= 60 AND minute < 210 THEN 'quiet_hours'
      WHEN NOT (contains(w, 'c') OR contains(w, 'e')) THEN 'group_not_allowed' WHEN length(t) < 2 THEN 'too_short' WHEN t[1] = '/' THEN 'command' WHEN NOT regexp_matches(t, '[\\p{{L}}\\p{{N}}]') THEN 'no_content' ELSE '' END AS rule,
    CASE WHEN contains(t, '小萌') THEN 'name_hit' WHEN contains(t, '客服') THEN 'keyword_force' WHEN id % 5 = 0 THEN 'turn_not_open' WHEN regexp_matches(t, '天气|买') THEN 'keyword' ELSE 'keyword_miss' END AS reason FROM raw),
may AS (SELECT * FROM m WHERE rule = '' AND reason IN ('name_hit', 'keyword_force', 'keyword')),
fires AS (
  (SELECT DISTINCT ON (w) w, ts, id, day, 1 AS n FROM may ORDER BY w, ts, id)
  UNION ALL
  SELECT w, ts, id, day, n FROM (
    SELECT c.w, c.ts, c.id, c.day, CASE WHEN c.day = f.day THEN f.n + 1 ELSE 1 END AS n, row_number() OVER (PARTITION BY c.w ORDER BY c.ts, c.id) AS k
    FROM fires f JOIN may c ON c.w = f.w AND c.ts >= f.ts + {_GAP} AND (c.day > f.day OR f.n < {_LIMIT})) WHERE k = 1),
last AS (
  SELECT m.*, last_value(f IGNORE NULLS) OVER (PARTITION BY m.w ORDER BY m.ts, m.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM (
    SELECT m.*, CASE WHEN x.id IS NOT NULL THEN {{'ts': x.ts, 'day': x.day, 'n': x.n}} END AS f, x.id IS NOT NULL AS mine FROM m LEFT JOIN fires x USING (w, id)) m)
SELECT w AS key, id, ts, CASE WHEN rule <> '' THEN rule WHEN ts - g.ts < {PAUSES["cooldown"]} THEN 'cooldown' WHEN ts - g.ts < {PAUSES["min_interval"]} THEN 'min_interval' WHEN g.day = day AND g.n >= {_LIMIT} THEN 'daily_limit' ELSE reason END AS outcome, mine AS fired FROM last"""


@query(REPLIES_SQL)
def reply_gate_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which messages are answered unasked, and what holds back the others."""
    return replies.gated_replies(event_messages(table(spark, sf_dir, "events")), "window_tag", **PAUSES)


@query(REPLIES_SQL)
def stream_reply_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    _stateful(spark)
    return jobs.drained(decisions.replies(event_messages(jobs.events(spark, sf_dir)), "window_tag", **PAUSES), "append")


_SHOWN_FOR, _PLACES = 6 * 3600, {"core": 2, "related": 1, "uncertain": 1}


def event_turns(rows: DataFrame) -> DataFrame:
    """Events as turns of ten windows for each type, with five facts of fifty each, spliced by the event's number."""
    i, j = F.col("event_id"), F.col("_j")
    d = rows.withColumn("_j", F.explode(F.array(*map(F.lit, range(5))))).withColumn("fact_id", (i * 7 + j * 13) % 50)
    tag = F.concat("event_type", F.lit(":"), (F.col("user_id") % 10).cast("string"))
    return d.select(tag.alias("window_tag"), i.alias("turn_id"), F.expr(EPOCH_SQL).alias("ts"), j.alias("place"), "fact_id", _pick(("core", "core", "related", "uncertain"), F.col("fact_id")).alias("kind"), (F.col("fact_id") % 11 == 0).alias("always"))


SHOWN_SQL = f"""WITH RECURSIVE c AS (
  SELECT event_type || ':' || user_id % 10 AS w, event_id AS id, epoch_us(ts) // 1000000 AS ts, j, (event_id * 7 + j * 13) % 50 AS f FROM events, (SELECT unnest(range(5)) AS j)),
turns AS (
  SELECT w, id, ts, row_number() OVER (PARTITION BY w ORDER BY ts, id) AS k, c FROM (
    SELECT w, id, ts, list({{'f': f, 'kind': ['core', 'core', 'related', 'uncertain'][f % 4 + 1], 'always': f % 11 = 0}} ORDER BY j) AS c FROM c GROUP BY w, id, ts)),
run AS (
  SELECT DISTINCT w, 0::BIGINT AS k, []::STRUCT(f BIGINT, ts BIGINT)[] AS s, NULL::BIGINT AS id, NULL::BIGINT AS ts, []::BIGINT[] AS a, []::BIGINT[] AS b, []::BIGINT[] AS u FROM turns
  UNION ALL
  SELECT w, k, list_concat(list_filter(s, lambda x: NOT list_contains(a || b || u, x.f)), list_transform(a || b || u, lambda x: {{'f': x, 'ts': ts}})), id, ts, a, b, u FROM (
    SELECT *, core[1:2] AS a, list_transform(list_filter(ok, lambda x: x.kind = 'related' OR list_contains(core[3:], x.f)), lambda x: x.f)[1:1] AS b, list_transform(list_filter(ok, lambda x: x.kind = 'uncertain'), lambda x: x.f)[1:1] AS u FROM (
      SELECT *, list_transform(list_filter(ok, lambda x: x.kind = 'core'), lambda x: x.f) AS core FROM (
        SELECT *, list_filter(c, lambda x: x.always OR NOT list_contains(list_transform(s, lambda z: z.f), x.f)) AS ok FROM (
          SELECT t.w, t.k, t.id, t.ts, t.c, list_filter(r.s, lambda x: x.ts >= t.ts - {_SHOWN_FOR}) AS s FROM run r JOIN turns t ON t.w = r.w AND t.k = r.k + 1)))))
SELECT w AS window_tag, id AS turn_id, ts, bucket, position::INT AS position, fact_id FROM (
  SELECT w, id, ts, 'core' AS bucket, generate_subscripts(a, 1) AS position, unnest(a) AS fact_id FROM run UNION ALL SELECT w, id, ts, 'related', generate_subscripts(b, 1), unnest(b) FROM run UNION ALL SELECT w, id, ts, 'uncertain', generate_subscripts(u, 1), unnest(u) FROM run)"""


@query(SHOWN_SQL)
def injected_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each turn shows, without what its window was shown in the last hours."""
    return memory.remembered(event_turns(table(spark, sf_dir, "events")), _SHOWN_FOR, _PLACES)


@query(SHOWN_SQL)
def stream_injected_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    _stateful(spark)
    return jobs.drained(decisions.remembered(event_turns(jobs.events(spark, sf_dir)), _SHOWN_FOR, _PLACES), "append")
