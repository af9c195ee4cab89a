"""Named queries on records: episodes, decisions, archives, clean-ups, windows elsewhere."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemora.functions.text import csv_items, platform_of, window_label
from mnemora.operators import aggregates, edits, episodes, filters, flow, links, maintenance, people, review, windows
from mnemora.sources.tables import conversation_timeline, event_episodes, event_facts, event_timeline, memory_facts, table
from mnemora.storage import shared_dir, written

from .catalogue import AS_OF, EV, FACTS, TL, query
from .requests import _EPISODES, _MEMORY

_USER = "role = 'user' AND speaker_id <> 'bot_self'"


@query(f"""WITH {TL}, p AS (SELECT window_tag, CASE WHEN role = 'assistant' OR speaker_id = '' THEN 'bot_self' ELSE speaker_id END AS id, CASE WHEN role = 'assistant' OR speaker_id = '' THEN 'assistant' ELSE 'user' END AS role, ts, tl.id AS m FROM tl)
  SELECT window_tag, id, role, min(ts) AS first_ts, row_number() OVER (PARTITION BY window_tag ORDER BY min((ts, m)))::INT AS place FROM p GROUP BY window_tag, id, role""")
def session_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.participants(conversation_timeline(spark, sf_dir), ["window_tag"])


_CLIP = "CASE WHEN length({0}) > {1} THEN substr({0}, 1, {1} - 1) || '…' ELSE {0} END"


@query(f"""WITH {TL}, u AS (SELECT *, trim(content) AS c, row_number() OVER (PARTITION BY window_tag ORDER BY ts, id) AS up, row_number() OVER (PARTITION BY window_tag ORDER BY ts DESC, id DESC) AS down FROM tl WHERE {_USER}),
  s AS (SELECT window_tag, string_agg({_CLIP.format("c", 80)}, ' / ' ORDER BY ts, id) FILTER (WHERE down <= 4) AS said, max(c) FILTER (WHERE up = 1) AS first FROM u GROUP BY window_tag),
  o AS (SELECT window_tag, min(ts) AS start_ts, max(ts) AS end_ts, arg_min(trim(content), (ts, id)) FILTER (WHERE NOT ({_USER})) AS other FROM tl GROUP BY window_tag),
  t AS (SELECT *, coalesce(nullif(coalesce(first, other), ''), '一段对话') AS raw FROM o LEFT JOIN s USING (window_tag))
  SELECT window_tag, start_ts, end_ts, {_CLIP.format("raw", 20)} AS title, coalesce(nullif({_CLIP.format("trim(coalesce(said, ''))", 200)}, ''), {_CLIP.format("raw", 20)}) AS summary FROM t""")
def episode_recap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = episodes.recaps(conversation_timeline(spark, sf_dir), ["window_tag"])
    return d.select("window_tag", "start_ts", "end_ts", "title", "summary")


@query(f"""WITH {_EPISODES}, e AS (SELECT *, event_window AS w FROM episodes), n AS (FROM e WHERE id % 2 = 0), o AS (FROM e WHERE id % 2 = 1)
  SELECT n.id, n.w AS event_window, CASE WHEN n.start_ts - o.end_ts <= 7200 AND n.end_ts - o.start_ts <= 86400 THEN o.id END AS target
  FROM n LEFT JOIN LATERAL (SELECT * FROM o WHERE o.w = n.w AND o.end_ts <= n.start_ts ORDER BY end_ts DESC, id DESC LIMIT 1) o ON true""")
def episode_continued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes with even ids stand for new ones, with odd ids for old ones: both sides are whole."""
    e = event_episodes(spark, sf_dir)
    return episodes.continued(e.where("id % 2 = 0"), e.where("id % 2 = 1"), "event_window", 7200, 86400)


@query(f"""WITH {FACTS}, r AS (SELECT slot_key, id, confidence, importance, [id, id // 2, access_count] AS ev, row_number() OVER (PARTITION BY slot_key ORDER BY created_at, id) AS n FROM facts),
  x AS (SELECT slot_key, e, min((n, p)) AS pos FROM (SELECT slot_key, n, unnest(ev) AS e, unnest([0, 1, 2]) AS p FROM r) GROUP BY ALL)
  SELECT slot_key, max(confidence) AS confidence, max(importance) AS importance, count(*) AS n, (SELECT list(e ORDER BY pos) FROM x WHERE x.slot_key = r.slot_key) AS evidence FROM r GROUP BY slot_key""")
def evidence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = event_facts(spark, sf_dir).withColumn("ev", F.array(F.col("id"), F.floor(F.col("id") / 2), F.col("access_count").cast("long")))
    return episodes.merged_evidence(f, ["slot_key"], "ev", [F.col("created_at"), F.col("id")])


_PENDING = f"""{_MEMORY}, old AS (SELECT *, lag(id) OVER (PARTITION BY slot_key ORDER BY created_at, id) AS sup FROM mem),
pend AS (SELECT id AS pending_id, slot_key, coalesce(sup, 0) AS old_id, CASE WHEN id % 5 = 0 THEN 'domain_needs_confirm' ELSE 'conflict' END AS reason, CASE WHEN id % 10 = 0 THEN 'd' ELSE '' END AS topic, CASE WHEN id % 7 = 0 THEN 'applied' ELSE 'open' END AS status FROM old),
live AS (SELECT slot_key, max(id) AS live_id FROM mem WHERE status = 'live' GROUP BY slot_key)"""


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("slot_key").orderBy("created_at", "id")
    return memory_facts(spark, sf_dir).withColumn("supersedes", F.lag("id").over(w))


@query(f"""WITH {_PENDING}, d AS (SELECT pend.*, CASE id3 WHEN 0 THEN 'confirm' WHEN 1 THEN 'reject' END AS verdict, mem.status AS was, live_id FROM (SELECT *, pending_id % 3 AS id3 FROM pend) pend LEFT JOIN mem ON mem.id = old_id LEFT JOIN live ON live.slot_key = pend.slot_key)
  SELECT pending_id, CASE WHEN status <> 'open' THEN 'not_found' WHEN verdict IS NULL THEN 'open' WHEN verdict = 'reject' THEN 'rejected' WHEN reason = 'domain_needs_confirm' OR (was IS DISTINCT FROM 'live' AND live_id IS NULL) THEN 'insert' ELSE 'supersede' END AS outcome,
  CASE WHEN status = 'open' AND verdict = 'confirm' THEN CASE WHEN reason = 'domain_needs_confirm' AND topic <> '' THEN slot_key || '|' || topic ELSE slot_key END END AS new_slot,
  CASE WHEN status = 'open' AND verdict = 'confirm' AND reason <> 'domain_needs_confirm' THEN CASE WHEN was = 'live' THEN old_id ELSE live_id END END AS closes FROM d""")
def pending_decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, i = _linked(spark, sf_dir), F.col("id")
    pending = f.select(i.alias("pending_id"), "slot_key", F.coalesce("supersedes", F.lit(0)).alias("old_id"), F.when(i % 5 == 0, "domain_needs_confirm").otherwise("conflict").alias("reason"), F.when(i % 10 == 0, "d").otherwise("").alias("topic"), F.when(i % 7 == 0, "applied").otherwise("open").alias("status"))
    decisions = f.where("id % 3 < 2").select(i.alias("pending_id"), F.when(i % 3 == 0, "confirm").otherwise("reject").alias("verdict"))
    return review.decided(pending, decisions, f)


@query(f"""WITH {_PENDING}, a AS (SELECT id FROM mem UNION SELECT -1)
  SELECT a.id, CASE WHEN f.status IS NULL THEN 'fact_not_found' WHEN f.status <> 'live' THEN 'not_live' WHEN f.sup IS NULL THEN 'nothing_superseded' WHEN o.status <> 'superseded' THEN 'old_not_superseded' WHEN live_id <> a.id THEN 'slot_taken' ELSE 'rollback' END AS outcome,
  CASE WHEN f.status = 'live' AND o.status = 'superseded' AND live_id = a.id THEN o.id END AS restored FROM a LEFT JOIN old f ON f.id = a.id LEFT JOIN old o ON o.id = f.sup LEFT JOIN live ON live.slot_key = o.slot_key""")
def rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _linked(spark, sf_dir)
    asked = f.select("id").union(spark.createDataFrame([(-1,)], "id long"))
    return review.rolled_back(asked, f)


@query(f"""WITH {_PENDING}, a AS (SELECT id FROM mem UNION SELECT -1) SELECT a.id, CASE WHEN f.status IS NULL THEN 'missing' WHEN f.status = 'live' THEN 'restored' WHEN live_id <> a.id THEN 'blocked' ELSE 'restored' END AS outcome,
  CASE WHEN f.status <> 'live' AND live_id <> a.id THEN live_id END AS conflict FROM a LEFT JOIN mem f ON f.id = a.id LEFT JOIN live ON live.slot_key = f.slot_key""")
def restore_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = memory_facts(spark, sf_dir)
    return review.restored(f.select("id").union(spark.createDataFrame([(-1,)], "id long")), f)


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY t, key ORDER BY line) AS nth FROM (
    SELECT event_id AS line, CASE event_id % 5 WHEN 0 THEN 'facts' WHEN 1 THEN 'timeline' WHEN 2 THEN 'profiles' WHEN 3 THEN 'aliases' ELSE 'junk' END AS t, CASE WHEN event_id % 11 = 0 THEN '' ELSE (event_id % 400)::VARCHAR END AS key, (user_id % 400)::VARCHAR AS other FROM events)),
  have AS (SELECT DISTINCT (doc_id % 150)::VARCHAR AS key FROM documents), known AS (SELECT n_nationkey::VARCHAR AS key FROM nation)
  SELECT t AS "table", CASE WHEN t IN ('facts', 'timeline') AND (key = '' OR (key NOT IN (FROM have) AND nth = 1)) THEN 'inserted' WHEN t = 'profiles' THEN 'merged' WHEN t = 'aliases' AND key <> '' AND other <> '' AND key <> other THEN CASE WHEN key IN (FROM known) OR nth > 1 THEN 'replaced' ELSE 'inserted' END ELSE 'skipped' END AS outcome, count(*) AS n FROM l GROUP BY ALL""")
def archive_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    name = F.element_at(F.array(*map(F.lit, ("facts", "timeline", "profiles", "aliases", "junk"))), (i % 5 + 1).cast("int"))
    lines = e.select(i.alias("line"), name.alias("table"), F.when(i % 11 == 0, "").otherwise((i % 400).cast("string")).alias("key"), (F.col("user_id") % 400).cast("string").alias("other"))
    have = table(spark, sf_dir, "documents").select((F.col("doc_id") % 150).cast("string").alias("fingerprint"))
    return review.imported(lines, have, have, table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("alias")))


_LATE = AS_OF + 120 * 86400


@query(f"""WITH {_MEMORY} SELECT job, count(*) AS n, sum(id)::BIGINT AS ids FROM (
    SELECT 'compact' AS job, id FROM mem WHERE status = 'superseded' AND updated_at < {_LATE} - 90 * 86400 UNION ALL
    SELECT 'low_value', id FROM mem WHERE status = 'live' AND NOT pinned AND confidence <= 0.45 AND updated_at < {_LATE} - 30 * 86400 AND access_count <= 1 AND id % 13 <> 0) GROUP BY job""")
def clean_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = memory_facts(spark, sf_dir).withColumn("explicit_correction", F.col("id") % 13 == 0)
    jobs = maintenance.compacted(f, _LATE).select(F.lit("compact").alias("job"), "id").unionByName(maintenance.low_value(f, _LATE).select(F.lit("low_value").alias("job"), "id"))
    return jobs.groupBy("job").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(f"""WITH {_EPISODES} SELECT id, round(w, 6) AS weight FROM (SELECT id, 0.5 * pow(0.5, greatest(0.0, ({_LATE} - end_ts) / 86400.0::DOUBLE) / 30.0) AS w FROM episodes WHERE status = 'live' AND NOT pinned AND end_ts < {_LATE} - 90 * 86400) WHERE w < 0.06""")
def faded_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.faded_episodes(event_episodes(spark, sf_dir), _LATE, 0.06).select("id", F.round("weight", 6).alias("weight"))


_TERMS = """terms AS (SELECT term, source AS persona_id, count(*) AS count, max(doc_id) AS last_seen FROM (SELECT source, doc_id, unnest(regexp_extract_all(lower(text), '[A-Za-z]{2,16}|[一-鿿]{2,8}')) AS term FROM documents) GROUP BY ALL)"""


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnemora.functions.text import terms

    d = table(spark, sf_dir, "documents").select(F.col("source").alias("persona_id"), "doc_id", F.explode_outer(terms(F.lower("text"))).alias("term")).where("term is not null")
    return d.groupBy("term", "persona_id").agg(F.count("*").alias("count"), F.max("doc_id").alias("last_seen"))


@query(f"WITH {_TERMS} SELECT term, count(*) AS spread, sum(count)::BIGINT AS n FROM terms GROUP BY term")
def persona_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of terms is one term of one persona, so the number of rows is the number of personas."""
    return _terms(spark, sf_dir).groupBy("term").agg(F.count("*").alias("spread"), F.sum("count").alias("n"))


@query(f"WITH {_TERMS} SELECT term, persona_id, count FROM terms WHERE term IN (SELECT term FROM terms WHERE count <= 1 AND last_seen < 500)")
def rare_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.rare_terms(_terms(spark, sf_dir), 500 + 86400, 1).select("term", "persona_id", "count")


@query(f"WITH {EV} SELECT window_tag, speaker_id, max(ts) AS last_ts FROM ev GROUP BY ALL HAVING max(ts) >= {AS_OF} - 86400")
def recall_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.recalled(event_timeline(spark, sf_dir), ["window_tag", "speaker_id"], AS_OF, 86400)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey > 0 AND 700000 - o_orderkey > 400000")
def draft_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.expired_drafts(table(spark, sf_dir, "orders").withColumn("created_at", F.col("o_orderkey")), 700000, 400000).select("o_orderkey")


@query(f"""WITH a(ask_id, speaker_id, window_tag, now) AS (VALUES (1, 'u3', 'qq:FriendMessage:9', 6 * 86400 + 300), (2, 'u6', 'qq:GroupMessage:2', 6 * 86400 + 600), (3, 'u17', 'other', 17 * 86400 + 600), (4, 'u6', 'qq:FriendMessage:1', 6 * 86400 + 900)), {TL},
  m AS (SELECT ask_id, a.window_tag AS win, tl.*, row_number() OVER (PARTITION BY ask_id ORDER BY ts DESC, id DESC) AS n FROM a JOIN tl USING (speaker_id) WHERE role = 'user' AND tl.window_tag <> a.window_tag AND ts BETWEEN now - 1800 AND now QUALIFY n <= 24),
  v AS (SELECT *, contains(window_tag, 'Group') AS g, trim(content) AS c FROM m WHERE win <> 'other' AND (contains(win, 'Friend') OR FALSE)),
  k AS (SELECT *, row_number() OVER (PARTITION BY ask_id ORDER BY ts DESC, id DESC) AS r FROM v WHERE length(c) >= 2 AND NOT regexp_matches(c, '^[/／!！]') AND regexp_matches(c, '[\\p{{L}}\\p{{N}}]') QUALIFY r <= 6),
  l AS (SELECT ask_id, id, ts, '- ' || strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%m-%d %H:%M') || ' 在' || CASE WHEN g THEN '群里' ELSE '私聊里' END || '说过：' || {_CLIP.format("c", 60)} AS line FROM k),
  u AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY ask_id ORDER BY ts, id) AS used, row_number() OVER (PARTITION BY ask_id ORDER BY ts, id)::INT AS place FROM l) SELECT ask_id, id, place, line FROM u WHERE used <= 200""")
def cross_window_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    asks = spark.createDataFrame([(1, "u3", "qq:FriendMessage:9", 6 * 86400 + 300), (2, "u6", "qq:GroupMessage:2", 6 * 86400 + 600), (3, "u17", "other", 17 * 86400 + 600), (4, "u6", "qq:FriendMessage:1", 6 * 86400 + 900)], "ask_id int, speaker_id string, window_tag string, now long")
    return flow.cross_windows(asks, conversation_timeline(spark, sf_dir), chars=200)


@query(f"""WITH {TL}, late AS (SELECT * FROM tl WHERE window_tag <> 'qq:GroupMessage:6' AND ts BETWEEN 864000 - 5 * 86400 AND 864000 ORDER BY ts DESC, id DESC LIMIT 48),
  s AS (SELECT *, trim(content) AS c FROM late WHERE contains(window_tag, 'Group') AND role IN ('user', 'assistant') AND length(trim(content)) >= 2 AND NOT regexp_matches(trim(content), '^[/／!！]') AND regexp_matches(content, '[\\p{{L}}\\p{{N}}]')),
  w AS (SELECT window_tag, max(ts) AS last FROM s GROUP BY 1 ORDER BY last DESC, window_tag LIMIT 3), n AS (SELECT count(*) AS n FROM w),
  d AS (SELECT s.*, row_number() OVER (PARTITION BY window_tag ORDER BY ts DESC, id DESC) AS r FROM s JOIN w USING (window_tag), n QUALIFY r <= greatest(4, 12 // n)),
  l AS (SELECT *, '[' || strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%m-%d %H:%M') || '] ' || CASE WHEN role = 'assistant' THEN '我(Bot)' ELSE speaker_id END || ': ' || {_CLIP.format("trim(replace(content, chr(10), ' '))", 40)} AS line, row_number() OVER (ORDER BY ts DESC, id DESC) AS k FROM d QUALIFY k <= 12),
  u AS (SELECT *, sum(length(line) + 1) OVER (ORDER BY ts DESC, id DESC) AS used FROM l QUALIFY used <= 500)
  SELECT id, window_tag, regexp_extract(window_tag, '([0-9]+)$', 1) AS label, row_number() OVER (ORDER BY ts, id)::INT AS place, line FROM u""")
def window_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.window_flow(conversation_timeline(spark, sf_dir), "qq:GroupMessage:6", 864000, hours=120, items=12, chars=500, message_chars=40, isolation="strict")


@query(f"WITH {_EPISODES} SELECT status, id, row_number() OVER (PARTITION BY status ORDER BY start_ts DESC, id)::INT AS rank FROM episodes WHERE NOT review QUALIFY rank <= 40")
def episode_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes by status, the newest first, without those that wait for a review."""
    e = event_episodes(spark, sf_dir).where("review_status != 'needs_review'")
    return windows.top_per_key(e, ["status"], [F.desc("start_ts"), F.col("id")], 40).select("status", "id", "rank")


@query("SELECT vec_id FROM embeddings WHERE embedding IS NULL OR len(embedding) = 0 OR vec_id % 97 = 0")
def missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose vector is null or empty; every 97th is emptied here, as the table has none."""
    e = table(spark, sf_dir, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 97 != 0, F.col("embedding")))
    return filters.without_vector(e, "embedding").select("vec_id")


@query(f"""WITH {_EPISODES} SELECT id FROM episodes WHERE end_ts >= {AS_OF - 3 * 86400} AND start_ts <= {AS_OF}""")
def overlapping_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.overlapping(event_episodes(spark, sf_dir), AS_OF - 3 * 86400, AS_OF).select("id")


@query(f"""WITH {TL}, w AS (SELECT window_tag, max(ts) AS last_ts FROM tl WHERE window_tag LIKE '%Group%' GROUP BY 1 ORDER BY last_ts DESC, window_tag LIMIT 20)
  SELECT window_tag, regexp_extract(window_tag, '([0-9]+)$', 1) AS label, 'qq' AS platform, row_number() OVER (ORDER BY last_ts DESC, window_tag)::INT AS ordinal FROM w""")
def named_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest groups, with the number by which one can be asked for."""
    tl = conversation_timeline(spark, sf_dir)
    w = aggregates.recent_windows(tl.where(F.contains("window_tag", F.lit("Group"))), 0, 20)
    place = F.row_number().over(Window.orderBy(F.desc("last_ts"), "window_tag"))  # 20 rows
    return w.select("window_tag", window_label(F.col("window_tag")).alias("label"), platform_of(F.col("window_tag")).alias("platform"), place.alias("ordinal"))


@query(f"""WITH {TL} SELECT window_tag, count(*) FILTER (WHERE ts > conv * 86400 + 120) AS since, max(ts) AS last_ts, {86400 * 300} - max(ts) >= 86400 AS idle FROM (SELECT *, regexp_extract(window_tag, '([0-9]+)$', 1)::BIGINT AS conv FROM tl) GROUP BY window_tag""")
def idle_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages since a moment of each window, and whether the window has been silent for a day."""
    tl = conversation_timeline(spark, sf_dir).withColumn("_from", window_label(F.col("window_tag")).cast("long") * 86400 + 120)
    return aggregates.idle(tl, "window_tag", F.col("_from"), 86400 * 300, 86400)


@query("SELECT n_nationkey, list_filter(list_transform(string_split(n_name || ' , ,x', ','), lambda s: trim(s)), lambda s: s <> '') AS items FROM nation")
def csv_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", csv_items(F.concat("n_name", F.lit(" , ,x"))).alias("items"))


@query("""WITH n AS (SELECT c_mktsegment AS speaker_name, c_nationkey AS speaker_id, count(*) AS n FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0) GROUP BY ALL),
  m AS (SELECT *, count(*) OVER (PARTITION BY speaker_name) AS ids, row_number() OVER (PARTITION BY speaker_name ORDER BY n DESC, speaker_id)::INT AS rank FROM n)
  SELECT speaker_name, speaker_id, n, rank FROM m WHERE ids > 1 ORDER BY n DESC, speaker_name, speaker_id LIMIT 20""")
def same_name_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("speaker_name"), F.col("c_nationkey").alias("speaker_id"))
    return people.same_name_suggestions(seen, table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("alias"))).select("speaker_name", "speaker_id", "n", "rank")


@query("""WITH a(id, updated_at, term, meaning) AS (SELECT doc_id, doc_id % 50, split_part(text, ' ', 1), lang FROM documents), q AS (SELECT item_id AS query_id, text AS query FROM benchmark)
  SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY updated_at DESC, id DESC)::INT AS place FROM a JOIN q ON list_contains(regexp_split_to_array(lower(query), '[^A-Za-z0-9_]+'), lower(term)) QUALIFY place <= 3""")
def terms_for_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 50).alias("updated_at"), F.split_part("text", F.lit(" "), F.lit(1)).alias("term"), F.col("lang").alias("meaning"))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return review.picked_samples(a, q, 3, True)


@query("""WITH a AS (SELECT c_custkey AS id, c_custkey % 50 AS updated_at, c_nationkey AS user_key FROM customer), o AS (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY updated_at DESC, id DESC) AS n FROM a QUALIFY n = 1),
  t AS (SELECT id, row_number() OVER (ORDER BY updated_at DESC, id DESC)::INT AS place FROM o QUALIFY place <= 2) SELECT item_id AS query_id, id, place FROM benchmark, t""")
def samples_for_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 50).alias("updated_at"), F.col("c_nationkey").alias("user_key"))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return review.picked_samples(a, q, 2, False)


@query(f"""WITH {_MEMORY}, {_EPISODES},
  f AS (SELECT mem.id, CASE WHEN speaker_id::BIGINT % 7 = 0 THEN 'nick' ELSE 'user' END || speaker_id AS who, CASE WHEN mem.id % 3 = 0 THEN ['fresh' || mem.id % 20, val] ELSE [attribute, val, 'word' || mem.id % 50] END AS words,
    CASE WHEN mem.id % 4 = 0 THEN attribute WHEN mem.id % 4 = 1 AND mem.id % 3 > 0 THEN 'music' END AS topic, p AS persona FROM mem WHERE mem.id % 10 > 0),
  e AS (SELECT id, CASE WHEN speakers[1]::BIGINT % 7 = 0 THEN 'nick' ELSE 'user' END || speakers[1] AS who, speakers[2] AS other, title, p AS persona FROM episodes),
  n AS (SELECT 'fact' AS ref, id AS ref_id, persona, who AS name, 0 AS k FROM f UNION ALL SELECT 'fact', id, persona, unnest(words), 1 FROM f UNION ALL SELECT 'fact', id, persona, topic, 2 FROM f
    UNION ALL SELECT 'event', id, persona, unnest([who, other]), 0 FROM e UNION ALL SELECT 'event', id, persona, replace(title, ' ', ''), 1 FROM e)
  SELECT name, ref, ref_id, ['person', 'keyword', 'topic'][max(k) + 1] AS kind, persona AS persona_id FROM n WHERE length(name) BETWEEN 2 AND 20 AND NOT regexp_full_match(name, '[0-9]+') GROUP BY name, ref, ref_id, persona""")
def entity_links_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of facts and episodes after a seventh of the speakers got other names, and then a third of the facts other words
    and a tenth went: each as a change of the kept index. SQL builds them anew from what holds at the end."""
    c, i = F.col, F.col("id")
    seventh = c("speaker_id").try_cast("long") % 7 == 0
    plain = memory_facts(spark, sf_dir).withColumns({"keywords": F.array("attribute", "value", F.concat(F.lit("word"), (i % 50).cast("string"))), "topic": F.when(i % 4 == 0, c("attribute")).when(i % 4 == 1, "music")})
    facts = plain.select("id", "speaker_id", "speaker_name", "keywords", "topic", "persona_id", "attribute", "value")
    named = facts.withColumn("speaker_name", F.when(seventh, F.concat(F.lit("nick"), "speaker_id")).otherwise(c("speaker_name")))
    worded = named.where(i % 10 > 0).withColumn("topic", F.when(~((i % 3 == 0) & (i % 4 == 1)), c("topic"))).withColumn("keywords", F.when(i % 3 == 0, F.array(F.concat(F.lit("fresh"), (i % 20).cast("string")), c("value"))).otherwise(c("keywords")))
    who = lambda word: F.array(F.struct(c("event_speakers")[0].alias("id"), F.concat(word, c("event_speakers")[0]).alias("name")), F.struct(F.lit("guest").alias("id"), c("event_speakers")[1].alias("name")))
    old = event_episodes(spark, sf_dir).withColumn("keywords", F.array("title"))
    episodes_before = old.select("id", who(F.lit("user")).alias("participants"), "keywords", "persona_id")
    episodes_after = old.select("id", who(F.when(c("event_speakers")[0].cast("long") % 7 == 0, "nick").otherwise("user")).alias("participants"), "keywords", "persona_id")
    index = links.LinkIndex(spark, f"{shared_dir(spark)}/mnemora/links-{uuid.uuid4().hex}", buckets=16)
    index.build(links.fact_links(facts).unionByName(links.episode_links(episodes_before)))
    renamed = links.refs_of_speakers(named, episodes_after, facts.where(seventh).select("speaker_id").distinct())
    index.relink(renamed, links.fact_links(named).unionByName(links.episode_links(episodes_after)))
    index.relink(facts.where((i % 3 == 0) | (i % 10 == 0)).select(F.lit("fact").alias("ref"), i.alias("ref_id")), links.fact_links(worded))
    return index.links()


_EDITS = f"""{FACTS}, ed AS (SELECT event_id AS edit_id, epoch_us(ts) // 1000000 AS ts, CASE WHEN event_id // 40 % 13 = 5 THEN -1 - event_id ELSE event_id - event_id % 40 END AS ref_id, CASE WHEN event_id % 5 > 0 THEN 1 + event_id % 40 // 3 END AS base,
  CASE WHEN event_id % 80 = 33 THEN 'delete' WHEN event_id % 7 = 0 THEN 'approve' WHEN event_id % 7 = 1 THEN 'status' ELSE 'edit' END AS op, CASE WHEN event_id % 7 > 3 THEN 'v' || round(value)::BIGINT END AS value,
  CASE event_id % 7 WHEN 2 THEN (event_id % 300 / 200.0::DOUBLE)::VARCHAR WHEN 3 THEN 'high' END AS importance, ['archived', ' live ', 'gone'][event_id % 3 + 1] AS status FROM events),
n AS (SELECT ed.*, row_number() OVER (PARTITION BY ref_id ORDER BY ed.ts, edit_id) AS n, CASE WHEN facts.id IS NOT NULL THEN 1 ELSE -1 END AS start,
  CASE WHEN op = 'edit' AND ed.importance = 'high' THEN 'bad_importance' WHEN op = 'status' AND ed.status = 'gone' THEN 'bad_status' ELSE 'applied' END AS does FROM ed LEFT JOIN facts ON facts.id = ref_id),
fold AS (SELECT n.*, CASE WHEN start < 0 THEN 'not_found' WHEN base <> start THEN 'stale' ELSE does END AS outcome, CASE WHEN start < 0 THEN -1 WHEN base <> start OR does <> 'applied' THEN start WHEN op = 'delete' THEN -1 ELSE start + 1 END AS rev FROM n WHERE n = 1
  UNION ALL SELECT n.*, CASE WHEN rev < 0 THEN 'not_found' WHEN n.base <> rev THEN 'stale' ELSE n.does END, CASE WHEN rev < 0 THEN -1 WHEN n.base <> rev OR n.does <> 'applied' THEN rev WHEN n.op = 'delete' THEN -1 ELSE rev + 1 END FROM fold JOIN n ON n.ref_id = fold.ref_id AND n.n = fold.n + 1)"""


def _edits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Facts at revision 1, and every event as an edit of the first fact of its forty, or of none; most name a revision."""
    f, i, c = memory_facts(spark, sf_dir), F.col("id"), F.col
    facts = f.select("id", F.lit(1).cast("long").alias("revision"), "slot_key", F.lit("").alias("persona_id"), "speaker_id", "speaker_name", F.lit("self").alias("subject"), "attribute", "value", "content", F.lit("").alias("plain"), F.lit("").alias("topic"), "importance", "confidence", "status", F.lit("").alias("review_status"), "pinned", "updated_at")
    e = event_timeline(spark, sf_dir)
    op = F.when(i % 80 == 33, "delete").when(i % 7 == 0, "approve").when(i % 7 == 1, "status").otherwise("edit")
    asked = e.select(
        i.alias("edit_id"), "ts", F.when(F.floor(i / 40) % 13 == 5, -1 - i).otherwise(i - i % 40).alias("ref_id"), F.when(i % 5 > 0, 1 + F.floor(i % 40 / 3)).alias("base"), op.alias("op"), F.when(i % 7 > 3, F.concat(F.lit("v"), F.round(c("value")).cast("long").cast("string"))).alias("value"),
        F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("plain"), F.when(i % 7 == 2, (i % 300 / 200.0).cast("string")).when(i % 7 == 3, "high").alias("importance"), F.when(i % 3 == 0, "archived").when(i % 3 == 1, " live ").otherwise("gone").alias("status"),
    )
    return facts, asked


@query(f"""WITH RECURSIVE {_EDITS} SELECT edit_id, ref_id, outcome, CASE WHEN rev >= 0 THEN rev END AS revision, 1 + sum((outcome = 'applied')::INT) OVER (ORDER BY ts, edit_id)::BIGINT AS store_revision FROM fold""")
def edit_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, asked = _edits(spark, sf_dir)
    return edits.store_revisions(edits.decided(asked, facts)).select("edit_id", "ref_id", "outcome", "revision", "store_revision")


@query(f"""WITH RECURSIVE {_EDITS}, a AS (SELECT ref_id, count(*) AS k, max(ts) AS newest, bool_or(op = 'delete') AS gone, bool_or(op = 'approve') AS yes, bool_or(op = 'edit' AND (value IS NOT NULL OR importance IS NOT NULL)) AS said,
    arg_max(value, (ts, edit_id)) FILTER (WHERE op = 'edit' AND value IS NOT NULL) AS v, arg_max(try_cast(importance AS DOUBLE), (ts, edit_id)) FILTER (WHERE op = 'edit' AND importance IS NOT NULL) AS imp,
    arg_max(CASE WHEN op = 'approve' THEN 'live' ELSE trim(status) END, (ts, edit_id)) FILTER (WHERE op IN ('approve', 'status')) AS st FROM fold WHERE outcome = 'applied' GROUP BY ref_id),
  f AS (SELECT id, speaker_id, slot_key, coalesce(v, facts.value::VARCHAR) AS value, coalesce(st, status) AS status, CASE WHEN imp IS NULL THEN importance ELSE greatest(0.0, least(1.0, imp)) END AS importance, CASE WHEN yes THEN greatest(confidence, 0.8) ELSE confidence END AS confidence,
    CASE WHEN said OR yes THEN 'manual' ELSE '' END AS review_status, 1 + coalesce(k, 0) AS revision, pinned, coalesce(newest, updated_at) AS updated_at, coalesce(said, false) AS said FROM facts LEFT JOIN a ON ref_id = id WHERE NOT coalesce(gone, false)),
  w AS (SELECT *, row_number() OVER s AS place, first_value(pinned) OVER s AS top FROM f WHERE status = 'live' AND speaker_id IN (SELECT speaker_id FROM f WHERE said) WINDOW s AS (PARTITION BY slot_key ORDER BY pinned DESC, updated_at DESC, confidence DESC, id))
  SELECT f.id, f.slot_key, f.value, CASE WHEN place > 1 AND NOT (f.pinned AND top) THEN 'archived' ELSE f.status END AS status, round(f.importance, 6) AS importance, round(f.confidence, 6) AS confidence, f.review_status, f.revision, f.updated_at FROM f LEFT JOIN w ON w.id = f.id""")
def edited_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, asked = _edits(spark, sf_dir)
    log = written(edits.decided(asked, facts), "edits")
    return edits.edited(facts, asked, log).select("id", "slot_key", "value", "status", F.round("importance", 6).alias("importance"), F.round("confidence", 6).alias("confidence"), "review_status", "revision", "updated_at")


@query(f"""WITH {EV}, r AS (SELECT id AS review_id, CASE WHEN id % 9 = 0 THEN 'approved' ELSE 'pending' END AS status FROM ev WHERE kind = 'error'),
  d AS (SELECT id AS decision_id, ts, lag(CASE WHEN kind = 'error' THEN id END IGNORE NULLS) OVER (PARTITION BY speaker_id ORDER BY ts, id) AS review_id, CASE kind WHEN 'click' THEN 'approve' WHEN 'view' THEN 'reject' ELSE 'later' END AS verdict FROM ev WHERE true QUALIFY kind <> 'error'),
  o AS (SELECT d.*, r.status, row_number() OVER (PARTITION BY d.review_id, verdict <> 'later' ORDER BY ts, decision_id) AS n FROM d LEFT JOIN r USING (review_id))
  SELECT decision_id, review_id, CASE WHEN verdict = 'later' THEN 'bad_verdict' WHEN status IS DISTINCT FROM 'pending' OR n > 1 THEN 'not_pending' WHEN verdict = 'approve' THEN 'approved' ELSE 'rejected' END AS outcome FROM o""")
def reviews_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as reviews; a user's later events decide on their last error."""
    e, c = event_timeline(spark, sf_dir), F.col
    reviews = e.where("kind = 'error'").select(c("id").alias("review_id"), F.when(c("id") % 9 == 0, "approved").otherwise("pending").alias("status"))
    before = Window.partitionBy("speaker_id").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(c("kind") == "error", c("id")), ignorenulls=True).over(before)
    verdict = F.when(c("kind") == "click", "approve").when(c("kind") == "view", "reject").otherwise("later")
    decisions = e.select(c("id").alias("decision_id"), "ts", last.alias("review_id"), verdict.alias("verdict"), "kind").where("kind <> 'error'").drop("kind")
    return edits.reviews_resolved(reviews, decisions)
