"""The named queries over the tables of a data folder, each with the SQL that gives the same rows.

A query is registered by @query(sql); its name is the function's. Floating results are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemora.functions import gates, scores, text, timeparse
from mnemora.operators import aggregates, filters, joins, maintenance, retrieval, search, windows
from mnemora.sources import jsonl
from mnemora.storage import written
from mnemora.sources.tables import conversation_timeline, event_facts, event_timeline, spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

TL = """tl AS (SELECT conv_id * 1000 + turn AS id, conv_id * 86400 + turn * 60 AS ts,
  CASE WHEN conv_id % 2 = 0 THEN 'qq:GroupMessage:' ELSE 'qq:FriendMessage:' END || conv_id AS window_tag,
  CASE WHEN role = 'assistant' THEN 'bot_self' ELSE 'u' || (conv_id % 37) END AS speaker_id, role, text AS content FROM conversations)"""
EV = """ev AS (SELECT event_id AS id, epoch_us(ts) // 1000000 AS ts, user_id AS speaker_id, 'qq:GroupMessage:' || event_type AS window_tag, event_type AS kind, value FROM events)"""
FACTS = """k AS (SELECT *, json_extract_string(props, '$.k')::INT AS k, epoch_us(ts) // 1000000 AS s FROM events),
facts AS (SELECT event_id AS id, '|' || user_id || '|self|' || event_type AS slot_key, user_id::VARCHAR AS speaker_id, event_type AS attribute,
  round(value)::BIGINT AS value, (floor(value)::BIGINT % 10) / 10.0::DOUBLE AS confidence, k / 100.0::DOUBLE AS importance, k % 29 = 0 AS pinned, k % 5 AS access_count,
  CASE WHEN k % 7 = 0 THEN 'owner' ELSE 'person' END AS scope, CASE WHEN k % 11 = 0 THEN 'archived' WHEN k % 13 = 0 THEN 'superseded' ELSE 'live' END AS status,
  s AS created_at, s + k * 3600 AS updated_at, CASE WHEN k % 17 = 0 THEN s + 86400 ELSE 0 END AS expires_at FROM k)"""
#: 2024-01-20 00:00 UTC, inside the month of the events table.
AS_OF = 1705708800
#: Marks and words of questions, of which a text holds one.
ASKS = "|".join(m.replace("?", "[?]") for m in gates.QUESTION)
TOKENS = r"list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+'), lambda t: length(t) <= 32)"


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add





@query(f"WITH {FACTS} SELECT id, speaker_id, confidence, updated_at FROM facts WHERE status = 'live' AND (speaker_id IN ('1', '2', '3', '', 'bot_self') OR scope = 'owner') ORDER BY confidence DESC, updated_at DESC, id LIMIT 240")
def live_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.live_facts(event_facts(spark, sf_dir), ["1", "2", "3"], 240).select("id", "speaker_id", "confidence", "updated_at")


@query(f"WITH {FACTS} SELECT status, count(*) AS n FROM facts GROUP BY status")
def status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_facts(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH {FACTS} SELECT id, slot_key, status FROM facts WHERE created_at <= {AS_OF} AND (status = 'live' OR (status IN ('superseded', 'archived') AND updated_at >= {AS_OF - 5 * 86400}))
  AND (expires_at = 0 OR expires_at >= {AS_OF - 5 * 86400})""")
def interval_overlap_valid_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.valid_between(event_facts(spark, sf_dir), AS_OF - 5 * 86400, AS_OF).select("id", "slot_key", "status")


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'and') OR contains(lower(source), 'and')")
def like_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.contains_any(table(spark, sf_dir, "documents"), "and", ["text", "source"]).select("doc_id", "lang")


@query(f"""WITH {FACTS} SELECT reason, count(*) AS n FROM (SELECT CASE WHEN status <> 'live' THEN 'not_live' WHEN expires_at > 0 AND expires_at < {AS_OF} THEN 'expired'
  WHEN scope = 'owner' THEN 'owner_private' WHEN speaker_id IN ('7', '8', 'bot_self', '') THEN CASE WHEN {AS_OF} - updated_at > 172800 AND attribute NOT IN ('likes', 'name', 'identity') THEN 'stale_for_status' ELSE 'visible' END
  WHEN length(speaker_id) >= 2 AND contains('what does 12 do', lower(speaker_id)) THEN 'visible' ELSE 'other_speaker' END AS reason FROM facts) GROUP BY reason""")
def visibility_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = event_facts(spark, sf_dir)
    reason = gates.fact_block_reason(F.col("status"), F.col("expires_at"), F.lit(""), F.col("scope"), F.col("speaker_id"), F.col("speaker_id"), as_of=F.lit(AS_OF), ask_persona="", asker=["7", "8"], owners=["1"], query="what does 12 do", route_name="current_status", attribute=F.col("attribute"), updated=F.col("updated_at"))
    return f.select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""WITH {TL} SELECT id, CASE WHEN trim(content) = '' OR regexp_matches(trim(content), '{gates.LOW_INFO}') THEN 'low_info' WHEN regexp_matches(content, '{gates.HISTORY}') THEN 'history'
  WHEN regexp_matches(content, '{gates.STATUS}') THEN 'current_status' WHEN regexp_matches(content, '{gates.TIME_WINDOW}') THEN 'time_window' WHEN regexp_matches(content, '{gates.RECALL}') THEN 'recall' ELSE 'long_term' END AS route FROM tl""")
def route_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_timeline(spark, sf_dir).select("id", gates.route(F.col("content")).alias("route"))


@query(r"WITH " + TL + r""" SELECT id, CASE WHEN length(trim(content)) < 2 THEN 'too_short' WHEN regexp_matches(trim(content), '^[/／!！]') THEN 'command' WHEN NOT regexp_matches(trim(content), '[\p{L}\p{N}]') THEN 'no_content' ELSE '' END AS reason,
  regexp_matches(content, '""" + ASKS + """') AS question FROM tl""")
def candidate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_timeline(spark, sf_dir).select("id", gates.text_usable(F.col("content")).alias("reason"), gates.question_like(F.col("content")).alias("question"))


@query(f"""WITH {TL}, w AS (SELECT DISTINCT window_tag, CASE WHEN window_tag LIKE '%GroupMessage%' THEN 'group' ELSE 'private' END AS kind FROM tl)
  SELECT a.window_tag AS source, b.kind AS target_kind, b.kind = 'private' OR a.kind = 'private' AS allowed FROM w a, (SELECT DISTINCT kind FROM w) b""")
def window_kind_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = conversation_timeline(spark, sf_dir).select("window_tag", gates.window_kind(F.col("window_tag")).alias("kind")).distinct()
    kinds = F.explode(F.array(F.lit("group"), F.lit("private"))).alias("target_kind")
    both = w.select("window_tag", "kind", kinds)
    allowed = gates.direction_allowed(F.col("kind"), F.col("target_kind"), private_to_group=True)
    return both.select(F.col("window_tag").alias("source"), "target_kind", allowed.alias("allowed"))


@query("SELECT event_id, CASE WHEN hour(ts) * 60 + minute(ts) >= 1380 OR hour(ts) * 60 + minute(ts) < 420 THEN true ELSE hour(ts) * 60 + minute(ts) BETWEEN 780 AND 839 END AS quiet FROM events")
def quiet_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = timeparse.quiet_ranges("23:00-7:00;13:00-14:00")
    return table(spark, sf_dir, "events").select("event_id", gates.quiet(F.col("ts"), ranges).alias("quiet"))


@query(f"""WITH {TL}, g AS (SELECT id, ts, window_tag, content, role, lag(ts) OVER (PARTITION BY window_tag ORDER BY ts, id) AS last FROM tl)
  SELECT id, CASE WHEN window_tag NOT LIKE '%GroupMessage%' THEN 'not_group' WHEN role = 'assistant' THEN 'self' WHEN length(trim(content)) < 2 THEN 'too_short' WHEN regexp_matches(trim(content), '^[/／!！]') THEN 'command'
  WHEN ts - last < 60 THEN 'cooldown' WHEN contains(lower(content), 'the') THEN 'fire:name' WHEN regexp_matches(content, '{ASKS}') THEN 'fire:question' ELSE 'miss' END AS outcome FROM g""")
def reply_gate_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("window_tag").orderBy("ts", "id")
    tl = conversation_timeline(spark, sf_dir).withColumn("last", F.lag("ts").over(w))
    kind = gates.window_kind(F.col("window_tag")) == "group"
    out = gates.reply_gate(F.lit(True), kind, F.col("role") == "assistant", F.col("window_tag"), [], F.col("content"), F.lit(False), F.col("ts") - F.col("last"), F.lit(0), F.contains(F.lower("content"), F.lit("the")), gates.question_like(F.col("content")), cooldown=60)
    return tl.select("id", out.alias("outcome"))





@query("SELECT c_custkey, c_name, count(o_orderkey) AS facts FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name")
def profile_fact_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.with_count(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), ("c_custkey", "o_custkey"), "facts").select("c_custkey", "c_name", "facts")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def empty_profile_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(big, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def entity_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(named, "o_custkey", "left_semi").select("o_orderkey")


@query(f"""WITH names AS (SELECT DISTINCT unnest({TOKENS.format("text")}) AS name FROM benchmark),
  t AS (SELECT DISTINCT conv_id * 1000 + turn AS id, unnest({TOKENS.format("text")}) AS tok FROM conversations) SELECT id, name FROM t JOIN names ON tok = name""")
def entity_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "benchmark").select(F.explode(text.tokens(F.col("text"))).alias("name")).distinct()
    return joins.mentions(conversation_timeline(spark, sf_dir), names, "id", "content", "name")


@query("""WITH RECURSIVE l AS (SELECT n_nationkey AS k, n_nationkey // 2 AS t FROM nation WHERE n_nationkey > 0),
  walk AS (SELECT k, t, 1 AS d FROM l UNION ALL SELECT w.k, l.t, w.d + 1 FROM walk w JOIN l ON w.t = l.k WHERE w.d < 4)
  SELECT k AS n_nationkey, t AS reached, min(d) AS depth FROM walk GROUP BY k, t""")
def alias_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "nation").where("n_nationkey > 0").withColumn("up", F.floor(F.col("n_nationkey") / 2).cast("int"))
    return joins.closure(links, "n_nationkey", "up", 4)


@query(f"""WITH {FACTS}, c AS (SELECT *, lead(id) OVER (PARTITION BY slot_key ORDER BY created_at, id) AS nx FROM facts),
  l AS (SELECT id, coalesce(nx, id) AS nx FROM c)
  SELECT a.id, coalesce(d.nx, c.nx, b.nx, a.id) AS resolved, (b.id IS NOT NULL)::INT + (c.id IS NOT NULL)::INT + (d.id IS NOT NULL)::INT AS hops
  FROM l a LEFT JOIN (FROM l WHERE id <> nx) b ON a.id = b.id LEFT JOIN (FROM l WHERE id <> nx) c ON b.nx = c.id LEFT JOIN (FROM l WHERE id <> nx) d ON c.nx = d.id""")
def supersede_chain_3hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("slot_key").orderBy("created_at", "id")
    links = event_facts(spark, sf_dir).select("id", F.coalesce(F.lead("id").over(w), "id").alias("next"))
    return joins.resolve_chain(links, "id", "next", 3)


@query(f"""WITH {TL}, g AS (SELECT *, lag(role) OVER w AS r, lag(id) OVER w AS i, lag(ts) OVER w AS t FROM tl WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY window_tag ORDER BY ts, id))
  SELECT window_tag, i AS user_id, id AS bot_id, ts - t AS wait FROM g WHERE role = 'assistant' AND r = 'user' AND ts - t <= 90""")
def user_bot_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.answered_pairs(conversation_timeline(spark, sf_dir))


@query(f"""WITH {EV}, l AS (SELECT id, ts, lag(id) OVER w AS before, lag(ts) OVER w AS before_ts FROM ev WINDOW w AS (PARTITION BY window_tag ORDER BY ts, id))
  SELECT id, CASE WHEN ts - before_ts <= 7200 THEN before END AS found FROM l""")
def merge_target_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = windows.with_previous(event_timeline(spark, sf_dir), ["window_tag"], ["id", "ts"])
    return d.select("id", F.when(F.col("ts") - F.col("previous.ts") <= 7200, F.col("previous.id")).alias("found"))


@query(f"""WITH {EV}, n AS (SELECT a.id, min(b.ts) AS nx FROM ev a LEFT JOIN ev b ON a.window_tag = b.window_tag AND a.speaker_id <> b.speaker_id AND (b.ts, b.id) > (a.ts, a.id) GROUP BY a.id)
  SELECT id FROM n JOIN ev USING (id) WHERE nx IS NULL OR nx - ts > 3600""")
def unanswered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.unanswered(event_timeline(spark, sf_dir), 3600).select("id")


@query(f"WITH {FACTS} SELECT count(*) FILTER (WHERE status = 'live') AS live, count(*) FILTER (WHERE status = 'archived') AS archived, count(*) FILTER (WHERE pinned) AS pinned, count(*) FILTER (WHERE scope = 'owner' AND status = 'live') AS owner FROM facts")
def library_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = F.col("status") == "live"
    return aggregates.conditional_counts(event_facts(spark, sf_dir), live=live, archived=F.col("status") == "archived", pinned=F.col("pinned"), owner=live & (F.col("scope") == "owner"))


@query(f"WITH {TL} SELECT window_tag, count(*) AS n, max(ts) AS last_ts FROM tl WHERE ts >= 864000 GROUP BY window_tag ORDER BY last_ts DESC, window_tag LIMIT 50")
def recent_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.recent_windows(conversation_timeline(spark, sf_dir), 864000, 50)


@query(f"WITH {FACTS} SELECT speaker_id, count(*) AS n, max(attribute) AS name FROM facts WHERE status = 'live' GROUP BY speaker_id ORDER BY n DESC, speaker_id LIMIT 80")
def live_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = event_facts(spark, sf_dir).where("status = 'live'").groupBy("speaker_id").agg(F.count("*").alias("n"), F.max("attribute").alias("name"))
    return d.orderBy(F.desc("n"), "speaker_id").limit(80)


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority, count(*) AS calls, count(*) FILTER (WHERE o_orderstatus <> 'F') AS failed, sum(o_custkey)::BIGINT AS tokens FROM orders GROUP BY ALL")
def usage_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.usage_by_day(table(spark, sf_dir, "orders"), "o_orderdate", ["o_orderpriority"], F.col("o_orderstatus") == "F", F.col("o_custkey"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS calls, sum(l_orderkey)::BIGINT AS tokens, max(l_suppkey) AS last FROM lineitem GROUP BY ALL")
def usage_by_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("calls"), F.sum("l_orderkey").alias("tokens"), F.max("l_suppkey").alias("last"))


@query("SELECT lang, term, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[A-Za-z]{2,16}|[一-鿿]{2,8}')) AS term FROM documents) GROUP BY ALL")
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.term_counts(spread(table(spark, sf_dir, "documents").select("text", "lang")), "text", "lang")


@query("""WITH c AS (SELECT source, term, count(*) AS n FROM (SELECT source, unnest(regexp_extract_all(lower(text), '[A-Za-z]{2,16}|[一-鿿]{2,8}')) AS term FROM documents) GROUP BY ALL)
  SELECT term, sum(n)::BIGINT AS n, count(DISTINCT source) AS spread FROM c GROUP BY term HAVING sum(n) >= 4 AND count(DISTINCT source) < 4 AND sum(n) / (SELECT sum(n) FROM c) <= 0.25 ORDER BY n DESC, term LIMIT 20""")
def hot_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = aggregates.term_counts(spread(table(spark, sf_dir, "documents").select("text", "source")), "text", "source")
    return aggregates.hot_terms(counts, "source", 4, 0.25, 4, 20)


@query(f"WITH {EV} SELECT speaker_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS seen_count FROM ev GROUP BY speaker_id")
def profile_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.profiles(event_timeline(spark, sf_dir))


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return aggregates.last_values(log, "user_id", ["ts", "event_id"]).select("user_id", "event_type", "event_id")




_SPLIT: dict[tuple[str, tuple[str, ...]], DataFrame] = {}


def tokens_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of the documents, written once in a session for all queries that search words in the same files."""
    docs = table(spark, sf_dir, "documents")
    key = (spark.sparkContext.applicationId, tuple(sorted(docs.inputFiles())))
    if key not in _SPLIT:
        _SPLIT[key] = written(retrieval.tokenised(spread(docs.select("doc_id", "text"))), "tokens")
    return _SPLIT[key]


_BM25 = f"""q AS (SELECT DISTINCT item_id, unnest({TOKENS.format("text")}) AS term FROM benchmark), terms AS (SELECT DISTINCT term FROM q),
d AS (SELECT doc_id, {TOKENS.format("text")} AS t FROM documents), total AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d) JOIN terms USING (term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (term) JOIN q USING (term), total GROUP BY ALL)"""


def _by_words(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """The n documents of each item with the best BM25 scores."""
    s = search.best(tokens_of(spark, sf_dir), table(spark, sf_dir, "benchmark"), n).select("item_id", "doc_id", F.round("score", 6).alias("score"))
    return retrieval.ranked(s, "item_id", "doc_id", n)


@query(f"WITH {_BM25} SELECT item_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id)::INT AS rank FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_words(spark, sf_dir, 10)


@query(f"WITH {_BM25} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, total")
def idf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, q = tokens_of(spark, sf_dir), table(spark, sf_dir, "benchmark")
    wanted = q.select(F.explode(text.tokens(F.col("text"))).alias("term")).distinct()
    split = docs.select("_d", F.explode_outer(F.array_distinct("_t")).alias("term"))
    df = split.join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    n = F.broadcast(docs.agg(F.count("*").alias("n")))  # one row
    return df.join(n, how="cross").select("term", "df", F.round(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


@query("""SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id, (contains(lower(text), 'the')::INT + contains(lower(text), 'heed')::INT + contains(lower(text), 'ment')::INT) / 3.0::DOUBLE AS score FROM documents)
  ORDER BY score DESC, doc_id LIMIT 50""")
def keyword_score_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.round(text.keyword_score(["the", "heed", "ment"], F.col("text")), 6).alias("score"))
    return d.orderBy(F.desc("score"), "doc_id").limit(50)


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 50 = 0)
  SELECT query_id, vec_id, round(list_cosine_similarity(v::DOUBLE[], embedding::DOUBLE[]), 6) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(v::DOUBLE[], embedding::DOUBLE[]), 6) DESC, vec_id)::INT AS rank
  FROM q, embeddings QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(v::DOUBLE[], embedding::DOUBLE[]), 6) DESC, vec_id) <= 10""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.nearest_by_cosine(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 10)


_FUSED = f"""{_BM25}, a AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s QUALIFY rank <= 32),
k AS (SELECT item_id, doc_id, count(*) AS hits FROM q JOIN tf USING (term) GROUP BY ALL), b AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) AS rank FROM k QUALIFY rank <= 32),
r AS (SELECT item_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM (FROM a UNION ALL FROM b) GROUP BY ALL)"""


def _two_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = search.best(tokens_of(spark, sf_dir), table(spark, sf_dir, "benchmark"), 32, by_hits=True)
    one = found.select("item_id", "doc_id", F.round("score", 6).alias("score"))
    hits = found.select("item_id", "doc_id", F.col("hits").alias("score"))
    return retrieval.ranked(one, "item_id", "doc_id", 32), retrieval.ranked(hits, "item_id", "doc_id", 32)


@query(f"WITH {_FUSED} SELECT item_id, doc_id, round(rrf, 9) AS rrf FROM r")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = retrieval.rrf(_two_lists(spark, sf_dir), "item_id", "doc_id")
    return fused.select("item_id", "doc_id", F.round("rrf", 9).alias("rrf"))


@query(f"""WITH {FACTS} SELECT id, round(CASE WHEN pinned THEN greatest(base, 1.0) ELSE base * pow(0.5, greatest(0.0, ({AS_OF} - greatest(updated_at, created_at)) / 86400.0::DOUBLE) / (30.0 * least(1.0 + 0.5 * access_count, 3.0))) END, 6) AS weight
  FROM (SELECT *, CASE WHEN importance > 0 THEN importance ELSE confidence END AS base FROM facts)""")
def decay_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = event_facts(spark, sf_dir)
    w = scores.decay_weight(F.col("importance"), F.col("confidence"), F.col("pinned"), F.col("access_count"), F.greatest("updated_at", "created_at"), F.lit(AS_OF))
    return f.select("id", F.round(w, 6).alias("weight"))


_SCORE = f"""round(0.2 / (1.0 + greatest(0.0, ({AS_OF} - updated_at) / 86400.0::DOUBLE) / 14.0) + 0.25 * least(1.0, confidence) + 0.15 * (speaker_id = '7')::INT + 2.5 * (value > 90)::INT + 0.12 * (scope = 'owner')::INT + 0.25 * importance + 0.2 * pinned::INT - 0.5 * ({AS_OF} - updated_at > 172800)::INT, 6)"""


@query(f"WITH {FACTS} SELECT id, {_SCORE} AS score FROM facts WHERE status = 'live' ORDER BY score DESC, id LIMIT 32")
def local_score_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, as_of = event_facts(spark, sf_dir).where("status = 'live'"), F.lit(AS_OF)
    s = scores.local_score(F.lit(0.0), scores.recency(as_of, F.col("updated_at")), F.col("confidence"), F.col("speaker_id") == "7", F.col("value") > 90, F.col("scope") == "owner", F.col("importance"), F.col("pinned"), as_of - F.col("updated_at") > 172800)
    return f.select("id", F.round(s, 6).alias("score")).orderBy(F.desc("score"), "id").limit(32)


@query(f"""WITH {_FUSED} SELECT item_id, doc_id, round(rrf + 2.0 * (lang = 'en')::INT + 0.05 / (1.0 + n_chars / 14.0), 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(rrf + 2.0 * (lang = 'en')::INT + 0.05 / (1.0 + n_chars / 14.0), 6) DESC, doc_id)::INT AS rank
  FROM r JOIN documents USING (doc_id) QUALIFY rank <= 16""")
def fused_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = retrieval.rrf(_two_lists(spark, sf_dir), "item_id", "doc_id").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    no = F.lit(False)
    s = scores.fused_score(F.col("rrf"), F.lit(0.0), F.lit(0.0), 1.0 / (1.0 + F.col("n_chars") / 14.0), no, no, F.col("lang") == "en", no)
    return retrieval.ranked(fused.select("item_id", "doc_id", F.round(s, 6).alias("score")), "item_id", "doc_id", 16)


@query(None)
def mmr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tokens_of(spark, sf_dir)
    top = written(_by_words(spark, sf_dir, 32), "top")
    terms = docs.withColumnRenamed("_d", "doc_id").join(top.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.array_distinct("_t").alias("terms"))
    return retrieval.mmr(top.join(terms, "doc_id"), "item_id", "doc_id", "terms", "score", 16)


@query(f"""WITH {FACTS}, h AS (SELECT *, CASE WHEN confidence < 0.3 THEN 'uncertain' WHEN speaker_id IN ('1', '2', '3') THEN 'core' ELSE 'related' END AS kind FROM facts WHERE status = 'live'),
  n AS (SELECT *, row_number() OVER (PARTITION BY attribute, kind ORDER BY confidence DESC, id) AS n FROM h), b AS (SELECT *, CASE WHEN kind = 'core' AND n > 4 THEN 'related' ELSE kind END AS bucket FROM n)
  SELECT attribute, id, bucket, row_number() OVER (PARTITION BY attribute, bucket ORDER BY confidence DESC, id)::INT AS position FROM b
  QUALIFY position <= CASE bucket WHEN 'core' THEN 4 WHEN 'related' THEN 6 ELSE 3 END""")
def slotting(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = event_facts(spark, sf_dir).where("status = 'live'")
    d = retrieval.slots(hits, "attribute", F.col("speaker_id").isin("1", "2", "3"), F.col("confidence") < 0.3, [F.desc("confidence"), F.col("id")])
    return d.select("attribute", "id", "bucket", "position")





@query(f"WITH {FACTS} SELECT id, slot_key, row_number() OVER w = 1 OR (pinned AND first(pinned) OVER w) AS keep FROM facts WINDOW w AS (PARTITION BY slot_key ORDER BY pinned DESC, updated_at DESC, confidence DESC, id)")
def slot_keep_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.slot_keepers(event_facts(spark, sf_dir)).select("id", "slot_key", "keep")


@query(f"""WITH {FACTS}, b AS (SELECT *, lag(value) OVER (PARTITION BY slot_key ORDER BY created_at, id) AS p FROM facts), c AS (FROM b WHERE p IS NULL OR value IS DISTINCT FROM p)
  SELECT id, slot_key, value, created_at AS valid_from, lead(created_at) OVER w AS valid_to, lag(id) OVER w AS supersedes, lead(id) OVER w AS superseded_by FROM c WINDOW w AS (PARTITION BY slot_key ORDER BY created_at, id)""")
def scd2_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.versions(event_facts(spark, sf_dir)).select("id", "slot_key", "value", "valid_from", "valid_to", "supersedes", "superseded_by")


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 200")
def ring_buffer_200(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.newest(table(spark, sf_dir, "events").select("event_id", "event_type"), 200, "event_id")


@query(f"WITH {FACTS} SELECT speaker_id, attribute, id, row_number() OVER (PARTITION BY speaker_id, attribute ORDER BY confidence DESC, updated_at DESC, id)::INT AS rank FROM facts WHERE status = 'live' QUALIFY rank <= 2")
def top2_per_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = event_facts(spark, sf_dir).where("status = 'live'")
    return windows.top_per_key(live, ["speaker_id", "attribute"], [F.desc("confidence"), F.desc("updated_at"), F.col("id")], 2).select("speaker_id", "attribute", "id", "rank")


@query(f"""WITH {TL}, w AS (SELECT window_tag, max(ts) AS last FROM tl GROUP BY window_tag ORDER BY last DESC, window_tag LIMIT 3)
  SELECT window_tag, id, row_number() OVER (PARTITION BY window_tag ORDER BY ts DESC, id DESC)::INT AS rank FROM tl JOIN w USING (window_tag) QUALIFY rank <= 50""")
def flow_top_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.newest_of_newest_windows(conversation_timeline(spark, sf_dir), 3, 50).select("window_tag", "id", "rank")


@query(f"WITH {TL} SELECT window_tag, id, sum(length(content) + 1) OVER (PARTITION BY window_tag ORDER BY ts DESC, id DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM tl QUALIFY used <= 600")
def cross_window_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    tl = conversation_timeline(spark, sf_dir)
    return windows.within_budget(tl, ["window_tag"], [F.desc("ts"), F.desc("id")], F.length("content") + 1, 600).select("window_tag", "id", "used")


@query(f"""WITH {TL}, l AS (SELECT window_tag, list(content ORDER BY ts, id) AS lines FROM tl GROUP BY window_tag)
  SELECT window_tag, len(kept) AS lines, array_to_string(kept, chr(10)) AS pack FROM (SELECT window_tag, list_reduce(list_prepend({{'kept': []::VARCHAR[], 'used': 0::BIGINT}}, list_transform(lines, lambda x: {{'kept': [x], 'used': length(x)::BIGINT}})),
  lambda d, x: CASE WHEN d.used + x.used + CASE WHEN len(d.kept) > 0 THEN 1 ELSE 0 END <= 800 THEN {{'kept': list_concat(d.kept, x.kept), 'used': d.used + x.used + CASE WHEN len(d.kept) > 0 THEN 1 ELSE 0 END}} ELSE d END).kept AS kept FROM l)""")
def pack_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ts", "id", "content"))), lambda x: x["content"])
    d = conversation_timeline(spark, sf_dir).groupBy("window_tag").agg(lines.alias("_lines")).withColumn("kept", windows.packed(F.col("_lines"), 800))
    return d.select("window_tag", F.size("kept").cast("long").alias("lines"), F.array_join("kept", "\n").alias("pack"))


_SESSION = f"""{EV}, g AS (SELECT *, coalesce((ts - lag(ts) OVER w > 2700)::INT, 1) AS new FROM ev WINDOW w AS (PARTITION BY window_tag ORDER BY ts, id)),
sess AS (SELECT *, sum(new) OVER (PARTITION BY window_tag ORDER BY ts, id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g)"""


@query(f"WITH {_SESSION} SELECT id, window_tag, session FROM sess")
def session_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sessions_by_gap(event_timeline(spark, sf_dir), ["window_tag"], 2700).select("id", "window_tag", "session")


@query(f"WITH {_SESSION} SELECT window_tag, session, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS messages, count(DISTINCT speaker_id) AS speakers FROM sess GROUP BY ALL")
def session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = windows.sessions_by_gap(event_timeline(spark, sf_dir), ["window_tag"], 2700)
    return d.groupBy("window_tag", "session").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("messages"), F.countDistinct("speaker_id").alias("speakers"))


@query(f"""WITH RECURSIVE {_SESSION}, p AS (SELECT window_tag, session, id, ts, row_number() OVER (PARTITION BY window_tag, session ORDER BY ts, id) AS n FROM sess),
  r AS (SELECT window_tag, session, id, ts, n, ts AS start, 1 AS part FROM p WHERE n = 1 UNION ALL
    SELECT p.window_tag, p.session, p.id, p.ts, p.n, CASE WHEN p.ts - r.start > 21600 THEN p.ts ELSE r.start END, CASE WHEN p.ts - r.start > 21600 THEN r.part + 1 ELSE r.part END
    FROM r JOIN p ON p.window_tag = r.window_tag AND p.session = r.session AND p.n = r.n + 1)
  SELECT id, window_tag, dense_rank() OVER (PARTITION BY window_tag ORDER BY session, part) AS session FROM r""")
def session_maxspan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sessions_by_gap_and_span(event_timeline(spark, sf_dir), ["window_tag"], 2700, 21600).select("id", "window_tag", "session")


@query(f"WITH {EV} SELECT id, ((row_number() OVER (PARTITION BY window_tag ORDER BY ts, id) - 1) // 40)::INT AS chunk FROM ev")
def chunk_40(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.chunks(event_timeline(spark, sf_dir), ["window_tag"], 40).select("id", "chunk")


@query(f"""WITH {TL} SELECT window_tag, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS messages, count(*) FILTER (WHERE role = 'user') AS user_messages, count(DISTINCT speaker_id) FILTER (WHERE role = 'user') AS speakers,
  CASE WHEN coalesce(bool_or(role = 'user' AND regexp_matches(content, '{gates.EPISODE_CUE}')), false) THEN 'life' ELSE 'talk' END AS kind,
  count(*) FILTER (WHERE role = 'user' AND trim(content) <> '') > 0 AND count(*) FILTER (WHERE role = 'user') >= 4 AS worthy FROM tl GROUP BY window_tag""")
def session_worthy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = windows.sessions_by_gap(conversation_timeline(spark, sf_dir), ["window_tag"], 2700)
    return aggregates.episodes(d, ["window_tag"], gates.EPISODE_CUE, 4).drop("session")





@query("SELECT doc_id, substr(sha256(lower(trim(source)) || '||' || lower(trim(lang)) || '||' || doc_id), 1, 24) AS fingerprint FROM documents")
def fingerprint_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.fingerprint(F.col("source"), F.col("lang"), F.col("doc_id")).alias("fingerprint"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(lower(trim(text)))")
def fingerprint_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = text.fingerprint(F.col("text")).alias("fp")
    return table(spark, sf_dir, "documents").groupBy(key).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("fp")


@query("""SELECT item_id, regexp_replace(lower(trim(text)), '[\\s　,，.。!！?？、~～''"“”‘’]+', '', 'g') AS slot FROM benchmark""")
def normalise_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", text.normalize_slot(F.col("text")).alias("slot"))


@query("SELECT doc_id, (w + (length(text) - w + 3) // 4)::INT AS tokens FROM (SELECT doc_id, text, length(regexp_replace(text, '[^぀-ヿ一-鿿가-힯]', '', 'g')) AS w FROM documents)")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT item_id, CASE WHEN length(trim(text)) > 60 THEN substr(trim(text), 1, 59) || '…' ELSE trim(text) END AS clipped FROM benchmark")
def clip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", text.clip(F.col("text"), 60).alias("clipped"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def json_props_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("""WITH t AS (SELECT item_id, list_distinct(string_split(text, ' ')) AS w FROM benchmark)
  SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))::DOUBLE, 6) AS similarity FROM t a JOIN t b ON a.item_id < b.item_id""")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(F.split("text", " ")).alias("w"))
    a, b = t.select(F.col("item_id").alias("a"), F.col("w").alias("wa")), t.select(F.col("item_id").alias("b"), F.col("w").alias("wb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(text.jaccard(F.col("wa"), F.col("wb")), 6).alias("similarity"))





@query(f"WITH {FACTS} SELECT id FROM facts WHERE status = 'live' AND speaker_id = '7' UNION SELECT id FROM facts WHERE scope = 'owner' UNION SELECT id FROM facts WHERE pinned")
def union_distinct_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = event_facts(spark, sf_dir)
    return f.where("(status = 'live' and speaker_id = '7') or scope = 'owner' or pinned").select("id").distinct()


@query(f"WITH {TL} SELECT id FROM tl WHERE ts >= 4320000 OR id IN (SELECT id FROM tl WHERE role = 'system')")
def except_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    tl = conversation_timeline(spark, sf_dir)
    return maintenance.retained(tl, tl.where("role = 'system'"), 4320000).select("id")


@query("SELECT 'facts' AS \"table\", count(*) AS lines FROM events UNION ALL SELECT 'timeline', count(*) FROM conversations UNION ALL SELECT 'profiles', count(*) FROM customer")
def export_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = jsonl.export_lines({"facts": event_facts(spark, sf_dir), "timeline": conversation_timeline(spark, sf_dir), "profiles": table(spark, sf_dir, "customer")})
    return jsonl.preview(lines)


@query(f"WITH {FACTS} SELECT id, round(weight, 6) AS weight FROM (SELECT id, (CASE WHEN importance > 0 THEN importance ELSE confidence END) * pow(0.5, greatest(0.0, ({AS_OF + 60 * 86400} - greatest(updated_at, created_at)) / 86400.0::DOUBLE) / (30.0 * least(1.0 + 0.5 * access_count, 3.0))) AS weight FROM facts WHERE status = 'live' AND NOT pinned AND updated_at < {AS_OF + 30 * 86400}) WHERE weight < 0.12")
def decay_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.faded(event_facts(spark, sf_dir), AS_OF + 60 * 86400).select("id", F.round("weight", 6).alias("weight"))


@query(f"WITH {FACTS} SELECT id, CASE WHEN status = 'live' AND expires_at > 0 AND expires_at < {AS_OF} THEN 'archived' ELSE status END AS status FROM facts")
def status_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.expired(event_facts(spark, sf_dir), AS_OF).select("id", "status")


@query("SELECT o_orderkey, coalesce(n2.n_nationkey, c_nationkey) AS nation FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT n_nationkey + 1 AS alias, n_nationkey FROM nation WHERE n_nationkey % 2 = 0) n2 ON alias = c_nationkey")
def identity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("nation"))
    aliases = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select((F.col("n_nationkey") + 1).alias("alias"), F.col("n_nationkey").alias("canonical"))
    return maintenance.renamed(owners, aliases, "nation")


@query("SELECT user_id, count(*) AS access_count, max(ts) AS last_accessed FROM events WHERE event_type = 'view' GROUP BY user_id")
def access_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.counters(table(spark, sf_dir, "events").where("event_type = 'view'"), "user_id", "ts")


@query(None)
def guarded_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = event_facts(spark, sf_dir)
    claims = f.select("slot_key", "id", F.col("created_at").alias("ts"), "value", "confidence", (F.col("id") % 3 == 0).alias("first_person"), (F.col("id") % 10 == 0).alias("correction"), (F.col("id") % 23 == 0).alias("joke"), (F.col("id") % 19 == 0).alias("hearsay"), (F.col("id") % 41 == 0).alias("close"), "pinned")
    return maintenance.guarded_ingest(claims)
