"""Named queries of the read path: requests of several askers, their facts, histories, episodes, buckets and packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions import matching, render, timeparse, visibility
from mnemora.operators import requests
from mnemora.sources.tables import event_episodes, event_timeline, memory_facts, table

from .catalogue import AS_OF, EV, FACTS, TOKENS, query

#: Requests that take every route: (id, query, ids, persona, window, isolation, owners, start and end of the time asked for).
ASKED = (
    (1, "did user12 view 57 or purchase 103?", ["7", "12"], "", "", "shared", [], 0, 0),
    (2, "今天穿 view 还是 click", ["12"], "p1", "qq:GroupMessage:1", "strict", ["30"], AS_OF - 7 * 86400, 0),
    (3, "昨天 signup 了吗", ["30"], "", "qq:FriendMessage:30", "strict", ["30"], AS_OF - 2 * 86400, 0),
    (4, "以前 purchase 过什么 user41", ["41"], "p2", "qq:GroupMessage:view", "owner", ["30"], AS_OF - 9 * 86400, AS_OF - 3 * 86400),
    (5, "还记得 error 吗", ["9", "10"], "p1", "qq:GroupMessage:click", "off", [], 0, 0),
    (6, "谢谢", ["9"], "", "", "shared", [], 0, 0),
)
_SHAPE = "request_id int, query string, speaker_ids array<string>, ask_persona string, window_tag string, isolation string, owners array<string>, start long, end long"


def asked(spark: SparkSession) -> DataFrame:
    """The requests, len(ASKED) rows: they go to what they meet, which has owners' rows in plenty under one key."""
    return F.broadcast(requests.routed(spark.createDataFrame(ASKED, _SHAPE).withColumn("as_of", F.lit(AS_OF))))


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(xs: list[str]) -> str:
    return f"[{', '.join(map(_text, xs))}]::VARCHAR[]"


_ROUTES = ("long_term", "current_status", "time_window", "history", "recall", "low_info")
_REQ = "req(request_id, q, ids, persona, win, iso, owners, s, e, route) AS (VALUES " + ", ".join(f"({i}, {_text(q)}, {_list(ids)}, {_text(p)}, {_text(w)}, {_text(iso)}, {_list(o)}, {s}, {e}, '{r}')" for (i, q, ids, p, w, iso, o, s, e), r in zip(ASKED, _ROUTES)) + ")"
_MEMORY = f"""{FACTS}, mem AS (SELECT *, 'user' || speaker_id AS name, value::VARCHAR AS val, attribute || ' ' || value::VARCHAR || ' by user' || speaker_id AS content, CASE WHEN id % 3 = 0 THEN 'p1' ELSE '' END AS p,
  CASE WHEN id % 4 = 0 THEN 'qq:FriendMessage:' || speaker_id ELSE 'qq:GroupMessage:1' END AS origin, lead(id) OVER (PARTITION BY slot_key ORDER BY created_at, id) AS nx FROM facts)"""
_HIDDEN = """CASE WHEN iso <> 'off' AND scope = 'owner' AND len(owners) > 0 THEN CASE WHEN len(list_intersect(ids, owners)) = 0 THEN 'owner_private' END
  WHEN iso = 'strict' AND contains(origin, 'Friend') AND (NOT contains(win, 'Friend') OR NOT list_contains(ids, speaker_id)) THEN 'private_origin' END"""
_NAMED = f"(len(list_filter({TOKENS.format('content')} || {TOKENS.format('val')}, lambda t: length(t) >= 2 AND contains(lower(q), t))) > 0 OR (length(val) BETWEEN 2 AND 15 AND contains(lower(q), val)) OR (length(content) BETWEEN 2 AND 15 AND contains(lower(q), lower(content))))"


def _words(source: str, text: str) -> str:
    """BM25 of the rows of a source (request_id, id, q, ...) within each request, the best of them 1."""
    return f"""wt AS (SELECT request_id, id, q, {TOKENS.format(text)} AS t FROM {source}), wn AS (SELECT request_id, count(*) AS n, avg(len(t)) AS mean FROM wt GROUP BY 1),
wq AS (SELECT DISTINCT request_id, unnest(regexp_extract_all(regexp_replace(lower(q), '([一-鿿])', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}]+')) AS term FROM req),
wf AS (SELECT request_id, id, dl, term, count(*) AS tf FROM (SELECT request_id, id, len(t) AS dl, unnest(t) AS term FROM wt) JOIN wq USING (request_id, term) GROUP BY ALL),
wd AS (SELECT request_id, term, count(*) AS df FROM wf GROUP BY ALL),
ws AS (SELECT request_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) AS s FROM wf JOIN wd USING (request_id, term) JOIN wn USING (request_id) GROUP BY ALL),
words AS (SELECT request_id, id, s / max(s) OVER (PARTITION BY request_id) AS words FROM ws)"""


_CAND = f"""{_REQ}, {_MEMORY}, live AS (SELECT * FROM mem WHERE status = 'live'),
own AS (SELECT *, row_number() OVER (PARTITION BY speaker_id ORDER BY confidence DESC, updated_at DESC, id) AS k FROM live QUALIFY k <= 240),
low AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, updated_at DESC, id) AS k FROM live WHERE scope = 'owner' QUALIFY k <= 240),
met AS (SELECT request_id, id, max(o) AS o FROM (SELECT request_id, id, 0 AS o FROM req JOIN own ON list_contains(ids, speaker_id) UNION ALL SELECT request_id, id, 1 FROM req, low) GROUP BY ALL),
cand AS (SELECT req.*, mem.*, o, row_number() OVER (PARTITION BY request_id ORDER BY confidence DESC, updated_at DESC, mem.id) AS a, row_number() OVER (PARTITION BY request_id, o ORDER BY confidence DESC, updated_at DESC, mem.id) AS b
  FROM met JOIN req USING (request_id) JOIN mem USING (id) QUALIFY a <= 240 OR (o = 1 AND b <= 200)),
judged AS (SELECT *, {_HIDDEN} AS hidden, {_NAMED} AS matched, CASE WHEN status <> 'live' THEN 'not_live' WHEN expires_at > 0 AND expires_at < {AS_OF} THEN 'expired' WHEN p <> '' AND persona <> '' AND p <> persona THEN 'other_persona'
  WHEN hidden IS NOT NULL THEN hidden WHEN scope = 'owner' THEN 'visible' WHEN list_contains(ids, speaker_id) THEN CASE WHEN route = 'current_status' AND {AS_OF} - updated_at > 172800 THEN 'stale_for_status' ELSE 'visible' END
  WHEN contains(q, name) OR (length(speaker_id) >= 4 AND contains(q, speaker_id)) THEN 'visible' ELSE 'other_speaker' END AS reason FROM cand)"""


@query(f"WITH {_CAND} SELECT request_id, reason, count(*) AS n FROM judged GROUP BY ALL")
def candidate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = requests.judged(requests.candidates(asked(spark), memory_facts(spark, sf_dir)), AS_OF)
    return met.groupBy("request_id", "reason").agg(F.count("*").alias("n"))


_RANKED = f"""{_CAND}, vis AS (SELECT * REPLACE (CASE route WHEN 'low_info' THEN 'recall' ELSE route END AS route) FROM judged WHERE reason = 'visible' AND (route <> 'low_info' OR request_id IN (SELECT request_id FROM judged WHERE matched AND reason = 'visible'))),
{_words("vis", "content")},
loc AS (SELECT *, coalesce(words, 0.0) AS w, 1.0 / (1.0 + greatest(0.0, ({AS_OF} - updated_at) / 86400.0::DOUBLE) / 14.0) AS rec, list_contains(ids, speaker_id) AS mine, route = 'current_status' AND {AS_OF} - updated_at > 172800 AS stale FROM vis LEFT JOIN words USING (request_id, id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(w + 0.2 * rec + 0.25 * least(1.0, confidence) + 0.15 * mine::INT + 2.5 * matched::INT + 0.12 * (scope = 'owner')::INT + 0.2 * pinned::INT - 0.5 * stale::INT, 9) DESC, id)::INT AS rank FROM loc QUALIFY rank <= 32)"""


@query(f"WITH {_RANKED} SELECT request_id, id, route, rank, matched, round(1.0::DOUBLE / (60 + rank) + 0.15 * w + 0.05 * rec + 0.05 * pinned::INT + 0.08 * mine::INT + 2.0 * matched::INT - 0.1 * stale::INT, 6) AS score FROM rk")
def retrieve_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = requests.ranked_facts(asked(spark), memory_facts(spark, sf_dir), AS_OF)
    return d.select("request_id", "id", "route", "rank", "matched", F.round("score", 6).alias("score"))


#: Facts of which this many are seen are also ranked by their vectors.
_VECTORS_FROM = 20


def _with_vector(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The requests with vectors, but the third, and vectors of facts, those whose number 7 divides excepted."""
    e = table(spark, sf_dir, "embeddings")
    asks = asked(spark).join(e.where("vec_id <> 3").select(F.col("vec_id").cast("int").alias("request_id"), F.col("embedding").alias("vector")), "request_id", "left")
    facts = memory_facts(spark, sf_dir).where("id % 7 > 0").select("id", (F.col("id") % 400).alias("vec_id"))
    return asks, facts.join(e, "vec_id").select("id", F.col("embedding").alias("vector"))


@query(f"""WITH {_RANKED.replace("QUALIFY rank <= 32", "")}, cs AS (SELECT rk.*, count(*) OVER (PARTITION BY request_id) >= {_VECTORS_FROM} AND rk.id % 7 > 0 AS has, round(list_cosine_similarity(q.embedding::DOUBLE[], f.embedding::DOUBLE[]), 9) AS cs
    FROM rk LEFT JOIN embeddings q ON q.vec_id = request_id AND request_id <> 3 LEFT JOIN embeddings f ON f.vec_id = rk.id % 400),
  both_ AS (SELECT * REPLACE (CASE WHEN has THEN cs END AS cs), row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN has THEN cs END DESC NULLS LAST, id) AS near FROM cs),
  heads AS (SELECT * REPLACE (CASE WHEN rank <= 32 THEN rank END AS rank, CASE WHEN cs IS NOT NULL AND near <= 32 THEN near END AS near) FROM both_),
  fused AS (SELECT *, round(coalesce(1.0::DOUBLE / (60 + rank), 0.0) + coalesce(1.0::DOUBLE / (60 + near), 0.0), 12) AS rrf FROM heads WHERE rank IS NOT NULL OR near IS NOT NULL),
  placed AS (SELECT * REPLACE ((row_number() OVER (PARTITION BY request_id ORDER BY rrf DESC, coalesce(rank, 32 + near)))::INT AS rank) FROM fused)
  SELECT request_id, id, rank, matched, round(coalesce(cs, 0.0), 6) AS cosine, round(rrf + 0.15 * w + 0.1 * coalesce(cs, 0.0) + 0.05 * rec + 0.05 * pinned::INT + 0.08 * mine::INT + 2.0 * matched::INT - 0.1 * stale::INT, 6) AS score FROM placed WHERE rank <= 32""")
def retrieve_ranks_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval: words and vectors, fused."""
    asks, vectors = _with_vector(spark, sf_dir)
    d = requests.ranked_facts(asks, memory_facts(spark, sf_dir), AS_OF, vectors=vectors, vectors_from=_VECTORS_FROM)
    return d.select("request_id", "id", "rank", "matched", F.round("cosine", 6).alias("cosine"), F.round("score", 6).alias("score"))


@query(None)
def retrieve_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole read path; tests hold it against a plain fold over the ranks of retrieve_ranks."""
    return requests.bundles(asked(spark), memory_facts(spark, sf_dir), AS_OF).select("request_id", "route", "bucket", "position", "id")


@query(None)
def retrieve_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts, histories and episodes of each request, the best of all that it meets, as one text of 400 characters."""
    empty, asks, facts, c = F.lit(""), asked(spark), memory_facts(spark, sf_dir), F.col
    found = requests.blocks(requests.bundles(asks, facts, AS_OF, cut=False))
    line = render.fact_line(F.col("scope"), F.col("speaker_name"), F.col("speaker_id"), F.col("attribute"), empty, F.col("content"), F.col("value"), empty, F.when(F.col("bucket") == "uncertain", "uncertain").otherwise("mention"))
    past = requests.histories(asks.where("route = 'history'"), facts, 6, cut=False)
    then = render.history_line(c("scope"), c("speaker_name"), c("speaker_id"), c("content"), c("created_at"), c("updated_at"), F.coalesce("current", empty))
    best = F.broadcast(requests.ranked_episodes(asks, event_episodes(spark, sf_dir), 2))  # two rows for each request
    seen = best.join(event_episodes(spark, sf_dir).select("id", "scope", "title", "summary", "start_ts", "review_status", F.get("event_speakers", F.lit(0)).alias("_who")), "id")
    told = render.episode_line(c("scope"), empty, c("_who"), F.lit("talk"), c("title"), c("summary"), c("start_ts"), c("review_status"))
    lines = [found.withColumn("line", line), past.withColumns({"block": F.lit("history"), "position": c("rank"), "line": then}), seen.withColumns({"block": F.lit("events"), "position": c("rank"), "line": told})]
    one = lambda d: d.select("request_id", "block", F.col("position").cast("int").alias("position"), "line")
    return requests.packs(one(lines[0]).unionByName(one(lines[1])).unionByName(one(lines[2])), 400)


_PAST = f"""{_REQ}, {_MEMORY}, pr AS (SELECT * REPLACE (CASE WHEN e = 0 THEN {AS_OF} ELSE e END AS e) FROM req),
past AS (SELECT pr.*, mem.*, {_HIDDEN} AS hidden FROM pr JOIN mem ON (list_contains(ids, speaker_id) OR scope = 'owner') AND status <> 'live' AND created_at <= e AND updated_at >= pr.s AND (expires_at = 0 OR expires_at >= pr.s)),
top AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY updated_at DESC, id) AS k FROM past QUALIFY k <= 240),
vis AS (SELECT * FROM top WHERE NOT (p <> '' AND persona <> '' AND p <> persona) AND hidden IS NULL AND (scope = 'owner' OR list_contains(ids, speaker_id) OR contains(q, name))),
{_words("vis", "content")},
sc AS (SELECT *, round(coalesce(words, 0.0) + 0.2 / (1.0 + greatest(0.0, ({AS_OF} - updated_at) / 86400.0::DOUBLE) / 30.0) + 0.1 * least(1.0, confidence) + 0.2 * pinned::INT + 0.05 * (least(e - s, e - greatest(s, created_at)) > 0)::INT, 9) AS score FROM vis LEFT JOIN words USING (request_id, id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, id)::INT AS rank FROM sc QUALIFY rank <= 12)"""


@query(f"""WITH {_PAST} SELECT r.request_id, r.id, r.rank, round(r.score, 6) AS score, CASE WHEN a.status = 'live' THEN a.content WHEN b.status = 'live' THEN b.content WHEN c.status = 'live' THEN c.content END AS current
  FROM rk r LEFT JOIN mem a ON r.nx = a.id LEFT JOIN mem b ON a.status <> 'live' AND a.nx = b.id LEFT JOIN mem c ON b.status <> 'live' AND b.nx = c.id""")
def history_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = asked(spark).withColumn("end", F.when(F.col("end") == 0, AS_OF).otherwise(F.col("end")))
    d = requests.histories(r, memory_facts(spark, sf_dir), 12)
    return d.select("request_id", "id", "rank", F.round("score", 6).alias("score"), "current")


_EPISODES = f"""{EV}, ep AS (SELECT min(id) AS id, speaker_id, ts // 86400 AS day, min(ts) AS start_ts, max(ts) AS end_ts, min(kind) AS kind, count(*) AS n FROM ev GROUP BY speaker_id, ts // 86400),
episodes AS (SELECT id, start_ts, end_ts, kind || ' day' AS title, n || ' events of user' || speaker_id AS summary, [speaker_id::VARCHAR, 'u' || speaker_id % 5] AS speakers, 'qq:GroupMessage:' || kind AS event_window,
  CASE WHEN day % 5 = 0 THEN 'owner' ELSE 'person' END AS scope, CASE WHEN day % 7 = 0 THEN 'archived' ELSE 'live' END AS status, n > 4 AS review, CASE WHEN id % 3 = 0 THEN 'p1' ELSE '' END AS p, n / 10.0::DOUBLE AS confidence, id % 29 = 0 AS pinned FROM ep)"""
_EP_REASON = """CASE WHEN status <> 'live' AND NOT (route = 'history' AND status = 'archived') THEN 'not_live' WHEN review THEN 'needs_review' WHEN p <> '' AND persona <> '' AND p <> persona THEN 'other_persona'
  WHEN iso IN ('off', 'shared') THEN CASE WHEN len(list_intersect(speakers, ids)) > 0 OR (win <> '' AND win = event_window) OR (scope = 'owner' AND (len(owners) = 0 OR len(list_intersect(ids, owners)) > 0)) THEN 'visible' ELSE 'other_speaker' END
  WHEN iso = 'strict' AND win <> '' THEN 'visible' WHEN win = '' AND (len(list_intersect(speakers, ids)) > 0 OR (scope = 'owner' AND len(list_intersect(ids, owners)) > 0)) THEN 'visible' ELSE 'other_session' END"""


@query(f"WITH {_REQ}, {_EPISODES} SELECT request_id, {_EP_REASON} AS reason, count(*) AS n FROM req, episodes GROUP BY ALL")
def event_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every episode under each of the requests, which are a handful of rows."""
    e, r = event_episodes(spark, sf_dir), F.broadcast(asked(spark))  # len(ASKED) rows
    c = F.col
    reason = visibility.episode_reason(c("status"), c("review_status"), c("persona_id"), c("scope"), c("event_speakers"), c("event_window"), route=c("route"), ids=c("speaker_ids"), ask_persona=c("ask_persona"), ask_window=c("window_tag"), isolation=c("isolation"), owners=c("owners"))
    return e.join(r, how="cross").groupBy("request_id", reason.alias("reason")).agg(F.count("*").alias("n"))


_EP_NAMED = f"(len(list_filter({TOKENS.format('title')} || {TOKENS.format('summary')}, lambda t: length(t) >= 2 AND contains(lower(q), t))) > 0 OR (length(title) BETWEEN 2 AND 15 AND contains(lower(q), lower(title))))"


@query(f"""WITH {_REQ}, {_EPISODES}, met AS (SELECT * FROM req, episodes
    WHERE CASE WHEN iso = 'strict' AND win <> '' THEN event_window = win ELSE len(list_intersect(speakers, ids)) > 0 OR scope = 'owner' END AND (s = 0 OR end_ts >= s) AND (e = 0 OR start_ts <= e)),
  vis AS (SELECT *, title || ' ' || summary AS txt FROM met WHERE {_EP_REASON} = 'visible'), {_words("vis", "txt")},
  sc AS (SELECT *, greatest(0.0, ({AS_OF} - end_ts) / 86400.0::DOUBLE) AS age FROM vis LEFT JOIN words USING (request_id, id)),
  f AS (SELECT request_id, id, round(coalesce(words, 0.0) + 0.25 / (1.0 + age / 14.0) + 0.2 * least(1.0, confidence) + 0.25 * CASE WHEN pinned THEN 1.0 ELSE 0.5 * pow(0.5, age / 30.0) END + 0.25 * pinned::INT + 2.5 * {_EP_NAMED}::INT
    + CASE WHEN route = 'current_status' AND age > 7 THEN -0.4 WHEN route = 'time_window' THEN 0.15 WHEN route = 'history' THEN 0.15 + 0.1 * (e > 0 AND end_ts <= e)::INT ELSE 0.0 END, 9) AS score FROM sc)
  SELECT request_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, id)::INT AS rank FROM f QUALIFY rank <= 8""")
def event_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = requests.ranked_episodes(asked(spark), event_episodes(spark, sf_dir), 8)
    return d.select("request_id", "id", F.round("score", 6).alias("score"), "rank")


_PHRASES = ("刚才说的", "昨天去哪", "前天呢", "这周怎样", "上周末", "上个月", "2024年1月", "去年3月", "最近 5 天", "什么时候", "")


@query("WITH p(q, days) AS (VALUES ('刚才说的', 1), ('昨天去哪', 2), ('前天呢', 3), ('这周怎样', 7), ('上周末', 14), ('上个月', 40), ('2024年1月', 0), ('去年3月', 0), ('最近 5 天', 7), ('什么时候', 0), ('', 0)), " + EV + f""",
  r(q, s, e) AS (VALUES ('2024年1月', 1704067200, 1706745600), ('去年3月', 1677628800, 1680307200), ('最近 5 天', {AS_OF - 5 * 86400}, {AS_OF}), ('上个月', 1701388800, 1704067200))
  SELECT q, days, coalesce(s, 0)::BIGINT AS start, coalesce(e, 0)::BIGINT AS until, (SELECT count(*) FROM ev WHERE ts <= {AS_OF} AND (days = 0 OR ts >= {AS_OF} - days * 86400)) AS looked, (SELECT count(*) FROM ev WHERE ts BETWEEN s AND e) AS inside FROM p LEFT JOIN r USING (q)""")
def time_window_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many messages each phrase looks back on, by its days and by its range of time."""
    from mnemora.functions.gates import look_back_days

    rows = [(q, *timeparse.parse_time_range(q, AS_OF)[:2]) for q in _PHRASES]
    p = F.broadcast(spark.createDataFrame(rows, "q string, start long, until long").withColumn("days", look_back_days(F.col("q"))))  # len(_PHRASES) rows
    back = (F.col("ts") <= AS_OF) & ((F.col("days") == 0) | (F.col("ts") >= AS_OF - F.col("days") * 86400))
    n = event_timeline(spark, sf_dir).join(p, how="cross").groupBy("q", "days", "start", "until")
    return n.agg(F.count(F.when(back, 1)).alias("looked"), F.count(F.when((F.col("until") > 0) & F.col("ts").between(F.col("start"), F.col("until")), 1)).alias("inside"))


@query(f"WITH {_MEMORY}, a(asked) AS (VALUES (''), ('p1'), ('p2')) SELECT asked, p AS persona_id, count(*) AS n FROM a, mem WHERE asked = '' OR p IN ('', asked) GROUP BY ALL")
def persona_or_global_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.broadcast(spark.createDataFrame([("",), ("p1",), ("p2",)], "asked string"))  # three rows
    met = memory_facts(spark, sf_dir).select("persona_id").groupBy("persona_id").agg(F.count("*").alias("n")).join(a, how="cross")
    return met.where(visibility.persona_or_global(F.col("persona_id"), F.col("asked"))).select("asked", "persona_id", "n")


@query(f"""WITH {_MEMORY}, c AS (SELECT request_id, q FROM (VALUES (1, 'is it 57 today?'), (2, 'it is 57 today'), (3, 'view 57 by user12')) t(request_id, q))
  SELECT request_id, count(*) FILTER (WHERE {_NAMED}) AS named, count(*) FILTER (WHERE length(val) >= 2 AND contains(lower(replace(replace(q, ' ', ''), '?', '')), val)) AS said,
  count(*) FILTER (WHERE length(val) >= 2 AND contains(lower(replace(replace(q, ' ', ''), '?', '')), val) AND NOT contains(q, '?') AND NOT pinned) AS no_news FROM mem, c GROUP BY request_id""")
def match_and_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many facts each query names, says, and leaves without news."""
    q = F.broadcast(spark.createDataFrame([(1, "is it 57 today?"), (2, "it is 57 today"), (3, "view 57 by user12")], "request_id int, query string"))  # three rows
    d, c = memory_facts(spark, sf_dir).join(q, how="cross"), F.col
    value = F.array("value")
    return d.groupBy("request_id").agg(
        F.count(F.when(matching.names(c("query"), F.array("value", "content")), 1)).alias("named"), F.count(F.when(matching.says(c("query"), value), 1)).alias("said"),
        F.count(F.when(matching.said_already(c("query"), value, c("content"), c("value"), c("pinned")), 1)).alias("no_news"),
    )
