"""Retrieval for many requests at once: what each asker may see, ranked, made diverse, sorted into buckets and packed.

A request is a row: request_id, query, speaker_ids array<string>, persona_id, window_tag, isolation, owners array<string>,
and route and the time asked for once `routed` has added them. Requests meet facts by an equality of speakers, after each
speaker's facts have been cut to those that any one request may look at, so nothing is compared pair by pair. Where nothing
is cut (episodes, and facts with cut=False), requests are few and sent to the rows that they meet.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions import gates, matching, scores, visibility
from mnemora.functions.text import let, tokens
from mnemora.storage import written

from .retrieval import B, K1

#: What a request may look at: facts of its speakers and owners', owners' facts besides, and ranks of a list.
OWN, OWNERS, RRF = 240, 200, 60
#: Attributes of which a sure fact is a core one; the confidence from which it is sure, and below which it is not.
CORE, SURE, UNSURE = ("likes", "dislikes", "name", "identity", "habit", "promise"), 0.7, 0.45


def routed(requests: DataFrame) -> DataFrame:
    """requests with `route`."""
    return requests.withColumn("route", gates.route(F.col("query")))


def candidates(requests: DataFrame, facts: DataFrame, cut: bool = True) -> DataFrame:
    """Requests with the live facts (all columns) that they look at: their speakers', nobody's, the bot's and the owner's.

    The surest and newest OWN of each speaker take part, and of these the OWN best of a request, and OWNERS of the
    owner's besides. A speaker with very many facts is cut before anything is joined. With cut=False all of them take
    part, for requests so few that they are sent to the facts.
    """
    if not cut:
        return _meeting(requests, facts.where("status = 'live'"), F.concat("speaker_ids", F.array(*[F.lit(x) for x in visibility.COMMON_IDS], F.lit("#owner"))), _fact_keys())
    best = [F.desc("confidence"), F.desc("updated_at"), F.col("id")]
    first = lambda d, n, *by: d.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*best))).where(F.col("_n") <= n).drop("_n")
    live = facts.where("status = 'live'")
    own = first(live.withColumn("_key", F.col("speaker_id")), OWN, "_key")
    owner = first(live.where("scope = 'owner'").withColumn("_key", F.lit("#owner")), OWN, "_key")
    keys = F.explode(F.array_distinct(F.concat("speaker_ids", F.array(*[F.lit(x) for x in (*visibility.COMMON_IDS, "#owner")])))).alias("_key")
    met = requests.select("*", keys).join(own.unionByName(owner), "_key").withColumn("_owner", F.col("_key") == "#owner").drop("_key")
    one = met.withColumn("_copy", F.row_number().over(Window.partitionBy("request_id", "id").orderBy(F.desc("_owner")))).where("_copy = 1").drop("_copy")
    w = Window.partitionBy("request_id")
    one = one.withColumn("_all", F.row_number().over(w.orderBy(*best))).withColumn("_mine", F.row_number().over(Window.partitionBy("request_id", "_owner").orderBy(*best)))
    return one.where((F.col("_all") <= OWN) | (F.col("_owner") & (F.col("_mine") <= OWNERS))).drop("_owner", "_all", "_mine")


def judged(met: DataFrame, as_of: int) -> DataFrame:
    """Candidates with `reason`: 'visible', or why a fact is hidden. The bot's own facts are shown elsewhere: own_block."""
    c = F.col
    reason = visibility.fact_reason(
        c("status"), c("expires_at"), c("persona_id"), c("scope"), c("speaker_id"), c("speaker_name"), c("origin_window"), c("attribute"), c("updated_at"), as_of=F.lit(as_of),
        query=c("query"), route=c("route"), ids=c("speaker_ids"), ask_persona=c("ask_persona"), ask_window=c("window_tag"), isolation=c("isolation"), owners=c("owners"),
    )
    return met.withColumn("reason", F.when(c("speaker_id") == "bot_self", "own_block").otherwise(reason))


def word_scores(visible: DataFrame, text_col: str = "content", key: str = "request_id", item: str = "id") -> DataFrame:
    """(key, item, words): BM25 of each item for its request's query among the request's items, the best of them 1."""
    d = visible.select(key, item, tokens(F.col(text_col)).alias("_t"), F.array_distinct(tokens(F.col("query"))).alias("_q"))
    total = d.groupBy(key).agg(F.count("*").alias("_all"), F.avg(F.size("_t")).alias("_mean"))
    hit = F.explode(F.filter(F.transform("_q", lambda q: F.struct(q.alias("term"), F.size(F.filter("_t", lambda t: t == q)).alias("tf"))), lambda x: x["tf"] > 0))
    tf = d.select(key, item, F.size("_t").alias("dl"), hit.alias("_h")).select(key, item, "dl", "_h.term", "_h.tf")
    df = tf.groupBy(key, "term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("_all") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("_mean")))
    s = tf.join(df, [key, "term"]).join(total, key).groupBy(key, item).agg(F.sum(part).alias("_s"))
    return s.select(key, item, (F.col("_s") / F.max("_s").over(Window.partitionBy(key))).alias("words"))


def _meeting(requests: DataFrame, rows: DataFrame, asked: Column, held: Column) -> DataFrame:
    """Requests with all rows that hold one of the keys that they ask for (arrays), each pair once, by the first of its keys."""
    r = requests.withColumn("_asked", F.array_compact(asked)).withColumn("_key", F.explode(F.array_distinct("_asked")))
    d = rows.withColumn("_held", F.array_distinct(F.array_compact(held))).withColumn("_key", F.explode("_held"))
    first = F.get(F.array_intersect("_held", "_asked"), F.lit(0))
    return r.join(d, "_key").where(first == F.col("_key")).drop("_key", "_asked", "_held")


def with_words(visible: DataFrame, content: Column) -> DataFrame:
    """visible with `words`: BM25 of each row's content for its request's query among the request's rows, the best of them 1.

    For few requests with very many rows. Rows with equal numbers of words have equal scores, so numbers are counted
    first; what the rows then meet is one line for each request, which is broadcast as the requests are.
    """
    c = F.col
    asked = F.array_distinct(tokens(c("query")))
    times = let(tokens(content), lambda t: F.struct(F.size(t).alias("dl"), F.transform(asked, lambda q: F.size(F.filter(t, lambda x: x == q))).alias("tf")))
    d = visible.withColumn("_w", times)
    alike = d.groupBy("request_id", "_w").agg(F.count("*").alias("_n"))
    total = alike.groupBy("request_id").agg(F.sum("_n").alias("_all"), (F.sum(c("_n") * c("_w.dl")) / F.sum("_n")).alias("_mean"))
    df = alike.select("request_id", "_n", F.posexplode("_w.tf").alias("_at", "_tf")).groupBy("request_id", "_at").agg(F.sum(F.when(c("_tf") > 0, c("_n")).otherwise(0)).alias("_df"))
    dfs = df.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_df"))), lambda x: x["_df"]).alias("_dfs"))
    of = total.join(dfs, "request_id", "left")
    idf = F.transform(F.coalesce("_dfs", F.array().cast("array<bigint>")), lambda n: F.log(1 + (c("_all") - n + 0.5) / (n + 0.5)))
    of = of.select("request_id", "_mean", idf.alias("_idf"))
    part = lambda n, idf: F.when(n > 0, idf * n * (K1 + 1) / (n + K1 * (1 - B + B * c("_w.dl") / c("_mean")))).otherwise(0.0)
    score = F.aggregate(F.zip_with("_w.tf", "_idf", part), F.lit(0.0), lambda s, x: s + x)
    best = alike.join(F.broadcast(of), "request_id").groupBy("request_id").agg(F.max(score).alias("_best"))  # a line for each request
    d = d.join(F.broadcast(of.join(best, "request_id")), "request_id")  # a line for each request
    return d.withColumn("words", F.when(c("_best") > 0, score / c("_best")).otherwise(0.0)).drop("_w", "_mean", "_idf", "_best")


def _worded(seen: DataFrame, cut: bool) -> DataFrame:
    """Facts seen with `words`, 0 where they have none of their query's: of short lists, or (not cut) of all rows of few requests."""
    if not cut:
        return with_words(seen, F.col("content"))
    return seen.join(word_scores(seen), ["request_id", "id"], "left").withColumn("words", F.coalesce("words", F.lit(0.0)))


def _fact_keys() -> Column:
    return F.array(F.col("speaker_id"), F.when(F.col("scope") == "owner", "#owner"))


def _matched() -> Column:
    return matching.names(F.col("query"), F.array("value", "content"))


def ranked_facts(requests: DataFrame, facts: DataFrame, as_of: int, top: int = 16, importance: float = 0.0, vectors: DataFrame | None = None, vectors_from: int = 0, cut: bool = True) -> DataFrame:
    """The ranked candidates of every request: rank by the local score, `score` by the fused one, and `matched`.

    A greeting (route low_info) gets nothing, unless a fact that it may see is named in it: then it is a recall.

    vectors (id, vector): those of facts; requests then have a `vector` of their query, or null. What a request may see is
    also ranked by cosine, where it sees `vectors_from` facts or more, and the heads of both lists are fused: `rank` is by
    the sum of reciprocal ranks, ties as the local score has them. Facts meet their vectors by id after they are cut.
    cut: that of `candidates`.
    """
    met = judged(candidates(requests, facts, cut), as_of).withColumn("matched", _matched())
    if cut:
        named = F.max((F.col("matched") & (F.col("reason") == "visible")).cast("int")).over(Window.partitionBy("request_id"))
        met = met.withColumn("_named", named)
    else:
        named = met.where("route = 'low_info' and matched and reason = 'visible'").select("request_id").distinct().withColumn("_named", F.lit(1))
        met = met.join(F.broadcast(named), "request_id", "left")  # no more rows than requests
    met = met.where((F.col("route") != "low_info") | (F.col("_named") == 1))
    seen = met.withColumn("route", F.when(F.col("route") == "low_info", "recall").otherwise(F.col("route"))).where("reason = 'visible'").drop("_named", "reason")
    d = _worded(seen, cut)
    now = F.lit(as_of)
    own = F.array_contains("speaker_ids", F.col("speaker_id"))
    stale = (F.col("route") == "current_status") & (now - F.col("updated_at") > 2 * 86400)
    rec = scores.recency(now, F.col("updated_at"))
    weight = scores.decay_weight(F.col("importance"), F.col("confidence"), F.col("pinned"), F.col("access_count"), F.greatest("updated_at", "created_at"), now)
    local = scores.local_score(F.col("words"), rec, F.col("confidence"), own, F.col("matched"), F.col("scope") == "owner", weight, F.col("pinned"), stale, importance)
    most, by = max(2 * top, 12), Window.partitionBy("request_id")
    d = d.withColumn("local", F.round(local, 9)).withColumn("rank", F.row_number().over(by.orderBy(F.desc("local"), "id")))
    if vectors is None:
        d = d.where(F.col("rank") <= most).withColumns({"_rrf": 1.0 / (RRF + F.col("rank")), "cosine": F.lit(0.0)})
    else:
        d = _with_vectors(d, vectors, vectors_from, most)
    fused = scores.fused_score(F.col("_rrf"), F.col("words"), F.col("cosine"), rec, F.col("pinned"), own, F.col("matched"), stale)
    return d.withColumn("score", F.round(fused, 9)).drop("_rrf")


def _with_vectors(d: DataFrame, vectors: DataFrame, least: int, most: int) -> DataFrame:
    """The `most` best of each request by the sum of reciprocal ranks in the heads of the local list and of that by cosine."""
    by = Window.partitionBy("request_id")
    d = d.join(vectors.select("id", F.col("vector").alias("_fact")), "id", "left").withColumn("_seen", F.count("*").over(by))
    asked = F.when((F.col("_seen") >= least) & F.col("vector").isNotNull() & F.col("_fact").isNotNull(), F.round(scores.cosine(F.col("vector"), F.col("_fact")), 9))
    d = d.withColumn("_near", asked).drop("_fact", "_seen")
    near = F.row_number().over(by.orderBy(F.desc_nulls_last("_near"), "id"))
    d = d.withColumn("_second", F.when(F.col("_near").isNotNull(), near))
    head = lambda c: F.when(F.col(c) <= most, F.col(c))
    d = d.withColumns({"rank": head("rank"), "_second": head("_second")}).where("rank is not null or _second is not null")
    part = lambda c: F.coalesce(1.0 / (RRF + F.col(c)), F.lit(0.0))
    d = d.withColumns({"_rrf": F.round(part("rank") + part("_second"), 12), "cosine": F.coalesce("_near", F.lit(0.0))})
    fused = F.row_number().over(by.orderBy(F.desc("_rrf"), F.coalesce(F.col("rank"), most + F.col("_second"))))
    return d.withColumn("rank", fused).where(F.col("rank") <= most).drop("_near", "_second")


def chosen(ranked: DataFrame, top: int = 16, balance: float = 0.7) -> DataFrame:
    """(request_id, id, place): all that the query names, in order of rank, then what is unlike what is taken; `top` in all.

    Facts of one slot are alike by 1, others by the Jaccard similarity of their tokens. A request's ranked facts are a
    short list, so each request is one small group.
    """

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rank")
        ids, score, slot, words = g["id"].tolist(), g["score"].tolist(), g["slot_key"].tolist(), [set(t) for t in g["_t"]]

        def like(i: int, j: int) -> float:
            either = len(words[i] | words[j])
            return 1.0 if slot[i] == slot[j] else len(words[i] & words[j]) / either if words[i] and words[j] else 0.0

        order = list(range(len(ids)))
        if len(ids) > top:
            order, left, near = [0], list(range(1, len(ids))), [0.0] * len(ids)
            while len(order) < top:
                for i in left:
                    near[i] = max(near[i], like(i, order[-1]))
                best = max(left, key=lambda i: (balance * score[i] - (1 - balance) * near[i], -i))
                order.append(best)
                left.remove(best)
        named = [i for i, m in enumerate(g["matched"]) if m]
        final = list(dict.fromkeys([*named, *order]))[:top]
        return pd.DataFrame({"request_id": g["request_id"].iloc[0], "id": [ids[i] for i in final], "place": range(1, len(final) + 1)})

    d = ranked.select("request_id", "id", "rank", "score", "slot_key", "matched", tokens(F.col("content")).alias("_t"))
    return d.groupBy("request_id").applyInPandas(pick, f"request_id {dict(ranked.dtypes)['request_id']}, id {dict(ranked.dtypes)['id']}, place int")


def bundles(requests: DataFrame, facts: DataFrame, as_of: int, top: int = 16, core: int = 4, related: int = 6, uncertain: int = 3, injected: DataFrame | None = None, vectors: DataFrame | None = None, vectors_from: int = 0, cut: bool = True) -> DataFrame:
    """What each request gets: (request_id, route, bucket, position, id, content, ...), the whole read path.

    route, candidates, visibility, ranks, diversity, then novelty (what the query says already, and what `injected`
    (request_id, id) had lately unless named, goes; pinned facts stay), then buckets: unsure facts apart; named ones,
    and sure ones of the asker, the owner or pinned about lasting things, are core up to `core`; the rest are related.
    With cut=False all facts that a request meets are ranked; their heads are written, so that this is done once.
    """
    ranked = ranked_facts(requests, facts, as_of, top, vectors=vectors, vectors_from=vectors_from, cut=cut)
    ranked = ranked if cut else written(ranked, "ranked")
    d = ranked.join(chosen(ranked, top), ["request_id", "id"])
    if injected is not None:
        d = d.join(injected.select("request_id", "id", F.lit(True).alias("_lately")), ["request_id", "id"], "left")
        again = F.coalesce("_lately", F.lit(False)) & F.col("route").isin("long_term", "current_status", "history") & ~F.col("pinned") & ~F.col("matched")
        d = d.where(~again).drop("_lately")
    d = d.where(~matching.said_already(F.col("query"), F.array("value"), F.col("content"), F.col("value"), F.col("pinned")))
    unsure = (F.col("mention_policy") == "uncertain") | (F.col("confidence") < UNSURE)
    mine = F.array_contains("speaker_ids", F.col("speaker_id")) | (F.col("scope") == "owner") | F.col("pinned")
    kind = F.when(unsure, "uncertain").when(F.col("matched") | (mine & (F.col("confidence") >= SURE) & F.col("attribute").isin(*CORE)), "core").otherwise("related")
    w = lambda *c: Window.partitionBy("request_id", *c).orderBy("place")
    d = d.withColumn("_kind", kind).withColumn("_n", F.row_number().over(w("_kind")))
    d = d.withColumn("bucket", F.when((F.col("_kind") == "core") & (F.col("_n") > core), "related").otherwise(F.col("_kind"))).withColumn("position", F.row_number().over(w("bucket")))
    few = F.when(F.col("route") == "current_status", max(2, related // 2)).otherwise(related)
    most = F.when(F.col("bucket") == "core", core).when(F.col("bucket") == "related", few).otherwise(uncertain)
    return d.where(F.col("position") <= most).drop("_kind", "_n")


def histories(requests: DataFrame, facts: DataFrame, limit: int, cut: bool = True) -> DataFrame:
    """Of requests with start and end of a time: the facts that are over and held within it, ranked, with `current`.

    current: the text of the live fact that three links of superseded_by lead to at most, else null. The newest OWN of a
    request are ranked; with cut=False all of them, for requests so few that they are sent to the facts.
    """
    closed = facts.where("status != 'live' and speaker_id != 'bot_self'")
    c = F.col
    within = (c("created_at") <= c("end")) & (c("updated_at") >= c("start")) & ((c("expires_at") == 0) | (c("expires_at") >= c("start")))
    asked = F.concat("speaker_ids", F.array(F.lit("#owner")))
    if cut:
        keyed = closed.withColumn("_key", c("speaker_id")).unionByName(closed.where("scope = 'owner'").withColumn("_key", F.lit("#owner")))
        met = requests.select("*", F.explode(F.array_distinct(asked)).alias("_key")).join(keyed, "_key").where(within).drop("_key").dropDuplicates(["request_id", "id"])
        newest = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("updated_at"), "id"))
        met = met.withColumn("_n", newest).where(c("_n") <= OWN).drop("_n")
    else:
        met = _meeting(requests, closed, asked, _fact_keys()).where(within)
    reason = visibility.history_reason(c("persona_id"), c("scope"), c("speaker_id"), c("speaker_name"), c("origin_window"), query=c("query"), ids=c("speaker_ids"), ask_persona=c("ask_persona"), ask_window=c("window_tag"), isolation=c("isolation"), owners=c("owners"))
    d = _worded(met.where(reason == "visible"), cut)
    inside = F.least(c("end") - c("start"), c("end") - F.greatest("start", "created_at")) > 0
    s = scores.history_score(c("words"), scores.age_days(c("as_of"), c("updated_at")), c("confidence"), c("pinned"), inside, F.lit(False))
    d = d.withColumn("score", F.round(s, 9)).withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), "id"))).where(c("rank") <= limit)
    step = facts.select(c("id").alias("_to"), c("status").alias("_status"), c("content").alias("_text"), c("superseded_by").alias("_next"))
    d = d.withColumn("_at", c("superseded_by")).withColumn("current", F.lit(None).cast("string"))
    for _ in range(3):
        d = d.join(step, c("_at") == c("_to"), "left")
        found = c("current").isNull() & (c("_status") == "live")
        d = d.withColumn("current", F.when(found, c("_text")).otherwise(c("current"))).withColumn("_at", F.when(c("_status") != "live", c("_next"))).drop("_to", "_status", "_text", "_next")
    return d.drop("_at")


def ranked_episodes(requests: DataFrame, episodes: DataFrame, limit: int) -> DataFrame:
    """(request_id, id, score, rank): the episodes that an asker may see, all of them scored; the best `limit`.

    requests have start and end: the time that the route looks back on, 0 for no bound; they are few, and sent to the
    episodes. They meet by each of an episode's speakers, by window under strict isolation, and the owner's by themselves.
    """
    c = F.col
    strict = (c("isolation") == "strict") & (c("window_tag") != "")
    asked = F.when(strict, F.array(F.concat(F.lit("@"), "window_tag"))).otherwise(F.concat("speaker_ids", F.array(F.lit("#owner"))))
    held = F.concat("event_speakers", F.array(F.concat(F.lit("@"), "event_window"), F.when(c("scope") == "owner", "#owner")))
    met = _meeting(requests, episodes, asked, held)
    met = met.where(((c("start") == 0) | (c("end_ts") >= c("start"))) & ((c("end") == 0) | (c("start_ts") <= c("end"))))
    reason = visibility.episode_reason(c("status"), c("review_status"), c("persona_id"), c("scope"), c("event_speakers"), c("event_window"), route=c("route"), ids=c("speaker_ids"), ask_persona=c("ask_persona"), ask_window=c("window_tag"), isolation=c("isolation"), owners=c("owners"))
    d = with_words(met.where(reason == "visible"), matching.fact_text(c("title"), c("summary")))
    weight = scores.decay_weight(c("importance"), c("confidence"), c("pinned"), F.lit(0), c("end_ts"), c("as_of"))
    before = (c("end") > 0) & (c("end_ts") <= c("end"))
    named = matching.names(c("query"), F.array("title", "summary"))
    s = scores.event_score(c("words"), scores.age_days(c("as_of"), c("end_ts")), c("confidence"), weight, c("pinned"), named, c("route"), before, F.lit(False))
    d = d.withColumn("score", F.round(s, 9)).withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), "id")))
    return d.where(c("rank") <= limit).select("request_id", "id", "score", "rank")


# The blocks of a pack in the order in which they are filled, with the place where each is shown and its title.
BLOCKS = {
    "history": (4, "【当时】当时 的状态；这是过去，可能已被更新，不要当现状说。"), "events": (5, "【事件】按时间回忆用；可能不完整，不要当逐字记录。"), "core": (6, "【核心】"), "related": (7, "【本轮相关】"),
    "promises": (8, "【约定】相关时才提，不要催。"), "statuses": (9, "【近况】可能已过期，只作参考。"), "uncertain": (10, "【不确定】只能带不确定感。"),
}
#: What asks for promises, and for how someone is.
PROMISE_CUE = "(约定|说好|答应|约好|计划|提醒|别忘了|记得|上次说|办了吗|完成了吗)"
STATUS_CUE = "(近况|最近|这几天|状态|还好吗|怎么样|身体|加班|熬夜|感冒|发烧|失眠|出差|请假)"
TITLES = {k: title for k, (_, title) in BLOCKS.items()}


def blocks(found: DataFrame) -> DataFrame:
    """What `bundles` found, with `block`: related promises and statuses have blocks of their own, if they are called for.

    They are where the route looks back, the query has their cue, or it says what one of them is about; else they go.
    """
    kind = F.when(F.col("bucket") != "related", F.col("bucket")).when(F.col("attribute") == "promise", "promises").when(F.col("attribute") == "status", "statuses").otherwise("related")
    d = found.withColumn("block", kind)
    q = F.col("query")
    said = matching.says(q, F.array("value")) & ~(gates.question_like(q) & matching.richer(F.col("content"), F.col("value")))
    any_said = F.max(said.cast("int")).over(Window.partitionBy("request_id", "block")) == 1
    promises = F.col("route").isin("recall", "time_window") | q.rlike(PROMISE_CUE) | any_said
    statuses = F.col("route").isin("current_status", "recall", "time_window") | q.rlike(STATUS_CUE) | any_said
    return d.withColumn("_called", F.when(F.col("block") == "promises", promises).when(F.col("block") == "statuses", statuses).otherwise(True)).where("_called").drop("_called")


def packs(lines: DataFrame, budget: int = 1000, head: str = "<memory>", tail: str = "</memory>") -> DataFrame:
    """(request_id, pack): the lines (request_id, block, position, line) of each request as one text within the budget.

    Blocks are filled in the order of BLOCKS and shown in that of their places; a line that does not fit is passed over,
    a block without lines goes, and a request without blocks has no pack.
    """
    of = lambda values: F.create_map(*[F.lit(x) for kv in zip(BLOCKS, values) for x in kv])[F.col("block")]
    row = F.struct(of(range(len(BLOCKS))).alias("fill"), F.col("position").alias("position"), of([p for p, _ in BLOCKS.values()]).alias("place"), of([t for _, t in BLOCKS.values()]).alias("title"), F.col("line").alias("line"))
    rows = lines.groupBy("request_id").agg(F.array_sort(F.collect_list(row)).alias("_rows"))

    def add(done: Column, r: Column) -> Column:
        piece = F.when(done["fill"] == r["fill"], r["line"]).otherwise(F.concat_ws("\n", r["title"], r["line"]))
        used = done["used"] + 1 + F.length(piece)
        kept = F.struct(r["place"].alias("place"), r["fill"].alias("fill"), r["position"].alias("position"), piece.alias("piece"))
        return F.when(used + 1 + len(tail) <= budget, F.struct(F.array_append(done["kept"], kept).alias("kept"), used.alias("used"), r["fill"].alias("fill"))).otherwise(done)

    start = F.struct(F.array().cast("array<struct<place:int,fill:int,position:int,piece:string>>").alias("kept"), F.lit(len(head)).alias("used"), F.lit(-1).alias("fill"))
    kept = F.array_sort(F.aggregate("_rows", start, add)["kept"])
    shown = F.array_join(F.transform("_kept", lambda x: x["piece"]), "\n")
    return rows.withColumn("_kept", kept).where(F.size("_kept") > 0).select("request_id", F.concat_ws("\n", F.lit(head), shown, F.lit(tail)).alias("pack"))
