"""Named queries of lists, counters and settings that panels, commands and jobs show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemora.functions import gates, matching, scores, visibility
from mnemora.functions.text import tokens
from mnemora.operators import aggregates, cards, filters, joins, maintenance, people, windows
from mnemora.sources.tables import conversation_timeline, event_episodes, event_facts, event_timeline, table

from .catalogue import AS_OF, EV, FACTS, TL, TOKENS, query
from .requests import _EPISODES

_c = F.col


@query(f"""WITH {FACTS}, top AS (SELECT speaker_id, count(*) AS n FROM facts WHERE status = 'live' GROUP BY 1 ORDER BY n DESC, speaker_id LIMIT 80),
  v AS (SELECT speaker_id, attribute, value::VARCHAR AS value, max(updated_at) AS seen FROM facts WHERE status = 'live' AND speaker_id IN (SELECT speaker_id FROM top) GROUP BY ALL)
  SELECT speaker_id, attribute, value, row_number() OVER (PARTITION BY speaker_id, attribute ORDER BY seen DESC, value)::INT AS position FROM v QUALIFY position <= 3""")
def dossier_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of the 80 speakers with the most live facts, in one grouped plan."""
    f = event_facts(spark, sf_dir).where("status = 'live'")
    top = f.groupBy("speaker_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "speaker_id").limit(80)
    mine = f.join(F.broadcast(top), "speaker_id", "left_semi")  # 80 rows
    d = mine.select("speaker_id", "attribute", F.col("value").cast("string").alias("value"), F.lit("").alias("plain"), F.lit("").alias("content"), "updated_at", "expires_at")
    return cards.profile_card(d, "", AS_OF).select("speaker_id", "attribute", "value", "position")


@query("SELECT c_nationkey, min(c_custkey) FILTER (WHERE c_custkey % 50 = 0) AS owner, coalesce(list(c_custkey ORDER BY c_custkey) FILTER (WHERE c_custkey % 7 = 0 AND c_custkey % 50 <> 0), []) AS admins FROM customer GROUP BY c_nationkey")
def group_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    role = F.when(k % 50 == 0, "owner").when(k % 7 == 0, "admin").otherwise("member")
    return people.group_roles(table(spark, sf_dir, "customer").select("c_nationkey", k.alias("member"), role.alias("role")), "c_nationkey")


@query(f"WITH {EV} SELECT window_tag, ts // 86400 AS day, count(*) AS fires, max(ts) AS last_ts FROM ev WHERE value > 50 GROUP BY ALL")
def fires_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    fired = event_timeline(spark, sf_dir).where("value > 50").withColumn("day", F.floor(F.col("ts") / 86400))
    return fired.groupBy("window_tag", "day").agg(F.count("*").alias("fires"), F.max("ts").alias("last_ts"))


@query("SELECT o_orderstatus AS status, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC)::INT AS rank FROM orders QUALIFY rank <= 100")
def review_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 100 items of each state of review."""
    d = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("id"), "o_orderdate")
    return windows.top_per_key(d, ["status"], [F.desc("o_orderdate"), F.desc("id")], 100).select("status", "id", "rank")


@query(f"WITH {TL} SELECT window_tag, id, row_number() OVER (PARTITION BY window_tag ORDER BY ts, id)::INT AS place FROM (SELECT * FROM tl QUALIFY row_number() OVER (PARTITION BY window_tag ORDER BY ts DESC, id DESC) <= 3)")
def judge_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three messages of each window, oldest first."""
    d = windows.top_per_key(conversation_timeline(spark, sf_dir), ["window_tag"], [F.desc("ts"), F.desc("id")], 3)
    return d.select("window_tag", "id", F.row_number().over(Window.partitionBy("window_tag").orderBy("ts", "id")).alias("place"))


@query("SELECT DISTINCT lower(trim(split_part(text, ' ', 1))) AS term FROM documents WHERE doc_id % 3 < 2 AND trim(split_part(text, ' ', 1)) <> '' UNION SELECT DISTINCT lower(trim(split_part(text, ' ', 1))) FROM benchmark WHERE trim(split_part(text, ' ', 1)) <> ''")
def blocked_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that are not to be suggested again: decided ones and pending ones, as one set."""
    term = lambda name, where: table(spark, sf_dir, name).where(where).select(F.lower(F.trim(F.split_part("text", F.lit(" "), F.lit(1)))).alias("term"))
    return term("documents", "doc_id % 3 < 2").unionByName(term("benchmark", "true")).where("term != ''").distinct()


@query(f"WITH {FACTS} SELECT count(*) FILTER (WHERE status = 'live') AS live, count(*) FILTER (WHERE status = 'live') >= 2500 AS vectors FROM facts")
def vector_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = aggregates.conditional_counts(event_facts(spark, sf_dir), live=F.col("status") == "live")
    return d.select("live", (F.col("live") >= 2500).alias("vectors"))


@query("SELECT 'config' AS origin, 'Bot' AS name, 1 AS place UNION ALL SELECT 'facts', n_name, (1 + row_number() OVER (ORDER BY n_nationkey))::INT FROM nation WHERE n_regionkey = 1")
def bot_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configured names, then those of facts that are no repeats, in order."""
    own = spark.createDataFrame([("config", "Bot", 0, 0)], "origin string, name string, part int, at int")
    known = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.lit("facts").alias("origin"), F.col("n_name").alias("name"), F.lit(1).alias("part"), F.col("n_nationkey").alias("at"))
    first = own.unionByName(known).withColumn("_n", F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("part", "at"))).where("_n = 1")
    return first.select("origin", "name", F.row_number().over(Window.orderBy("part", "at")).alias("place"))  # a handful of names


@query("""SELECT 'facts' AS item, count(*) AS n FROM events UNION ALL SELECT 'messages', count(*) FROM conversations UNION ALL SELECT 'windows', count(DISTINCT conv_id) FROM conversations UNION ALL SELECT 'speakers', count(DISTINCT user_id) FROM events
  UNION ALL SELECT 'calls', count(*) FROM orders UNION ALL SELECT 'aliases', count(*) FROM nation""")
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda name, item, c="*": table(spark, sf_dir, name).agg((F.count("*") if c == "*" else F.count_distinct(F.col(c))).alias("n")).select(F.lit(item).alias("item"), "n")
    parts = [count("events", "facts"), count("conversations", "messages"), count("conversations", "windows", "conv_id"), count("events", "speakers", "user_id"), count("orders", "calls"), count("nation", "aliases")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""WITH {_EPISODES}, a(alias, canonical) AS (SELECT n_nationkey::VARCHAR, 'n' || n_nationkey % 5 FROM nation)
  SELECT id, [coalesce(x.canonical, speakers[1]), coalesce(y.canonical, speakers[2])] AS speakers FROM episodes LEFT JOIN a x ON x.alias = speakers[1] LEFT JOIN a y ON y.alias = speakers[2]""")
def participants_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("alias"), F.concat(F.lit("n"), (F.col("n_nationkey") % 5).cast("string")).alias("canonical"))
    return maintenance.renamed_elements(event_episodes(spark, sf_dir).select("id", F.col("event_speakers").alias("speakers")), aliases, "id", "speakers")


@query("SELECT o_orderkey AS k FROM orders WHERE strftime(o_orderdate, '%Y%m%d') >= '19960101'")
def rate_keys_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of counters whose final stamp is not older than the cut-off."""
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("rate:"), F.col("o_orderkey").cast("string"), F.lit(":"), F.date_format("o_orderdate", "yyyyMMdd")).alias("key"))
    return d.where(F.substring("key", -8, 8) >= "19960101").select("k")


@query(f"""WITH {TL}, t AS (SELECT window_tag, ts, id, CASE WHEN role = 'assistant' THEN '我(Bot)' ELSE speaker_id END || ': ' || trim(content) AS line FROM tl)
  SELECT window_tag, string_agg(line, chr(10) ORDER BY ts, id) AS lines FROM t GROUP BY window_tag""")
def episode_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each conversation, line by line, as a model would be shown it."""
    line = F.concat(F.when(F.col("role") == "assistant", "我(Bot)").otherwise(F.col("speaker_id")), F.lit(": "), F.trim("content"))
    rows = conversation_timeline(spark, sf_dir).groupBy("window_tag").agg(F.array_sort(F.collect_list(F.struct("ts", "id", line.alias("line")))).alias("_l"))
    return rows.select("window_tag", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("lines"))


@query(f"""WITH {FACTS}, log AS (SELECT id, CASE WHEN id % 9 = 0 THEN 'delete' ELSE 'update' END AS op, created_at AS ts, 1 AS change, CASE WHEN id % 4 = 0 THEN 'archived' END AS status, CASE WHEN id % 5 = 0 THEN true END AS pinned FROM facts
    UNION ALL SELECT id, CASE WHEN id % 18 = 0 THEN 'insert' ELSE 'update' END, created_at, 2, CASE WHEN id % 8 = 0 THEN 'live' END, NULL FROM facts)
  SELECT f.id, coalesce(arg_max(l.status, (ts, change)) FILTER (WHERE l.status IS NOT NULL), f.status) AS status, coalesce(arg_max(l.pinned, (ts, change)) FILTER (WHERE l.pinned IS NOT NULL), f.pinned) AS pinned
  FROM facts f JOIN log l USING (id) GROUP BY f.id, f.status, f.pinned HAVING coalesce(arg_max(op, (ts, change)) FILTER (WHERE op IN ('insert', 'delete')), 'insert') = 'insert'""")
def fact_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts after updates, archivings, restorations, pins and deletions, as a fold over the log of them."""
    f, i = event_facts(spark, sf_dir), F.col("id")
    none = F.lit(None)
    one = f.select("id", F.when(i % 9 == 0, "delete").otherwise("update").alias("op"), F.col("created_at").alias("ts"), F.lit(1).alias("change"), F.when(i % 4 == 0, "archived").alias("status"), F.when(i % 5 == 0, True).alias("pinned"))
    two = f.select("id", F.when(i % 18 == 0, "insert").otherwise("update").alias("op"), F.col("created_at").alias("ts"), F.lit(2).alias("change"), F.when(i % 8 == 0, "live").alias("status"), none.cast("boolean").alias("pinned"))
    return maintenance.changed(f, one.unionByName(two), ["status", "pinned"])


@query("SELECT o_orderkey AS id, try_cast(o_orderpriority AS INT) AS importance, 'live' AS status, coalesce(o_totalprice, 0.5)::DOUBLE AS confidence, ''::VARCHAR AS persona_id FROM orders")
def schema_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old rows in the present shape: missing columns and values that do not parse get defaults."""
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("importance"), F.col("o_totalprice").alias("confidence"))
    shape = T.StructType([T.StructField("id", T.LongType()), T.StructField("importance", T.IntegerType()), T.StructField("status", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("persona_id", T.StringType())])
    return maintenance.schema_upgraded(old, shape, {"status": F.lit("live"), "confidence": F.lit(0.5), "persona_id": F.lit("")})


@query(f"""WITH n AS (SELECT DISTINCT name FROM (SELECT unnest({TOKENS.format("text")}) AS name FROM benchmark) WHERE length(name) >= 2), t AS (SELECT conv_id * 1000 + turn AS id, regexp_replace(lower(trim(text)), '[\\s　,，.。!！?？、~～''"“”‘’]+', '', 'g') AS t FROM conversations)
  SELECT id, name FROM t JOIN n ON contains(t, name)""")
def name_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names within texts, inside of words too."""
    names = table(spark, sf_dir, "benchmark").select(F.explode(tokens(F.col("text"))).alias("name")).where(F.length("name") >= 2)
    return joins.names_within(conversation_timeline(spark, sf_dir), names, "id", "content", "name")


@query(f"""WITH d AS (SELECT conv_id * 1000 + turn AS id, list_distinct({TOKENS.format("text")}) AS s FROM conversations)
  SELECT x.id AS a, y.id AS b, round(len(list_intersect(x.s, y.s)) / len(list_distinct(x.s || y.s))::DOUBLE, 6) AS similarity FROM d x JOIN d y ON x.id < y.id AND len(x.s) > 0 AND len(y.s) > 0 AND len(list_intersect(x.s, y.s)) >= 0.2 * len(list_distinct(x.s || y.s))""")
def similar_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that share a fifth of their words or more."""
    d = conversation_timeline(spark, sf_dir).select("id", tokens(F.col("content")).alias("s"))
    return joins.similar_pairs(d, "id", "s", 0.2).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {FACTS} SELECT id, attribute, value::VARCHAR AS value, status, pinned, CASE WHEN status <> 'live' THEN updated_at ELSE 0 END AS valid_to,
  round(CASE WHEN pinned THEN greatest(base, 1.0) ELSE base * pow(0.5, greatest(0.0, ({AS_OF} - greatest(updated_at, created_at)) / 86400.0::DOUBLE) / (30.0 * least(1.0 + 0.5 * access_count, 3.0))) END, 3) AS weight FROM (SELECT *, CASE WHEN importance > 0 THEN importance ELSE confidence END AS base FROM facts)""")
def fact_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts as a panel shows them: with their present weight, and until when they held."""
    f = event_facts(spark, sf_dir)
    weight = scores.decay_weight(_c("importance"), _c("confidence"), _c("pinned"), _c("access_count"), F.greatest("updated_at", "created_at"), F.lit(AS_OF))
    return f.select("id", "attribute", F.col("value").cast("string").alias("value"), "status", "pinned", F.when(_c("status") != "live", _c("updated_at")).otherwise(0).alias("valid_to"), F.round(weight, 3).alias("weight"))


@query(f"""WITH {_EPISODES} SELECT id, title, summary, status, CASE WHEN review THEN 'needs_review' ELSE '' END AS review_status, array_to_string(speakers, ',') AS speakers, end_ts - start_ts AS seconds, round(CASE WHEN pinned THEN 1.0 ELSE 0.5 * pow(0.5, greatest(0.0, ({AS_OF} - end_ts) / 86400.0::DOUBLE) / 30.0) END, 3) AS weight FROM episodes""")
def episode_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_episodes(spark, sf_dir)
    weight = scores.decay_weight(_c("importance"), _c("confidence"), _c("pinned"), F.lit(0), _c("end_ts"), F.lit(AS_OF))
    return e.select("id", "title", "summary", "status", "review_status", F.array_join("event_speakers", ",").alias("speakers"), (_c("end_ts") - _c("start_ts")).alias("seconds"), F.round(weight, 3).alias("weight"))


@query(f"""WITH {FACTS}, n AS (SELECT * FROM facts ORDER BY updated_at DESC, id DESC LIMIT 200) SELECT 'by_scope' AS list, id FROM n WHERE status = 'live' AND scope = 'owner'
  UNION ALL SELECT 'search', id FROM (SELECT id FROM facts WHERE scope = 'owner' AND (contains(attribute, 'sign') OR contains(value::VARCHAR, 'sign')) ORDER BY updated_at DESC, id DESC LIMIT 40)""")
def panel_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 200 facts, filtered; and a search of the owner's facts."""
    f = event_facts(spark, sf_dir)
    order = [F.desc("updated_at"), F.desc("id")]
    first = f.orderBy(*order).limit(200).where("status = 'live' and scope = 'owner'").select(F.lit("by_scope").alias("list"), "id")
    own = filters.contains_any(f.where("scope = 'owner'").withColumn("value", F.col("value").cast("string")), "sign", ["attribute", "value"])
    return first.unionByName(own.orderBy(*order).limit(40).select(F.lit("search").alias("list"), "id"))


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, sum(o_custkey)::BIGINT AS used, CASE WHEN sum(o_custkey) >= 4000 THEN 'daily_token_limit' WHEN sum(o_custkey) >= 2000 THEN 'soft_token_limit' ELSE '' END AS reason FROM orders GROUP BY 1")
def token_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each day, and what holds back a call that is not urgent."""
    used = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.sum("o_custkey").alias("used"))
    return used.withColumn("reason", gates.budget_reason(_c("used"), F.lit(4000), F.lit(2000), F.lit(False), F.lit(0), F.lit(0), F.lit(False)))


@query("SELECT vec_id, list_aggregate(coalesce(CASE WHEN vec_id % 97 <> 0 THEN embedding END, [vec_id::FLOAT, 1.0::FLOAT]), 'count')::INT AS size, vec_id % 97 = 0 AS filled FROM embeddings")
def vector_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a vector get the one that was made for them since; every 97th is emptied here, as the table has none."""
    e = table(spark, sf_dir, "embeddings").withColumn("embedding", F.when(_c("vec_id") % 97 != 0, _c("embedding")))
    made = e.where("embedding is null").select("vec_id", F.array(_c("vec_id").cast("float"), F.lit(1.0).cast("float")).alias("vector"))
    return maintenance.backfilled(e.select("vec_id", "embedding"), made, "vec_id", "embedding", "vector").select("vec_id", F.size("embedding").alias("size"), "filled")
