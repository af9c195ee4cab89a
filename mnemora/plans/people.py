"""Named queries on people: birthdays, members, settings, cards, statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions import addressee, extraction, slots, text
from mnemora.operators import cards, joins, people, retrieval, windows
from mnemora.sources.tables import conversation_timeline, event_facts, table

from .catalogue import AS_OF, FACTS, query


@query("""WITH m AS (SELECT c_custkey, c_custkey % 12 + 1 AS month, c_custkey % 31 + 1 AS day FROM customer),
  d AS (SELECT c_custkey, try_cast(format('{}-{:02d}-{:02d}', y, month, day) AS DATE) - DATE '2024-02-20' AS until FROM m, (VALUES (2024), (2025)) t(y))
  SELECT c_custkey, min(until)::INT AS days_until FROM d WHERE until >= 0 GROUP BY c_custkey HAVING min(until) <= 14""")
def upcoming_birthdays(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 12 + 1).cast("string").alias("month"), (F.col("c_custkey") % 31 + 1).cast("string").alias("day"))
    return people.upcoming_birthdays(c, F.lit("2024-02-20").cast("date"), 14).select("c_custkey", "days_until")


@query("""WITH a(asked) AS (VALUES ('nation_1'), ('NATION_20'), ('3'), ('tion_7'), ('nobody')),
  m AS (SELECT asked, n_nationkey, CASE WHEN n_nationkey::VARCHAR = lower(asked) THEN 0 WHEN lower(n_name) = lower(asked) THEN 1 WHEN contains(lower(n_name), lower(asked)) THEN 2 END AS tier FROM a, nation),
  b AS (SELECT *, min(tier) OVER (PARTITION BY asked) AS best FROM m WHERE tier IS NOT NULL)
  SELECT asked, n_nationkey, tier::INT AS tier, count(*) OVER (PARTITION BY asked) > 1 AS ambiguous FROM b WHERE tier = best""")
def member_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([("nation_1",), ("NATION_20",), ("3",), ("tion_7",), ("nobody",)], "asked string")
    return people.resolved_members(asked, table(spark, sf_dir, "nation"), "asked", "n_nationkey", ("n_name",))


@query("""WITH a AS (SELECT n_name AS key, n_regionkey::VARCHAR AS value FROM nation WHERE n_nationkey < 20), b AS (SELECT n_name AS key, (n_nationkey % 3)::VARCHAR AS value FROM nation WHERE n_nationkey > 4)
  SELECT key, a.value AS old, b.value AS new, CASE WHEN a.value IS NULL THEN 'added' WHEN b.value IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (key) WHERE a.value IS DISTINCT FROM b.value""")
def preset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    a = n.where("n_nationkey < 20").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    b = n.where("n_nationkey > 4").select(F.col("n_name").alias("key"), (F.col("n_nationkey") % 3).cast("string").alias("value"))
    return people.settings_diff(a, b)


@query(f"""WITH {FACTS}, v AS (SELECT speaker_id, attribute, value::VARCHAR AS value, contains('is it 12 or 7', value::VARCHAR) OR contains(value::VARCHAR, 'is it 12 or 7') AS named, max(updated_at) AS seen FROM facts GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY speaker_id, attribute ORDER BY named DESC, seen DESC, value)::INT AS position FROM v)
  SELECT speaker_id, attribute, position, value FROM r WHERE position <= CASE WHEN named THEN 4 ELSE 3 END""")
def profile_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = event_facts(spark, sf_dir).select("speaker_id", "attribute", F.col("value").cast("string").alias("value"), F.lit("").alias("plain"), F.lit("").alias("content"), "updated_at", "expires_at")
    return cards.profile_card(f, "is it 12 or 7", AS_OF)


@query("SELECT event_id, 'at:' || user_id || '|user ' || user_id || ',at:all|' AS addressee, 2 AS n, user_id = 7 AS mentioned FROM events")
def addressee_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    raw = F.concat(F.lit("at:"), F.col("user_id").cast("string"), F.lit("|user "), F.col("user_id").cast("string"), F.lit(" , bad,at:all|"))
    return e.select("event_id", addressee.encode(addressee.decode(raw)).alias("addressee"), F.size(addressee.decode(raw)).alias("n"), addressee.mentions(raw, "7").alias("mentioned"))


@query("SELECT event_id, CASE event_type WHEN 'signup' THEN 'signup' ELSE event_type END AS attribute, 'note' AS kind, CASE WHEN user_id = 7 THEN 'self' ELSE user_id::VARCHAR END AS subject FROM events")
def slot_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    subject = slots.canonical_subject(F.col("user_id").cast("string"), F.lit("7"), F.lit(""))
    return e.select("event_id", slots.canonical_attribute(F.col("event_type")).alias("attribute"), slots.fact_kind(F.col("event_type")).alias("kind"), subject.alias("subject"))


@query(None)
def self_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.statements(conversation_timeline(spark, sf_dir))


@query("""SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.c, b.c)) / len(a.c)::DOUBLE, 6) AS overlap FROM
  (SELECT item_id, list_distinct(string_split(text, '')) AS c FROM benchmark) a JOIN (SELECT item_id, list_distinct(string_split(text, '')) AS c FROM benchmark) b ON a.item_id < b.item_id""")
def char_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "benchmark")
    a, b = t.select(F.col("item_id").alias("a"), F.col("text").alias("x")), t.select(F.col("item_id").alias("b"), F.col("text").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(text.char_overlap(F.col("x"), F.col("y")), 6).alias("overlap"))


@query(None)
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = event_facts(spark, sf_dir).where("status = 'live'")
    top = live.groupBy("speaker_id", "attribute").agg(F.array_sort(F.collect_set(F.col("value").cast("string"))).alias("lines"))
    fill = F.when(F.col("attribute") == "purchase", 0).otherwise(1)
    blocks = top.select("speaker_id", fill.alias("fill"), (1 - fill).alias("place"), F.concat(F.col("attribute"), F.lit(":")).alias("title"), "lines")
    return cards.context_pack(blocks, "speaker_id", 120)


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN doc_id ELSE doc_id - doc_id % 4 END AS resolved FROM documents")
def identity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.col("doc_id")).otherwise(F.col("doc_id") - 1).alias("alias_of"))
    return joins.resolve_chain(links, "doc_id", "alias_of", 4).select("doc_id", "resolved")


@query("""WITH RECURSIVE r AS (SELECT conv_id, turn, coalesce(length(text), 0) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
  walk AS (
    SELECT conv_id, turn, i, 0 AS chunk, 1 AS n, size AS used FROM r WHERE i = 1
    UNION ALL
    SELECT r.conv_id, r.turn, r.i, w.chunk + (w.n >= 4 OR w.used + r.size > 600)::INT, CASE WHEN w.n >= 4 OR w.used + r.size > 600 THEN 1 ELSE w.n + 1 END,
      CASE WHEN w.n >= 4 OR w.used + r.size > 600 THEN r.size ELSE w.used + r.size END
    FROM walk w JOIN r ON r.conv_id = w.conv_id AND r.i = w.i + 1)
  SELECT conv_id * 1000 + turn AS id, chunk::INT AS chunk FROM walk""")
def session_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.chunks_within(conversation_timeline(spark, sf_dir), ["window_tag"], 4, 600, F.length("content")).select("id", "chunk")


@query(None)
def multi_hop_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.navigate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
