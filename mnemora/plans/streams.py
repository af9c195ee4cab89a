"""Named queries that run a stream, or rounds, over a table and read what they leave, with the SQL of their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.sources.tables import event_timeline
from mnemora.storage import shared_dir
from mnemora.streaming import jobs
from mnemora.streaming.cursor import Consumer

from .catalogue import query

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _stateful(spark: SparkSession) -> None:
    spark.conf.set(PROVIDER, ROCKSDB)


@query("SELECT DISTINCT user_id, event_type, value FROM events")
def stream_ingest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs.deduplicated(jobs.events(spark, sf_dir), ["user_id", "event_type", "value"], "60 days")
    return jobs.drained(rows.select("user_id", "event_type", "value"), "append")


@query("""WITH g AS (SELECT *, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w > 2700000000)::INT, 1) AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
  s AS (SELECT event_type, ts, sum(new) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS session FROM g),
  m AS (SELECT event_type, count(*) AS messages, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us FROM s GROUP BY event_type, session)
  SELECT event_type, messages, start_us, end_us FROM m WHERE end_us + 2700000000 < (SELECT epoch_ms(max(ts)) * 1000 FROM events)""")
def stream_session_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.drained(jobs.closed_sessions(jobs.events(spark, sf_dir), "event_type", 2700), "append")


@query("""SELECT event_type, minute, n FROM (SELECT event_type, epoch_us(ts) // 3600000000 * 3600 AS minute, count(*) AS n FROM events GROUP BY ALL)
  WHERE n > 3 AND (minute + 3600) * 1000 <= (SELECT epoch_ms(max(ts)) FROM events)""")
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.drained(jobs.over_limit(jobs.events(spark, sf_dir), "event_type", 3, "1 hour"), "append")


@query("SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[A-Za-z]{2,16}|[一-鿿]{2,8}')) AS term FROM conversations) GROUP BY term")
def stream_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.drained(jobs.running_term_counts(jobs.stream_of(spark, sf_dir, "conversations")), "complete")


@query(None)
def stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    _stateful(spark)
    return jobs.drained(jobs.debounced(jobs.events(spark, sf_dir), "user_id", "event_type", "event_id", gap=3600, span=4 * 3600, most=4), "append")


@query(None)
def stream_unanswered(spark: SparkSession, sf_dir: str) -> DataFrame:
    _stateful(spark)
    rows = jobs.events(spark, sf_dir)
    return jobs.drained(jobs.unanswered_questions(rows, "event_type", "user_id", F.col("value") > 100, "event_id", 600), "append")



#: Where the episodes of events are cut: after so much silence, and so long after their start; and the least messages of one.
CUT = {"gap": 6 * 3600, "span": 24 * 3600, "least": 2}


@query(f"""WITH RECURSIVE e AS (SELECT event_id AS id, epoch_us(ts) // 1000000 AS ts, user_id, event_type FROM events),
  g AS (SELECT *, coalesce((ts - lag(ts) OVER w > {CUT["gap"]})::INT, 1) AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, id)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, id) AS piece FROM g), p AS (SELECT *, row_number() OVER (PARTITION BY user_id, piece ORDER BY ts, id) AS n FROM s),
  r AS (SELECT user_id, piece, id, ts, event_type, n, ts AS start, 1 AS part FROM p WHERE n = 1 UNION ALL
    SELECT p.user_id, p.piece, p.id, p.ts, p.event_type, p.n, CASE WHEN p.ts - r.start > {CUT["span"]} THEN p.ts ELSE r.start END, CASE WHEN p.ts - r.start > {CUT["span"]} THEN r.part + 1 ELSE r.part END
    FROM r JOIN p ON p.user_id = r.user_id AND p.piece = r.piece AND p.n = r.n + 1)
  SELECT user_id, min(id) AS start_id, max(id) AS last_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS messages, count(DISTINCT event_type) AS kinds
  FROM r GROUP BY user_id, piece, part HAVING count(*) FILTER (WHERE event_type <> 'error') >= {CUT["least"]}""")
def cursor_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of users in rounds: a quarter of the time each, with work that fails for a fifth of the users in all of
    them, and one that closes what is left. SQL gives what one run over everything does."""
    e = event_timeline(spark, sf_dir).select(F.col("speaker_id").alias("user_id"), "id", "ts", F.when(F.col("kind") == "error", "assistant").otherwise("user").alias("role"), "kind")
    lo, hi = e.agg(F.min("ts"), F.max("ts")).first()
    failing = True

    def work(rows: DataFrame) -> DataFrame:
        ok = ~((F.col("user_id") % 5 == 0) & (F.col("session") % 2 == 0) & F.lit(failing))
        return rows.groupBy("user_id", "session").agg(F.countDistinct("kind").alias("kinds")).withColumn("ok", ok)

    c = Consumer(spark, f"{shared_dir(spark)}/mnemora/cursor-{uuid.uuid4().hex}", "user_id", work=work, **CUT)
    quarter = F.least(F.lit(3), F.floor((F.col("ts") - F.lit(lo)) * 4 / F.greatest(F.lit(1), F.lit(hi) - F.lit(lo))))
    for n in range(4):
        c.step(e.where(quarter == n))
    failing = False
    c.step(force=True)
    return c.done().select("user_id", "start_id", "last_id", "start_ts", "end_ts", "messages", "kinds")
