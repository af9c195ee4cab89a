"""Tables of a data folder, and the engine's own shapes (timeline, facts) as projections of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Seconds since 1970 of a time without a zone, whatever the session's zone.
EPOCH_SQL = "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """A table of fewer pieces than there are cores, dealt to all of them before its texts are worked on; others as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < 2 * cores else rows


def conversation_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages (id, ts, window_tag, speaker_id, role, content): even conversations are groups, odd ones private."""
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("conv_id") % 2 == 0, "qq:GroupMessage:").otherwise("qq:FriendMessage:")
    speaker = F.when(F.col("role") == "assistant", "bot_self").otherwise(F.concat(F.lit("u"), (F.col("conv_id") % 37).cast("string")))
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), (F.col("conv_id") * 86400 + F.col("turn") * 60).alias("ts"),
        F.concat(kind, F.col("conv_id").cast("string")).alias("window_tag"), speaker.alias("speaker_id"), "role", F.col("text").alias("content"),
    )


def event_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages (id, ts, speaker_id, window_tag, kind, value): one window for each event type."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.expr(EPOCH_SQL).alias("ts"), F.col("user_id").alias("speaker_id"), F.concat(F.lit("qq:GroupMessage:"), "event_type").alias("window_tag"), F.col("event_type").alias("kind"), "value")


def event_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with history: a slot for each user and event type, a new value with each event."""
    e = table(spark, sf_dir, "events")
    k, s = F.get_json_object("props", "$.k").cast("int"), F.expr(EPOCH_SQL)
    return e.select(
        F.col("event_id").alias("id"), F.concat_ws("|", F.lit(""), F.col("user_id").cast("string"), F.lit("self"), F.col("event_type")).alias("slot_key"),
        F.col("user_id").cast("string").alias("speaker_id"), F.col("event_type").alias("attribute"), F.round("value").cast("long").alias("value"),
        (F.floor(F.col("value")) % 10 / 10.0).alias("confidence"), (k / 100.0).alias("importance"), (k % 29 == 0).alias("pinned"), (k % 5).alias("access_count"),
        F.when(k % 7 == 0, "owner").otherwise("person").alias("scope"), F.when(k % 11 == 0, "archived").when(k % 13 == 0, "superseded").otherwise("live").alias("status"),
        s.alias("created_at"), (s + k * 3600).alias("updated_at"), F.when(k % 17 == 0, s + 86400).otherwise(0).cast("long").alias("expires_at"),
    )


def memory_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_facts with all that retrieval reads: texts, personas, windows, policies and links to what came after."""
    f = event_facts(spark, sf_dir)
    w = Window.partitionBy("slot_key").orderBy("created_at", "id")
    private = F.concat(F.lit("qq:FriendMessage:"), "speaker_id")
    return f.withColumn("superseded_by", F.lead("id").over(w)).select(
        "id", "slot_key", "speaker_id", F.concat(F.lit("user"), "speaker_id").alias("speaker_name"), "attribute", F.col("value").cast("string").alias("value"),
        F.concat("attribute", F.lit(" "), F.col("value").cast("string"), F.lit(" by user"), "speaker_id").alias("content"), "confidence", "importance", "pinned", "access_count", "scope", "status",
        "created_at", "updated_at", "expires_at", "superseded_by", F.when(F.col("id") % 3 == 0, "p1").otherwise("").alias("persona_id"),
        F.when(F.col("id") % 4 == 0, private).otherwise("qq:GroupMessage:1").alias("origin_window"), F.when(F.col("id") % 6 == 0, "uncertain").otherwise("mention").alias("mention_policy"),
    )


def event_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes: a user's events of a day, with speakers, a window, and marks by the day's number."""
    e = event_timeline(spark, sf_dir).withColumn("day", F.floor(F.col("ts") / 86400))
    g = e.groupBy("speaker_id", "day").agg(F.min("id").alias("id"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.min("kind").alias("kind"), F.count("*").alias("n"))
    speaker = F.col("speaker_id").cast("string")
    return g.select(
        "id", "start_ts", "end_ts", F.concat("kind", F.lit(" day")).alias("title"), F.concat(F.col("n").cast("string"), F.lit(" events of user"), speaker).alias("summary"),
        F.array(speaker, F.concat(F.lit("u"), (F.col("speaker_id") % 5).cast("string"))).alias("event_speakers"), F.concat(F.lit("qq:GroupMessage:"), "kind").alias("event_window"),
        F.when(F.col("day") % 5 == 0, "owner").otherwise("person").alias("scope"), F.when(F.col("day") % 7 == 0, "archived").otherwise("live").alias("status"),
        F.when(F.col("n") > 4, "needs_review").otherwise("").alias("review_status"), F.when(F.col("id") % 3 == 0, "p1").otherwise("").alias("persona_id"),
        (F.col("n") / 10.0).alias("confidence"), F.lit(0.5).alias("importance"), (F.col("id") % 29 == 0).alias("pinned"),
    )
