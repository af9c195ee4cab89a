"""Aggregates: counts, roll-ups, term statistics, merges of state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.functions.text import terms


def conditional_counts(rows: DataFrame, **conditions: Column) -> DataFrame:
    """One row: how many rows meet each condition, in one pass."""
    return rows.agg(*[F.count(F.when(c, 1)).alias(name) for name, c in conditions.items()])


def recent_windows(rows: DataFrame, since: int, limit: int, window: str = "window_tag", ts: str = "ts") -> DataFrame:
    d = rows.where((F.col(window) != "") & (F.col(ts) >= since)).groupBy(window)
    return d.agg(F.count("*").alias("n"), F.max(ts).alias("last_ts")).orderBy(F.desc("last_ts"), window).limit(limit)


def usage_by_day(rows: DataFrame, ts: str, keys: list[str], ok: Column, tokens: Column) -> DataFrame:
    """Calls, failures and tokens by day and keys."""
    d = rows.withColumn("day", F.date_format(F.col(ts), "yyyy-MM-dd"))
    return d.groupBy("day", *keys).agg(F.count("*").alias("calls"), F.count(F.when(~ok, 1)).alias("failed"), F.sum(tokens).alias("tokens"))


def term_counts(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, term, n) of the candidate terms of all texts, lower case."""
    # explode_outer: explode would have every text split once more, to filter out those without terms
    split = rows.select(*keys, F.explode_outer(terms(F.lower(F.col(text)))).alias("term")).where("term is not null")
    return split.groupBy(*keys, "term").agg(F.count("*").alias("n"))


def hot_terms(counts: DataFrame, spread_key: str, least: int, most_share: float, most_spread: int, limit: int, small: int = 80) -> DataFrame:
    """Terms said often, but neither by everyone nor nearly all the time: (term, n, spread)."""
    by_term = counts.groupBy("term").agg(F.sum("n").alias("n"), F.countDistinct(spread_key).alias("spread"))
    total = F.broadcast(counts.agg(F.sum("n").alias("_total")))  # one row
    d = by_term.join(total, how="cross").where((F.col("n") >= least) & (F.col("spread") < most_spread))
    d = d.where((F.col("_total") < small) | (F.col("n") / F.col("_total") <= most_share))
    return d.orderBy(F.desc("n"), "term").limit(limit).drop("_total")


def profiles(rows: DataFrame, key: str = "speaker_id", ts: str = "ts", name: str | None = None) -> DataFrame:
    """Speakers: first and last seen, how often, and the last name that is not empty."""
    aggs = [F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count("*").alias("seen_count")]
    if name:
        aggs.append(F.max_by(F.nullif(F.col(name), F.lit("")), F.when(F.col(name) != "", F.col(ts))).alias("speaker_name"))
    return rows.groupBy(key).agg(*aggs)


def merged_profiles(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two profile tables as one: earliest first seen (0: unknown), latest and largest of the others, a name over none."""
    both = old.unionByName(new)
    return both.groupBy("speaker_id").agg(
        F.coalesce(F.min(F.nullif(F.col("first_seen"), F.lit(0))), F.lit(0)).alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.max("seen_count").alias("seen_count"), F.max_by("speaker_name", F.when(F.col("speaker_name") != "", F.col("last_seen"))).alias("speaker_name"),
    )


def last_values(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key: the state that a log of writes leaves."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")).select(key, "_last.*")


def episodes(rows: DataFrame, keys: list[str], cue: str, least: int) -> DataFrame:
    """Sessions as episodes: bounds, sizes, speakers, kind, and whether they are worth keeping."""
    from mnemora.functions.gates import low_info

    user = F.col("role") == "user"
    d = rows.groupBy(*keys, "session").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("messages"), F.count(F.when(user, 1)).alias("user_messages"),
        F.countDistinct(F.when(user, F.col("speaker_id"))).alias("speakers"), F.coalesce(F.bool_or(user & F.col("content").rlike(cue)), F.lit(False)).alias("cue"),
        F.coalesce(F.bool_and(F.when(user, low_info(F.col("content")))), F.lit(True)).alias("_low"),
    )
    worthy = (F.col("user_messages") > 0) & ~F.col("_low") & ((F.col("user_messages") >= least) | F.col("cue"))
    return d.withColumn("kind", F.when(F.col("cue"), "life").otherwise("talk")).withColumn("worthy", worthy).drop("_low", "cue")


def idle(timeline: DataFrame, key: str, since: Column, now: int, seconds: int) -> DataFrame:
    """(key, since, last_ts, idle): messages after a moment, the last one's time, and whether silence has lasted `seconds`."""
    g = timeline.groupBy(key).agg(F.count(F.when(F.col("ts") > since, 1)).alias("since"), F.max("ts").alias("last_ts"))
    return g.withColumn("idle", now - F.col("last_ts") >= seconds)
