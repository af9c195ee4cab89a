"""Episodes as records: who took part, what is said without a model, which earlier episode goes on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions.gates import EPISODE_CUE
from mnemora.functions.text import clip, fingerprint, text_or_empty


def participants(messages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, id, role, first_ts, place): each speaker of an episode once, in order of first words; the bot under one id.

    Distinct speakers are made before the exchange, so an episode of very many messages is a few rows.
    """
    bot = (F.col("role") == "assistant") | text_or_empty(F.col("speaker_id")).isin("", "bot_self")
    d = messages.select(*keys, F.when(bot, "bot_self").otherwise(F.col("speaker_id")).alias("id"), F.when(bot, "assistant").otherwise("user").alias("role"), "ts", F.col("id").alias("_m"))
    g = d.groupBy(*keys, "id", "role").agg(F.min(F.struct("ts", "_m")).alias("_first"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_first"))
    return g.withColumn("place", place).select(*keys, "id", "role", F.col("_first.ts").alias("first_ts"), "place")


def recaps(messages: DataFrame, keys: Sequence[str], title_chars: int = 20, line_chars: int = 80, summary_chars: int = 200, last: int = 4) -> DataFrame:
    """(keys, start_ts, end_ts, kind, title, summary, fingerprint, importance, confidence, review_status): without a model.

    The title is the first message of a user, or of the episode; the summary the last four of users. Only these few
    messages of an episode are gathered. Such recaps wait for a review.
    """
    c = F.col
    user = (c("role") == "user") & (c("speaker_id") != "bot_self")
    w = lambda *o: Window.partitionBy(*keys, "_user").orderBy(*o)
    d = messages.withColumn("_user", user)
    d = d.withColumn("_up", F.row_number().over(w("ts", "id"))).withColumn("_down", F.row_number().over(w(F.desc("ts"), F.desc("id"))))
    few = F.array_sort(F.collect_list(F.when(user & (c("_down") <= last), F.struct("ts", "id", clip(c("content"), line_chars).alias("line")))))
    g = d.groupBy(*keys).agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.max(F.when(user & c("content").rlike(EPISODE_CUE), 1)).alias("_life"),
        F.min(F.when(user & (c("_up") == 1), c("content"))).alias("_first"), F.min(F.when(~user & (c("_up") == 1), c("content"))).alias("_other"), F.transform(few, lambda x: x["line"]).alias("_lines"),
    )
    title = clip(F.coalesce(F.nullif(F.coalesce(c("_first"), c("_other")), F.lit("")), F.lit("一段对话")), title_chars)
    said = clip(F.array_join("_lines", " / "), summary_chars)
    g = g.withColumn("title", title).withColumn("summary", F.when(said != "", said).otherwise(c("title")))
    return g.select(
        *keys, "start_ts", "end_ts", F.when(c("_life") == 1, "life").otherwise("talk").alias("kind"), "title", "summary", fingerprint(*map(F.col, keys), c("start_ts"), c("title")).alias("fingerprint"),
        F.lit(0.5).alias("importance"), F.lit(0.3).alias("confidence"), F.lit("needs_review").alias("review_status"),
    )


def continued(new: DataFrame, old: DataFrame, key: str, within: int, span: int) -> DataFrame:
    """new episodes with `target`: the last old one of their window that ended at most `within` seconds before, or null.

    The two together must not be longer than `span`. One window over both sides: no pairs.
    """
    both = new.select(F.col(key), F.col("start_ts").alias("_at"), F.lit(1).alias("_side"), F.col("id"), "start_ts", "end_ts")
    both = both.unionByName(old.select(F.col(key), F.col("end_ts").alias("_at"), F.lit(0).alias("_side"), F.col("id"), "start_ts", "end_ts"))
    w = Window.partitionBy(key).orderBy("_at", "_side", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("_side") == 0, F.struct("id", "start_ts", "end_ts")), ignorenulls=True).over(w)
    d = both.withColumn("_last", last).where("_side = 1")
    fits = (F.col("start_ts") - F.col("_last.end_ts") <= within) & (F.col("end_ts") - F.col("_last.start_ts") <= span)
    return d.select(F.col("id"), F.col(key), F.when(fits, F.col("_last.id")).alias("target"))


def cleaned(draft: DataFrame) -> DataFrame:
    """A model's drafts (kind, title, summary, highlights, keywords, importance, confidence) within their bounds.

    The fallback columns fallback_title and fallback_summary stand in for empty texts; kinds other than life and talk
    are talk; lists lose repeats and are cut to 4 and 6; rates are clamped to 0 .. 1, else 0.5.
    """
    rate = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(c).try_cast("double"), F.lit(0.5))))
    few = lambda c, chars, most: F.slice(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: clip(x, chars)), lambda x: x != "")), 1, most)
    kind = F.lower(F.trim(text_or_empty(F.col("kind"))))
    own = {
        "kind": F.when(kind.isin("life", "talk"), kind).otherwise("talk"), "title": F.coalesce(F.nullif(clip(F.col("title"), 40), F.lit("")), F.col("fallback_title")), "summary": F.coalesce(F.nullif(clip(F.col("summary"), 240), F.lit("")), F.col("fallback_summary")),
        "highlights": few(F.col("highlights"), 40, 4), "keywords": few(F.col("keywords"), 16, 6), "importance": rate("importance"), "confidence": rate("confidence"),
    }
    return draft.withColumns(own).drop("fallback_title", "fallback_summary")


def merged_evidence(rows: DataFrame, keys: Sequence[str], evidence: str, order: Sequence[Column]) -> DataFrame:
    """(keys, evidence, confidence, importance, n): rows of one slot and value as one: evidence in order of first use.

    Pieces of evidence are made distinct before they are gathered, so what is repeated costs nothing.
    """
    d = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    best = d.groupBy(*keys).agg(F.max("confidence").alias("confidence"), F.max("importance").alias("importance"), F.count("*").alias("n"))
    first = d.select(*keys, "_n", F.posexplode(evidence).alias("_p", "_e")).groupBy(*keys, "_e").agg(F.min(F.struct("_n", "_p")).alias("_at"))
    lists = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_e"))), lambda x: x["_e"]).alias("evidence"))
    return best.join(lists, list(keys), "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(rows.schema[evidence].dataType)))
