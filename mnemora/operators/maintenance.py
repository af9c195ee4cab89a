"""State as logs and views: guarded ingest, expiry, retention, identity merges."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemora.functions.scores import decay_weight
from mnemora.functions.text import detect_domain, normalize_slot, topic_key


def unseen(new: DataFrame, old: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of new that old does not have, one for each key."""
    return new.dropDuplicates(list(keys)).join(old, list(keys), "left_anti")


def expired(facts: DataFrame, as_of: int) -> DataFrame:
    return facts.withColumn("status", F.when((F.col("status") == "live") & (F.col("expires_at") > 0) & (F.col("expires_at") < as_of), "archived").otherwise(F.col("status")))


def faded(facts: DataFrame, as_of: int, threshold: float = 0.12, least_days: int = 30, half_life: float = 30.0) -> DataFrame:
    """Live, unpinned facts untouched for least_days whose decayed weight is below the threshold, with the weight."""
    last = F.greatest("updated_at", "created_at")
    weight = decay_weight(F.col("importance"), F.col("confidence"), F.col("pinned"), F.col("access_count"), last, F.lit(as_of), half_life)
    old = F.col("updated_at") < as_of - least_days * 86400
    return facts.where((F.col("status") == "live") & ~F.col("pinned") & old).withColumn("weight", weight).where(F.col("weight") < threshold)


def compacted(facts: DataFrame, as_of: int, days: int = 90) -> DataFrame:
    """Superseded facts past their time for rollback, which may be deleted."""
    return facts.where((F.col("status") == "superseded") & (F.col("updated_at") < as_of - max(1, days) * 86400))


def low_value(facts: DataFrame, as_of: int, days: int = 30, sure: float = 0.45) -> DataFrame:
    """Live facts that are unsure, old, hardly used, not pinned and no correction, which may be archived."""
    return facts.where((F.col("status") == "live") & ~F.col("pinned") & (F.col("confidence") <= sure) & (F.col("updated_at") < as_of - max(1, days) * 86400) & (F.col("access_count") <= 1) & ~F.col("explicit_correction"))


def faded_episodes(episodes: DataFrame, as_of: int, threshold: float = 0.12, days: int = 90, half_life: float = 30.0) -> DataFrame:
    """Live, unpinned episodes that ended `days` ago and whose decayed weight is below the threshold, with the weight."""
    weight = decay_weight(F.col("importance"), F.col("confidence"), F.col("pinned"), F.lit(0), F.col("end_ts"), F.lit(as_of), half_life)
    return episodes.where((F.col("status") == "live") & ~F.col("pinned") & (F.col("end_ts") < as_of - max(1, days) * 86400)).withColumn("weight", weight).where(F.col("weight") < threshold)


def rare_terms(terms: DataFrame, as_of: int, days: int = 30) -> DataFrame:
    """terms (term, persona_id, count, last_seen) that some persona used once, long ago: pruned for all personas."""
    old = terms.where((F.col("count") <= 1) & (F.col("last_seen") < as_of - max(1, days) * 86400)).select("term").distinct()
    return terms.join(old, "term", "left_semi")


def recalled(log: DataFrame, keys: Sequence[str], as_of: int, keep: int) -> DataFrame:
    """(keys, last_ts): when each was last shown, for those shown within `keep` seconds."""
    return log.groupBy(*keys).agg(F.max("ts").alias("last_ts")).where(F.col("last_ts") >= as_of - keep)


def expired_drafts(drafts: DataFrame, as_of: int, ttl: int = 14 * 86400) -> DataFrame:
    return drafts.where((F.col("created_at") > 0) & (as_of - F.col("created_at") > ttl))


def retained(timeline: DataFrame, protected: DataFrame, cutoff: int, id_col: str = "id") -> DataFrame:
    """What a clean-up of the timeline keeps: rows from the cutoff on, and older ones that are referred to."""
    young = timeline.where(F.col("ts") >= cutoff)
    old = timeline.where(F.col("ts") < cutoff).join(protected.select(id_col).distinct(), id_col, "left_semi")
    return young.unionByName(old)


def newest(rows: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    """A ring buffer: the n rows with the largest ids."""
    return rows.orderBy(F.desc(id_col)).limit(n)


def renamed(rows: DataFrame, aliases: DataFrame, column: str = "speaker_id") -> DataFrame:
    """rows with the canonical id in place of an alias (alias, canonical)."""
    a = aliases.select(F.col("alias").alias("_alias"), F.col("canonical").alias("_canonical"))
    d = rows.join(a, F.col(column) == F.col("_alias"), "left").withColumn(column, F.coalesce("_canonical", column))
    return d.select(*rows.columns)


def renamed_elements(rows: DataFrame, aliases: DataFrame, id_col: str, column: str) -> DataFrame:
    """(id, column): an array of ids of each row with canonical ids in place of aliases, in order."""
    a = aliases.select(F.col("alias").alias("_e"), F.col("canonical").alias("_canonical"))
    d = rows.select(id_col, F.posexplode_outer(column).alias("_p", "_e")).join(a, "_e", "left")
    g = d.groupBy(id_col).agg(F.array_sort(F.collect_list(F.when(F.col("_p").isNotNull(), F.struct("_p", F.coalesce("_canonical", "_e").alias("_e"))))).alias("_l"))
    return g.select(id_col, F.transform("_l", lambda x: x["_e"]).alias(column))


def backfilled(rows: DataFrame, made: DataFrame, id_col: str, column: str, made_col: str) -> DataFrame:
    """rows with `column` filled from made (id, made_col) where it is null or empty, and whether it was: `filled`."""
    none = F.col(column).isNull() | (F.size(column) == 0)
    d = rows.join(made.select(F.col(id_col), F.col(made_col).alias("_made")), id_col, "left")
    return d.withColumn("filled", none & F.col("_made").isNotNull()).withColumn(column, F.when(F.col("filled"), F.col("_made")).otherwise(F.col(column))).drop("_made")


def changed(base: DataFrame, log: DataFrame, columns: Sequence[str], id_col: str = "id", order: Sequence[str] = ("ts", "change")) -> DataFrame:
    """base as a log of changes leaves it: rows (id, op, order, columns), op one of insert, update, delete.

    Of each column the newest value that is not null holds; a row whose last insert or delete is a delete is gone. The
    log is summed before it is exchanged, so a row that changes very often costs as much as one that changes once.
    """
    at = F.struct(*order)
    start = base.select(F.col(id_col), *columns, F.lit("insert").alias("op"), *[F.lit(None).cast(log.schema[c].dataType).alias(c) for c in order])
    both = start.unionByName(log.select(id_col, *columns, "op", *order))
    newest = [F.max(F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("v"))))["v"].alias(c) for c in columns]
    last = F.max(F.when(F.col("op").isin("insert", "delete"), F.struct(at.alias("at"), F.col("op").alias("v"))))["v"].alias("_last")
    return both.groupBy(id_col).agg(*newest, last).where("_last = 'insert'").drop("_last")


def counters(log: DataFrame, key: str, ts: str) -> DataFrame:
    """Access counters as the sum of a log: (key, access_count, last_accessed)."""
    return log.groupBy(key).agg(F.count("*").alias("access_count"), F.max(ts).alias("last_accessed"))


#: What guarded ingest did with a claim.
OUTCOMES = ("rejected", "uncertain", "inserted", "refreshed", "superseded", "pending", "closed", "ignored")
_INGESTED = "slot_key string, id long, outcome string, live_id long"


def guarded_ingest(claims: DataFrame, high: float = 0.8) -> DataFrame:
    """(slot_key, id, outcome, live_id): what each claim does to its slot, in order of (ts, id); one live fact a slot.

    claims: slot_key, id, ts, value, confidence, first_person, correction, joke, hearsay, close, pinned. A joke is
    rejected; hearsay stays uncertain; a close ends the live fact, if there is one, else it is ignored; a first
    claim is inserted; the same value refreshes; a conflicting one supersedes if it is an explicit correction or
    first-hand and no less sure, unless the live fact is pinned or well evidenced, when it waits for confirmation.

    The outcome of a claim depends on those before it, so a slot is a fold over its claims: they stream by in order,
    slot after slot, and only the live fact is held. Jokes and hearsay leave the slot as it is and are settled
    outside the fold, as are slots with a single claim.
    """
    d = claims.withColumn("outcome", F.when(F.col("joke"), "rejected").when(F.col("hearsay"), "uncertain"))
    plain = d.where(F.col("outcome").isNotNull()).select("slot_key", "id", "outcome", F.lit(None).cast("long").alias("live_id"))
    rest = d.where(F.col("outcome").isNull()).withColumn("_n", F.count("*").over(Window.partitionBy("slot_key")))
    single = rest.where("_n = 1").select("slot_key", "id", F.when(F.col("close"), "ignored").otherwise("inserted").alias("outcome"), F.when(~F.col("close"), F.col("id")).alias("live_id"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slot, live = None, None
        for batch in batches:
            out = []
            for c in batch.itertuples():
                if c.slot_key != slot:
                    slot, live = c.slot_key, None
                if c.close:
                    outcome, live = ("closed", None) if live is not None else ("ignored", None)
                elif live is None:
                    outcome, live = "inserted", c
                elif c.value == live.value:
                    outcome = "refreshed"
                elif live.pinned or (live.confidence >= high and not c.correction):
                    outcome = "pending"
                elif c.correction or (c.first_person and c.confidence >= live.confidence):
                    outcome, live = "superseded", c
                else:
                    outcome = "pending"
                out.append((c.slot_key, c.id, outcome, live.id if live is not None else None))
            yield pd.DataFrame(out, columns=["slot_key", "id", "outcome", "live_id"]).astype({"live_id": "Int64"})

    many = rest.where("_n > 1").select("slot_key", "id", "ts", "value", "confidence", "first_person", "correction", "close", "pinned")
    folded = many.repartition("slot_key").sortWithinPartitions("slot_key", "ts", "id").mapInPandas(fold, _INGESTED)
    return plain.unionByName(single).unionByName(folded)


def completed_tool_groups(messages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tool calls whose every id was answered once before the next assistant message: (keys, turn, calls).

    messages: keys, turn, role, calls array<string>, answers string. A running count of assistant messages cuts a
    conversation into segments, so the test is a comparison of sets by group.
    """
    w = Window.partitionBy(*keys).orderBy("turn")
    d = messages.withColumn("_segment", F.sum((F.col("role") == "assistant").cast("int")).over(w))
    g = d.groupBy(*keys, "_segment").agg(
        F.min(F.when(F.col("role") == "assistant", F.col("turn"))).alias("turn"), F.array_sort(F.flatten(F.collect_list(F.when(F.col("role") == "assistant", F.col("calls"))))).alias("calls"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "tool", F.col("answers")))).alias("_answers"),
    )
    return g.where((F.size("calls") > 0) & (F.col("calls") == F.col("_answers"))).drop("_segment", "_answers")


def schema_upgraded(rows: DataFrame, shape: T.StructType, defaults: dict[str, Column]) -> DataFrame:
    """rows in the wanted shape: missing columns and nulls get their defaults, others go."""
    have = set(rows.columns)
    cols = []
    for f in shape.fields:
        c = F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        cols.append((F.coalesce(c, defaults[f.name]) if f.name in defaults else c).alias(f.name))
    return rows.select(*cols)


def folded_preferences(facts: DataFrame) -> DataFrame:
    """(id, keeper): dislikes and notes that say again what a like of the same speaker says, and may go.

    facts: live ones, with id, speaker_id, persona_id, attribute, value, content, topic, pinned. The first like (by
    id) whose topic the other mentions decides: personas and domains must not differ, and only what has the same
    polarity is folded; pinned facts stay. An equality join by speaker and the first two characters of a topic, which
    are among the pairs of characters of what mentions it, with the mention as its condition.
    """
    likes = facts.where("attribute = 'likes'").select("speaker_id", F.col("id").alias("keeper"), F.col("persona_id").alias("_p"), F.col("value").alias("_v"), F.col("topic").alias("_t"), topic_key(F.col("value")).alias("_key")).withColumn("_two", F.substring("_key", 1, 2))
    others = facts.where(F.col("attribute").isin("dislikes", "note") & ~F.col("pinned"))
    value, content = normalize_slot(F.col("value")), normalize_slot(F.col("content"))
    verbs = "(喜欢|讨厌|爱喝|爱吃|受不了|习惯|怕)"
    says = lambda c: F.contains(c, F.col("_key")) & ((F.length("_key") >= 2) | c.rlike(verbs))
    agree = lambda a, b: (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "") | (a == b)
    domain = F.coalesce(F.nullif(F.col("topic"), F.lit("")), detect_domain(F.col("content"), F.col("_v")))
    both = F.concat_ws(" ", value, content)
    parts = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(both)), lambda i: F.array(F.substr(both, i, F.lit(1)), F.substr(both, i, F.lit(2))))))
    keyed = others.where(F.length(both) > 0).withColumn("_two", F.explode(parts))
    met = keyed.join(likes, ["speaker_id", "_two"]).where((F.col("_key") != "") & (says(value) | says(content)) & agree(F.col("_p"), F.col("persona_id")) & agree(F.col("_t"), domain))
    first = F.row_number().over(Window.partitionBy("id").orderBy("keeper"))
    negative = (F.col("attribute") == "dislikes") | F.concat(value, F.lit(" "), content).rlike("(不喜欢|没喜欢|不再喜欢|不爱|讨厌|受不了)")
    d = met.withColumn("_n", first).where("_n = 1")
    return d.where(normalize_slot(F.col("_v")).rlike("^[不没别非]") == negative).select("id", "keeper")
