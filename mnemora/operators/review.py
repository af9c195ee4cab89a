"""What people decide about facts: pending claims, rollbacks, restorations, learned terms. Folds over logs, no mutation.

Facts are rows (id, slot_key, value, status, supersedes, ...); decisions are rows of a log. A view joins the two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions.gates import relation_claim


def _live(facts: DataFrame) -> DataFrame:
    """(slot_key, live_id): the live fact of each slot; of several the newest."""
    return facts.where("status = 'live'").groupBy("slot_key").agg(F.max("id").alias("live_id"))


def decided(pending: DataFrame, decisions: DataFrame, facts: DataFrame) -> DataFrame:
    """(pending_id, outcome, new_slot, closes): what each decision on a pending claim does.

    pending: pending_id, slot_key, old_id, reason, topic, status; decisions: pending_id, verdict (confirm or reject). A
    claim that is not open, or not decided, keeps what it is. A rejected one is closed. A confirmed one that only asked
    for its meaning gets a slot of its own, by topic; else it supersedes the old fact if that is live, else the fact
    that holds the slot now; else it is inserted.
    """
    p = pending.join(decisions.groupBy("pending_id").agg(F.max("verdict").alias("verdict")), "pending_id", "left")
    old = facts.select(F.col("id").alias("old_id"), F.col("status").alias("_old"))
    d = p.join(old, "old_id", "left").join(_live(facts), "slot_key", "left")
    open_ = F.col("status") == "open"
    apart = (F.col("reason") == "domain_needs_confirm") & (F.col("slot_key") != "") & (F.col("topic") != "")
    meaning = F.col("reason") == "domain_needs_confirm"
    closes = F.when(F.col("_old") == "live", F.col("old_id")).otherwise(F.col("live_id"))
    yes = open_ & (F.col("verdict") == "confirm")
    outcome = F.when(~open_, "not_found").when(F.col("verdict").isNull(), "open").when(F.col("verdict") == "reject", "rejected").when(meaning | closes.isNull(), "insert").otherwise("supersede")
    return d.select("pending_id", outcome.alias("outcome"), F.when(yes, F.when(apart, F.concat_ws("|", "slot_key", "topic")).otherwise(F.col("slot_key"))).alias("new_slot"), F.when(yes & ~meaning, closes).alias("closes"))


def rolled_back(asked: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, outcome, restored): of each fact to be rolled back: its predecessor returns, unless a rule forbids it.

    Only a live fact that superseded another can go; the other must still be there, be superseded, and its slot be
    held by no third fact.
    """
    f = facts.select("id", F.col("status").alias("_status"), F.col("supersedes").alias("_old"))
    old = facts.select(F.col("id").alias("_old"), F.col("status").alias("_was"), F.col("slot_key").alias("slot_key"))
    d = asked.select("id").distinct().join(f, "id", "left").join(old, "_old", "left").join(_live(facts), "slot_key", "left")
    outcome = (
        F.when(F.col("_status").isNull(), "fact_not_found").when(F.col("_status") != "live", "not_live").when(F.col("_old").isNull(), "nothing_superseded")
        .when(F.col("_was").isNull(), "old_is_gone").when(F.col("_was") != "superseded", "old_not_superseded").when(F.col("live_id") != F.col("id"), "slot_taken").otherwise("rollback")
    )
    return d.withColumn("outcome", outcome).select("id", "outcome", F.when(F.col("outcome") == "rollback", F.col("_old")).alias("restored"))


def restored(asked: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, outcome, conflict): closed facts that come back, unless another live fact holds their slot."""
    d = asked.select("id").distinct().join(facts.select("id", "slot_key", "status"), "id", "left").join(_live(facts), "slot_key", "left")
    taken = F.col("live_id").isNotNull() & (F.col("live_id") != F.col("id"))
    outcome = F.when(F.col("status").isNull(), "missing").when(F.col("status") == "live", "restored").when(taken, "blocked").otherwise("restored")
    return d.withColumn("outcome", outcome).select("id", "outcome", F.when(F.col("outcome") == "blocked", F.col("live_id")).alias("conflict"))


def guarded_relations(claims: DataFrame, owners: list[str]) -> DataFrame:
    """claims with `verdict` and attribute: relations to the owner that others claim are rejected, owners' become notes."""
    claim = relation_claim(F.col("attribute"), F.col("speaker_id"), F.concat_ws(" ", "value", "content", "plain", "subject"))
    own = F.col("speaker_id").isin(*owners) if owners else F.lit(False)
    return claims.withColumn("verdict", F.when(claim & ~own, "rejected").otherwise("passes")).withColumn("attribute", F.when(claim & own, "note").otherwise(F.col("attribute")))


def imported(lines: DataFrame, facts: DataFrame, timeline: DataFrame, aliases: DataFrame) -> DataFrame:
    """(table, outcome, n) of archive lines (table, key, other), by each table's rule of merging.

    facts and timeline: a fingerprint that is there, or came before in the file, is skipped, an empty one never is;
    aliases: an alias of itself, or without a name, is skipped, a known one is replaced; profiles: merged, always;
    other tables are skipped.
    """
    have = facts.select(F.lit("facts").alias("table"), F.col("fingerprint").alias("key")).unionByName(timeline.select(F.lit("timeline").alias("table"), F.col("fingerprint").alias("key"))).distinct().withColumn("_have", F.lit(True))
    nth = F.row_number().over(Window.partitionBy("table", "key").orderBy("line"))
    d = lines.withColumn("_nth", nth).join(have, ["table", "key"], "left")
    printed = F.col("table").isin("facts", "timeline")
    fresh = (F.col("key") == "") | (F.col("_have").isNull() & (F.col("_nth") == 1))
    known = aliases.select(F.col("alias").alias("key"), F.lit("aliases").alias("table")).distinct().withColumn("_known", F.lit(True))
    d = d.join(known, ["table", "key"], "left")
    name = (F.col("key") != "") & (F.col("other") != "") & (F.col("key") != F.col("other"))
    outcome = (
        F.when(printed & fresh, "inserted").when(F.col("table") == "profiles", "merged").when((F.col("table") == "aliases") & name, F.when(F.col("_known") | (F.col("_nth") > 1), "replaced").otherwise("inserted")).otherwise("skipped")
    )
    return d.groupBy("table", outcome.alias("outcome")).agg(F.count("*").alias("n"))


def picked_samples(approved: DataFrame, queries: DataFrame, each: int, term: bool) -> DataFrame:
    """(query_id, id, place): approved terms that a query holds, or sample exchanges with users' words of their own.

    approved: id, updated_at, term and meaning, or user_key. The newest count first, `each` for a query. Terms meet
    queries by their words, so not every term is tried on every query.
    """
    newest = [F.desc("updated_at"), F.desc("id")]
    if term:
        q = queries.select("query_id", F.explode(F.array_distinct(F.split(F.lower("query"), "[^A-Za-z0-9_]+"))).alias("_w"))
        met = approved.where("term != '' and meaning != ''").withColumn("_w", F.lower("term")).join(q, "_w").drop("_w")
    else:
        once = approved.withColumn("_n", F.row_number().over(Window.partitionBy("user_key").orderBy(*newest))).where("_n = 1").drop("_n")
        few = F.broadcast(once.orderBy(*newest).limit(each))  # `each` rows
        met = queries.select("query_id").join(few, how="cross")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*newest))
    return met.withColumn("place", place).where(F.col("place") <= each).select("query_id", "id", "place")
