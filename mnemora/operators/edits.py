"""Edits of facts that name the revision they were made on, as one operation: what each does and why, and what they leave.

An edit is a row of a log, and so is its outcome; facts after the edits are a view. Two people who edit the same fact at once do
not overwrite each other: the second edit names a revision that is gone, and is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.functions.slots import applied
from mnemora.functions.text import slot_key, text_or_empty

from .windows import numbered, slot_keepers

OPS = ("edit", "status", "approve", "delete")
#: What an edit does; the last five are refusals, in the order in which they are looked for.
OUTCOMES = ("applied", "not_found", "stale", "bad_op", "bad_importance", "bad_status")
#: The least confidence of a fact that a person approved.
APPROVED = 0.8
_FIELDS = ("value", "content", "plain", "importance", "status")
_LOG = "edit_id long, ts long, ref_id long, outcome string, revision long"


def checked(edits: DataFrame) -> DataFrame:
    """edits with `bad`: what is wrong with each by itself, or empty; an edit without any field changes nothing and is an
    applied one. edits: edit_id, ts, ref_id, base, op, value, content, plain, importance (as typed), status."""
    c = F.col
    wrong_number = c("importance").isNotNull() & (c("importance").try_cast("double").isNull() | F.isnan(c("importance").try_cast("double")))
    bad = (
        F.when(~F.coalesce(c("op").isin(*OPS), F.lit(False)), "bad_op").when((c("op") == "edit") & wrong_number, "bad_importance")
        .when((c("op") == "status") & ~F.coalesce(F.trim("status").isin("live", "archived"), F.lit(False)), "bad_status").otherwise("")
    )
    return edits.withColumn("bad", bad)


def decided(edits: DataFrame, facts: DataFrame) -> DataFrame:
    """(edit_id, ts, ref_id, outcome, revision): what each edit does, in order of (ts, edit_id), and the fact's revision after it.

    facts: id, revision. An edit of a fact that is not there, or was deleted before, is not_found, without a revision; one
    that names another revision than the fact has is stale; a null base names none. What is applied raises the revision
    by one. An edit depends on those of its fact before it: they stream by in order, and a worker holds one number, so a
    fact with very many edits costs one task's time and no memory.
    """
    d = checked(edits).join(facts.select(F.col("id").alias("ref_id"), F.col("revision").alias("_start")), "ref_id", "left")
    d = d.select("ref_id", "ts", "edit_id", F.coalesce("base", F.lit(-1)).cast("long").alias("base"), F.coalesce("_start", F.lit(-1)).cast("long").alias("start"), F.coalesce(F.col("op") == "delete", F.lit(False)).alias("ends"), "bad")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ref, at = None, -1
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.ref_id != ref:
                    ref, at = r.ref_id, r.start
                outcome = "not_found" if at < 0 else "stale" if r.base >= 0 and r.base != at else r.bad or "applied"
                if outcome == "applied":
                    at = -1 if r.ends else at + 1
                out.append((r.edit_id, r.ts, r.ref_id, outcome, at if at >= 0 else None))
            yield pd.DataFrame(out, columns=["edit_id", "ts", "ref_id", "outcome", "revision"]).astype({"revision": "Int64"})

    known = d.where("ref_id is not null").repartition("ref_id").sortWithinPartitions("ref_id", "ts", "edit_id").mapInPandas(fold, _LOG)
    none = d.where("ref_id is null").select("edit_id", "ts", "ref_id", F.lit("not_found").alias("outcome"), F.lit(None).cast("long").alias("revision"))
    return known.unionByName(none)


def store_revisions(log: DataFrame, start: int = 1) -> DataFrame:
    """log with `store_revision`: the whole store's counter after each edit, which every applied one raises: sums by slices of
    time, offset by those before them."""
    d = log.withColumn("_all", F.lit(0)).withColumn("_one", (F.col("outcome") == "applied").cast("int"))
    n = numbered(d, ["_all"], "_one", "_n", "ts", "edit_id")
    return n.withColumn("store_revision", (F.col("_n") + start).cast("long")).drop("_all", "_one", "_n")


def edited(facts: DataFrame, edits: DataFrame, log: DataFrame) -> DataFrame:
    """facts as the applied edits of the log leave them, without those that were deleted.

    facts: id, revision, slot_key, persona_id, speaker_id, speaker_name, subject, attribute, value, content, plain, topic,
    importance, confidence, status, review_status, pinned, updated_at; more columns stay as they are. Of each field the
    newest that an edit gave holds; importance within 0 .. 1. An approval makes a fact live and at least APPROVED sure. Facts
    whose words were edited, or approved, count as checked by a person. A new value gets its slot anew; a fact in a slot of its
    own by domain stays in such a one. Then each slot of the speakers concerned keeps its first live fact (slot_keepers), and
    the others are archived. The slot is found once, from what all edits leave.
    """
    c = F.col
    at = F.struct("ts", "edit_id")
    d = log.where("outcome = 'applied'").select("edit_id", "revision").join(edits, "edit_id")
    number = c("importance").try_cast("double")
    own = {x: c(x) for x in ("value", "content", "plain")} | {"importance": F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))), "status": F.trim("status")}
    given = {x: F.when(c("op") == "edit", own[x]) for x in ("value", "content", "plain", "importance")} | {"status": F.when(c("op") == "status", own["status"]).when(c("op") == "approve", "live")}
    newest = [F.max(F.when(v.isNotNull(), F.struct(at.alias("at"), v.alias("v"))))["v"].alias(f"_{x}") for x, v in given.items()]
    said = F.greatest(*[v.isNotNull().cast("int") for x, v in given.items() if x != "status"])
    g = d.groupBy(c("ref_id").alias("_ref")).agg(
        *newest, F.count("*").alias("_n"), F.max("ts").alias("_ts"), F.max((c("op") == "delete").cast("int")).alias("_gone"), F.max((c("op") == "approve").cast("int")).alias("_yes"), F.max(said).alias("_said"),
    )
    f = facts.join(g, c("id") == c("_ref"), "left").where("coalesce(_gone, 0) = 0")
    f = f.withColumns({x: F.coalesce(f"_{x}", x) for x in _FIELDS if x != "value"} | {"_old": c("value"), "_new": F.coalesce("_value", "value")})
    slot = applied(c("attribute"), c("_new"), c("content"), c("plain"), c("topic"), c("subject"), c("speaker_id"), c("speaker_name"))
    f = f.withColumn("_slot", F.when(c("_said") == 1, slot))
    key = lambda subject, attribute, value: slot_key(c("persona_id"), c("speaker_id"), subject, attribute, value)
    base = key(c("_slot.subject"), c("_slot.attribute"), c("_slot.value"))
    apart = (text_or_empty(c("slot_key")) != "") & (c("slot_key") != key(c("subject"), c("attribute"), c("_old"))) & (text_or_empty(c("_slot.topic")) != "")
    moved = (c("_said") == 1) & (~c("_slot.value").eqNullSafe(c("_old")) | (text_or_empty(c("slot_key")) == ""))
    f = f.withColumn("slot_key", F.when(moved & apart, F.concat_ws("|", base, c("_slot.topic"))).when(moved, base).otherwise(c("slot_key")))
    f = f.withColumns({
        "attribute": F.coalesce("_slot.attribute", "attribute"), "value": F.coalesce("_slot.value", "_new"), "topic": F.coalesce("_slot.topic", "topic"), "confidence": F.when(c("_yes") == 1, F.greatest("confidence", F.lit(APPROVED))).otherwise(c("confidence")),
        "review_status": F.when((c("_said") == 1) | (c("_yes") == 1), "manual").otherwise(c("review_status")), "updated_at": F.coalesce("_ts", "updated_at"), "revision": c("revision") + F.coalesce("_n", F.lit(0)),
    })
    who = f.where("_said = 1").select(c("speaker_id").alias("_who")).distinct()
    f = f.join(who.withColumn("_concerned", F.lit(True)), c("speaker_id").eqNullSafe(c("_who")), "left")
    contended = (c("status") == "live") & F.coalesce("_concerned", F.lit(False)) & (text_or_empty(c("slot_key")) != "")
    kept = slot_keepers(f.where(contended)).withColumn("status", F.when(c("keep"), c("status")).otherwise("archived")).drop("keep")
    return kept.unionByName(f.where(~F.coalesce(contended, F.lit(False)))).select(*facts.columns)


def reviews_resolved(reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """(decision_id, review_id, outcome): of each review's decisions the first counts: approved or rejected; one that is
    neither is a bad_verdict and leaves the review open; later ones, and those of reviews that are not there or not open, are not_pending.

    reviews: review_id, status; decisions: decision_id, ts, review_id, verdict. A minimum by review, made before it is sent.
    """
    good = F.col("verdict").isin("approve", "reject")
    first = decisions.where(good).groupBy("review_id").agg(F.min(F.struct("ts", "decision_id"))["decision_id"].alias("_first"))
    open_ = reviews.where("status = 'pending'").select("review_id").distinct().withColumn("_open", F.lit(True))
    d = decisions.join(open_, "review_id", "left").join(first, "review_id", "left")
    counts = F.coalesce(F.col("_open"), F.lit(False)) & F.coalesce(F.col("_first") == F.col("decision_id"), F.lit(False))
    outcome = F.when(~F.coalesce(good, F.lit(False)), "bad_verdict").when(~counts, "not_pending").when(F.col("verdict") == "approve", "approved").otherwise("rejected")
    return d.select("decision_id", "review_id", outcome.alias("outcome"))
