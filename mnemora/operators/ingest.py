"""Guarded ingest: a log of claims becomes facts, each claim under the rules that keep what is known safe.

What a claim does depends on those before it in its slots, so slots that can touch each other are one group, and a group is
a fold over its claims in order. All that looks at a claim alone (names of speakers, slots, domains, what its words
signal, claims that never reach a slot) is done by column functions before; the fold streams a group's claims by and
holds its live facts.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from heapq import heappop, heappush
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.functions import gates
from mnemora.functions.scores import default_importance
from mnemora.functions.slots import applied
from mnemora.functions.text import detect_domain, normalize_slot, slot_key, text_or_empty, topic_key
from mnemora.storage import written

from .joins import resolve_chain

#: What ingest did with a claim, and why.
ACTIONS = ("ignored", "rejected_relation", "ignored_joke", "wrote_uncertain", "insert", "closed", "refresh", "pending", "supersede")
REASONS = ("extractor_ignore", "relation_claim_not_owner", "joke_or_banter", "hearsay", "close_without_existing", "domain_split", "domain_needs_confirm", "pinned_needs_confirm", "not_first_person_or_correction", "high_evidence_needs_confirm")
LOG = "id long, ts long, action string, reason string, fact_id long, old_fact_id long, slot_key string, value string, confidence double, importance double, access_count long, topic string"
_IN = ["group", "id", "ts", "persona_id", "look", "slot_key", "attribute", "value", "norm", "about", "confidence", "importance", "default_importance", "pinned", "topic", "guess", "close", "first_person", "correction", "uncertain"]
PREFERENCES, PROMISES = ("likes", "dislikes"), ("promise", "habit")
#: How many of the newest facts of an attribute a close without a slot looks at.
LOOKED_AT = 50


def prepared(claims: DataFrame, aliases: DataFrame | None = None, owners: Sequence[str] = (), cut: bool = True) -> DataFrame:
    """claims with canonical speakers, slots, domains, signals of their words, a group, and `settled`: what is decided at once.

    claims: id, ts, persona_id, speaker_id, speaker_name, subject, attribute, value, content, plain, topic, confidence,
    importance, pinned, op, origin, review_status, first_person, correction. aliases (alias, canonical) are followed up to
    four links. A relation that no owner claims is rejected; an owner's is a note that keeps the slot it was said in.

    cut: whether a table is written after the slots are found, whose large expressions the rest names many times; a
    stream can't be. Slots that can touch each other share a group: an attribute's promises or habits (a close may mean any of them), an
    owner's name, identity and notes, and else one slot with the domains that split from it.
    """
    c = F.col
    d = claims.withColumn("_said", c("speaker_id"))
    if aliases is not None:
        known = resolve_chain(aliases.select("alias", "canonical"), "alias", "canonical", 4).select(c("alias").alias("_alias"), c("resolved").alias("_canonical"))
        d = d.join(known, c("_said") == c("_alias"), "left").withColumn("speaker_id", F.coalesce("_canonical", "_said")).drop("_alias", "_canonical")
    slot = applied(c("attribute"), c("value"), c("content"), c("plain"), c("topic"), c("subject"), c("_said"), c("speaker_name"))
    d = d.withColumn("_slot", slot)
    d = written(d, "claim-slots") if cut else d
    d = d.withColumns({k: c("_slot")[k] for k in ("attribute", "value", "subject", "topic")}).drop("_slot")
    key = lambda attribute: slot_key(c("persona_id"), c("speaker_id"), c("subject"), attribute, c("value"))
    said = text_or_empty(c("content"))
    blob = F.concat_ws(" ", *[text_or_empty(c(x)) for x in ("value", "content", "plain", "subject")])
    relation = gates.relation_claim(c("attribute"), c("speaker_id"), blob)
    mine = c("speaker_id").isin(*owners) if owners else F.lit(False)
    d = d.withColumns({"slot_key": key(c("attribute")), "_relation": relation, "_mine": mine})
    d = d.withColumn("attribute", F.when(c("_relation") & c("_mine"), "note").otherwise(c("attribute")))
    first = F.coalesce(c("first_person"), F.lit(False)) | said.rlike(gates.FIRST_PERSON)
    correction = F.coalesce(c("correction"), F.lit(False)) | said.rlike(gates.CORRECTION)
    op = F.lower(F.trim(text_or_empty(c("op"))))
    manual = (text_or_empty(c("origin")) == "manual") | (text_or_empty(c("review_status")) == "manual")
    d = d.withColumns({"first_person": first, "correction": correction, "close": op == "close", "look": key(c("attribute")), "norm": normalize_slot(c("value")), "about": topic_key(c("value")), "guess": detect_domain(c("content"), c("value"))})
    settled = F.when(op == "ignore", "ignored").when(c("_relation") & ~c("_mine"), "rejected_relation").when(~manual & said.rlike(gates.JOKE) & ~c("correction"), "ignored_joke")
    who = F.when(c("_mine") & c("attribute").isin("name", "identity", "note"), "who").otherwise(c("attribute"))
    wide = c("attribute").isin(*PROMISES) | (who == "who")
    group = F.when(wide, F.concat_ws("|", F.lit("*"), text_or_empty(c("speaker_id")), c("subject"), who)).otherwise(c("look"))
    return d.withColumns({
        "settled": settled, "group": group, "uncertain": said.rlike(gates.HEARSAY) & ~c("first_person") & ~c("correction"), "persona_id": text_or_empty(c("persona_id")), "pinned": F.coalesce(c("pinned"), F.lit(False)),
        "default_importance": default_importance(manual, text_or_empty(c("review_status")) == "ai_passed", c("correction"), c("first_person")),
    }).drop("_relation", "_mine", "_said")


def conflict(old: str, new: str) -> bool:
    """Whether two values in normal form exclude each other: unlike polarity, or neither within the other."""
    if not old or not new or old == new:
        return False
    if (old[0] in "不没别非") != (new[0] in "不没别非"):
        return True
    return old not in new and new not in old


@dataclass
class Live:
    """A live fact as the fold needs it; `version` counts its changes."""

    id: int
    slot_key: str
    persona_id: str
    value: str
    norm: str
    about: str
    confidence: float
    importance: float
    access_count: int
    pinned: bool
    topic: str
    guess: str
    updated: int
    version: int = 0


class Slots:
    """The live facts of a group, and what each further claim does to them.

    A slot shows its surest fact, of those the newest, of those the first: a heap with entries that are out of date
    until they come up. `order` has all facts by last change.
    """

    FIELDS = list(Live.__dataclass_fields__)

    def __init__(self, high: float = 0.8, facts: Sequence[Sequence[Any]] = ()):
        self.high = high
        self.facts: dict[int, Live] = {}
        self.heaps: dict[str, list] = {}
        self.order: OrderedDict[int, None] = OrderedDict()
        for f in facts:  # in the order of their last changes
            self._put(Live(*f))

    def state(self) -> list[tuple]:
        return [tuple(getattr(self.facts[i], k) for k in self.FIELDS) for i in self.order]

    def _put(self, f: Live) -> None:
        f.version += 1
        self.facts[f.id] = f
        heappush(self.heaps.setdefault(f.slot_key, []), (-f.confidence, -f.updated, f.id, f.version))
        self.order.pop(f.id, None)
        self.order[f.id] = None

    def _drop(self, f: Live) -> None:
        del self.facts[f.id], self.order[f.id]

    def _top(self, key: str) -> Live | None:
        heap = self.heaps.get(key, [])
        while heap:
            f = self.facts.get(heap[0][2])
            if f is not None and f.version == heap[0][3] and f.slot_key == key:
                return f
            heappop(heap)
        self.heaps.pop(key, None)
        return None

    def _latest(self, persona: str, about: str) -> Live | None:
        found: list[Live] = []
        for i in reversed(self.order):
            f = self.facts[i]
            if f.persona_id not in ("", persona):
                continue
            if len(found) >= LOOKED_AT and f.updated < found[-1].updated:
                break
            found.append(f)
        found = sorted(found, key=lambda f: (-f.updated, f.id))[:LOOKED_AT]
        return next((f for f in found if about and f.about == about), found[0] if found else None)

    def _new(self, c: Any, key: str, confidence: float, importance: float = 0.0, topic: str = "") -> Live:
        own = c.importance if c.importance == c.importance and c.importance > 0 else importance
        f = Live(int(c.id), key, c.persona_id, c.value, c.norm, c.about, confidence, own if own > 0 else c.default_importance, 0, bool(c.pinned), c.topic or topic, c.guess, int(c.ts))
        self._put(f)
        return f

    def step(self, c: Any) -> tuple:
        """(action, reason, fact, old fact's id): what claim c does."""
        given = c.confidence if c.confidence == c.confidence else None
        if c.uncertain:
            return "wrote_uncertain", "hearsay", self._new(c, c.slot_key, min(0.4 if given is None else given, 0.4)), None
        key, prefer = c.slot_key, c.attribute in PREFERENCES
        old = self._top(c.look)
        if old is None and prefer and c.topic:
            old = self._top(f"{key}|{c.topic}")
            key = key if old is None else old.slot_key
        if old is None and c.close and c.attribute in PROMISES:
            old = self._latest(c.persona_id, c.about)
        sure = 0.6 if given is None else given
        if old is None:
            return ("ignored", "close_without_existing", None, None) if c.close else ("insert", None, self._new(c, key, sure), None)
        domain = old.topic or old.guess
        if prefer and c.topic and domain and c.topic != domain:
            split = f"{old.slot_key}|{c.topic}"
            same = self._top(split)
            if same is None:
                return "insert", "domain_split", self._new(c, split, sure), None
            old = same
        if c.close:
            self._drop(old)
            return "closed", None, old, None
        if not conflict(old.norm, c.norm):
            if prefer and c.topic and not domain:
                return "pending", "domain_needs_confirm", None, old.id
            if c.value != old.value:
                topic = old.topic or c.topic
                old.slot_key = f"{c.look}|{topic}" if old.slot_key != c.look and topic else c.look
            old.value, old.norm, old.about, old.guess, old.topic = c.value, c.norm, c.about, c.guess, old.topic or c.topic
            old.confidence = old.confidence if given is None else max(old.confidence, given)
            old.importance = max(old.importance, c.importance if c.importance == c.importance else 0.0)
            old.access_count, old.updated = old.access_count + 1, int(c.ts)
            self._put(old)
            return "refresh", None, old, None
        if old.pinned:
            return "pending", "pinned_needs_confirm", None, old.id
        if not (c.first_person or c.correction):
            return "pending", "not_first_person_or_correction", None, old.id
        if old.confidence >= self.high and old.access_count >= 1 and not c.correction:
            return "pending", "high_evidence_needs_confirm", None, old.id
        self._drop(old)
        return "supersede", None, self._new(c, key, sure, old.importance, old.topic), old.id

    def log(self, c: Any) -> tuple:
        action, reason, f, old = self.step(c)
        shown = (f.id, old, f.slot_key, f.value, f.confidence, f.importance, f.access_count, f.topic) if f else (None, old, c.slot_key, None, None, None, None, None)
        return (int(c.id), int(c.ts), action, reason, *shown)


_COLUMNS = [x.split()[0] for x in LOG.split(", ")]


def logged(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS).astype({"fact_id": "Int64", "old_fact_id": "Int64", "access_count": "Int64"})


def settled_log(prep: DataFrame) -> DataFrame:
    """LOG of the claims that are settled without their slots."""
    why = F.create_map(*[F.lit(x) for kv in (("ignored", "extractor_ignore"), ("rejected_relation", "relation_claim_not_owner"), ("ignored_joke", "joke_or_banter")) for x in kv])
    none = lambda kind: F.lit(None).cast(kind)
    return prep.where("settled is not null").select(
        "id", "ts", F.col("settled").alias("action"), F.try_element_at(why, F.col("settled")).alias("reason"), none("long").alias("fact_id"), none("long").alias("old_fact_id"), "slot_key",
        none("string").alias("value"), none("double").alias("confidence"), none("double").alias("importance"), none("long").alias("access_count"), none("string").alias("topic"),
    )


def open_claims(prep: DataFrame) -> DataFrame:
    """The columns that the fold reads, of the claims that reach it."""
    kinds = {"confidence": "double", "importance": "double"}
    return prep.where("settled is null").select(*[F.col(x).cast(kinds[x]).alias(x) if x in kinds else F.col(x) for x in _IN])


def ingest_claims(claims: DataFrame, aliases: DataFrame | None = None, owners: Sequence[str] = (), high: float = 0.8) -> DataFrame:
    """LOG: what each claim of `prepared`'s shape does, in order of (ts, id): its action and reason, the fact it made, changed or
    closed (with that fact as it is after it), and the fact that it superseded or waits for.

    Claims travel once, by group, and stream by in order; a worker holds the live facts of one group. A speaker with a
    third of all claims is as many groups as there are slots; one slot's claims are one after the other, in one task.
    """
    prep = written(prepared(claims, aliases, owners), "claims")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, slots = None, Slots(high)
        for batch in batches:
            out = []
            for c in batch.itertuples():
                if c.group != group:
                    group, slots = c.group, Slots(high)
                out.append(slots.log(c))
            yield logged(out)

    folded = open_claims(prep).repartition("group").sortWithinPartitions("group", "ts", "id").mapInPandas(fold, LOG)
    return settled_log(prep).unionByName(folded)


def facts_after(log: DataFrame) -> DataFrame:
    """(fact_id, status, slot_key, value, confidence, importance, access_count, topic, superseded_by): facts as a LOG leaves them.

    A fact is as its newest row says, and superseded or archived where a row says so: sums by key, which need no order.
    """
    at = F.struct("ts", "id")
    shown = ("slot_key", "value", "confidence", "importance", "access_count", "topic")
    state = log.where("fact_id is not null").groupBy("fact_id").agg(F.max_by(F.struct("action", *shown), at).alias("s"))
    gone = log.where("action = 'supersede'").select(F.col("old_fact_id").alias("fact_id"), F.col("fact_id").alias("superseded_by"))
    status = F.when(F.col("superseded_by").isNotNull(), "superseded").when(F.col("s.action") == "closed", "archived").otherwise("live")
    return state.join(gone, "fact_id", "left").select("fact_id", status.alias("status"), *[F.col(f"s.{x}").alias(x) for x in shown], "superseded_by")
