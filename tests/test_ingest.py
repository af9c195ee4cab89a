"""Guarded ingest against a plain fold that looks everything up anew, in batch and as a stream."""

import random

import pytest
from pyspark.sql import functions as F

from mnemora.functions import text
from mnemora.functions.slots import applied
from mnemora.operators import ingest
from mnemora.streaming import decisions, jobs

SHAPE = "id long, ts long, persona_id string, speaker_id string, speaker_name string, subject string, attribute string, value string, content string, plain string, topic string, confidence double, importance double, pinned boolean, op string, origin string, review_status string, first_person boolean, correction boolean"
ALIASES = [("a", "b"), ("b", "c"), ("lone", "lone")]
OWNERS = ("own",)
ATTRIBUTES = ("likes", "喜欢", "dislikes", "habit", "promise", "name", "identity", "note", "status", "odd")
VALUES = ("美式", "黑美式", "不美式", "早起", "戒烟", "不早起", "小王", "老王", "老板", "主人的朋友", "", "不喜欢香菜。")
SAYS = ("", "我", "听说", "开玩笑", "改口", "喝", "穿", "我喝", "听说穿", "改口 我")


def claims(seed, n=400, speakers=("a", "b", "c", "own", "d", "bot_self"), hot=None):
    r = random.Random(seed)
    out = []
    for i in range(n):
        v, who = r.choice(VALUES), r.choice(speakers) if hot is None or i % 3 else hot
        flag = lambda p: True if r.random() < p else r.choice([None, False])
        out.append((i, r.randrange(n // 3), r.choice(["", "p1", "p1", None]), who, "nick", r.choice(["", "我", "nick", "bot"]), r.choice(ATTRIBUTES), v, r.choice(SAYS) + v, r.choice(["", "", "喝" + v]), r.choice(["", "", "咖啡", "穿衣", "饮料 游戏"]),
                    r.choice([None, 0.2, 0.5, 0.8, 0.95]), r.choice([None, 0.0, 0.3, 0.9]), r.random() < 0.05, r.choice(["create", "update", " CLOSE ", "ignore", "what", None, "create"]), r.choice(["", "manual", None]), r.choice(["", "ai_passed", None]), flag(0.2), flag(0.1)))
    return out


def slots_of(spark, rows):
    """By claim id what the column functions say of its slot; they have their own tests."""
    c = F.col
    d = spark.createDataFrame(rows, SHAPE)
    s = d.select("*", applied(c("attribute"), c("value"), c("content"), c("plain"), c("topic"), c("subject"), c("speaker_id"), c("speaker_name")).alias("s"))
    s = s.select("*", text.normalize_slot(c("s.value")).alias("norm"), text.topic_key(c("s.value")).alias("about"), text.detect_domain(c("content"), c("s.value")).alias("guess"))
    return {r.id: r for r in s.collect()}


def fold(rows, slots, high=0.8):
    """Facts as a list of dicts; every look-up goes through all of them."""
    facts, log = [], {}
    chain = dict(ALIASES)

    def live(key):
        found = [f for f in facts if f["live"] and f["key"] == key]
        return min(found, key=lambda f: (-f["conf"], -f["upd"], f["id"]), default=None)

    def clash(a, b):
        if not a or not b or a == b:
            return False
        neg = [x.startswith(("不", "没", "别", "非")) for x in (a, b)]
        return neg[0] != neg[1] or (a not in b and b not in a)

    for c in sorted(rows, key=lambda c: (c[1], c[0])):
        i, ts, persona, who, _, _, _, _, content, plain, _, conf, imp, pin, op, origin, review, first, corr = c
        s = slots[i]
        attr, value, subject, topic = s.s.attribute, s.s.value, s.s.subject, s.s.topic
        for _ in range(4):
            who = chain.get(who, who) or who
        persona, content, op = persona or "", content or "", (op or "").strip().lower()
        base = lambda a: f"{persona}|{who}|{subject}|{a}" + (f"|{s.about}" if a in ("likes", "dislikes", "promise", "habit") and s.about else "")  # noqa: E731, B023
        key = base(attr)
        first = bool(first) or any(w in content for w in ("我", "俺", "咱", "本人", "主人"))
        corr = bool(corr) or any(w in content for w in ("不是", "改口", "纠正"))
        manual = origin == "manual" or review == "manual"
        if op == "ignore":
            log[i] = ("ignored", "extractor_ignore", None, None)
            continue
        words = f"{value} {content} {plain} {subject}"
        if who != "bot_self" and attr in ("identity", "name") and any(w in words for w in ("主人", "老板")):
            if who not in OWNERS:
                log[i] = ("rejected_relation", "relation_claim_not_owner", None, None)
                continue
            attr = "note"
        if not manual and "开玩笑" in content and not corr:
            log[i] = ("ignored_joke", "joke_or_banter", None, None)
            continue

        def add(key, conf, old=None):
            mine = imp if imp and imp > 0 else old["imp"] if old else 0
            mine = mine if mine > 0 else min(1.0, (1.0 if manual else 0.8 if review == "ai_passed" else 0.5) + 0.1 * corr + 0.05 * first)
            facts.append({"id": i, "key": key, "p": persona, "who": who, "subj": subject, "attr": attr, "v": value, "n": s.norm, "about": s.about, "conf": conf, "imp": mine, "acc": 0, "pin": pin, "topic": topic or (old["topic"] if old else ""), "guess": s.guess, "upd": ts, "live": True})  # noqa: B023
            return facts[-1]

        sure = 0.6 if conf is None else conf
        if "听说" in content and not first and not corr:
            add(key, min(0.4 if conf is None else conf, 0.4))
            log[i] = ("wrote_uncertain", "hearsay", i, None)
            continue
        old, prefer = live(base(attr)), attr in ("likes", "dislikes")
        if old is None and prefer and topic and (sep := live(f"{key}|{topic}")):
            old, key = sep, sep["key"]
        if old is None and op == "close" and attr in ("promise", "habit"):
            last = sorted((f for f in facts if f["live"] and (f["who"], f["subj"], f["attr"]) == (who, subject, attr) and f["p"] in ("", persona)), key=lambda f: (-f["upd"], f["id"]))[:50]
            old = next((f for f in last if s.about and f["about"] == s.about), last[0] if last else None)
        if old is None:
            if op == "close":
                log[i] = ("ignored", "close_without_existing", None, None)
            else:
                add(key, sure)
                log[i] = ("insert", None, i, None)
            continue
        domain = old["topic"] or old["guess"]
        if prefer and topic and domain and topic != domain:
            split = f"{old['key']}|{topic}"
            if (same := live(split)) is None:
                add(split, sure)
                log[i] = ("insert", "domain_split", i, None)
                continue
            old = same
        if op == "close":
            old["live"] = False
            log[i] = ("closed", None, old["id"], None)
        elif not clash(old["n"], s.norm):
            if prefer and topic and not domain:
                log[i] = ("pending", "domain_needs_confirm", None, old["id"])
                continue
            if value != old["v"]:
                t = old["topic"] or topic
                old["key"] = f"{base(attr)}|{t}" if old["key"] != base(attr) and t else base(attr)
            old |= {"v": value, "n": s.norm, "about": s.about, "guess": s.guess, "topic": old["topic"] or topic, "conf": max(old["conf"], conf or 0), "imp": max(old["imp"], imp or 0), "acc": old["acc"] + 1, "upd": ts}
            log[i] = ("refresh", None, old["id"], None)
        elif old["pin"]:
            log[i] = ("pending", "pinned_needs_confirm", None, old["id"])
        elif not first and not corr:
            log[i] = ("pending", "not_first_person_or_correction", None, old["id"])
        elif old["conf"] >= high and old["acc"] and not corr:
            log[i] = ("pending", "high_evidence_needs_confirm", None, old["id"])
        else:
            old["live"] = False
            add(key, sure, old)
            log[i] = ("supersede", None, i, old["id"])
    return log, {f["id"]: f for f in facts}


def aliases(spark):
    return spark.createDataFrame(ALIASES, "alias string, canonical string")


@pytest.mark.parametrize("seed,hot", [(0, None), (1, "own"), (2, "c")])
def test_every_outcome_equals_the_fold(spark, seed, hot):
    """Three seeds; in two, one speaker says a third of all."""
    rows = claims(seed, n=900 if hot else 500, hot=hot)
    want, facts = fold(rows, slots_of(spark, rows))
    log = ingest.written(ingest.ingest_claims(spark.createDataFrame(rows, SHAPE), aliases(spark), OWNERS), "log")
    got = {r.id: (r.action, r.reason, r.fact_id, r.old_fact_id) for r in log.collect()}
    assert got == want
    if seed:
        assert {(a, r) for a, r, *_ in got.values()} >= {("insert", None), ("insert", "domain_split"), ("refresh", None), ("supersede", None), ("closed", None), ("wrote_uncertain", "hearsay"), ("pending", "domain_needs_confirm"), ("pending", "not_first_person_or_correction"), ("ignored", "close_without_existing")}
    after = {r.fact_id: r for r in ingest.facts_after(log).collect()}
    assert set(after) == set(facts)
    for i, f in facts.items():
        r = after[i]
        assert (r.status == "live") == f["live"] and (r.slot_key, r.value, r.access_count, r.topic) == (f["key"], f["v"], f["acc"], f["topic"]), i
        assert (r.confidence, r.importance) == (pytest.approx(f["conf"]), pytest.approx(f["imp"]))


def test_a_stream_of_several_batches_equals_the_batch(spark, tmp_path):
    """Claims in order over three files, one file a batch: the state between batches is all that the fold holds."""
    rows = sorted(claims(5, n=240), key=lambda c: (c[1], c[0]))
    want, _ = fold(rows, slots_of(spark, rows))
    prep = ingest.open_claims(ingest.prepared(spark.createDataFrame(rows, SHAPE), aliases(spark), OWNERS))
    order = [r.id for r in prep.orderBy("ts", "id").collect()]
    for k in range(3):
        part = order[k * len(order) // 3 : (k + 1) * len(order) // 3]
        prep.where(F.col("id").isin(part)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/claims")
    stream = spark.readStream.schema(prep.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/claims")
    got = {r.id: (r.action, r.reason, r.fact_id, r.old_fact_id) for r in jobs.drained(decisions.ingested(stream), "append").collect()}
    assert got == {i: want[i] for i in order}


def test_no_claims(spark):
    log = ingest.ingest_claims(spark.createDataFrame([], SHAPE))
    assert log.count() == 0 and ingest.facts_after(log).count() == 0
