"""Edits with revisions against a plain loop; what they leave, slot by slot; decisions on reviews."""

import random

from mnemora.operators import edits

EDIT = "edit_id long, ts long, ref_id long, base long, op string, value string, content string, plain string, importance string, status string"
FACT = "id long, revision long, slot_key string, persona_id string, speaker_id string, speaker_name string, subject string, attribute string, value string, content string, plain string, topic string, importance double, confidence double, status string, review_status string, pinned boolean, updated_at long, more string"


def fact(i, **k):
    d = dict(id=i, revision=1, slot_key=f"|s{i}|self|note", persona_id="", speaker_id=f"s{i}", speaker_name="", subject="self", attribute="note", value=f"v{i}", content="", plain="", topic="", importance=0.5, confidence=0.5, status="live", review_status="", pinned=False, updated_at=0, more="m")
    return tuple((d | k).values())


def edit(i, ref, base=None, op="edit", ts=None, **k):
    d = dict(edit_id=i, ts=i if ts is None else ts, ref_id=ref, base=base, op=op, value=None, content=None, plain=None, importance=None, status=None)
    return tuple((d | k).values())


def loop(es, revisions):
    at, out = dict(revisions), {}
    for i, ts, ref, base, op, _, _, _, imp, status in sorted(es, key=lambda e: (e[1], e[0])):
        if ref not in at:
            out[i] = ("not_found", None)
            continue
        number = imp not in ("x", "NaN")
        bad = "bad_op" if op not in edits.OPS else "bad_importance" if op == "edit" and not number else "bad_status" if op == "status" and status not in ("live", "archived") else ""
        if base is not None and base != at[ref]:
            out[i] = ("stale", at[ref])
        elif bad:
            out[i] = (bad, at[ref])
        elif op == "delete":
            del at[ref]
            out[i] = ("applied", None)
        else:
            at[ref] += 1
            out[i] = ("applied", at[ref])
    return out


def test_edits_equal_a_loop(spark):
    r = random.Random(5)
    es, hot = [], 0
    for i in range(600):
        ref = 0 if i % 3 == 0 else r.choice([*range(1, 12), 99, None])  # a third of all edits are of one fact
        base = r.choice([None, 1, 2, 3, r.randrange(1, 40)])
        es.append(edit(i, ref, base, r.choice(("edit",) * 6 + ("status", "approve", "delete" if r.random() < 0.1 and ref else "edit", "move", None)), r.randrange(300), importance=r.choice((None, "0.4", "x", "NaN")), status=r.choice(("live", "gone", None))))
    facts = spark.createDataFrame([fact(i, revision=1 + i % 2) for i in range(12)], FACT)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        log = edits.decided(spark.createDataFrame(es, EDIT).repartition(5), facts)
        got = {x.edit_id: (x.outcome, x.revision) for x in log.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = loop(es, {i: 1 + i % 2 for i in range(12)})
    assert got == want and {o for o, _ in want.values()} == set(edits.OUTCOMES)
    n, expect = 1, {}
    for e in sorted(es, key=lambda e: (e[1], e[0])):
        n += want[e[0]][0] == "applied"
        expect[e[0]] = n
    assert {x.edit_id: x.store_revision for x in edits.store_revisions(log).collect()} == expect


def test_what_edits_leave(spark):
    facts = spark.createDataFrame([
        fact(1), fact(2, confidence=0.3, status="archived"), fact(3), fact(4), fact(5, pinned=True),
        fact(6, speaker_id="a", attribute="likes", value="tea", slot_key="|a|self|likes|tea"), fact(7, speaker_id="a", attribute="likes", value="coffee", slot_key="|a|self|likes|coffee", updated_at=1),
        fact(8, speaker_id="b", attribute="likes", value="苹果", slot_key="|b|self|likes|苹果|饮品", topic="饮品"), fact(9, speaker_id="c", slot_key="|c|self|note"), fact(10, speaker_id="c", slot_key="|c|self|note"),
    ], FACT)
    es = spark.createDataFrame([
        edit(10, 1, 1, value="one"), edit(11, 1, 1, value="two"), edit(12, 1, 2, importance="7", content="said"),  # the second names a revision that is gone
        edit(13, 2, None, "approve"), edit(14, 3, 1, "delete"), edit(15, 3, None, value="late"), edit(16, 4, 1, "status", status=" archived "),
        edit(17, 6, 1, value="coffee"), edit(20, 6, 2, content="said"), edit(18, 8, 1, value="香蕉"), edit(19, 5, 1),
    ], EDIT)
    log = edits.decided(es, facts)
    left = {r.id: r for r in edits.edited(facts, es, log).collect()}
    assert {r.edit_id for r in log.collect() if r.outcome == "stale"} == {11} and {r.edit_id for r in log.collect() if r.outcome == "not_found"} == {15}
    assert set(left) == {1, 2, 4, 5, 6, 7, 8, 9, 10} and all(r.more == "m" for r in left.values())
    assert (left[1].value, left[1].content, left[1].importance, left[1].revision, left[1].review_status, left[1].updated_at) == ("one", "said", 1.0, 3, "manual", 12)
    assert (left[2].status, left[2].confidence, left[2].review_status) == ("live", 0.8, "manual")
    assert (left[4].status, left[4].review_status) == ("archived", "")
    assert (left[5].value, left[5].revision, left[5].review_status) == ("v5", 2, "")
    assert left[6].importance == 0.5  # not given
    assert left[6].slot_key == left[7].slot_key == "|a|self|likes|coffee" and (left[6].status, left[7].status) == ("live", "archived")
    assert left[8].slot_key == "|b|self|likes|香蕉|饮品"
    assert left[9].status == left[10].status == "live"  # of a speaker without edits of words


def test_nothing(spark):
    facts, none = spark.createDataFrame([fact(1)], FACT), spark.createDataFrame([], EDIT)
    assert edits.decided(none, facts).collect() == [] and edits.store_revisions(edits.decided(none, facts)).collect() == []
    assert [r.id for r in edits.edited(facts, none, edits.decided(none, facts)).collect()] == [1]
    log = edits.decided(spark.createDataFrame([edit(1, 1)], EDIT), spark.createDataFrame([], FACT))
    assert [(r.outcome, r.revision) for r in log.collect()] == [("not_found", None)]


def test_the_first_decision_counts(spark):
    reviews = spark.createDataFrame([(1, "pending"), (2, "approved"), (3, "pending"), (4, "pending")], "review_id long, status string")
    rows = [(1, 5, 1, "reject"), (2, 4, 1, "approve"), (3, 1, 2, "approve"), (4, 1, 9, "approve"), (5, 1, 3, "maybe"), (6, 2, 3, "reject"), (7, 2, 3, "approve"), (8, 1, None, "reject"), (9, 1, 4, None)]
    got = {r.decision_id: r.outcome for r in edits.reviews_resolved(reviews, spark.createDataFrame(rows, "decision_id long, ts long, review_id long, verdict string")).collect()}
    assert got == {1: "not_pending", 2: "approved", 3: "not_pending", 4: "not_pending", 5: "bad_verdict", 6: "rejected", 7: "not_pending", 8: "not_pending", 9: "bad_verdict"}
