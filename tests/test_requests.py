"""The read path as a whole, against plain folds over its ranks; and what its pieces leave out."""

import re
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from mnemora.operators import flow, requests, retrieval, windows
from mnemora.plans import catalogue, people, streams  # noqa: F401  registers queries
from mnemora.plans.requests import AS_OF, ASKED, asked
from mnemora.sources.tables import event_episodes, memory_facts

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


def words(text):
    return set(re.findall(r"[一-鿿]|[^\W_一-鿿]+", text.lower()))


def fold(rows, top=16, core=4, related=6, balance=0.7):
    """Buckets of one request, as lists of ids."""
    rows = sorted(rows, key=lambda r: r["rank"])
    like = lambda a, b: 1.0 if a.slot_key == b.slot_key else len(words(a.content) & words(b.content)) / len(words(a.content) | words(b.content))
    taken, left = list(rows[:1]), list(rows[1:])
    if len(rows) <= top:
        taken = rows
    while len(taken) < min(top, len(rows)):
        best = max(left, key=lambda r: (balance * r.score - (1 - balance) * max(like(r, t) for t in taken), -r["rank"]))
        taken.append(best)
        left.remove(best)
    final = list({r.id: r for r in [*(r for r in rows if r.matched), *taken]}.values())[:top]
    out = {"core": [], "related": [], "uncertain": []}
    query = re.sub(r"[\s,?？。]", "", rows[0].query.lower()) if rows else ""
    for r in final:
        if len(r.value) >= 2 and r.value in query and not r.pinned and not any(m in r.query for m in catalogue.gates.QUESTION):
            continue
        if r.mention_policy == "uncertain" or r.confidence < 0.45:
            out["uncertain"].append(r.id)
        elif (r.matched or ((r.speaker_id in r.speaker_ids or r.scope == "owner" or r.pinned) and r.confidence >= 0.7 and r.attribute in requests.CORE)) and len(out["core"]) < core:
            out["core"].append(r.id)
        else:
            out["related"].append(r.id)
    most = {"core": core, "related": max(2, related // 2) if rows and rows[0].route == "current_status" else related, "uncertain": 3}
    return {k: v[: most[k]] for k, v in out.items()}


def test_bundles_equal_a_fold(spark):
    ranked = requests.ranked_facts(asked(spark), memory_facts(spark, DATA), AS_OF).collect()
    by = defaultdict(list)
    for r in ranked:
        by[r.request_id].append(r)
    got = defaultdict(lambda: {"core": [], "related": [], "uncertain": []})
    for r in sorted(catalogue.QUERIES["retrieve_bundle"](spark, DATA).collect(), key=lambda r: r.position):
        got[r.request_id][r.bucket].append(r.id)
    assert set(by) == set(got) and len(by) >= 4
    for i, rows in by.items():
        assert got[i] == fold(rows)


def test_packs_keep_to_their_budget(spark):
    for r in catalogue.QUERIES["retrieve_pack"](spark, DATA).collect():
        assert len(r.pack) <= 400 and r.pack.startswith("<memory>\n") and r.pack.endswith("\n</memory>")
        assert sum(t in r.pack for t in requests.TITLES.values()) >= 1
    assert 6 not in {r.request_id for r in catalogue.QUERIES["retrieve_bundle"](spark, DATA).collect()}  # a greeting


def test_promises_and_statuses_are_packed_when_called_for(spark):
    shape = "request_id int, query string, route string, bucket string, attribute string, value string, content string, position int"
    rows = [(1, "随便聊聊", "long_term"), (2, "我们约好了什么", "long_term"), (3, "身体怎么样", "long_term"), (4, "那天", "time_window"), (5, "周五见面的事", "long_term")]
    found = spark.createDataFrame([(*r, "related", a, v, v, i) for r in rows for i, (a, v) in enumerate([("promise", "周五见面"), ("status", "感冒了"), ("note", "养猫")], 1)], shape)
    got = defaultdict(set)
    for r in requests.blocks(found).collect():
        got[r.request_id].add(r.block)
    assert got == {1: {"related"}, 2: {"related", "promises"}, 3: {"related", "statuses"}, 4: {"related", "promises", "statuses"}, 5: {"related", "promises"}}
    lines = requests.blocks(found).withColumn("line", F.concat(F.lit("- "), "value"))
    packs = {r.request_id: r.pack for r in requests.packs(lines, 200).collect()}
    assert packs[1] == "<memory>\n【本轮相关】\n- 养猫\n</memory>" and packs[4].index("【约定】") < packs[4].index("【近况】")
    assert requests.packs(lines, 20).count() == 0


def test_lately_injected_facts_are_left_out(spark):
    facts = memory_facts(spark, DATA)
    first = requests.bundles(asked(spark), facts, AS_OF)
    seen = first.where("not pinned and not matched and route in ('long_term', 'current_status', 'history')").select("request_id", "id")
    again = requests.bundles(asked(spark), facts, AS_OF, injected=seen)
    assert not {tuple(r) for r in seen.collect()} & {tuple(r) for r in again.select("request_id", "id").collect()}


def test_requests_without_facts(spark):
    none = memory_facts(spark, DATA).limit(0)
    assert requests.bundles(asked(spark), none, AS_OF).count() == 0 and len(ASKED) == 6


def test_navigation_sees_nothing_twice(spark):
    rows = catalogue.QUERIES["multi_hop_navigation"](spark, DATA).collect()
    seen = [(r.item_id, r.doc_id) for r in rows]
    assert len(seen) == len(set(seen)) and {r.step for r in rows} == {1, 2, 3}


def test_mmr_select_starts_with_the_best(spark):
    top = {r.item_id: r.doc_id for r in catalogue.QUERIES["bm25_topk"](spark, DATA).where("rank = 1").collect()}
    first = {r.item_id: r.doc_id for r in catalogue.QUERIES["mmr_select"](spark, DATA).where("position = 1").collect()}
    assert first == top


def test_sessions_with_null_keys_and_slices(spark):
    day = windows.SLICE
    rows = [(1, None, 0), (2, None, 10), (3, "a", day - 5), (4, "a", day + 5), (5, "a", 3 * day), (6, "a", 3 * day), (7, "b", 5)]
    d = spark.createDataFrame(rows, "id long, k string, ts long")
    got = {r.id: r.session for r in windows.sessions_by_gap(d, ["k"], 60).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 2, 7: 1}
    before = {r.id: r.previous.id if r.previous else None for r in windows.with_previous(d, ["k"], ["id"]).collect()}
    assert before == {1: None, 2: 1, 3: None, 4: 3, 5: 4, 6: 5, 7: None}


def test_cosine_of_odd_vectors(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [2.0]), (4, [3.0, 3.0])], "vec_id long, embedding array<float>")
    got = {(r.query_id, r.vec_id): r.score for r in retrieval.nearest_by_cosine(d, F.col("id") % 2 == 0, 9, block=2, group=1).collect()}
    assert got[0, 0] == 1.0 and got[0, 4] == pytest.approx(0.707107) and {got[0, i] for i in (1, 2, 3)} == {0.0} and {got[2, i] for i in range(5)} == {0.0}


def test_flow_budgets(spark):
    tl = spark.createDataFrame([(i, 1000 + i, "qq:GroupMessage:1", "u1", "user", f"message {i}") for i in range(30)], "id long, ts long, window_tag string, speaker_id string, role string, content string")
    got = flow.window_flow(tl, "qq:GroupMessage:2", 2000, items=8, chars=120).orderBy("place").collect()
    assert sum(len(r.line) + 1 for r in got) <= 120 and [r.id for r in got] == list(range(30 - len(got), 30))
    assert flow.window_flow(tl, "elsewhere", 2000).count() == 0


def test_stream_unanswered_equals_a_fold(spark):
    got = sorted((r.key, r.id) for r in catalogue.QUERIES["stream_unanswered"](spark, DATA).collect())
    rows = duckdb.connect().execute(f"select event_type, event_id, user_id, epoch_us(ts), value > 100 from '{DATA}/events.parquet' order by ts, event_id").fetchall()
    asked_, want, wait = {}, [], 600 * 10**6
    for key, i, who, t, question in rows:
        a = asked_.get(key)
        if a and t - a[2] > wait:
            want.append((key, a[0]))
            a = None
        a = (i, who, t) if question else (None if a and who != a[1] else a)
        asked_[key] = a
    end = rows[-1][3]
    open_ = {(k, a[0]) for k, a in asked_.items() if a}
    sure = set(want) | {(k, a[0]) for k, a in asked_.items() if a and a[2] + wait < end - 10**6}
    assert sure <= set(got) <= sure | open_ and want


def test_requests_are_sent_to_what_they_meet(spark):
    """The owner's facts and episodes have one key: none of them is dealt by it."""
    met = requests.ranked_episodes(asked(spark), event_episodes(spark, DATA), 8)
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
