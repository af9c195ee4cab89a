"""Operators on small frames, held against plain Python folds."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from mnemora.operators import aggregates, joins, maintenance, retrieval, windows
from mnemora.sources import jsonl, transcript


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_sessions_by_gap_and_span_equal_a_fold(spark, seed):
    r = random.Random(seed)
    rows, t = [], 0
    for i in range(300):
        t += r.choice([0, 5, 10, 30])
        rows.append((i, t, r.choice("ab")))
    d = windows.sessions_by_gap_and_span(spark.createDataFrame(rows, "id long, ts long, k string"), ["k"], 20, 60)
    state, want = {}, []
    for i, t, k in rows:
        n, start, last = state.get(k, (0, None, None))
        if last is None or t - last > 20 or t - start > 60:
            n, start = n + 1, t
        state[k] = (n, start, t)
        want.append((i, n))
    assert rows_of(d, "id", "session") == want


def test_slot_keepers_pinned_stay_beside_pinned(spark):
    rows = [(1, "s", True, 1, 0.1), (2, "s", True, 2, 0.1), (3, "s", False, 9, 0.9), (4, "t", False, 1, 0.1), (5, "t", False, 2, 0.1)]
    d = windows.slot_keepers(spark.createDataFrame(rows, "id int, slot_key string, pinned boolean, updated_at int, confidence double"))
    assert rows_of(d, "id", "keep") == [(1, True), (2, True), (3, False), (4, False), (5, True)]


def test_versions_leave_out_repeats(spark):
    rows = [(1, "s", 10, "a"), (2, "s", 20, "a"), (3, "s", 30, "b"), (4, "s", 40, None), (5, "s", 50, None)]
    d = windows.versions(spark.createDataFrame(rows, "id long, slot_key string, created_at long, value string"))
    assert [tuple(x) for x in d.orderBy("id").select("id", "valid_to", "supersedes", "superseded_by").collect()] == [(1, 30, None, 3), (3, 40, 1, 4), (4, None, 3, None)]


def test_packed_skips_what_is_too_long_and_goes_on(spark):
    d = spark.createDataFrame([(["aaaa", "b" * 20, "cc", "dd"],)], "l array<string>")
    assert d.select(windows.packed(F.col("l"), 10).alias("x")).first().x == ["aaaa", "cc", "dd"]


def test_answered_pairs_use_a_message_once(spark):
    rows = [(1, 0, "w", "user"), (2, 10, "w", "assistant"), (3, 20, "w", "assistant"), (4, 30, "w", "user"), (5, 200, "w", "assistant"), (6, 40, "v", "assistant")]
    d = windows.answered_pairs(spark.createDataFrame(rows, "id long, ts long, window_tag string, role string"))
    assert rows_of(d, "user_id", "bot_id", "wait") == [(1, 2, 10)]


@pytest.mark.parametrize("seed", range(3))
def test_unanswered_equals_a_scan(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.randrange(500), r.choice("ab"), r.choice("xyz")) for i in range(120)]
    d = windows.unanswered(spark.createDataFrame(rows, "id long, ts long, window_tag string, speaker_id string"), 30)
    want = []
    for i, t, w, s in rows:
        later = [b[1] for b in rows if b[2] == w and b[3] != s and (b[1], b[0]) > (t, i)]
        if not later or min(later) - t > 30:
            want.append((i,))
    assert rows_of(d, "id") == sorted(want)


def test_resolve_chain_stops_at_its_end_and_at_loops(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "c"), ("x", "x")], "k string, t string")
    assert rows_of(joins.resolve_chain(links, "k", "t", 4), "k", "resolved", "hops") == [("a", "c", 2), ("b", "c", 1), ("c", "c", 0), ("x", "x", 0)]


def test_closure_is_bounded(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "k int, t int")
    assert rows_of(joins.closure(links, "k", "t", 2), "k", "reached", "depth") == [(1, 2, 1), (1, 3, 2), (2, 1, 2), (2, 3, 1), (3, 1, 1), (3, 2, 2)]


def test_last_before_takes_the_newest_within_reach(spark):
    a = spark.createDataFrame([(1, "w", 100), (2, "w", 500), (3, "v", 100)], "id long, w string, ts long")
    b = spark.createDataFrame([(10, "w", 50), (11, "w", 100), (12, "w", 101)], "id long, w string, ts long")
    d = joins.last_before(a, b, ["w"], "ts", "ts", "id", 200)
    assert {r.id: r.found for r in d.collect()} == {1: 11, 2: None, 3: None}


def test_bm25_prefers_rare_terms_and_short_documents(spark):
    docs = spark.createDataFrame([(1, "cat dog"), (2, "cat cat cat bird bird bird"), (3, "dog bird dog"), (4, None)], "doc_id long, text string")
    q = spark.createDataFrame([(0, "cat cat")], "item_id long, text string")
    got = {r.doc_id: r.score for r in retrieval.bm25(retrieval.tokenised(docs), q).collect()}
    assert set(got) == {1, 2}
    import math

    idf, avg = math.log(1 + (4 - 2 + 0.5) / 2.5), 11 / 4
    want = idf * 1 * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / avg))
    assert got[1] == pytest.approx(want)


def test_mmr_takes_the_best_first_then_what_differs(spark):
    rows = [(0, 1, ["a", "b"], 1.0), (0, 2, ["a", "b"], 0.95), (0, 3, ["c"], 0.8)]
    c = spark.createDataFrame(rows, "q int, item int, terms array<string>, score double")
    assert rows_of(retrieval.mmr(c, "q", "item", "terms", "score", 2), "position", "item") == [(1, 1), (2, 3)]
    assert rows_of(retrieval.mmr(c, "q", "item", "terms", "score", 5), "position", "item") == [(1, 1), (2, 2), (3, 3)]


def test_core_overflow_joins_the_related(spark):
    rows = [(i, 1.0 - i / 100, "core") for i in range(6)] + [(10, 0.1, "other")]
    d = retrieval.slots(spark.createDataFrame(rows, "id int, s double, k string").withColumn("q", F.lit(1)), "q", F.col("k") == "core", F.lit(False), [F.desc("s")])
    assert rows_of(d.where("bucket = 'related'"), "id", "position") == [(4, 1), (5, 2), (10, 3)]


def _ingest(claims):
    live, out = {}, {}
    for slot, i, _ts, value, conf, first, corr, joke, hear, close, pin in sorted(claims, key=lambda c: (c[2], c[1])):
        cur = live.get(slot)
        if joke:
            out[i] = "rejected"
        elif hear:
            out[i] = "uncertain"
        elif close:
            out[i] = "closed" if cur else "ignored"
            live.pop(slot, None)
        elif cur is None:
            out[i], live[slot] = "inserted", (value, conf, pin)
        elif cur[0] == value:
            out[i] = "refreshed"
        elif cur[2] or (cur[1] >= 0.8 and not corr):
            out[i] = "pending"
        elif corr or (first and conf >= cur[1]):
            out[i], live[slot] = "superseded", (value, conf, pin)
        else:
            out[i] = "pending"
    return out


@pytest.mark.parametrize("seed", range(3))
def test_guarded_ingest_equals_a_fold(spark, seed):
    r = random.Random(seed)
    flag = lambda p: r.random() < p
    claims = [(r.choice("abcdefgh"), i, r.randrange(50), r.choice("xyz"), r.random(), flag(0.5), flag(0.2), flag(0.1), flag(0.1), flag(0.1), flag(0.1)) for i in range(150)]
    claims.append(("single", 999, 1, "x", 0.5, False, False, False, False, True, False))
    shape = "slot_key string, id long, ts long, value string, confidence double, first_person boolean, correction boolean, joke boolean, hearsay boolean, close boolean, pinned boolean"
    d = maintenance.guarded_ingest(spark.createDataFrame(claims, shape))
    assert {x.id: x.outcome for x in d.collect()} == _ingest(claims)


def test_tool_groups_need_every_answer_once(spark):
    rows = [(1, 1, "assistant", ["a", "b"], None), (1, 2, "tool", [], "b"), (1, 3, "tool", [], "a"), (1, 4, "assistant", ["c"], None), (1, 5, "assistant", [], None), (1, 6, "tool", [], "c"), (2, 1, "assistant", ["x"], None), (2, 2, "tool", [], "x"), (2, 3, "tool", [], "x")]
    d = maintenance.completed_tool_groups(spark.createDataFrame(rows, "conv int, turn int, role string, calls array<string>, answers string"), ["conv"])
    assert rows_of(d, "conv", "turn", "calls") == [(1, 1, ["a", "b"])]


def test_profiles_merge_by_rule(spark):
    shape = "speaker_id string, first_seen long, last_seen long, seen_count long, speaker_name string"
    old = spark.createDataFrame([("u", 0, 5, 3, "Ann"), ("v", 4, 5, 1, "")], shape)
    new = spark.createDataFrame([("u", 7, 9, 2, "")], shape)
    assert rows_of(aggregates.merged_profiles(old, new), "speaker_id", "first_seen", "last_seen", "seen_count", "speaker_name") == [("u", 7, 9, 3, "Ann"), ("v", 4, 5, 1, None)]


def test_hot_terms_leave_out_what_everyone_says(spark):
    c = spark.createDataFrame([("a", "yolo", 9), ("a", "the", 50), ("b", "the", 50), ("c", "the", 50), ("a", "rare", 1)], "src string, term string, n long")
    assert rows_of(aggregates.hot_terms(c, "src", 4, 0.25, 3, 10), "term", "n", "spread") == [("yolo", 9, 1)]


def test_jsonl_tells_tables_apart(spark):
    lines = ['{"table":"facts","x":1}', '{"attribute":"likes","content":"y"}', '{"content":"hi"}', "not json", "", '{"z":1}']
    d = jsonl.preview(spark.createDataFrame([(x,) for x in lines], ["value"]))
    assert rows_of(d, "table", "lines") == [("error", 1), ("facts", 2), ("timeline", 1), ("unknown", 1)]


def test_transcript_carries_times_and_joins_lines(spark):
    text = ["noise", "Ann 2024-03-01 10:00:00", "hello", " there", "Bot 03-01 10:05", "hi", "2024-03-01 10:06:00 Ann", "bye", "Bob 99-99 10:00", "odd"]
    d = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "file string, line int, text string")
    got = [(r.name, r.role, r.content) for r in transcript.messages(d, 2024, ("Bot",)).orderBy("message").collect()]
    assert got == [("Ann", "user", "hello\n there"), ("Bot", "assistant", "hi"), ("Ann", "user", "bye"), ("Bob", "user", "odd")]
    times = [r.ts for r in transcript.messages(d, 2024).orderBy("message").collect()]
    assert times[1] - times[0] == 300 and times[3] == times[2]


def test_retention_keeps_what_is_referred_to(spark):
    tl = spark.createDataFrame([(1, 10), (2, 10), (3, 99)], "id long, ts long")
    kept = maintenance.retained(tl, spark.createDataFrame([(2,)], "id long"), 50)
    assert rows_of(kept, "id") == [(2,), (3,)]


def test_counts_of_sessions_match_the_plain_count(spark):
    rows = [(i, i * 10, "w", "user" if i % 2 else "assistant", f"u{i % 3}", "去了" if i == 3 else "嗯") for i in range(10)]
    d = windows.sessions_by_gap(spark.createDataFrame(rows, "id long, ts long, window_tag string, role string, speaker_id string, content string"), ["window_tag"], 100)
    from mnemora.functions.gates import EPISODE_CUE

    e = aggregates.episodes(d, ["window_tag"], EPISODE_CUE, 4).first()
    groups = defaultdict(int)
    for r in rows:
        groups[r[3]] += 1
    assert (e.messages, e.user_messages, e.kind, e.worthy) == (10, groups["user"], "life", True)


@pytest.mark.parametrize(("most_rows", "most_size"), [(40, 6000), (3, 50), (5, 9), (1, 1)])
def test_chunks_within_equal_a_fold(spark, most_rows, most_size):
    r = random.Random(most_rows)
    rows = [(i, i // 3, r.choice("abc"), None if i % 11 == 0 else "x" * r.randrange(20)) for i in range(200)]
    d = windows.chunks_within(spark.createDataFrame(rows, "id long, ts long, k string, content string"), ["k"], most_rows, most_size, F.length("content"))
    held, want = {}, []
    for i, _, k, text in rows:
        chunk, sizes = held.get(k, (0, []))
        if sizes and (len(sizes) >= most_rows or sum(sizes) + len(text or "") > most_size):
            chunk, sizes = chunk + 1, []
        held[k] = chunk, [*sizes, len(text or "")]
        want.append((i, chunk))
    assert rows_of(d, "id", "chunk") == want


def test_navigate_asks_with_the_first_new_hit(spark):
    texts = ["red fox", "fox den den", "den bear", "bear honey", "honey bee", "other words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame([(7, "red"), (8, "nothing")], "item_id long, text string")
    got = sorted(tuple(r) for r in retrieval.navigate(docs, asked, steps=3, each=1).select("item_id", "step", "rank", "doc_id").collect())

    def best(text, seen):
        scores = retrieval.bm25(retrieval.tokenised(docs), spark.createDataFrame([(0, text)], "item_id long, text string")).collect()
        left = sorted((-round(s.score, 6), s.doc_id) for s in scores if s.doc_id not in seen)
        return left[0][1] if left else None

    seen, text = [], "red"
    while len(seen) < 3 and (hit := best(text, seen)) is not None:
        seen.append(hit)
        text = texts[hit]
    assert got == [(7, i, 1, d) for i, d in enumerate(seen, 1)] and len(seen) == 3
