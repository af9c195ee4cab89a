"""Column functions on small frames."""

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from mnemora.functions import gates, scores, text, timeparse


def one(spark, column, **values):
    d = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return d.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("value", "slot"),
    [("  Hello, World! ", "helloworld"), ("“咖啡”。", "咖啡"), ("", "")],
)
def test_normalize_slot(spark, value, slot):
    assert one(spark, text.normalize_slot(F.col("v")), v=value) == slot


@pytest.mark.parametrize(("value", "topic"), [("我不喜欢喝咖啡了", "咖啡"), ("现在讨厌看电影吧", "电影"), ("coffee", "coffee"), ("我", "")])
def test_topic_key(spark, value, topic):
    assert one(spark, text.topic_key(F.col("v")), v=value) == topic


def test_slot_key_has_a_topic_only_where_many_may_stand(spark):
    args = {"p": "", "s": "u1", "j": "self", "v": "喜欢咖啡"}
    likes = one(spark, text.slot_key(F.col("p"), F.col("s"), F.col("j"), F.lit("likes"), F.col("v")), **args)
    name = one(spark, text.slot_key(F.col("p"), F.col("s"), F.col("j"), F.lit("name"), F.col("v")), **args)
    assert (likes, name) == ("|u1|self|likes|咖啡", "|u1|self|name")


def test_fingerprint_ignores_case_and_outer_space_and_takes_null_as_empty(spark):
    d = spark.createDataFrame([(" A ", None), ("a", "")], "x string, y string").select(text.fingerprint(F.col("x"), F.col("y")).alias("f"))
    a, b = [r.f for r in d.collect()]
    assert a == b and len(a) == 24


@pytest.mark.parametrize(("value", "limit", "want"), [("abcdef", 4, "abc…"), ("abc", 4, "abc"), (" abc ", 0, "abc")])
def test_clip(spark, value, limit, want):
    assert one(spark, text.clip(F.col("v"), limit), v=value) == want


def test_tokens_split_ideographs_and_keep_runs(spark):
    assert one(spark, text.tokens(F.col("v")), v="Hello 咖啡x9 " + "a" * 33) == ["hello", "咖", "啡", "x9"]


@pytest.mark.parametrize(("value", "n"), [("咖啡", 2), ("abcd", 1), ("abcde", 2), ("", 0), ("咖ab", 2)])
def test_token_estimate(spark, value, n):
    assert one(spark, text.token_estimate(F.col("v")), v=value) == n


@pytest.mark.parametrize(("a", "b", "clash"), [("咖啡", "不咖啡", True), ("咖啡", "黑咖啡", False), ("茶", "咖啡", True), ("茶", "茶", False), ("", "茶", False)])
def test_values_conflict(spark, a, b, clash):
    assert one(spark, text.values_conflict(F.col("a"), F.col("b")), a=a, b=b) is clash


def test_detect_domain_needs_a_single_leader(spark):
    assert one(spark, text.detect_domain(F.col("a"), F.lit("")), a="喝咖啡") == "饮品"
    assert one(spark, text.detect_domain(F.col("a"), F.lit("")), a="喝吃") == ""


def test_merged_spaces_latin_edges_only(spark):
    d = spark.createDataFrame([(["hi ", "there", "咖", "啡", ""],)], "f array<string>")
    assert d.select(text.merged(F.col("f")).alias("x")).first().x == "hi there咖啡"


@pytest.mark.parametrize(
    ("query", "route"),
    [("嗯嗯", "low_info"), ("以前住哪", "history"), ("2023年5月去了哪", "history"), ("最近3天", "history"), ("在干嘛", "current_status"), ("昨天说的", "time_window"), ("还记得吗", "recall"), ("我的猫", "long_term"), ("", "low_info")],
)
def test_route(spark, query, route):
    assert one(spark, gates.route(F.col("q")), q=query) == route


@pytest.mark.parametrize(
    ("query", "start", "end", "label"),
    [("2023年5月", (2023, 5, 1), (2023, 6, 1), "2023-05"), ("去年12月", (2023, 12, 1), (2024, 1, 1), "2023-12"), ("上个月", (2023, 12, 1), (2024, 1, 1), "2023-12"), ("今年", (2024, 1, 1), (2025, 1, 1), "2024"), ("3月", (2023, 3, 1), (2023, 4, 1), "2023-03")],
)
def test_parse_time_range(query, start, end, label):
    as_of = int(datetime(2024, 1, 20, tzinfo=UTC).timestamp())
    at = lambda d: int(datetime(*d, tzinfo=UTC).timestamp())
    assert timeparse.parse_time_range(query, as_of) == (at(start), at(end), label)
    assert timeparse.parse_time_range("最近2周", as_of) == (as_of - 14 * 86400, as_of, "最近2周")
    assert timeparse.parse_time_range("hello", as_of) == (0, 0, "")


def test_quiet_ranges_go_over_midnight(spark):
    ranges = timeparse.quiet_ranges("23:00-7:00;13-14;bad;5-5")
    assert ranges == [(1380, 420), (780, 840)]
    d = spark.createDataFrame([("2024-01-01 23:30:00",), ("2024-01-01 07:00:00",), ("2024-01-01 13:59:00",)], ["t"])
    assert [r.q for r in d.select(gates.quiet(F.col("t").cast("timestamp"), ranges).alias("q")).collect()] == [True, False, True]


def test_decay_halves_in_a_half_life_and_accesses_stretch_it(spark):
    w = lambda pin, acc: one(spark, scores.decay_weight(F.lit(0.8), F.lit(0.5), F.lit(pin), F.lit(acc), F.lit(1), F.lit(1 + 30 * 86400)))
    assert w(False, 0) == pytest.approx(0.4)
    assert w(False, 2) == pytest.approx(0.8 * 0.5**0.5)
    assert w(True, 0) == 1.0


def test_cosine_of_odd_vectors_is_zero(spark):
    d = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([0.0], [1.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r.c for r in d.select(scores.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_judge_score_renormalises_over_known_dimensions(spark):
    d = spark.createDataFrame([({"relevance": "8", "timing": "x", "social": "20"},)], "m map<string,string>")
    assert d.select(scores.judge_score(F.col("m")).alias("s")).first().s == pytest.approx((8 * 0.3 + 10 * 0.25) / 0.55)


def test_visibility_rules_in_order(spark):
    rows = [("superseded", 0, "", "person", "7", "x"), ("live", 5, "", "person", "7", "x"), ("live", 0, "q", "person", "7", "x"), ("live", 0, "", "owner", "9", "x"), ("live", 0, "", "person", "7", "x"), ("live", 0, "", "person", "8", "Bob"), ("live", 0, "", "person", "8", "x")]
    d = spark.createDataFrame(rows, "status string, exp int, persona string, scope string, speaker string, name string")
    r = gates.fact_block_reason(F.col("status"), F.col("exp"), F.col("persona"), F.col("scope"), F.col("speaker"), F.col("name"), as_of=F.lit(10), ask_persona="p", asker=["7"], owners=["1"], query="what about bob")
    assert [x.r for x in d.select(r.alias("r")).collect()] == ["not_live", "expired", "other_persona", "owner_private", "visible", "visible", "other_speaker"]
