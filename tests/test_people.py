"""Attributes, addressees, statements, members, cards."""

import pytest
from pyspark.sql import functions as F

from mnemora.functions import addressee, extraction, history, render, slots
from mnemora.operators import cards, maintenance, people


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize(("raw", "want"), [("Likes", "likes"), ("爱-好", "likes"), ("我的爱好", "likes"), ("职业", "identity"), ("", "note"), (None, "note"), ("zzz", "zzz")])
def test_canonical_attribute(spark, raw, want):
    d = spark.createDataFrame([(raw,)], "a string")
    assert d.select(slots.canonical_attribute(F.col("a")).alias("x")).first().x == want


def test_canonical_subject_and_kind(spark):
    d = spark.createDataFrame([("你", "u", "Ann"), ("我", "u", "Ann"), ("ann", "u", "Ann"), ("", "u", ""), ("Bob", "u", "")], "r string, s string, n string")
    assert [r.x for r in d.select(slots.canonical_subject(F.col("r"), F.col("s"), F.col("n")).alias("x")).collect()] == ["bot", "self", "self", "self", "Bob"]
    assert d.select(slots.fact_kind(F.lit("喜欢")).alias("k")).first().k == "preference"


def test_addressees_there_and_back(spark):
    raw = "at:1|Ann,reply:2|,bad,at:|x,at:all|"
    d = spark.createDataFrame([(raw,)], "a string")
    r = d.select(addressee.encode(addressee.decode(F.col("a"))).alias("e"), addressee.rendered(F.col("a"), "2").alias("r"), addressee.mentions(F.col("a"), "2").alias("m"), addressee.turn_open(F.col("a"), "2").alias("o")).first()
    assert tuple(r) == ("at:1|Ann,reply:2|,at:all|", "Ann、你、全体", True, False)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("我喜欢喝咖啡", {("likes", "咖啡")}),
        ("我平时很喜欢咖啡和奶茶。", {("likes", "咖啡"), ("likes", "奶茶")}),
        ("朋友说不喜欢香菜", set()),
        ("不喜欢香菜", {("likes", "不香菜")}),
        ("请叫我小明", {("name", "小明")}),
        ("我讨厌下雨", {("dislikes", "下雨")}),
        (None, set()),
    ],
)
def test_statements(spark, text, want):
    d = spark.createDataFrame([(text,)], "t string").select(extraction.stated(F.col("t")).alias("s"))
    assert {tuple(x) for x in d.first().s} == want


def test_closing_messages_are_rows_of_their_own(spark):
    d = extraction.statements(spark.createDataFrame([(1, "已经寄了"), (2, "hello")], "id int, content string"))
    assert [tuple(r) for r in d.collect()] == [(1, None, None, True)]


def test_birthdays_go_over_the_new_year_and_leave_out_odd_dates(spark):
    rows = [("a", 12, 30), ("b", 1, 2), ("c", 2, 30), ("d", 6, 1), ("e", 12, 28)]
    d = people.upcoming_birthdays(spark.createDataFrame(rows, "id string, month int, day int"), F.lit("2023-12-28").cast("date"), 7)
    assert rows_of(d, "id", "days_until") == [("a", 2), ("b", 5), ("e", 0)]


def test_members_by_tier(spark):
    members = spark.createDataFrame([(1, "Ann"), (2, "Anna"), (3, "ann"), (42, "Bob")], "member_id int, name string")
    asked = spark.createDataFrame([("ann",), ("anna",), ("42",), ("nobody",), ("",)], "asked string")
    assert rows_of(people.resolved_members(asked, members), "asked", "member_id", "tier", "ambiguous") == [("42", 42, 0, False), ("ann", 1, 1, True), ("ann", 3, 1, True), ("anna", 2, 1, False)]


@pytest.mark.parametrize(("text", "want"), [("帮我去第2个群说:hi", ("index", "2", "hi")), ("去12345群说 hi", ("number", "12345", "hi")), ("群里说，hi", ("default", "", "hi")), ("hi", None)])
def test_speak_intent(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(people.speak_intent(F.col("t")).alias("x")).first().x
    assert (tuple(got) if got else None) == want


def test_settings(spark):
    t = lambda *kv: spark.createDataFrame(list(kv), "key string, value string")
    assert rows_of(people.settings_diff(t(("a", "1"), ("b", "2"), ("c", "3")), t(("a", "1"), ("b", "9"), ("d", "4"))), "key", "change") == [("b", "changed"), ("c", "removed"), ("d", "added")]
    assert rows_of(people.effective_settings(t(("a", "1"), ("b", "1")), t(("b", "2")), t(("c", "3"), ("a", "9"))), "key", "value") == [("a", "9"), ("b", "2"), ("c", "3")]


def test_same_names_without_aliases(spark):
    seen = spark.createDataFrame([("u1", "Ann"), ("u1", "Ann"), ("u2", "Ann"), ("u3", "Ann"), ("u4", "Bob")], "speaker_id string, speaker_name string")
    d = people.same_name_suggestions(seen, spark.createDataFrame([("u3",)], "alias string"))
    assert rows_of(d, "speaker_id", "n", "rank") == [("u1", 2, 1), ("u2", 1, 2)]


def test_profile_card_puts_named_values_first_with_a_place_more(spark):
    rows = [("u", "likes", v, "", "", i, 0) for i, v in enumerate(["tea", "rice", "jazz", "go", "tea"])] + [("u", "status", "ill", "", "", 1, 5), ("u", "note", "", "plain", "", 1, 0)]
    facts = spark.createDataFrame(rows, "speaker_id string, attribute string, value string, plain string, content string, updated_at int, expires_at int")
    got = rows_of(cards.profile_card(facts, "any rice left?", 10), "attribute", "position", "value")
    assert got == [("likes", 1, "rice"), ("likes", 2, "tea"), ("likes", 3, "go"), ("note", 1, "plain")]


def test_pack_fills_by_priority_and_shows_by_place(spark):
    rows = [("q", 1, 2, "B:", ["bbb", "b" * 50]), ("q", 2, 1, "A:", ["aa", "aaa"]), ("q", 3, 0, "C:", ["c" * 50])]
    d = cards.context_pack(spark.createDataFrame(rows, "q string, fill int, place int, title string, lines array<string>"), "q", 20)
    assert d.first().pack == "A:\naa\naaa\nB:\nbbb"


def test_histories_lose_images_and_finished_tools(spark):
    d = spark.createDataFrame([([("user", "see data:image/png;base64,AAAA=="), ("tool", "long result"), ("tool", "open")],)], "m array<struct<role:string,content:string>>")
    m = history.without_finished_tools(history.without_images(F.col("m")), F.array(F.lit(1)))
    assert [x.content for x in d.select(m.alias("m")).first().m] == ["see [image]", "[tool result]", "open"]


def test_lines(spark):
    lit = lambda *x: [F.lit(v) for v in x]
    d = spark.range(1).select(
        render.fact_line(*lit("person", "", "u1", "likes", "", "tea please", "tea", "饮品", "uncertain")).alias("f"), render.episode_line(*lit("owner", "", "", "talk", "T", "", 0, "")).alias("e"),
        render.history_line(*lit("person", "Ann", "u1", "tea", 86400, 172800, "rice")).alias("h"),
    ).first()
    assert tuple(d) == ("- [u1/likes] tea please（饮品）（不确定）", "- [时间未知 · T] T（主人聊过）", "- [01-02 00:00~01-03 00:00] Ann：tea（现在：rice）")


def test_review_scores(spark):
    rows = [("jargon", "yolo", "live now", "", "", ""), ("jargon", "12", "", "", "", ""), ("fewshot", "", "", "a" * 40, "b" * 60, ""), ("fewshot", "", "", "/cmd", "b" * 60, ""), ("persona", "", "", "", "", "你是猫"), ("x", "", "", "", "", "")]
    d = spark.createDataFrame(rows, "k string, t string, m string, u string, b string, d string")
    assert [r.s for r in d.select(render.review_score(*[F.col(c) for c in "ktmubd"]).alias("s")).collect()] == [85, 25, 60, 11, 5, 50]


def test_preferences_fold_only_with_the_same_polarity(spark):
    shape = "id int, speaker_id string, persona_id string, attribute string, value string, content string, topic string, pinned boolean"
    rows = [(1, "u", "", "likes", "喜欢美式", "", "饮品", False), (2, "u", "", "note", "", "喜欢喝美式咖啡", "", False), (3, "u", "", "dislikes", "美式", "", "", False), (4, "u", "", "note", "", "美式穿搭风格", "穿搭", False), (5, "u", "", "note", "", "美式", "", True), (6, "v", "", "note", "", "美式", "", False)]
    assert rows_of(maintenance.folded_preferences(spark.createDataFrame(rows, shape)), "id", "keeper") == [(2, 1)]
