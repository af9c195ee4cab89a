"""Rules over rows that hit every branch, with what they give."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pytest
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions import extraction, gates, matching, scores, slots, text, visibility
from mnemora.operators import people, review
from mnemora.sources import transcript

CASES: dict[str, tuple] = {}


def stated(columns: str, rows: Sequence[tuple], types: str | None = None) -> Callable:
    """A frame, a function of (spark, folder), and the rows that it has."""

    def add(f: Callable) -> Callable:
        CASES[f.__name__] = (lambda spark: f(spark, "").select(*columns.split(", ")), list(rows))
        return f

    return add


def matrix(inputs: str, rows: Sequence[tuple], n: int, out: str) -> Callable:
    """The first n values of each row are inputs, the others what the columns of the function give."""

    def add(f: Callable[[], dict[str, Column]]) -> Callable:
        def run(spark: SparkSession) -> DataFrame:
            d = spark.createDataFrame([(k, *r[:n]) for k, r in enumerate(rows)], f"row int, {inputs}")
            found = f()
            return d.select("row", *[found[k].alias(k) for k in out.split(", ")])

        CASES[f.__name__] = (run, [(k, *r[n:]) for k, r in enumerate(rows)])
        return f

    return add


_c = F.col


@matrix("t string", (
    ("", "low_info", 0), (None, "low_info", 0), ("哈哈哈！", "low_info", 0), ("OK~", "low_info", 0), ("在干嘛", "current_status", 0), ("以前叫什么", "history", 0), ("2024年3月去哪了", "history", 0), ("去年 12 月", "history", 0),
    ("最近 3 周怎样", "history", 7), ("5 月见过谁", "history", 0), ("昨天去哪了", "time_window", 2), ("刚才说的", "time_window", 1), ("那天谁来了", "time_window", 0), ("你还记得吗", "recall", 0), ("我跟你说过的", "recall", 0), ("喜欢什么", "long_term", 0),
    ("昨天在干嘛", "current_status", 2), ("还记得以前吗", "history", 0), ("上个月的事", "history", 40), ("what about 57", "long_term", 0), ("上周末", "time_window", 14), ("前天 vs 昨天", "time_window", 2),
), 1, "route, days")
def route_matrix() -> dict[str, Column]:
    return {"route": gates.route(_c("t")), "days": gates.look_back_days(_c("t"))}


@matrix("t string", (
    ("", "too_short", False, False, True), ("啊", "too_short", False, True, True), ("/help me", "command", False, False, False), ("！开始", "command", False, True, False), ("。。。", "no_content", False, False, False), ("你好", "", False, True, True),
    ("去吗", "", True, True, False), ("谁去", "", True, True, False), ("我闺蜜是小美呢", "", False, False, False), ("what?", "", True, False, False), ("好的好的", "", False, False, False), ("收到收到", "", False, False, False),
    ("我今天想去买菜然后", "", False, True, False), ("今天的天气很好，", "", False, True, False), ("今天的天气很好吃饭", "", False, False, False), ("我想说", "", False, True, False), ("我想说。", "", False, False, False), ("这件事情说来话长一言难尽啊真的很长很长", "", False, False, False),
    ("今天的天气很好-", "", False, False, False), ("能不能帮我", "", True, True, False), ("晚安~", "", False, False, True), ("OK", "", False, False, True), ("thanks", "", False, True, False),
), 1, "reason, question, unfinished, low")
def gate_matrix() -> dict[str, Column]:
    return {"reason": gates.text_usable(_c("t")), "question": gates.question_like(_c("t")), "unfinished": gates.incomplete(_c("t")), "low": gates.low_info(_c("t"))}


@matrix("t string", (
    ("不是，我说错了", True, False, False, True, False, True), ("开玩笑的", False, True, False, False, False, False), ("听说他好像走了", False, False, True, False, False, False), ("我去了北京", False, False, False, True, False, True), ("她是我女朋友", False, False, False, True, True, False),
    ("帮我记一下，我住上海", False, False, False, True, False, False), ("搬家那天", False, False, False, False, False, True), ("他妈妈来了", False, False, False, False, True, False), ("改口，以后叫我小王", True, False, False, True, False, True), ("hello", False, False, False, False, False, False),
), 1, "correction, joke, hearsay, first_person, relation, episode")
def cue_matrix() -> dict[str, Column]:
    t = _c("t")
    return {"correction": t.rlike(gates.CORRECTION), "joke": t.rlike(gates.JOKE), "hearsay": t.rlike(gates.HEARSAY), "first_person": t.rlike(gates.FIRST_PERSON), "relation": t.rlike(gates.RELATION), "episode": t.rlike(gates.EPISODE_CUE)}


_STATEMENTS = (
    ("我喜欢咖啡", [("likes", "咖啡")]), ("我喜欢苹果、香蕉和梨", [("likes", "苹果"), ("likes", "香蕉"), ("likes", "梨")]), ("我不喜欢香菜", [("likes", "不香菜")]), ("我喜欢和平精英", [("likes", "和平精英")]),
    ("朋友说不喜欢鱼", []), ("我讨厌下雨", [("dislikes", "下雨")]), ("叫我小王", [("name", "小王")]), ("我住在上海", [("identity", "上海")]), ("我喜欢咖啡，打篮球", [("likes", "咖啡"), ("likes", "打篮球")]), ("我喜欢咖啡，但是不喝了", [("likes", "咖啡")]),
    ("我喜欢跑步跟游泳", [("likes", "跑步跟游泳")]), ("我迷上了爬山", [("likes", "爬山")]), ("今天好热", []), ("我最近在学画画", [("status", "在学画画")]),
)


@stated("row, attribute, value", [(k, a, v) for k, (_, found) in enumerate(_STATEMENTS) for a, v in found])
def statement_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(_STATEMENTS)], "row int, t string")
    return d.select("row", F.explode(extraction.stated(_c("t"))).alias("s")).select("row", "s.attribute", "s.value")


@matrix("attribute string, value string, content string, topic string, subject string", (
    ("喜欢", "咖啡", "我喜欢喝咖啡", "", "我", "likes", "咖啡", "self", "preference", "饮品"), ("like", "香菜", "我不喜欢香菜", "", "", "likes", "不香菜", "self", "preference", "食物"), ("dislikes", "不喜欢吃鱼了", "", "", "user", "likes", "不鱼", "self", "preference", ""),
    ("讨厌", "下雨", "讨厌下雨", "", "小明", "dislikes", "下雨", "小明", "preference", ""), ("note", "", "他没喜欢过她", "", "机器人", "likes", "不过她", "bot", "preference", ""), ("昵称", "小王", "叫我小王", "饮品", "u7", "name", "小王", "self", "identity", ""),
    ("likes", "美式", "我喜欢美式", "穿搭", "俺", "likes", "美式", "self", "preference", "穿搭"), ("", "x", "", "", "你", "note", "x", "bot", "note", ""), ("likes", "不辣", "我不喜欢辣", "", "本人", "likes", "不辣", "self", "preference", "食物"), ("约定", "周五见", "周五见", "", "小王", "promise", "周五见", "self", "promise", ""),
), 5, "attribute, value, subject, kind, topic")
def slot_matrix() -> dict[str, Column]:
    s = slots.applied(_c("attribute"), _c("value"), _c("content"), F.lit(""), _c("topic"), _c("subject"), F.lit("u7"), F.lit("小王"))
    return {k: s[k] for k in ("attribute", "value", "subject", "kind", "topic")}


@matrix("enabled boolean, capture boolean, yielded boolean, owner boolean, platform string, place string", (
    (False, True, False, False, "qq", "w1", "disabled"), (True, False, False, False, "qq", "w1", "capture_off"), (True, True, True, False, "qq", "w1", "coexistence"), (True, True, False, False, "wx", "w1", "platform:wx"), (True, True, False, True, "wx", "qq:Group:w1", ""),
    (True, True, False, False, "", "qq:Group:w1", ""), (True, True, False, False, "qq", "qq:Group:w2", "whitelist"), (True, True, False, False, "qq", "qq:Group:w1 u7", ""),
), 6, "reason")
def capture_matrix() -> dict[str, Column]:
    return {"reason": gates.capture_reason(_c("enabled"), _c("capture"), _c("yielded"), _c("owner"), _c("platform"), ["qq"], _c("place"), ["w1"])}


_NOW, _OLD = 1_000_000, 1_000_000 - 3 * 86400


@matrix("status string, expires long, persona string, scope string, speaker string, win string, attribute string, updated long, route string, persona_asked string, here string, iso string, owners array<string>", (
    ("archived", 0, "", "person", "7", "", "note", _NOW, "recall", "", "", "shared", [], "not_live", "visible"), ("live", 5, "", "person", "7", "", "note", _NOW, "recall", "", "", "shared", [], "expired", "visible"), ("live", 0, "q", "person", "7", "", "note", _NOW, "recall", "p", "", "shared", [], "other_persona", "other_persona"),
    ("live", 0, "q", "person", "7", "", "note", _NOW, "recall", "", "", "shared", [], "visible", "visible"), ("live", 0, "", "owner", "9", "", "note", _NOW, "recall", "", "", "shared", ["9"], "owner_private", "owner_private"), ("live", 0, "", "owner", "9", "", "note", _NOW, "recall", "", "", "off", ["9"], "visible", "visible"),
    ("live", 0, "", "owner", "9", "", "note", _NOW, "recall", "", "", "shared", ["7"], "visible", "visible"), ("live", 0, "", "person", "7", "qq:FriendMessage:7", "note", _NOW, "recall", "", "qq:GroupMessage:1", "strict", [], "private_origin", "private_origin"), ("live", 0, "", "person", "7", "qq:FriendMessage:7", "note", _NOW, "recall", "", "qq:FriendMessage:7", "strict", [], "visible", "visible"),
    ("live", 0, "", "person", "bot_self", "qq:FriendMessage:7", "note", _NOW, "recall", "", "qq:FriendMessage:7", "strict", [], "private_origin", "private_origin"), ("live", 0, "", "person", "7", "qq:FriendMessage:7", "note", _NOW, "recall", "", "qq:GroupMessage:1", "owner", [], "visible", "visible"), ("live", 0, "", "person", "7", "", "note", _OLD, "current_status", "", "", "shared", [], "stale_for_status", "visible"),
    ("live", 0, "", "person", "7", "", "likes", _OLD, "current_status", "", "", "shared", [], "visible", "visible"), ("live", 0, "", "person", "4321", "", "note", _NOW, "recall", "", "", "shared", [], "visible", "visible"), ("live", 0, "", "person", "8", "", "note", _NOW, "recall", "", "", "shared", [], "other_speaker", "other_speaker"), ("live", 0, "", "person", "", "", "note", _NOW, "recall", "", "", "shared", [], "visible", "visible"),
), 13, "fact, history")
def visibility_matrix() -> dict[str, Column]:
    ask = {"query": F.lit("what does 4321 do"), "ids": F.array(F.lit("7")), "ask_persona": _c("persona_asked"), "ask_window": _c("here"), "isolation": visibility.isolation_of(_c("iso")), "owners": _c("owners")}
    fact = visibility.fact_reason(_c("status"), _c("expires"), _c("persona"), _c("scope"), _c("speaker"), F.lit("x"), _c("win"), _c("attribute"), _c("updated"), as_of=F.lit(_NOW), route=_c("route"), **ask)
    return {"fact": fact, "history": visibility.history_reason(_c("persona"), _c("scope"), _c("speaker"), F.lit("x"), _c("win"), **ask)}


@matrix("status string, review string, persona string, scope string, speakers array<string>, win string, route string, here string, iso string, owners array<string>", (
    ("archived", "", "", "person", ["7"], "w", "recall", "", "shared", [], "not_live"), ("archived", "", "", "person", ["7"], "w", "history", "", "shared", [], "visible"), ("deleted", "", "", "person", ["7"], "w", "history", "", "shared", [], "not_live"), ("live", "needs_review", "", "person", ["7"], "w", "recall", "", "shared", [], "needs_review"),
    ("live", "", "q", "person", ["7"], "w", "recall", "", "shared", [], "other_persona"), ("live", "", "", "person", ["8", "7"], "w", "recall", "", "off", [], "visible"), ("live", "", "", "person", ["8"], "w", "recall", "w", "shared", [], "visible"), ("live", "", "", "owner", ["8"], "w", "recall", "", "shared", [], "visible"),
    ("live", "", "", "owner", ["8"], "w", "recall", "", "shared", ["9"], "other_speaker"), ("live", "", "", "person", ["8"], "w", "recall", "v", "shared", [], "other_speaker"), ("live", "", "", "person", ["8"], "w", "recall", "w", "strict", [], "visible"), ("live", "", "", "person", ["7"], "w", "recall", "", "strict", [], "visible"),
    ("live", "", "", "owner", ["8"], "w", "recall", "", "owner", ["7"], "visible"), ("live", "", "", "owner", ["8"], "w", "recall", "", "owner", [], "other_session"), ("live", "", "", "person", ["7"], "w", "recall", "w", "owner", [], "other_session"),
), 10, "reason")
def episode_visibility_matrix() -> dict[str, Column]:
    return {"reason": visibility.episode_reason(_c("status"), _c("review"), _c("persona"), _c("scope"), _c("speakers"), _c("win"), route=_c("route"), ids=F.array(F.lit("7")), ask_persona=F.lit("p"), ask_window=_c("here"), isolation=_c("iso"), owners=_c("owners"))}


@matrix("relevance string, willingness string, social string, timing string", (
    ("8", "6", "4", "2", 5.3), ("10", None, None, "x", 10.0), (None, None, None, None, None), ("8", None, "20", None, 8.909090909), ("-3", "5", "5", "5", 3.5),
), 4, "score")
def judge_matrix() -> dict[str, Column]:
    values = F.create_map(*[x for k in ("relevance", "willingness", "social", "timing") for x in (F.lit(k), _c(k))])
    return {"score": F.round(scores.judge_score(F.map_filter(values, lambda k, v: v.isNotNull())), 9)}


@matrix("t string, q string", (
    ("yyds", "他真是YYDS！", True, "yyds", False), ("yyds", "yyds2", False, "yyds", False), ("破防", "我破防了", True, "破防", False), ("", "x", False, "", False), ("u_1", "see u_1 here", True, "u_1", False), ("12345", "12345", True, "", False), ("主人", "主人来了", True, "", False),
    ("A B", "a b", False, "ab", False), ("抱歉，我不能", "x", False, "抱歉我不能", True), ("As an AI model", "As an AI model", True, "asanaimodel", True),
), 2, "in_query, entity, refusal")
def term_matrix() -> dict[str, Column]:
    return {"in_query": matching.term_in_query(_c("t"), _c("q")), "entity": matching.entity_name(_c("t")), "refusal": matching.looks_refusal(_c("t"))}


@matrix("old string, new string", (
    ("咖啡", "咖啡", False, "咖啡", "饮品"), ("咖啡", "不咖啡", True, "咖啡", "饮品"), ("喝咖啡", "咖啡", False, "咖啡", "饮品"), ("猫", "狗", True, "猫", ""), ("", "狗", False, "", ""), ("我其实喜欢打篮球了", "足球", True, "打篮球", "运动"), ("穿外套喝奶茶", "x", True, "穿外套奶茶", "饮品"),
), 2, "conflict, topic, domain")
def value_matrix() -> dict[str, Column]:
    return {"conflict": text.values_conflict(_c("old"), _c("new")), "topic": text.topic_key(_c("old")), "domain": text.detect_domain(_c("old"), F.lit(""))}


@matrix("used long, hard long, soft long, urgent boolean, size long, cap long, fallback boolean", (
    (10, 0, 0, False, 5, 0, False, ""), (10, 10, 0, True, 5, 0, False, "daily_token_limit"), (10, 20, 10, False, 5, 0, False, "soft_token_limit"), (10, 20, 10, True, 5, 4, True, "single_call_cap"), (10, 0, 0, False, 5, 4, False, "single_call_cap_no_fallback"), (10, 20, 10, True, 5, 5, False, ""),
), 7, "reason")
def budget_matrix() -> dict[str, Column]:
    return {"reason": gates.budget_reason(_c("used"), _c("hard"), _c("soft"), _c("urgent"), _c("size"), _c("cap"), _c("fallback"))}


@matrix("t string", (
    ("帮我去第2个群说：开会", "index", "2", "开会"), ("去12345群说大家好", "number", "12345", "大家好"), ("在群里说，晚上见", "default", "", "晚上见"), ("群里说", None, None, None), ("今天吃什么", None, None, None), (None, None, None, None),
), 1, "target, value, content")
def speak_matrix() -> dict[str, Column]:
    s = people.speak_intent(_c("t"))
    return {k: s[k] for k in ("target", "value", "content")}


_LINES = ("noise", "小明：2024-03-01 10:00:00", "", "你好", "在吗", "", "丢掉", "小王: 03-02 11:00:00", "早", "发送者：小红", "时间：2024-03-03 08:00:00", "内容：第一行", "第二行", "", "又丢掉", "发送者：机器人", "消息：收到", "小明：99-99", "怪", "消息：2024-03-04", "x", "小刚: 3-5", "")


@stated("message, name, speaker_id, ts, role, content", (
    (1, "小明", "小明", 1709287200, "user", "你好\n在吗"), (2, "小王", "小王", 1709377200, "user", "早"), (3, "小红", "小红", 1709452800, "user", "第一行\n第二行"), (4, "机器人", "bot_self", 1709452800, "assistant", "收到"), (5, "小明", "小明", 1709452800, "user", "怪"),
))
def transcript_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame([("f", k, t) for k, t in enumerate(_LINES)], "file string, line int, text string")
    return transcript.messages(d, 2024, ("机器人",)).select("message", "name", "speaker_id", "ts", "role", "content")


@matrix("t string", (
    ("记住我住上海", True), ("帮我记一下她的电话", True), ("我喜欢猫", True), ("他喜欢猫", False), ("", False), ("改口，以后叫他老王", False), ("叫我小王", True),
), 1, "directive")
def directive_matrix() -> dict[str, Column]:
    return {"directive": matching.self_directive(_c("t"), gates.FIRST_PERSON)}


@matrix("q string, title string, summary string, pinned boolean, win string, here string, iso string", (
    ("猫 怎样", "猫", "猫生病了", False, "qq:FriendMessage:7", "qq:GroupMessage:1", "strict", True, False, True, False), ("猫 怎样", "猫", "猫生病了", True, "qq:FriendMessage:7", "qq:FriendMessage:7", "strict", True, False, True, True), ("说到爬山", "爬山", "爬山", False, "", "qq:GroupMessage:1", "strict", False, True, False, True),
    ("说到爬山吗", "爬山", "爬山去了黄山", False, "qq:FriendMessage:7", "", "strict", True, True, True, True), ("随便", "爬山", "", False, "qq:FriendMessage:7", "qq:GroupMessage:1", "shared", True, False, False, True),
), 7, "news, says, richer, in_card")
def novelty_matrix() -> dict[str, Column]:
    title, summary = _c("title"), _c("summary")
    news = matching.episode_is_news(_c("q"), title, summary, _c("pinned"), F.lit(False))
    return {"news": news, "says": matching.says(_c("q"), F.array(title)), "richer": matching.richer(summary, title), "in_card": visibility.in_card(_c("win"), _c("here"), _c("iso"))}


@matrix("kind string, raw string", (
    ("bool", "Yes", "true"), ("bool", "off", "false"), ("bool", "?", None), ("int", " 12 ", "12"), ("int", "12.9", "12"), ("int", "x", None), ("float", "1.50", "1.5"), ("float", "", None), ("string", " a ", "a"), ("other", "b", "b"),
), 2, "value")
def setting_matrix() -> dict[str, Column]:
    return {"value": people.coerced(_c("raw"), _c("kind"))}


@matrix("reason string, enabled boolean, allowed boolean", (
    ("turn_not_open", True, True, True, True), ("low_info", True, False, True, False), ("cooldown", True, True, False, True), ("judge_below", False, True, True, False), ("quiet", False, False, False, False),
), 3, "delayed, inject")
def follow_up_matrix() -> dict[str, Column]:
    return {"delayed": gates.worth_waiting(_c("reason")), "inject": _c("enabled") & _c("allowed")}


@matrix("t string, kind string, image boolean, mentioned boolean, awake boolean, owner boolean", (
    ("我想说", "group", False, False, False, True, True, False, True, True), ("我想说", "private", False, False, False, False, True, True, True, False), ("我想说", "group", True, False, False, False, False, False, True, False), ("我想说", "group", False, True, False, False, False, False, True, False), ("我想说", "group", False, False, True, False, False, False, True, False),
    ("小萨在吗", "group", False, False, False, True, False, False, True, True), ("/我想", "group", False, False, False, False, False, False, True, False), ("", "group", False, False, False, False, False, False, True, False), ("好的", "private", False, False, False, False, False, False, True, False), ("今天的天气很好，", "private", False, False, False, False, True, True, True, False),
), 6, "held, private_only, everybody, owner_only")
def hold_matrix() -> dict[str, Column]:
    held = lambda scope: gates.held_back(_c("t"), _c("kind"), scope, _c("image"), _c("mentioned"), _c("awake"), ["小萨", "Bot"])
    return {"held": held("both"), "private_only": held("private"), "everybody": gates.term_counts_from(_c("owner"), "all"), "owner_only": gates.term_counts_from(_c("owner"), "owner")}


@stated("id, verdict, attribute", [(1, "rejected", "identity"), (2, "passes", "note"), (3, "passes", "identity"), (4, "passes", "identity"), (5, "passes", "likes"), (6, "rejected", "name")])
def relation_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "7", "identity", "主人的女朋友", ""), (2, "1", "identity", "老板", ""), (3, "bot_self", "identity", "主人的助手", ""), (4, "7", "identity", "学生", ""), (5, "7", "likes", "妈妈做的菜", ""), (6, "8", "name", "小王", "群主小王")]
    d = spark.createDataFrame(rows, "id int, speaker_id string, attribute string, value string, content string").withColumns({"plain": F.lit(""), "subject": F.lit("")})
    return review.guarded_relations(d, ["1"])


@pytest.mark.parametrize("name", list(CASES))
def test_every_branch(spark, name):
    run, want = CASES[name]
    same = lambda a, b: a == b or (isinstance(a, (int, float)) and isinstance(b, (int, float)) and math.isclose(a, b, abs_tol=1e-6))
    got = sorted((tuple(r) for r in run(spark).collect()), key=repr)
    want = sorted(want, key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(same(x, y) for x, y in zip(a, b)), (a, b)
