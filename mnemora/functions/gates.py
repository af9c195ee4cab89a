"""Column predicates that decide on messages: routes, windows, candidates, replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text_or_empty

# The phrases by which messages are told apart.
LOW_INFO = r"(?i)^(哈+|啊+|嗯+|哦+|额+|好+|ok+|okay+|你好|在吗|早|晚安|谢谢|谢谢你)[\s!！。.~～]*$"
STATUS = "(在干嘛|在做什么|吃了没|吃晚饭|吃午饭|累不累|睡了吗|起床了|今天穿)"
TIME_WINDOW = "(昨天|前天|上周|上个月|最近一周|这周|那天|上次|刚才|刚刚|今天早|今晚)"
RECALL = "(还记得|你记得|记不记得|你不是说|你说过|我跟你说过|改口)"
HISTORY = "(以前|之前|原来|过去|当时|那时候|那时|从前|曾经|当年|那年|改口前|原来叫|以前叫)"
CORRECTION = "(不是|改口|纠正|以后叫|以后请|其实是|记错|说错|不要再说|别再记)"
JOKE = "(开玩笑|逗你|反话|随口|假装|骗你的|笑死|哈哈哈)"
HEARSAY = "(听说|别人说|他好像|她好像|可能是|大概是|不确定)"
FIRST_PERSON = "(我|俺|咱|本人|主人)"
RELATION = "(主人|owner|老公|老婆|男朋友|女朋友|男友|女友|未婚夫|未婚妻|爸爸|妈妈|父亲|母亲|儿子|女儿|哥哥|弟弟|姐姐|妹妹|老板|上司|领导|管理员|群主|admin)"
EPISODE_CUE = "(去了|到了|见了|见到|碰到|参加|出差|旅游|旅行|搬家|买房|买车|买了|辞职|入职|面试|考试|挂科|毕业|住院|看病|手术|结婚|订婚|分手|离婚|生了|怀孕|领养|养了|报名|预约|约好|答应|决定|打算|计划|完成|办完|搞定|签了|开了|开始学|放弃了|聚会|聚餐|出去玩|过生日|过年|回家|回老家|加班|改口|纠正|记错|说错)"
COMMAND = r"^[/／!！]"
QUESTION = ("？", "?", "吗", "怎么", "为什么", "为啥", "能不能", "可不可以", "是否", "啥", "多少", "几点", "谁", "哪里", "哪儿", "如何")
#: Of messages: whole short answers, marks that end a sentence, marks and words that go on.
ACK_WORDS = ("好", "好的", "好嘞", "好的好的", "收到", "收到收到", "明白", "知道了", "了解", "可以", "行", "嗯", "嗯嗯", "哦", "哦哦", "哈哈", "嘿嘿", "没问题", "OK", "ok", "Ok", "okok")
SENTENCE_END, GOES_ON = r"[。！？!?…~～.]$", "[，,、；;：:]$"
GOES_ON_WORDS = ("然后", "而且", "但是", "因为", "所以", "就是", "那个", "这个", "还有", "以及", "如果", "虽然", "不过", "并且", "要是", "感觉", "觉得", "帮我", "你看看")
WAITS = ("turn_not_open", "probability_miss", "keyword_miss", "no_keywords", "low_info", "memory_miss", "judge_below", "judge_unparsed", "mode_miss")
LOOK_BACK = ((r"(刚才|刚刚|今天早|今晚|今天)", 1), (r"昨天", 2), (r"前天", 3), (r"(这周|本周|最近)", 7), (r"(上周|上星期)", 14), (r"上个月", 40))
RANGE = r"(\d{4}\s*年|去年|前年|今年|本年|上个月|上月|这个月|本月|最近\s*\d+\s*(天|周|个?月|年)|(?<![\d年\-])(1[0-2]|0?[1-9])\s*月)"


def low_info(text: Column) -> Column:
    t = F.trim(text_or_empty(text))
    return (t == "") | t.rlike(LOW_INFO)


def route(query: Column) -> Column:
    """The first that fits: low_info, history, current_status, time_window, recall, long_term."""
    q = text_or_empty(query)
    history = q.rlike(HISTORY) | q.rlike(RANGE)
    return F.when(low_info(q), "low_info").when(history, "history").when(q.rlike(STATUS), "current_status").when(q.rlike(TIME_WINDOW), "time_window").when(q.rlike(RECALL), "recall").otherwise("long_term")


def look_back_days(query: Column) -> Column:
    """Days back that a phrase implies; 0: no limit."""
    out = F.when(F.lit(False), 0)
    for pattern, days in LOOK_BACK:
        out = out.when(text_or_empty(query).rlike(pattern), days)
    return out.otherwise(0)


def window_kind(tag: Column) -> Column:
    t = F.lower(text_or_empty(tag))
    return F.when(t.rlike("groupmessage|group_message|:group"), "group").when(t.rlike("friendmessage|friend_message|private"), "private").otherwise("unknown")


def direction_allowed(source: Column, target: Column, private_to_group: bool = False, group_to_group: bool = False) -> Column:
    """Whether what was said in one kind of window may be shown in another."""
    return F.when((source == "unknown") | (target == "unknown"), False).when(target == "private", True).when(source == "private", private_to_group).otherwise(group_to_group)


def text_usable(text: Column, least: int = 2) -> Column:
    """'' for a usable message, else why not: too_short, command, no_content."""
    t = F.trim(text_or_empty(text))
    return F.when(F.length(t) < least, "too_short").when(t.rlike(r"^[/／!！]"), "command").when(~t.rlike(r"[\p{L}\p{N}]"), "no_content").otherwise("")


def question_like(text: Column, markers: tuple[str, ...] = QUESTION) -> Column:
    """Whether a text holds one of the marks and words of questions."""
    t = F.trim(text_or_empty(text))
    return F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(t, m))


def in_targets(tag: Column, targets: list[str]) -> Column:
    """An empty list allows all windows; else the tag holds one of the targets."""
    if not targets:
        return F.lit(True)
    return F.exists(F.array(*map(F.lit, targets)), lambda t: F.contains(text_or_empty(tag), t) & (t != ""))


def quiet(ts: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether the minute of the day of a timestamp lies in a range; a range may go over midnight."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    out = F.lit(False)
    for a, b in ranges:
        out = out | (((minute >= a) & (minute < b)) if a < b else ((minute >= a) | (minute < b)))
    return out


def reply_gate(enabled: Column, is_group: Column, is_self: Column, tag: Column, targets: list[str], text: Column, quiet_now: Column, since_last: Column, today: Column, name_hit: Column, question: Column, cooldown: int = 90, daily: int = 30) -> Column:
    """Why a reply does not fire, the first that holds, or what makes it fire."""
    usable = text_usable(text)
    return (
        F.when(~enabled, "disabled").when(~is_group, "not_group").when(is_self, "self").when(~in_targets(tag, targets), "not_target")
        .when(usable != "", usable).when(quiet_now, "quiet").when(F.coalesce(since_last < cooldown, F.lit(False)), "cooldown").when(today >= daily, "daily_limit")
        .when(name_hit, "fire:name").when(question, "fire:question").otherwise("miss")
    )


def incomplete(text: Column, short: int = 12) -> Column:
    """Whether a message looks unfinished: short, without a final mark, and ending on a mark or word that goes on, or very short."""
    t = F.trim(text_or_empty(text))
    done = (t == "") | t.isin(*ACK_WORDS) | (F.length(t) > short) | t.rlike(SENTENCE_END)
    return F.when(done, False).when(t.rlike(GOES_ON) | t.rlike(f"(?:{'|'.join(GOES_ON_WORDS)})$"), True).otherwise(F.length(t) <= 6)


def held_back(text: Column, kind: Column, scope: str, image: Column, mentioned: Column, awake: Column, names: list[str], short: int = 12) -> Column:
    """Whether a message waits for more: in scope (both, group, private), plain text, to nobody's name, and unfinished."""
    t = F.trim(text_or_empty(text))
    away = ((kind == "private") & F.lit(scope == "group")) | ((kind != "private") & F.lit(scope == "private"))
    called = F.exists(F.array(*[F.lit(n.lower()) for n in names]), lambda n: F.contains(F.lower(t), n)) if names else F.lit(False)
    return ~away & (t != "") & ~t.rlike(COMMAND) & ~image & ~mentioned & ~awake & ~called & incomplete(text, short)


def term_counts_from(owner: Column, scope: str) -> Column:
    """Whether a speaker's words are counted as terms: everybody's, or the owner's alone."""
    return owner if scope in ("owner", "owner_only", "master") else F.lit(True)


def capture_reason(enabled: Column, capture: Column, yielded: Column, owner: Column, platform: Column, platforms: list[str], place: Column, allowed: list[str]) -> Column:
    """'' where a message is captured, else why not. platform: of the message, '' if unknown, which passes as do owners'.

    place: its window, speaker and group in one text; allowed: parts one of which it must hold, none for all.
    """
    known = platform.isin(*platforms, "") if platforms else F.lit(True)
    return F.when(~enabled, "disabled").when(~capture, "capture_off").when(yielded, "coexistence").when(~owner & ~known, F.concat(F.lit("platform:"), platform)).when(~in_targets(place, allowed), "whitelist").otherwise("")


def worth_waiting(reason: Column) -> Column:
    """Whether a message that got no reply may get one later: what it said was against it, not a rule."""
    return reason.isin(*WAITS)


def relation_claim(attribute: Column, speaker: Column, blob: Column) -> Column:
    """Whether a name or identity claims a relation that cannot be checked; the bot's own are defined, not claimed."""
    return (speaker != "bot_self") & attribute.isin("identity", "name") & text_or_empty(blob).rlike(RELATION)


def budget_reason(used: Column, hard: Column, soft: Column, urgent: Column, size: Column, cap: Column, fallback: Column) -> Column:
    """'' where a call may go as it is, else what holds it back or moves it to another provider; limits of 0 do not hold."""
    return F.when((hard > 0) & (used >= hard), "daily_token_limit").when((soft > 0) & (used >= soft) & ~urgent, "soft_token_limit").when((cap > 0) & (size > cap), F.when(fallback, "single_call_cap").otherwise("single_call_cap_no_fallback")).otherwise("")


def fact_block_reason(status: Column, expires: Column, persona: Column, scope: Column, speaker: Column, name: Column, *, as_of: Column, ask_persona: str, asker: list[str], owners: list[str], query: str, isolation: str = "shared", route_name: str = "long_term", attribute: Column | None = None, updated: Column | None = None, private_origin: Column | None = None, private_session: bool = False) -> Column:
    """'visible', or the first rule that hides a fact from the asker."""
    ids, q = [*asker, "bot_self", ""], query.lower()
    no = F.lit(False)
    strict = (private_origin if private_origin is not None else no) if isolation == "strict" else no
    stale = no
    if route_name == "current_status" and attribute is not None and updated is not None:
        stale = (as_of - updated > 2 * 86400) & ~attribute.isin("likes", "name", "identity")
    owner_only = (F.lit(isolation != "off" and bool(owners) and not set(owners) & set(asker))) & (scope == "owner")
    named = ((F.length(name) >= 2) & F.contains(F.lit(q), F.lower(name))) | ((F.length(speaker) >= 4) & F.contains(F.lit(q), F.lower(speaker)))
    other_persona = (persona != "") & (persona != F.lit(ask_persona)) if ask_persona else no
    return (
        F.when(status != "live", "not_live").when((expires > 0) & (expires < as_of), "expired").when(other_persona, "other_persona")
        .when(owner_only, "owner_private").when((scope != "owner") & strict & F.lit(not private_session), "private_origin")
        .when((scope != "owner") & strict & ~speaker.isin(*ids), "private_origin").when(scope == "owner", "visible")
        .when(speaker.isin(*ids), F.when(stale, "stale_for_status").otherwise("visible")).when(named, "visible").otherwise("other_speaker")
    )
