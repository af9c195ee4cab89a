"""Whether a query names what a fact or an episode is about, and whether it says it already."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .gates import question_like
from .text import normalize_slot, text_or_empty, tokens

# Words that are too common to name anything, how a model refuses, and what asks to be remembered.
COMMON = (
    "什么", "怎么", "这个", "那个", "可以", "没有", "觉得", "知道", "喜欢", "讨厌",
    "不要", "不是", "就是", "还是", "以及", "因为", "所以", "但是", "如果", "虽然",
    "今天", "明天", "昨天", "现在", "最近", "刚才", "一下", "一次", "一直", "很多",
    "非常", "特别", "感觉", "告诉", "认识", "记得", "想起", "听说", "看到", "这是",
    "那是", "哪个", "哪里", "为什么", "什么时候", "多少", "怎样", "还有", "或者",
)
REFUSAL = r"(?i)(无法协助|不能协助|无法提供|无法帮助|不方便提供|抱歉[，,\s]{0,3}我(不能|无法|不可以)|作为一个?(AI|人工智能|语言模型)|我(不能|无法|不会)(提供|回答|协助)|I can'?t (help|assist)|I cannot (help|assist|provide)|as an AI)"
REMEMBER = "(记住|记一下|记下来|别忘了|帮我记)"
DIRECTIVE = "(记住|记一下|记下来|别忘了|帮我记|我喜欢|我不喜欢|我讨厌|叫我|称呼我|我是|我住|改口|以后请|以后叫|主人喜欢|主人不喜欢|主人讨厌)"
NOT_ENTITIES = ("bot", "bot_self", "未知", "某人", "主人", "admin", "用户", "我", "你", "他", "她", "它", "我们", "你们", "他们")
#: Lengths of texts that are a term as a whole, and of entity names.
SHORT, ENTITY = (2, 15), (2, 20)


def match_terms(texts: Column) -> Column:
    """array<string>: of an array of texts the short ones whole, and all tokens of two characters or more, none common."""
    clean = F.filter(F.transform(texts, lambda t: F.trim(text_or_empty(t))), lambda t: t != "")
    whole = F.filter(clean, lambda t: F.length(t).between(*SHORT))
    words = F.filter(F.flatten(F.transform(clean, lambda t: tokens(t))), lambda t: F.length(t) >= 2)
    common = F.array(*map(F.lit, COMMON))
    return F.array_distinct(F.transform(F.filter(F.concat(whole, words), lambda t: ~F.array_contains(common, t)), F.lower))


def names(query: Column, texts: Column) -> Column:
    """Whether a query of two characters or more holds a term of the texts."""
    q = F.lower(F.trim(text_or_empty(query)))
    return (F.length(q) >= 2) & F.exists(match_terms(texts), lambda t: F.contains(q, t))


def says(query: Column, texts: Column) -> Column:
    """Whether a query holds one of the texts, both in normal form, of two characters or more."""
    q = normalize_slot(query)
    return F.exists(F.transform(texts, normalize_slot), lambda t: (F.length(t) >= 2) & F.contains(q, t))


def richer(content: Column, value: Column) -> Column:
    """Whether the content of a fact tells more than its value."""
    return F.length(F.trim(text_or_empty(content))) > F.length(F.trim(text_or_empty(value)))


def said_already(query: Column, texts: Column, content: Column, value: Column, pinned: Column) -> Column:
    """Whether a fact is no news to who asks: the query says it, unless it is pinned or the query asks for more of it."""
    return says(query, texts) & ~(question_like(query) & richer(content, value)) & ~pinned


def episode_is_news(query: Column, title: Column, summary: Column, pinned: Column, named: Column) -> Column:
    """Pinned and named episodes pass; of the others, those whose title the query does not say, or asks for more of."""
    return pinned | named | ~(says(query, F.array(title)) & ~(question_like(query) & richer(summary, title)))


def term_in_query(term: Column, query: Column) -> Column:
    """A term of Latin letters, digits and _ as a whole word in any case; any other as a part of the query."""
    t, q = F.trim(text_or_empty(term)), text_or_empty(query)
    word = F.rlike(q, F.concat(F.lit("(?i)(?<![A-Za-z0-9_])"), t, F.lit("(?![A-Za-z0-9_])")))
    return F.when((t == "") | (q == ""), False).when(t.rlike("^[A-Za-z0-9_]+$"), word).otherwise(F.contains(q, t))


def looks_refusal(text: Column) -> Column:
    return text_or_empty(text).rlike(REFUSAL)


def self_directive(text: Column, first_person: str) -> Column:
    """Whether the speaker asks that something of theirs be remembered."""
    t = F.trim(text_or_empty(text))
    return (t.rlike(REMEMBER) | t.rlike(DIRECTIVE)) & t.rlike(first_person)


def entity_name(raw: Column) -> Column:
    """The normal form of an entity's name; empty for numbers, pronouns, and names too short or too long."""
    n = normalize_slot(raw)
    return F.when(F.length(n).between(*ENTITY) & ~n.rlike(r"^\p{Nd}+$") & ~n.isin(*NOT_ENTITIES), n).otherwise("")


def fact_text(*parts: Column) -> Column:
    """The texts of a fact or an episode as one, for word search; arrays give their elements."""
    return F.concat_ws(" ", *parts)
