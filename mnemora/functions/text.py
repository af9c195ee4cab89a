"""Column functions on text: normal forms, keys, tokens, sizes. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The punctuation that slots ignore, the words that a topic loses, the cues of each domain.
SLOT_NOISE = "[\\s　,，.。!！?？、~～'\"“”‘’]+"
TOPIC_LEADING = ("从今以后", "不再", "其实", "现在", "以后", "本人", "喜欢", "讨厌", "受不了", "我", "俺", "咱", "不", "没", "别", "非")
TOPIC_VERBS = "听喝吃看玩"
TOPIC_PARTICLES = "了啦呢吧啊呀嘛哦喔噢咯诶欸"
TOPIC_ATTRIBUTES = ("likes", "dislikes", "promise", "habit")
DOMAIN_CUES = {
    "饮品": ("喝", "咖啡", "奶茶", "拿铁", "饮料", "可乐", "果汁", "酒", "茶"),
    "食物": ("吃", "火锅", "披萨", "零食", "外卖", "甜食", "辣", "菜"),
    "穿搭": ("穿", "穿搭", "衣服", "外套", "裤", "裙", "鞋", "帽", "风格", "版型", "搭配", "配色", "日系", "复古"),
    "娱乐": ("玩", "游戏", "电影", "剧", "歌", "音乐", "小说", "动漫", "综艺"),
    "运动": ("运动", "跑步", "健身", "游泳", "骑行", "篮球", "足球", "网球", "羽毛球", "乒乓球", "排球", "滑板", "滑雪"),
}
DOMAIN_ALIASES = {
    "饮品": ("饮料", "喝的", "饮品", "咖啡", "茶"),
    "食物": ("吃的", "食物", "美食"),
    "穿搭": ("服饰", "衣着", "服装", "穿衣", "穿搭", "风格"),
    "娱乐": ("玩的", "游戏", "娱乐"),
    "运动": ("体育", "运动", "健身"),
}
CJK = "一-鿿"
#: Scripts that count one token a character.
WIDE = "぀-ヿ一-鿿가-힯"
PLATFORMS = {"qq_official_webhook": "qq_official", "qq_official_websocket": "qq_official"}


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalize_slot(c: Column) -> Column:
    """Trimmed and lower-cased, without white space, sentence marks and quotes."""
    return F.regexp_replace(F.lower(F.trim(text_or_empty(c))), SLOT_NOISE, "")


def topic_key(c: Column) -> Column:
    """What a preference is about: no leading subject or negation, no verbs, no final particles; 24 characters."""
    leading = "^(?:" + "|".join(sorted(TOPIC_LEADING, key=len, reverse=True)) + ")+"
    text = F.regexp_replace(normalize_slot(c), leading, "")
    text = F.regexp_replace(text, f"[{TOPIC_VERBS}]", "")
    return F.substring(F.regexp_replace(text, f"[{TOPIC_PARTICLES}]+$", ""), 1, 24)


def slot_key(persona: Column, speaker: Column, subject: Column, attribute: Column, value: Column) -> Column:
    """persona|speaker|subject|attribute, and |topic for attributes of which a speaker may have many."""
    base = F.concat_ws("|", text_or_empty(persona), text_or_empty(speaker), normalize_slot(subject), attribute)
    topic = topic_key(value)
    return F.when(attribute.isin(*TOPIC_ATTRIBUTES) & (topic != ""), F.concat(base, F.lit("|"), topic)).otherwise(base)


def fingerprint(*parts: Column) -> Column:
    """24 hexadecimal digits of the SHA-256 of the trimmed, lower-cased parts."""
    joined = F.concat_ws("||", *[F.lower(F.trim(text_or_empty(p.cast("string")))) for p in parts])
    return F.substring(F.sha2(joined, 256), 1, 24)


def clip(c: Column, limit: int) -> Column:
    """At most `limit` characters of the trimmed text, the last an ellipsis where it was cut; 0: all."""
    text = F.trim(text_or_empty(c))
    if limit <= 0:
        return text
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, max(0, limit - 1)), F.lit("…"))).otherwise(text)


def tokens(c: Column, longest: int = 32) -> Column:
    """Ideographs one by one, other runs of letters and digits whole; lower case, at most `longest` characters."""
    found = F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(f"[{CJK}]|[[\\p{{L}}\\p{{N}}]&&[^{CJK}]]+"), F.lit(0))
    return F.filter(found, lambda t: F.length(t) <= longest)


def terms(c: Column) -> Column:
    """Candidates for group slang: runs of 2 to 16 Latin letters or of 2 to 8 ideographs."""
    return F.regexp_extract_all(text_or_empty(c), F.lit(f"[A-Za-z]{{2,16}}|[{CJK}]{{2,8}}"), F.lit(0))


def token_estimate(c: Column) -> Column:
    """One for each character of a wide script, one for every four others, rounded up."""
    text = text_or_empty(c)
    wide = F.length(F.regexp_replace(text, f"[^{WIDE}]", ""))
    return wide + F.floor((F.length(text) - wide + 3) / 4).cast("int")


def csv_items(c: Column) -> Column:
    return F.filter(F.transform(F.split(text_or_empty(c), "[,\n]"), lambda x: F.trim(x)), lambda x: x != "")


def platform_of(window: Column) -> Column:
    """The platform before the first colon of a window tag, under its usual name."""
    name = F.lower(F.trim(F.split_part(text_or_empty(window), F.lit(":"), F.lit(1))))
    known = F.create_map(*[F.lit(x) for kv in PLATFORMS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, name), name)


def window_label(window: Column) -> Column:
    """The last number in a window tag."""
    return F.regexp_extract(text_or_empty(window), r"(\d+)\D*$", 1)


def detect_domain(content: Column, value: Column) -> Column:
    """The domain with the most cues in the text; none where two lead."""
    blob = F.trim(F.concat(normalize_slot(content), F.lit(" "), normalize_slot(value)))
    votes = lambda text: F.array(*[F.struct(sum((F.contains(text, F.lit(c)).cast("int") for c in cues), F.lit(0)).alias("n"), F.lit(name).alias("name")) for name, cues in DOMAIN_CUES.items()])
    leader = lambda v, top: let(F.filter(v, lambda x: x["n"] == top), lambda first: F.when((top > 0) & (F.size(first) == 1), first[0]["name"]).otherwise(""))
    return let(blob, lambda text: let(votes(text), lambda v: let(F.array_max(F.transform(v, lambda x: x["n"])), lambda top: leader(v, top))))


def normalize_domain(raw: Column) -> Column:
    """The domain whose names a text has; none where it has those of several."""
    text = normalize_slot(raw)
    named = F.array(*[F.when(text.rlike("|".join(names)), F.lit(domain)) for domain, names in DOMAIN_ALIASES.items()])
    known = F.filter(named, lambda x: x.isNotNull())
    return F.when(F.size(known) == 1, known[0]).otherwise("")


def values_conflict(old: Column, new: Column) -> Column:
    """Whether two values of one slot exclude each other: unlike polarity, or neither within the other."""
    a, b = normalize_slot(old), normalize_slot(new)
    negated = lambda x: x.rlike("^[不没别非]")
    same = (a == "") | (b == "") | (a == b)
    return F.when(same, False).when(negated(a) != negated(b), True).otherwise(~(F.contains(a, b) | F.contains(b, a)))


def keyword_score(query_terms: list[str], text: Column) -> Column:
    """The share of the query's terms that occur in the text."""
    if not query_terms:
        return F.lit(0.0)
    low = F.lower(text_or_empty(text))
    return reduce(lambda a, b: a + b, [F.contains(low, F.lit(t)).cast("double") for t in query_terms]) / len(query_terms)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements of two arrays; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def char_overlap(a: Column, b: Column) -> Column:
    """The share of a's distinct characters that b has."""
    x = F.filter(F.array_distinct(F.split(text_or_empty(a), "")), lambda c: c != "")
    y = F.split(text_or_empty(b), "")
    return F.when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.size(x)).otherwise(0.0)


def merged(fragments: Column, most: int = 600) -> Column:
    """Fragments of one message in order, with a space where two Latin letters or digits would touch."""
    edge = "[A-Za-z0-9]"

    def add(done: Column, piece: Column) -> Column:
        touch = done.rlike(f"{edge}$") & piece.rlike(f"^{edge}")
        return F.when(piece == "", done).when(touch, F.concat(done, F.lit(" "), piece)).otherwise(F.concat(done, piece))

    text = F.aggregate(F.transform(fragments, lambda x: F.trim(text_or_empty(x))), F.lit(""), add)
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)
