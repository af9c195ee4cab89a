"""Canonical attributes and subjects of facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import TOPIC_PARTICLES, detect_domain, let, normalize_domain, normalize_slot, text_or_empty

# The names by which attributes and subjects go.
ATTRIBUTES = {
    "likes": ("likes", "like", "love", "喜欢", "爱好", "口味", "偏好", "喜好", "爱喝", "爱吃"),
    "dislikes": ("dislikes", "dislike", "讨厌", "受不了"),
    "name": ("name", "称呼", "名字", "昵称", "小名"),
    "identity": ("identity", "身份", "职业"),
    "habit": ("habit", "习惯"),
    "promise": ("promise", "约定", "承诺"),
    "note": ("note", "correction", "纠正"),
    "status": ("status", "状态"),
    "schedule": ("schedule", "日程"),
}
SELF = ("用户", "user", "self", "我", "俺", "咱", "本人", "说话人", "当前用户", "主人")
BOT = ("bot", "机器人", "助手", "你")
NEGATED, NOT_LIKED = "(不喜欢|没喜欢|不再喜欢)", "不喜欢"
LIKED_THING = r"(?:不再喜欢|不喜欢|没喜欢|喜欢|讨厌|受不了)(?:听|喝|吃|看|玩)?(.+?)(?:[，。！!？?\s]|$)"
KINDS = {"likes": "preference", "dislikes": "preference", "name": "identity", "identity": "identity", "habit": "habit", "promise": "promise", "status": "status", "note": "note"}


def canonical_attribute(raw: Column) -> Column:
    """The usual name: of the whole, of the whole without - and _, of the first alias within it or around it; else itself."""
    aliases = [(a, name) for name, found in ATTRIBUTES.items() for a in found]
    known = F.create_map(*[F.lit(x) for kv in aliases for x in kv])
    named = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(n).alias("n")) for a, n in aliases])

    def find(text: Column) -> Column:
        part = F.filter(named, lambda x: F.contains(text, x["a"]) | F.contains(x["a"], text))
        compact = normalize_slot(F.translate(text, "_-", ""))
        found = let(normalize_slot(text), lambda key: F.coalesce(F.try_element_at(known, key), F.try_element_at(known, compact), F.get(part, F.lit(0))["n"], F.nullif(key, F.lit("")), F.lit("note")))
        return F.when(text == "", "note").otherwise(found)

    return let(F.trim(text_or_empty(raw)), find)


def applied(attribute: Column, value: Column, content: Column, plain: Column, topic: Column, subject: Column, speaker: Column, name: Column) -> Column:
    """struct<attribute, value, subject, kind, topic>: a claim in its usual slot.

    What is not liked is a like of its opposite: 不 before the thing, which is found after the verb and loses final
    particles. Likes and dislikes have a domain: the one given, else that of the claim's own words.
    """
    said, v = text_or_empty(content), text_or_empty(value)
    near = F.rlike(said, F.concat(F.lit(f"{NOT_LIKED}[^，。！!？?]{{0,6}}\\Q"), v, F.lit("\\E")))
    whole = F.when(v != "", v).otherwise(said)
    thing = F.regexp_replace(F.coalesce(F.nullif(F.trim(F.regexp_extract(whole, LIKED_THING, 1)), F.lit("")), whole), f"[{TOPIC_PARTICLES}]+$", "")
    opposite = let(thing, lambda t: F.when(t == "", v).when(t.startswith("不"), t).otherwise(F.concat(F.lit("不"), t)))
    clue = F.when(F.trim(text_or_empty(plain)) != "", F.trim(plain)).otherwise(said)
    domain = let(normalize_domain(topic), lambda given: F.when(given != "", given).otherwise(detect_domain(clue, v)))

    def slot(attr: Column) -> Column:
        negated = v.rlike(NEGATED) | (attr.isin("dislikes", "note") & said.rlike(NEGATED)) | ((attr == "likes") & (v != "") & ~v.startswith("不") & near)
        fold = negated & attr.isin("likes", "dislikes", "note")
        return F.struct(F.when(fold, "likes").otherwise(attr).alias("attribute"), F.when(fold, opposite).otherwise(v).alias("value"))

    own = lambda s: F.struct(s["attribute"].alias("attribute"), s["value"].alias("value"), canonical_subject(subject, speaker, name).alias("subject"), fact_kind(s["attribute"]).alias("kind"), F.when(s["attribute"].isin("likes", "dislikes"), domain).otherwise("").alias("topic"))
    return let(let(canonical_attribute(attribute), slot), own)


def canonical_subject(raw: Column, speaker: Column, name: Column) -> Column:
    """bot, self, or the first 40 characters of another."""
    text, key = F.trim(text_or_empty(raw)), normalize_slot(raw)
    is_ = lambda c: (F.trim(text_or_empty(c)) != "") & ((text == F.trim(text_or_empty(c))) | (key == normalize_slot(c)))
    return F.when(key.isin(*BOT), "bot").when((text == "") | key.isin(*SELF) | is_(speaker) | is_(name), "self").otherwise(F.substring(text, 1, 40))


def fact_kind(attribute: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, canonical_attribute(attribute)), F.lit("note"))
