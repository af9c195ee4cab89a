"""Facts that speakers state about themselves, by patterns; one row of text may give many."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import clip

# The words of which self-statements are made.
SUBJECT, ADVERB, DEGREE = "(?:我|俺|咱|主人)", "(?:其实|平时|一般|通常|最近|现在|一直|以前|原来|真的|也|就|更|又|还)?", "(?:很|最|超|挺|特别|尤其|真的)?"
VERB, END, OPEN = "(?:听|喝|吃|看|玩)?", r"(?:[，。！!？?\s]|$)", r"(?<![^，。！!？?；;：:、 \n\t])"
LIKE_VERBS = "(迷上|入坑|上瘾|喜欢|爱喝|爱吃|爱看|爱玩|爱听|讨厌)"
LIST = r"[、,，]|(?<=.)(?:和|以及)(?=.)"
ITEM_VERBS, ITEM_PARTICLES = "^(听|喝|吃|看|玩)", "[了啦呢吧啊呀嘛哦喔诶欸]+$"
#: What an item of an enumeration does not hold: then the whole is one value.
NOT_AN_ITEM = "(喜欢|讨厌|不爱|受不了|不|没|别|我|你|您|他|她|它|俺|咱|因为|所以|但是|不过|而且|然后|如果|虽然|就是|已经|正在|每天|今天|明天|昨天|现在|最近|这周|今晚|很|太|挺|超|最)"
#: After a value that ended on a comma, the rest of the sentence.
REST = r"(?:(?<=[，,、])(?=([^。！!？?；;\n]*)))?"
CLOSED = "(做完了|完成了|已经寄了|已经办了|不用记了|算了当我没说|取消约定)"

#: A statement needs a subject, or must open a clause: others' likes are not the speaker's.
_WHO = f"(?:{SUBJECT}|{OPEN}){ADVERB}{DEGREE}"
PATTERNS = (
    ("likes", True, f"{_WHO}(?:不|没|不再)(?:太|怎么|是很)?喜欢{VERB}(.+?){END}"),
    ("likes", False, f"{_WHO}喜欢{VERB}(.+?){END}"),
    ("likes", False, f"{_WHO}(?:迷上|入坑|上瘾)了?{VERB}(.+?){END}"),
    ("likes", False, f"{_WHO}爱(?:听|喝|吃|看|玩)(.+?){END}"),
    ("likes", True, f"{_WHO}(?:不(?:太|怎么)?|没)(?:吃|喝|看|玩|碰)(.+?){END}"),
    ("dislikes", False, f"{_WHO}(?:讨厌|受不了)(.+?){END}"),
    ("name", False, f"{SUBJECT}叫(.+?){END}"),
    ("name", False, f"(?:请)?(?:叫我|称呼我)(.+?){END}"),
    ("identity", False, f"{SUBJECT}(?:是|住在|在)(.+?)(?:人|[，。！!？?\\s]|$)"),
    ("habit", False, f"{SUBJECT}(?:以后|从今以后)(?:不再|不)(.+?)了?{END}"),
    ("status", False, f"{SUBJECT}(?:这周|最近|今晚|今天|这几天)(?!.{{0,4}}{LIKE_VERBS})(.{{2,24}}?){END}"),
)


def stated(text: Column) -> Column:
    """array<struct<attribute, value>>: what a text states, enumerations split, negated likes with 不 before them.

    What follows a liked thing after a comma is liked too, if it could be an item of an enumeration.
    """
    parts = []
    for attribute, negated, pattern in PATTERNS:
        group = 2 if attribute == "status" else 1
        listed = attribute in ("likes", "dislikes")
        all_of = lambda n, p: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(n))
        found = F.transform(all_of(group, pattern), lambda v: clip(v, 40))
        if listed:
            rests = all_of(2, pattern + REST)
            found = F.flatten(F.zip_with(found, rests, lambda v, rest: F.array_union(_items(v), F.filter(F.array(_item(rest)), _is_item))))
        if negated:
            found = F.transform(found, lambda v: F.when(v.startswith("不"), v).otherwise(F.concat(F.lit("不"), v)))
        parts.append(F.transform(F.filter(found, lambda v: v != ""), _named(attribute)))
    return F.array_distinct(F.concat(*parts))


def _named(attribute: str) -> Callable[[Column], Column]:
    return lambda v: F.struct(F.lit(attribute).alias("attribute"), v.alias("value"))


def _item(raw: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(raw), ITEM_VERBS, ""), ITEM_PARTICLES, ""))


def _is_item(item: Column) -> Column:
    return (F.length(item) > 0) & (F.length(item) <= 12) & ~item.rlike(NOT_AN_ITEM)


def _items(value: Column) -> Column:
    """The items of an enumeration if all could be some, else the whole."""
    clean = F.transform(F.filter(F.split(value, LIST), lambda x: F.trim(x) != ""), _item)
    return F.when((F.size(clean) > 1) & F.forall(clean, _is_item) & (F.size(F.array_distinct(clean)) == F.size(clean)), clean).otherwise(F.array(value))


def statements(messages: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id, attribute, value, closes) of all messages that state something or close something."""
    d = messages.select(id_col, F.explode_outer(stated(F.col(text_col))).alias("_s"), F.coalesce(F.col(text_col), F.lit("")).rlike(CLOSED).alias("closes"))
    return d.where(F.col("_s").isNotNull() | F.col("closes")).select(id_col, "_s.attribute", "_s.value", "closes")
