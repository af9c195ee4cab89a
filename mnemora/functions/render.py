"""Lines of text by which facts, episodes and their history are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _first(*columns: Column) -> Column:
    """The first text that is not empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def _who(scope: Column, name: Column, speaker: Column) -> Column:
    return F.when(scope == "owner", "主人").otherwise(F.coalesce(F.nullif(name, F.lit("")), F.nullif(speaker, F.lit("")), F.lit("某人")))


def fact_line(scope: Column, name: Column, speaker: Column, attribute: Column, plain: Column, content: Column, value: Column, topic: Column, policy: Column) -> Column:
    text = _first(plain, content, value)
    topic = F.when(topic != "", F.concat(F.lit("（"), topic, F.lit("）"))).otherwise("")
    note = F.when(policy == "uncertain", "（不确定）").when(policy == "tone", "（只调语气，勿复述细节）").otherwise("")
    return F.concat(F.lit("- ["), _who(scope, name, speaker), F.lit("/"), attribute, F.lit("] "), text, topic, note)


def episode_line(scope: Column, name: Column, speaker: Column, kind: Column, title: Column, summary: Column, start: Column, review: Column) -> Column:
    when = F.when(start > 0, F.date_format(F.timestamp_seconds(start), "yyyy-MM-dd")).otherwise("时间未知")
    verb = F.when(kind == "talk", "聊过").otherwise("讲过")
    note = F.when(review == "needs_review", "（不确定）").otherwise("")
    return F.concat(F.lit("- ["), when, F.lit(" · "), title, F.lit("] "), _first(summary, title), F.lit("（"), _who(scope, name, speaker), verb, F.lit("）"), note)


def history_line(scope: Column, name: Column, speaker: Column, text: Column, created: Column, closed: Column, current: Column) -> Column:
    stamp = lambda c: F.date_format(F.timestamp_seconds(c), "MM-dd HH:mm")
    span = F.when(created > 0, F.concat(stamp(created), F.lit("~"), stamp(closed))).otherwise("时间未知")
    now = F.when(current != "", F.concat(F.lit("（现在："), current, F.lit("）"))).otherwise("")
    return F.concat(F.lit("- ["), span, F.lit("] "), _who(scope, name, speaker), F.lit("："), text, now)


def review_score(kind: Column, term: Column, meaning: Column, user: Column, bot: Column, draft: Column) -> Column:
    """0 to 100: how much a learned term, a sample exchange or a style draft is worth a look."""
    n = lambda c: F.length(F.coalesce(c, F.lit("")))
    generic = F.coalesce(meaning, F.lit("")).rlike("(表示认同|常用语气|口头禅|语气词|没有特殊含义|普通词|感叹词)")
    junk = (n(term) < 2) | F.coalesce(term, F.lit("")).rlike(r"^\d+$|https?://|www\.|^[A-Za-z]{1,2}$")
    command = lambda c: (F.trim(F.coalesce(c, F.lit(""))) == "") | c.rlike(r"^[/／!]|tool_call|function_call|Traceback|Error:")
    jargon = 50 + 15 * ((n(term) >= 2) & (n(term) <= 8)).cast("int") + 20 * ((n(meaning) > 0) & ~generic).cast("int") - 40 * junk.cast("int")
    sample = 40 + F.least(F.lit(20), F.floor(n(user) / 4)) + F.least(F.lit(20), F.floor(n(bot) / 6)) - 40 * (command(user) | command(bot)).cast("int")
    style = 55 + F.least(F.lit(20), F.floor(n(draft) / 4)) - 50 * F.coalesce(draft, F.lit("")).rlike("(你是|你叫|你住|你的名字|你今年|你的身份|设定你)").cast("int")
    raw = F.when(kind == "jargon", jargon).when(kind == "fewshot", sample).when(kind == "persona", style).otherwise(50)
    return F.greatest(F.lit(0), F.least(F.lit(100), raw)).cast("int")
