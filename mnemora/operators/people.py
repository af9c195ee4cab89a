"""Members of groups: who is meant, whose birthday comes, who may be told what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upcoming_birthdays(members: DataFrame, today: Column, days: int, month: str = "month", day: str = "day") -> DataFrame:
    """members with days_until of their next birthday, where it is in at most `days` days; no real date: left out."""
    on = lambda year: F.expr(f"try_to_date(concat_ws('-', {{}}, lpad({month}, 2, '0'), lpad({day}, 2, '0')), 'yyyy-MM-dd')".replace("{}", year))
    d = members.withColumn("_today", today)
    until = [F.datediff(on("year(_today)"), F.col("_today")), F.datediff(on("year(_today) + 1"), F.col("_today"))]
    nearest = F.least(*[F.when(u >= 0, u) for u in until])
    return d.withColumn("days_until", nearest).where(F.col("days_until") <= days).drop("_today")


def resolved_members(asked: DataFrame, members: DataFrame, text: str = "asked", id_col: str = "member_id", names: tuple[str, ...] = ("name",)) -> DataFrame:
    """(asked, member_id, tier, ambiguous): id, then whole name, then part of a name; all of the best tier.

    The texts that are asked for are compared with all names, as parts of names have no key: Spark sends the smaller side.
    """
    a = asked.select(text).distinct().withColumn("_a", F.lower(F.trim(text)))
    whole, part = F.lit(False), F.lit(False)
    for n in names:
        low = F.lower(F.coalesce(F.col(n), F.lit("")))
        whole, part = whole | (low == F.col("_a")), part | F.contains(low, F.col("_a"))
    tier = F.when(F.col(id_col).cast("string") == F.col("_a"), 0).when(whole, 1).when(part, 2)
    met = members.join(a, (F.col("_a") != "") & tier.isNotNull())
    best = met.withColumn("tier", tier).withColumn("_best", F.min("tier").over(Window.partitionBy(text))).where("tier = _best")
    return best.withColumn("ambiguous", F.count("*").over(Window.partitionBy(text)) > 1).select(text, id_col, "tier", "ambiguous")


def same_name_suggestions(seen: DataFrame, aliases: DataFrame, limit: int = 20) -> DataFrame:
    """(name, speaker_id, n, rank): speakers who share a name, the most seen first, without known aliases."""
    n = seen.where("speaker_name != ''").groupBy("speaker_name", "speaker_id").agg(F.count("*").alias("n"))
    n = n.join(aliases.select(F.col("alias").alias("speaker_id")), "speaker_id", "left_anti")
    w = Window.partitionBy("speaker_name")
    many = n.withColumn("_ids", F.count("*").over(w)).where("_ids > 1").drop("_ids")
    rank = F.row_number().over(w.orderBy(F.desc("n"), "speaker_id"))
    return many.withColumn("rank", rank).orderBy(F.desc("n"), "speaker_name", "speaker_id").limit(limit)


#: How someone is told to speak elsewhere.
TELL = (
    ("index", r"^(?:帮我|麻烦)?\s*去\s*第?\s*(\d{1,2})\s*个?群(?:里)?说\s*[:：,，]?\s*(.+)$"),
    ("number", r"^(?:帮我|麻烦)?\s*去\s*(\d{4,})\s*群(?:里)?说\s*[:：,，]?\s*(.+)$"),
    ("default", r"^(?:帮我|麻烦)?\s*()(?:去群里说|去群说|在群里说|群里说|跟群友说|和群友说|给大家说)\s*[:：,，]?\s*(.+)$"),
)


def speak_intent(text: Column) -> Column:
    """struct<target, value, content> of a request to speak in a group; null for other texts."""
    t, out = F.trim(F.coalesce(text, F.lit(""))), F.when(F.lit(False), F.struct(F.lit("").alias("target"), F.lit("").alias("value"), F.lit("").alias("content")))
    for kind, pattern in TELL:
        content = F.trim(F.regexp_extract(t, pattern, 2))
        out = out.when(content != "", F.struct(F.lit(kind).alias("target"), F.regexp_extract(t, pattern, 1).alias("value"), content.alias("content")))
    return out


def settings_diff(current: DataFrame, target: DataFrame) -> DataFrame:
    """(key, old, new, change) of two tables (key, value): added, removed, changed."""
    a, b = current.select("key", F.col("value").alias("old")), target.select("key", F.col("value").alias("new"))
    d = a.join(b, "key", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return d.withColumn("change", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed"))


def effective_settings(defaults: DataFrame, raw: DataFrame, preset: DataFrame) -> DataFrame:
    """(key, value): the preset's where it has the key, else the user's, else the default."""
    own = lambda d, name: d.select("key", F.col("value").alias(name))
    d = own(defaults, "_d").join(own(raw, "_r"), "key", "full_outer").join(own(preset, "_p"), "key", "full_outer")
    return d.select("key", F.coalesce("_p", "_r", "_d").alias("value"))


def coerced(raw: Column, kind: Column) -> Column:
    """A setting's text in the usual form of its kind: bool, int, float, else text; null where it is none."""
    t = F.trim(F.coalesce(raw, F.lit("")))
    flag = F.when(F.lower(t).isin("1", "true", "yes", "on"), "true").when(F.lower(t).isin("0", "false", "no", "off", ""), "false")
    number = t.try_cast("double")
    return F.when(kind == "bool", flag).when(kind == "int", number.cast("long").cast("string")).when(kind == "float", number.cast("string")).otherwise(t)


def group_roles(members: DataFrame, key: str) -> DataFrame:
    """(key, owner, admins): the first owner of each group and all its admins, in order. members: key, member, role."""
    named = members.groupBy(key).agg(F.min(F.when(F.col("role") == "owner", F.col("member"))).alias("owner"), F.array_sort(F.collect_list(F.when(F.col("role") == "admin", F.col("member")))).alias("admins"))
    return named
