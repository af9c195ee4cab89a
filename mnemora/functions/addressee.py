"""Whom a message is for: 'kind:id|name' tokens, comma between, as an array of structs and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text_or_empty


def encode(items: Column) -> Column:
    clean = lambda c: F.trim(F.translate(text_or_empty(c), "|,", "  "))
    return F.array_join(F.transform(items, lambda x: F.concat(F.coalesce(x["kind"], F.lit("at")), F.lit(":"), text_or_empty(x["id"]), F.lit("|"), clean(x["name"]))), ",")


def decode(raw: Column) -> Column:
    """array<struct<kind, id, name>>; tokens without a kind or an id go."""
    tokens = F.filter(F.transform(F.split(text_or_empty(raw), ","), lambda t: F.trim(t)), lambda t: t.rlike(r"^[^:]*:\s*[^|\s]"))
    part = lambda t, n: F.trim(F.regexp_extract(t, r"^([^:]*):([^|]*)\|?(.*)$", n))
    return F.transform(tokens, lambda t: F.struct(part(t, 1).alias("kind"), part(t, 2).alias("id"), part(t, 3).alias("name")))


def mentions(raw: Column, who: str) -> Column:
    return F.exists(decode(raw), lambda x: x["id"] == who) if who else F.lit(False)


def rendered(raw: Column, own_id: str = "", own_label: str = "你", everyone: str = "全体") -> Column:
    label = lambda x: F.when((x["id"] == own_id) & F.lit(own_id != ""), own_label).when(x["id"] == "all", everyone).otherwise(F.coalesce(F.nullif(x["name"], F.lit("")), x["id"]))
    return F.array_join(F.array_distinct(F.transform(decode(raw), label)), "、")


def turn_open(raw: Column, bot_id: str) -> Column:
    """Whether a message is for nobody but the bot or all."""
    return F.forall(decode(raw), lambda x: x["id"].isin(bot_id, "all"))
