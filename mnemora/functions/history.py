"""Redaction of chat histories: images and finished tool calls become placeholders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE = r"data:image/[a-z.+-]+;base64,[A-Za-z0-9+/=]+"
PLACEHOLDER = "[image]"


def without_images(messages: Column) -> Column:
    """array<struct<role, content, ...>> with every inline image as a placeholder."""
    return F.transform(messages, lambda m: m.withField("content", F.regexp_replace(m["content"], IMAGE, PLACEHOLDER)))


def without_controls(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def without_finished_tools(messages: Column, finished: Column) -> Column:
    """Tool results at the positions (from 0) in `finished` shrink to a placeholder."""
    return F.transform(messages, lambda m, i: F.when((m["role"] == "tool") & F.array_contains(finished, i), m.withField("content", F.lit("[tool result]"))).otherwise(m))
