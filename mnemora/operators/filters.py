"""Filters on facts, episodes and messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_facts(facts: DataFrame, speakers: Sequence[str], limit: int) -> DataFrame:
    """Live facts of these speakers and of the owner, surest and newest first."""
    seen = F.col("speaker_id").isin(*speakers, "", "bot_self") | (F.col("scope") == "owner")
    return facts.where((F.col("status") == "live") & seen).orderBy(F.desc("confidence"), F.desc("updated_at"), "id").limit(limit)


def valid_between(facts: DataFrame, start: int, end: int) -> DataFrame:
    """Facts that held at some time in [start, end]: live ones, and closed ones that were not closed before."""
    closed = F.col("status").isin("superseded", "archived") & (F.col("updated_at") >= start)
    fresh = (F.col("expires_at") == 0) | (F.col("expires_at") >= start)
    return facts.where((F.col("created_at") <= end) & ((F.col("status") == "live") | closed) & fresh)


def contains_any(rows: DataFrame, word: str, columns: Sequence[str]) -> DataFrame:
    """Rows with the word in one of the columns, whatever its case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(word.lower()))
    return rows.where(hit)


def without_vector(rows: DataFrame, vector_col: str) -> DataFrame:
    return rows.where(F.col(vector_col).isNull() | (F.size(vector_col) == 0))


def overlapping(rows: DataFrame, start: int, end: int, start_col: str = "start_ts", end_col: str = "end_ts") -> DataFrame:
    return rows.where((F.col(end_col) >= start) & (F.col(start_col) <= end))
