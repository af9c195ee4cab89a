"""What is shown of a person: profile cards and context packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions.text import clip

from .windows import packed


def profile_card(facts: DataFrame, query: str, as_of: int, each: int = 3, chars: int = 24) -> DataFrame:
    """(speaker_id, attribute, position, value): distinct values of each attribute, those that the query names first.

    Named values have one place more. Values come from value, else plain, else content; expired states go.
    """
    q = query.strip().lower()
    value = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ("value", "plain", "content")])
    low = F.lower(F.coalesce("value", F.lit("")))
    named = (low != "") & (F.contains(F.lit(q), low) | F.contains(low, F.lit(q))) if len(q) >= 2 else F.lit(False)
    fresh = (F.col("attribute") != "status") | (F.col("expires_at") == 0) | (F.col("expires_at") >= as_of)
    d = facts.where(fresh).withColumn("value", clip(value, chars)).where("value != ''").withColumn("_named", named)
    d = d.groupBy("speaker_id", "attribute", "value").agg(F.max("_named").alias("_named"), F.max("updated_at").alias("_at"))
    w = Window.partitionBy("speaker_id", "attribute").orderBy(F.desc("_named"), F.desc("_at"), "value")
    d = d.withColumn("position", F.row_number().over(w))
    return d.where(F.col("position") <= F.when(F.col("_named"), each + 1).otherwise(each)).select("speaker_id", "attribute", "position", "value")


def context_pack(blocks: DataFrame, key: str, budget: int) -> DataFrame:
    """(key, pack) from (key, fill, place, title, lines): blocks take their share of the budget in the order of fill.

    Lines that do not fit are skipped; what is kept is shown in the order of place, so that stable blocks come first.
    """
    one = F.struct("fill", "place", "title", "lines")
    d = blocks.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("_blocks"))

    def add(done, block):
        fits = packed(F.concat(F.array(block["title"]), block["lines"]), budget - done["used"])
        text = F.array_join(fits, "\n")
        some = F.size(fits) > 1
        more = F.struct(F.array_append(done["kept"], F.struct(block["place"].alias("place"), text.alias("text"))).alias("kept"), (done["used"] + F.length(text) + 1).alias("used"))
        return F.when(some, more).otherwise(done)

    start = F.struct(F.array().cast("array<struct<place:int,text:string>>").alias("kept"), F.lit(0).alias("used"))
    kept = F.array_sort(F.aggregate("_blocks", start, add)["kept"])
    return d.select(key, F.array_join(F.transform(kept, lambda x: x["text"]), "\n").alias("pack"))
