"""JSON lines: tagged export of tables, and a reader that tells rows apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Which field tells a row's table where there is no tag; the first that is present.
TELLING = (("facts", "attribute"), ("profiles", "seen_count"), ("aliases", "canonical"), ("events", "start_ts"), ("timeline", "content"))


def export_lines(tables: dict[str, DataFrame]) -> DataFrame:
    """One JSON object a row, tagged with its table: (value)."""
    lines = [d.select(F.to_json(F.struct(F.lit(name).alias("table"), *d.columns)).alias("value")) for name, d in tables.items()]
    return reduce(DataFrame.unionAll, lines)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, table, valid) of each line that is not blank; table by tag, else by the fields it has, else 'unknown'."""
    return classified(spark.read.text(path))


def classified(lines: DataFrame) -> DataFrame:
    """Lines that do not parse are not valid; their table is null."""
    d = lines.where(F.trim("value") != "").withColumn("_v", F.try_parse_json("value"))
    field = lambda name: F.variant_get("_v", f"$.{name}", "string")
    table = F.when(field("table").isNotNull(), field("table"))
    for name, mark in TELLING:
        table = table.when(field(mark).isNotNull(), name)
    valid = F.col("_v").isNotNull() & F.trim("value").startswith("{")
    return d.select("value", F.when(valid, table.otherwise("unknown")).alias("table"), valid.alias("valid"))


def preview(lines: DataFrame) -> DataFrame:
    """How many lines go to each table; (table, lines)."""
    return classified(lines).groupBy(F.coalesce("table", F.lit("error")).alias("table")).agg(F.count("*").alias("lines"))
