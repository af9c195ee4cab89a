"""Session settings that the engine's plans count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",  # month and day bounds are those of UTC
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "mnemora", **settings: str) -> SparkSession:
    """A session with SETTINGS; master and memory come from the caller or spark-submit."""
    return SparkSession.builder.appName(app).config(map=SETTINGS | settings).getOrCreate()
