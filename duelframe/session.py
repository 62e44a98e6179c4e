"""A session with the settings that the engine's plans are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution sizes and splits partitions; partitions of a scan stay small enough for Python workers.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "duelframe", master: str | None = None, **settings: str) -> SparkSession:
    """getOrCreate with SETTINGS and then settings (dots as in spark__sql__...); the master is left to spark-submit unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
