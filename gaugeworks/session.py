"""Session settings that the operators assume; a cluster's own settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
    # heaps of the top N are small: a task may hold many groups before its aggregate falls back to sorting (Spark's default is 128)
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "50000",
}


def session(name: str = "gaugeworks", **settings: str) -> SparkSession:
    """A session with DEFAULTS, overridden by settings (dots written as __)."""
    builder = SparkSession.builder.appName(name)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
