"""A Spark session with the settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "coverlake", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution; the number of shuffle partitions is left to the cluster and to coalescing."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic", **conf
    }
    return builder.config(map=settings).getOrCreate()
