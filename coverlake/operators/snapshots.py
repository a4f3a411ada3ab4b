"""Snapshots of whole results as Variant, kept by window and version: writing one replaces the last, readers take the newest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .relational import latest


def snapshot(rows: DataFrame, window: str, version: str, generated_at: Column, order: list[str]) -> DataFrame:
    """One row: the result (bounded, as what is shown on one page is) as a list of objects in the given order."""
    values = F.transform(
        F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], F.struct(*rows.columns).alias("_row")))), lambda r: r["_row"]
    )
    whole = rows.agg(F.to_variant_object(values).alias("payload"))
    return whole.select(
        F.lit(window).alias("metric_window"), F.lit(version).alias("metric_version"), generated_at.alias("generated_at"), "payload"
    )


def write(snapshots: DataFrame, path: str) -> None:
    """Put snapshots in place of those of the same window and version. Staged first: a reader sees the old or the new one."""
    snapshots.write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("metric_window", "metric_version").parquet(path)


def read(spark: SparkSession, path: str, window: str | None = None, version: str | None = None) -> DataFrame:
    """The newest snapshot of each window and version, or of those asked for."""
    rows = spark.read.parquet(path)
    for name, value in (("metric_window", window), ("metric_version", version)):
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    return latest(
        rows.withColumn("metric_version", F.col("metric_version").cast("string")), ["metric_window", "metric_version"],
        F.desc("generated_at")
    )


def entries(snapshots: DataFrame, fields: dict[str, str]) -> DataFrame:
    """The objects of each payload as rows: place, and fields by name and type. Payloads that are no list have none."""
    values = F.coalesce(F.try_variant_get("payload", "$", "array<variant>"), F.array().cast("array<variant>"))
    each = snapshots.select("metric_window", "metric_version", "generated_at", F.posexplode(values).alias("place", "_v"))
    return each.select(
        "metric_window", "metric_version", "generated_at", "place",
        *[F.try_variant_get("_v", f"$.{name}", kind).alias(name) for name, kind in fields.items()]
    )
