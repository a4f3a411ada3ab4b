"""Items by how late they come: against the time of ingest, so that nothing inside the limit is dropped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From how many hours an item is late, and from how many days it is not kept.
LATE_HOURS, OLD_DAYS = 24, 7


def lateness(published: Column, ingested: Column, late_hours: int = LATE_HOURS, old_days: int = OLD_DAYS) -> Column:
    """fresh, late, old, or undated."""
    return F.when(published.isNull(), "undated").when(published < ingested - F.make_dt_interval(F.lit(old_days)), "old").when(
        published < ingested - F.make_dt_interval(hours=F.lit(late_hours)), "late"
    ).otherwise("fresh")


def split(items: DataFrame, published: str = "publication_datetime", ingested: str = "created_at", **limits: int) -> DataFrame:
    return items.withColumn("lateness", lateness(F.col(published), F.col(ingested), **limits))


def by_day(items: DataFrame, published: str = "publication_datetime", ingested: str = "created_at") -> DataFrame:
    """Items of each day of ingest by lateness."""
    marked = split(items, published, ingested)
    return marked.groupBy(F.to_date(ingested).alias("day")).agg(
        *[F.count_if(F.col("lateness") == x).alias(x) for x in ("fresh", "late", "old", "undated")]
    )


def by_hour(items: DataFrame, published: str = "publication_datetime", ingested: str = "created_at") -> DataFrame:
    """The same by hour, of a stream: the watermark is on the time of ingest, which an item's age does not touch."""
    marked = split(items, published, ingested).withWatermark(ingested, f"{OLD_DAYS} days")
    sums = marked.groupBy(F.window(ingested, "1 hour").alias("w")).agg(
        *[F.count_if(F.col("lateness") == x).alias(x) for x in ("fresh", "late", "old", "undated")]
    )
    return sums.select(F.col("w.start").alias("hour"), "fresh", "late", "old", "undated")


def land(path: str, published: str = "publication_datetime", ingested: str = "created_at") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: items that are kept by lateness (``items/batch=N/lateness=...``), and how many of each there were,
    those not kept too (``counts/batch=N``). A batch that runs again writes the same."""

    def run(batch: DataFrame, number: int) -> None:
        marked = split(batch, published, ingested)
        marked.filter("lateness <> 'old'").write.mode("overwrite").partitionBy("lateness").parquet(f"{path}/items/batch={number}")
        marked.groupBy("lateness").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/counts/batch={number}")

    return run
