"""Paged operations tables, further audits, and snapshots kept as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import at, before, blank_to
from ..operators.relational import latest, top_k
from .ops import paged, rollup


def ingest_runs(runs: DataFrame, as_of: str, page: int = 1, size: int = 25) -> DataFrame:
    """Hourly rollups, most fetched first."""
    rows = rollup(runs).filter(F.col("bucket") <= at(as_of)).withColumn(
        "row_key", F.concat_ws("/", F.date_format("bucket", "yyyyMMddHH"), "runner", "outlet_id", "method")
    )
    return paged(rows, "fetched_count", True, "row_key", page, size)


def feed_status(runs: DataFrame, as_of: str, page: int = 1, size: int = 25) -> DataFrame:
    """Endpoints by how long ago they last published, longest first; those that never did count from their last fetch."""
    marks = runs.filter((F.col("ran_at") <= at(as_of)) & F.col("ok")).groupBy("outlet_id", "method").agg(
        F.max("newest_item_published_at").alias("last_publication_at"), F.max("ran_at").alias("last_fetched_at")
    )
    lag = (
        F.unix_seconds(at(as_of).cast("timestamp")) - F.unix_seconds(F.coalesce("last_publication_at", "last_fetched_at").cast("timestamp"))
    ) / 3600.0
    rows = marks.withColumn("lag_hours", F.round(lag, 3)).withColumn("row_key", F.concat_ws("/", "outlet_id", "method"))
    return paged(rows, "lag_hours", True, "row_key", page, size)


def benchmark_metrics(series: DataFrame, page: int = 1, size: int = 25) -> DataFrame:
    rows = series.withColumn("row_key", F.concat_ws("/", F.date_format("day_bucket", "yyyyMMdd"), "country"))
    return paged(rows, "published", True, "row_key", page, size).select(
        "row_key", "published", "inserted", "active_sources", "top1_bps", "total"
    )


def snapshot(rows: DataFrame, window: str, version: str, generated_at: str) -> DataFrame:
    """One row that holds a whole result as JSON, by country."""
    payload = F.to_json(F.array_sort(F.collect_list(F.struct("country", "published", "fresh", "active_sources"))))
    return rows.agg(payload.alias("payload"), F.count("*").alias("n")).select(
        F.lit(window).alias("metric_window"), F.lit(version).alias("metric_version"), at(generated_at).alias("generated_at"), "payload"
    )


def map_snapshots(snapshots: DataFrame) -> DataFrame:
    """The latest snapshot of each window and version, with numbers read from its payload."""
    newest = latest(snapshots, ["metric_window", "metric_version"], F.desc("generated_at"))
    rows = F.from_json("payload", "array<struct<country:string,published:long,fresh:long,active_sources:long>>")
    parsed = newest.withColumn("rows", rows)
    total = lambda name: F.aggregate("rows", F.lit(0).cast("long"), lambda acc, r: acc + r[name])
    return parsed.select(
        "metric_window", "metric_version", "generated_at", F.size("rows").cast("long").alias("row_count"),
        total("published").alias("published"), total("active_sources").alias("active_sources")
    )


def recent(articles: DataFrame, as_of: str, days: int) -> DataFrame:
    return articles.filter((F.col("publication_datetime") >= before(as_of, f"{days} days")) & (F.col("created_at") <= at(as_of)))


def topics_by_section(articles: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return recent(articles, as_of, days).groupBy(
        blank_to("primary_section", "others").alias("section"), blank_to("primary_topic").alias("topic")
    ).agg(F.count("*").alias("articles"))


def unassigned_categories(articles: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Feed categories of articles without a topic; articles without categories stay, as (empty)."""
    rows = recent(articles, as_of, days).filter(blank_to("primary_topic").isNull())
    each = rows.select(blank_to("primary_section", "others").alias("section"), F.explode_outer("feed_categories").alias("c"))
    return each.groupBy("section", blank_to("c", "(empty)").alias("category")).agg(F.count("*").alias("articles"))


def unassigned_sources(articles: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    rows = recent(articles, as_of, days).filter(blank_to("primary_topic").isNull())
    return rows.groupBy(
        blank_to("primary_section", "others").alias("section"), blank_to("source", "(unknown source)").alias("source")
    ).agg(F.count("*").alias("articles"))


def others_categories(articles: DataFrame, as_of: str, days: int = 30, k: int = 20) -> DataFrame:
    """Feed categories of unclassified articles, most articles first, with up to three of their sources."""
    each = recent(articles, as_of, days).filter(
        blank_to("primary_section", "others") == "others"
    ).select(
        "source", F.explode("feed_categories").alias("c")
    ).select("source", blank_to("c").alias("category")).filter("category is not null")
    by_source = each.groupBy("category", "source").agg(F.count("*").alias("n"))
    totals = by_source.groupBy("category").agg(F.sum("n").alias("articles"), F.count("*").alias("sources"))
    sample = top_k(by_source, ["category"], 3, F.desc("n"), F.asc("source")).groupBy("category").agg(
        F.expr("listagg(source, ', ') within group (order by rn)").alias("sample_sources")
    )
    return totals.join(sample, "category").orderBy(F.desc("articles"), F.asc("category")).limit(k)


def day_counts_by_source(articles: DataFrame) -> DataFrame:
    return articles.groupBy("source", F.to_date("created_at").alias("day")).agg(
        F.count("*").alias("articles"), F.countDistinct("country").alias("countries")
    )


def schedule(articles: DataFrame, runs: DataFrame, as_of: str) -> DataFrame:
    """Sources that articles come from but nothing checked in the last day, and the reverse."""
    wrote = articles.filter(
        (F.col("created_at") >= before(as_of, "1 days")) & (F.col("created_at") <= at(as_of))
    ).select("source").distinct()
    checked = runs.filter(
        F.col("attempted") & (F.col("ran_at") >= before(as_of, "1 days")) & (F.col("ran_at") <= at(as_of))
    ).select("source").distinct()
    return wrote.exceptAll(checked).withColumn("side", F.lit("unchecked")).unionByName(
        checked.exceptAll(wrote).withColumn("side", F.lit("silent"))
    )
