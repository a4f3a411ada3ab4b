"""Coverage map: source metrics by window, health, countries, publishers and source details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import at, before, blank_to, health, health_rank, source_key, visible
from ..operators.relational import latest, top_k

WINDOWS = {"1h": "1 hour", "24h": "24 hours", "7d": "7 days"}


def _counters(name: str, as_of: str) -> list[Column]:
    since = before(as_of, WINDOWS[name])
    pub, seen = F.col("publication_datetime") >= since, F.col("created_at") >= since
    return [
        F.count_if(pub).alias(f"pub_{name}"), F.count_if(pub & seen).alias(f"fresh_{name}"),
        F.count_if(seen & (F.col("publication_datetime") < since)).alias(f"late_{name}"), F.count_if(seen).alias(f"first_seen_{name}")
    ]


def source_metrics(articles: DataFrame, as_of: str, window: str = "7d") -> DataFrame:
    """Counters of every window up to the chosen one; those beyond it are 0. Either clock puts a row into the scan.

    Windows have a lower bound only, so rows dated in the future count; rows seen after as_of do not exist yet.
    """
    since = before(as_of, WINDOWS[window])
    rows = articles.filter(
        visible() & (F.col("created_at") <= at(as_of)) & ((F.col("publication_datetime") >= since) | (F.col("created_at") >= since))
    )
    names = list(WINDOWS)
    counted = [c for n in names[: names.index(window) + 1] for c in _counters(n, as_of)] if window == "7d" else _counters(window, as_of)
    keys = [
        blank_to("source_country").alias("source_country"), blank_to("country").alias("article_country"),
        F.coalesce(blank_to("source_country"), blank_to("country")).alias("country"), F.col("source")
    ]
    out = rows.groupBy(*keys).agg(*counted)
    return out.withColumns(
        {f"{m}_{n}": F.lit(0).cast("long") for n in names for m in ("pub", "fresh", "late", "first_seen") if f"{m}_{n}" not in out.columns}
    )


def latest_health(runs: DataFrame, as_of: str) -> DataFrame:
    """Newest attempt of each (source, method), then the best status of each source."""
    past = runs.filter(F.col("ran_at") <= at(as_of))
    newest = latest(past, ["source", "method"], F.desc("ran_at"), F.desc("id")).select(
        "source", "method", "ok", "health_classification", "ran_at"
    )
    window = past.filter(F.col("ran_at") >= before(as_of, "24 hours")).groupBy("source", "method").agg(
        F.count_if("attempted").alias("attempts_24h"), F.count_if(F.col("attempted") & ~F.col("ok")).alias("failures_24h")
    )
    rows = newest.join(window, ["source", "method"], "left").na.fill(0, ["attempts_24h", "failures_24h"]).withColumn(
        "status", health(F.coalesce("health_classification", F.lit("")))
    )
    best = latest(
        rows.withColumn("source_key", source_key("source")), ["source_key"], health_rank(F.col("status")), F.asc("source"), F.asc("method")
    )
    return best.select("source_key", "source", "method", "status", "ok", "ran_at", "attempts_24h", "failures_24h")


def hourly_counts(articles: DataFrame, as_of: str, key: str = "source_country", hours: int = 24) -> DataFrame:
    rows = articles.filter(
        visible() & (F.col("publication_datetime") >= before(as_of, f"{hours} hours")) & (F.col("publication_datetime") <= at(as_of))
    )
    return rows.groupBy(
        blank_to(key, "Global").alias("member"), F.date_trunc("hour", "publication_datetime").cast("timestamp_ntz").alias("hour_bucket")
    ).agg(F.count("*").alias("articles"))


def checked_by_country(runs: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    rows = runs.filter(F.col("attempted") & (F.col("ran_at") >= before(as_of, f"{hours} hours")) & (F.col("ran_at") <= at(as_of)))
    return rows.select("country", source_key("source").alias("k")).distinct().groupBy("country").agg(F.count("*").alias("checked_sources"))


def with_meta(metrics: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog facts of each source by its key; unknown sources are direct publishers."""
    meta = catalog.select(source_key("catalog_source").alias("source_key"), "catalog_country", "distribution_class", "publisher")
    return metrics.withColumn("source_key", source_key("source")).join(meta, "source_key", "left").withColumn(
        "class", F.coalesce("distribution_class", F.lit("publisher"))
    )


def country_metrics(metrics: DataFrame, catalog: DataFrame, checked: DataFrame, window: str = "24h") -> DataFrame:
    """Per country: each source counts once, whatever article countries its rows name; portals apart."""
    pub, fresh, late, seen = (f"{m}_{window}" for m in ("pub", "fresh", "late", "first_seen"))
    rows = with_meta(metrics, catalog).withColumn("place", F.coalesce("catalog_country", "country")).filter("place is not null")
    sources = rows.groupBy("place", "source_key").agg(*[F.sum(c).alias(c) for c in (pub, fresh, late, seen)], F.max("class").alias("class"))
    totals = sources.groupBy("place").agg(
        F.sum(pub).alias("published"), F.sum(fresh).alias("fresh"), F.sum(late).alias("late"), F.sum(seen).alias("first_seen"), F.count_if(F.col(pub) > 0).alias("active_sources"),
        F.coalesce(F.sum(F.when(F.col("class") == "portal", F.col(pub))), F.lit(0)).alias("portal_published"),
    )
    configured = catalog.groupBy(F.col("catalog_country").alias("place")).agg(F.count("*").alias("configured_sources"))
    joined = totals.join(configured, "place", "left").join(checked.withColumnRenamed("country", "place"), "place", "left").na.fill(0)
    share = F.when(F.col("first_seen") > 0, F.round(F.col("late") / F.col("first_seen"), 6)).otherwise(0.0)
    return joined.select(
        F.col("place").alias("country"), "published", "fresh", "late", "first_seen", share.alias("late_share"), "active_sources",
        "portal_published", "configured_sources", F.least("checked_sources", "configured_sources").alias("checked_sources")
    )


def publishers(metrics: DataFrame, catalog: DataFrame, window: str = "24h", dedupe_sources: bool = False) -> DataFrame:
    """Per publisher. A source counts once for each of its metric rows, unless asked to count once."""
    pub = f"pub_{window}"
    rows = with_meta(metrics, catalog).withColumn("name", F.coalesce("publisher", "source"))
    active = F.countDistinct(F.when(F.col(pub) > 0, F.col("source_key"))) if dedupe_sources else F.count_if(F.col(pub) > 0)
    confidence = F.when(F.col("publisher").isNotNull(), 3).otherwise(1)
    totals = rows.groupBy("name").agg(
        F.sum(pub).alias("published"), active.alias("active_sources"), F.countDistinct("country").alias("countries"),
        F.avg(confidence).alias("_vote")
    )
    vote = F.when(F.col("_vote") >= 2.6, "high").when(F.col("_vote") >= 1.6, "medium").otherwise("low")
    by_country = rows.filter("country is not null").groupBy("name", "country").agg(F.sum(pub).alias("n"))
    main = top_k(by_country, ["name"], 3, F.desc("n"), F.asc("country")).groupBy("name").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rn", "country", "n"))),
                lambda x: F.concat_ws(":", x["country"], x["n"].cast("string"))
            ),
            ","
        ).alias("top_countries")
    )
    return totals.join(main, "name", "left").select(
        "name", "published", "active_sources", "countries", vote.alias("confidence"),
        F.coalesce("top_countries", F.lit("")).alias("top_countries")
    )


def country_sources(metrics: DataFrame, catalog: DataFrame, health_rows: DataFrame, window: str = "24h", k: int = 20) -> DataFrame:
    """The first k sources of every country at once, with their health."""
    pub = f"pub_{window}"
    rows = with_meta(metrics, catalog).filter("country is not null").groupBy("country", "source_key").agg(
        F.sum(pub).alias("published"), F.max("class").alias("class")
    )
    ranked = top_k(rows, ["country"], k, F.desc("published"), F.asc("source_key"))
    return ranked.join(health_rows.select("source_key", "status"), "source_key", "left").select(
        "country", F.col("rn").cast("long").alias("rn"), "source_key", "published", "class",
        F.coalesce("status", F.lit("unknown")).alias("status")
    )


def source_detail(metrics: DataFrame, health_rows: DataFrame) -> DataFrame:
    sums = [f"{m}_{n}" for n in WINDOWS for m in ("pub", "first_seen")]
    rows = metrics.groupBy(source_key("source").alias("source_key")).agg(*[F.sum(c).alias(c) for c in sums])
    rate = F.when(F.col("attempts_24h") > 0, F.round(F.col("failures_24h") / F.col("attempts_24h"), 6))
    return rows.join(health_rows.select("source_key", "status", "attempts_24h", "failures_24h"), "source_key", "left").select(
        "source_key", *sums, F.coalesce("status", F.lit("unknown")).alias("status"), rate.alias("fail_rate")
    )


def regions(metrics: DataFrame, catalog: DataFrame, nations: DataFrame, window: str = "24h", k: int = 5) -> DataFrame:
    """Regions by published articles, what has no region last."""
    rows = with_meta(metrics, catalog).join(nations, F.col("country") == F.col("n_name"), "left")
    totals = rows.groupBy(F.coalesce("r_name", F.lit("(unmapped)")).alias("region")).agg(
        F.max(F.col("r_name").isNull().cast("int")).alias("_unmapped"), F.sum(f"pub_{window}").alias("published"),
        F.countDistinct("source_key").alias("sources")
    )
    return totals.orderBy("_unmapped", F.desc("published"), F.desc("sources"), "region").limit(k).drop("_unmapped")


def coordinate_jitter(key: Column, scale: float = 0.35) -> tuple[Column, Column]:
    """A small stable offset of a point, from a digest of its key."""
    h = F.crc32(key)
    angle = (h % 360) * F.lit(3.141592653589793) / 180
    radius = F.lit(scale) * (0.35 + (h % 1000) / 1538.0)
    return F.round(radius * F.sin(angle), 4), F.round(radius * F.cos(angle), 4)
