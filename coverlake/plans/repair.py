"""Repairs as batch projections: title assessment, publisher countries, categories from addresses, local hours, seats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import before, blank_to, low_signal
from ..functions.scalars import path
from ..operators.relational import latest

STOP = ["www", "news", "story", "article", "index"]


def assess_titles(articles: DataFrame) -> DataFrame:
    """Quality of each title, why, and whether a repair is due; what was recovered before stays recovered."""
    title = blank_to("title_original")
    low = low_signal()
    quality = F.when(title.isNull() | low, "suspect").when(blank_to("title_quality", "ok") == "recovered", "recovered").otherwise("ok")
    reason = F.when(title.isNull(), "missing_title").when(low, "low_signal_title").otherwise("feed_title_ok")
    return articles.select(
        "external_id", quality.alias("quality"), reason.alias("reason"),
        F.when(title.isNull() | low, "pending").otherwise("not_needed").alias("repair")
    )


def country_repairs(articles: DataFrame, catalog: DataFrame) -> DataFrame:
    """Articles whose publisher country differs from the catalog's, with the new value."""
    found = articles.join(catalog.select("catalog_source", "catalog_country"), F.col("source") == F.col("catalog_source"))
    old = blank_to("source_country")
    return found.filter(~old.eqNullSafe(F.col("catalog_country"))).select(
        "external_id", old.alias("old_country"), F.col("catalog_country").alias("new_country")
    )


def path_parts(most: int = 3):
    """Segments of an address that may name a category: no stop words, digits, or long hexadecimal."""
    parts = F.filter(
        F.split(F.lower(path(F.col("url"))), "/"), lambda x: (x != "") & ~x.isin(STOP) & ~x.rlike("^[0-9]+$") & ~x.rlike("^[0-9a-f]{12,}$")
    )
    return F.slice(parts, 1, most)


def category_backfill(articles: DataFrame, least: int = 3) -> DataFrame:
    """For articles without feed categories, the most frequent one of articles of the same source with the same first path part."""
    rows = articles.select("external_id", "source", F.get(path_parts(), F.lit(0)).alias("part"), "feed_categories")
    known = rows.filter(F.size("feed_categories") > 0).select(
        "source", "part", F.explode("feed_categories").alias("category")
    ).groupBy("source", "part", "category").agg(F.count("*").alias("support")).filter(F.col("support") >= least)
    best = latest(known.filter("part is not null"), ["source", "part"], F.desc("support"), F.asc("category"))
    return rows.filter(
        (F.size("feed_categories") == 0) & F.col("part").isNotNull()
    ).join(best, ["source", "part"]).select("external_id", "category", "support")


def local_hours(runs: DataFrame, zone: str = "America/Chicago") -> DataFrame:
    """Attempts by hour of the day in a zone."""
    local = F.from_utc_timestamp(F.col("ran_at").cast("timestamp"), zone)
    return runs.groupBy(F.hour(local).cast("long").alias("hour")).agg(F.count("*").alias("attempts"))


def seats(articles: DataFrame, places: DataFrame) -> DataFrame:
    """Each source's seat: the place listed for it, else for its country, else none; places: (kind, name, seat)."""
    own, land = (
        places.filter(F.col("kind") == k).select(F.col("name").alias(f"_{k}"), F.col("seat").alias(f"_{k}_seat"))
        for k in ("source", "country")
    )
    rows = articles.groupBy("source").agg(
        F.min_by(blank_to("source_country"), F.struct(blank_to("source_country").isNull(), "created_at", "external_id")).alias("country")
    )
    joined = rows.join(own, F.col("source") == F.col("_source"), "left").join(land, F.col("country") == F.col("_country"), "left")
    basis = F.when(F.col("_source_seat").isNotNull(), "source").when(F.col("_country_seat").isNotNull(), "country").otherwise("none")
    return joined.select("source", F.coalesce("_source_seat", "_country_seat").alias("seat"), basis.alias("basis"))


def drift_scope(articles: DataFrame, as_of: str, source_prefix: str, hours: int = 168) -> DataFrame:
    """Recent articles of sources whose name begins so."""
    recent = (F.col("publication_datetime") >= before(as_of, f"{hours} hours")) & F.col("source").startswith(source_prefix)
    return articles.filter(recent).select("external_id", "stable_id", "source", "publication_datetime")


def topic_keys(
    articles: DataFrame, as_of: str, hours: int, primary_section: str | None = None, sources: list[str] | None = None,
    categories: list[str] | None = None, limit: int = 500
) -> DataFrame:
    """Keys of the newest articles whose topics are to be found again; each condition only if it is given."""
    rows = articles.filter(F.col("created_at") >= before(as_of, f"{hours} hours"))
    if primary_section:
        rows = rows.filter(blank_to("primary_section", "others") == primary_section)
    if sources:
        rows = rows.filter(F.col("source").isin(sources))
    if categories:
        rows = rows.filter(F.exists(F.coalesce("feed_categories", F.array().cast("array<string>")), lambda c: c.isin(categories)))
    return rows.select("external_id", "created_at").orderBy(F.desc("created_at"), F.desc("external_id")).limit(limit)


def seat_table(catalog: DataFrame, nations: DataFrame) -> DataFrame:
    """Seats for the fixtures: catalog sources by publisher name, countries by region."""
    a = catalog.select(F.lit("source").alias("kind"), F.col("catalog_source").alias("name"), F.col("publisher").alias("seat"))
    return a.unionByName(nations.select(F.lit("country").alias("kind"), F.col("n_name").alias("name"), F.col("r_name").alias("seat")))


def signatures(depths: int = 2) -> Column:
    """(depth, signature): the first one, two and so on of the parts of an address that may name a category."""
    parts = path_parts(depths)
    return F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depths))),
        lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, 1, d), "/").alias("signature"))
    )


def signature_backfill(articles: DataFrame, least: int = 5, share: float = 0.6, depths: int = 2) -> DataFrame:
    """For articles without feed categories those that most articles of the same source and signature have; the deepest signature
    that tells any counts. Categories by share, then by name."""
    rows = articles.select(
        "external_id", "source", "feed_categories", F.when(F.size(path_parts(depths)) > 0, signatures(depths)).alias("_s")
    )
    each = rows.filter("_s is not null").select(
        "external_id", "source", "feed_categories", F.explode("_s").alias("s")
    ).select("external_id", "source", "feed_categories", "s.*")
    filled = each.filter(F.size("feed_categories") > 0)
    samples = filled.groupBy("source", "depth", "signature").agg(F.count("*").alias("samples")).filter(F.col("samples") >= least)
    tags = filled.select(
        "source", "depth", "signature", F.explode(F.array_distinct("feed_categories")).alias("category")
    ).groupBy("source", "depth", "signature", "category").agg(F.count("*").alias("n"))
    key = ["source", "depth", "signature"]
    told = tags.join(samples, key).filter(F.col("n") >= share * F.col("samples"))
    known = told.groupBy(*key).agg(
        F.first("samples").alias("samples"),
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "category"))), lambda x: x["category"]
        ).alias("categories")
    )
    found = each.filter(F.size("feed_categories") == 0).join(known, key)
    return latest(found, ["external_id"], F.desc("depth")).select(
        "external_id", F.col("depth").cast("long").alias("depth"), "signature", F.array_join("categories", "|").alias("categories"),
        "samples"
    )


def stable_id_backfill(articles: DataFrame, feed_items: DataFrame) -> DataFrame:
    """Articles without a feed id whose address a feed item (link, feed_id) of the same source has; of several ids of one address
    the first in order."""
    ids = feed_items.filter(
        F.coalesce("feed_id", F.lit("")) != ""
    ).groupBy("source", F.col("link").alias("url")).agg(F.min("feed_id").alias("stable_id"))
    return articles.filter("stable_id is null").select(
        "external_id", "source", "url"
    ).join(ids, ["source", "url"]).select("external_id", "stable_id")


#: The rungs of the ladder, from the surest on.
RUNGS = ["headquarters", "publisher-headquarters", "inferred-city", "foreign-operated", "hub", "country-fallback"]


def located(sources: DataFrame, places: DataFrame) -> DataFrame:
    """Where each source (source, country, publisher) is, by the first rung that tells.

    places: (rung, name, country, lat, lon), unique by the first three. Headquarters and foreign-operated sources are named by
    source, or by publisher; a city counts if its name is a word of the source's name, of several the first by name; hubs and
    countries have no name. What none tells is at (0, 0).
    """
    rows = sources.select("source", "country", "publisher")
    for k, rung in enumerate(RUNGS):
        own = places.filter(F.col("rung") == rung).select(
            F.col("name").alias("_name"), F.col("country").alias("_country"), F.struct("lat", "lon", "name").alias(f"_{k}")
        )
        here = F.col("country") == F.col("_country")
        if rung == "inferred-city":
            words = rows.select(
                "source", "country", F.explode(F.array_distinct(F.split(F.lower("source"), r"[^\p{L}\p{N}]+"))).alias("_word")
            ).distinct()
            hits = words.join(own, (F.col("_word") == F.lower("_name")) & here)
            best = hits.groupBy("source", "country").agg(F.min_by(f"_{k}", "_name").alias(f"_{k}"))
            rows = rows.join(best, ["source", "country"], "left")
            continue
        if rung == "foreign-operated":
            by = [(F.col("source") == F.col("_name")) & here, (F.col("publisher") == F.col("_name")) & here]
            a = rows.join(own, by[0], "left").drop("_name", "_country").withColumnRenamed(f"_{k}", "_a")
            rows = a.join(own, by[1], "left").withColumn(f"_{k}", F.coalesce("_a", f"_{k}")).drop("_a", "_name", "_country")
            continue
        on = {
            "headquarters": (F.col("source") == F.col("_name")) & here,
            "publisher-headquarters": (F.col("publisher") == F.col("_name")) & here
        }.get(rung, here)
        rows = rows.join(own, on, "left").drop("_name", "_country")
    found = [
        F.when(
            F.col(f"_{k}").isNotNull(),
            F.struct(F.lit(rung).alias("rung"), F.col(f"_{k}.lat").alias("lat"), F.col(f"_{k}.lon").alias("lon"))
        )
        for k, rung in enumerate(RUNGS)
    ]
    none = F.struct(F.lit(RUNGS[-1]).alias("rung"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))
    at_ = F.coalesce(*found, none)
    kind = F.when(at_["rung"] == "publisher-headquarters", "headquarters").otherwise(at_["rung"])
    return rows.select(
        "source", "country", at_["rung"].alias("rung"), kind.alias("location_kind"), at_["lat"].alias("lat"), at_["lon"].alias("lon")
    )
