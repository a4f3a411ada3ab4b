"""Dashboard: totals, sections, topics, categories and previews of a window that ends at a given moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import at, before, blank_to, low_signal, section_of, visible
from ..operators.relational import top_k

#: Topics that a section may show, as (section, topics); a table of the caller's, here a small one of our own.
ALLOWED_TOPICS = {
    "tech": ["topic1", "topic2", "topic3"], "world": ["topic1", "topic4", "topic7", "topic10"], "sports": ["topic0", "topic5"],
    "business": []
}


def published(as_of: str, days: int = 31, future_minutes: int = 30) -> Column:
    return visible() & (F.col("publication_datetime") >= before(as_of, f"{days} days")) & (
        F.col("publication_datetime") <= at(as_of) + F.expr(f"interval {future_minutes} minutes")
    )


def stored_section() -> Column:
    return F.coalesce(blank_to("primary_section"), blank_to("section"), F.lit("others"))


def totals(articles: DataFrame, as_of: str, days: int = 31, hours: int = 24) -> DataFrame:
    recent = before(as_of, f"{hours} hours")
    return articles.filter(published(as_of, days)).agg(
        F.count("*").alias("total_rows"), F.count_if(F.col("created_at") >= recent).alias("inserted"), F.count_if((F.col("publication_datetime") >= recent) & (F.col("publication_datetime") <= at(as_of))).alias("published"), F.max("created_at").alias("newest")
    )


def checked_sources(runs: DataFrame, catalog: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Distinct attempted sources of the catalog in the window."""
    seen = runs.filter(
        F.col("attempted") & (F.col("ran_at") >= before(as_of, f"{hours} hours")) & (F.col("ran_at") <= at(as_of))
    ).select("source").distinct()
    return seen.join(catalog, seen["source"] == catalog["catalog_source"], "left_semi").agg(F.count("*").alias("checked_sources"))


def section_totals(articles: DataFrame, as_of: str, days: int = 31) -> DataFrame:
    stored = articles.filter(published(as_of, days)).groupBy(stored_section().alias("stored")).agg(F.count("*").alias("n"))
    return stored.groupBy(section_of(F.col("stored")).alias("section")).agg(F.sum("n").alias("articles"))


def preview_date(articles: DataFrame, as_of: str, days: int = 31) -> DataFrame:
    """The newest date, and the newest before today or else the newest."""
    dates = articles.filter(published(as_of, days)).select(F.to_date("publication_datetime").alias("d")).distinct()
    return dates.agg(
        F.max("d").alias("latest_date"),
        F.coalesce(F.max(F.when(F.col("d") < F.to_date(at(as_of)), F.col("d"))), F.max("d")).alias("preview_date")
    )


def recent_dates(articles: DataFrame, as_of: str, days: int = 31, k: int = 7) -> DataFrame:
    return articles.filter(published(as_of, days)).groupBy(
        F.to_date("publication_datetime").alias("day")
    ).agg(F.count("*").alias("articles")).orderBy(F.desc("day")).limit(k)


def topic_groups(articles: DataFrame, as_of: str, days: int = 31, k: int = 30, allowed: dict[str, list[str]] | None = None) -> DataFrame:
    """Top k topics of each section; the cut comes before topics that the section may not show go."""
    rows = articles.filter(published(as_of, days)).select(
        stored_section().alias("section"), blank_to("primary_topic").alias("topic")
    ).filter("section <> 'others'")
    # one aggregation gives both counts: the section's are sums of the topics'
    counts = rows.groupBy("section", "topic").agg(F.count("*").alias("n"))
    sections = counts.groupBy("section").agg(
        F.sum("n").alias("articles"), F.coalesce(F.sum(F.when(F.col("topic").isNull(), F.col("n"))), F.lit(0)).alias("unassigned")
    )
    ranked = top_k(counts.filter("topic is not null"), ["section"], k, F.desc("n"), F.asc("topic"))
    may = F.lit(False)
    for section, topics in (ALLOWED_TOPICS if allowed is None else allowed).items():
        may = may | ((F.col("section") == section) & F.col("topic").isin(topics))
    return ranked.filter(may).join(sections, "section").select(
        "section", "articles", "unassigned", "topic", F.col("n").alias("count"), F.col("rn").cast("long").alias("rn")
    )


def category_coverage(articles: DataFrame, as_of: str, days: int = 31) -> DataFrame:
    rows = articles.filter(published(as_of, days))
    return rows.agg(
        F.count("*").alias("articles"), F.count_if(F.size("feed_categories") > 0).alias("with_categories"),
        F.count_if(F.size("feed_categories") == 0).alias("without_categories")
    )


def top_categories(articles: DataFrame, as_of: str, days: int = 31, k: int = 24) -> DataFrame:
    each = articles.filter(published(as_of, days)).select(
        "source", F.explode("feed_categories").alias("c")
    ).select("source", blank_to("c").alias("category")).filter("category is not null")
    return each.groupBy("category").agg(
        F.count("*").alias("articles"), F.countDistinct("source").alias("sources")
    ).orderBy(F.desc("articles"), F.asc("category")).limit(k)


def preview_countries(articles: DataFrame, catalog: DataFrame, as_of: str, hours: int = 24, k: int = 6) -> DataFrame:
    """Countries by direct publishers' articles; sources outside the catalog count as direct."""
    recent = articles.filter(
        visible() & (F.col("publication_datetime") >= before(as_of, f"{hours} hours")) & (F.col("publication_datetime") <= at(as_of))
    )
    counts = recent.groupBy(blank_to("source_country", "Global").alias("country"), "source").agg(F.count("*").alias("n"))
    direct = counts.join(
        catalog.select("catalog_source", "distribution_class"), F.col("source") == F.col("catalog_source"), "left"
    ).filter(F.coalesce("distribution_class", F.lit("publisher")) == "publisher")
    return direct.groupBy("country").agg(
        F.sum("n").alias("articles"), F.count("*").alias("sources")
    ).orderBy(F.desc("articles"), F.asc("country")).limit(k)


def preview_headlines(articles: DataFrame, as_of: str, hours: int = 24, k: int = 8) -> DataFrame:
    """The newest k, of which those with a title that says nothing then go: fewer may be left."""
    recent = articles.filter(
        visible() & (F.col("publication_datetime") >= before(as_of, f"{hours} hours")) & (F.col("publication_datetime") <= at(as_of))
    )
    first = recent.orderBy(F.desc("publication_datetime"), F.desc("created_at"), F.asc("external_id")).limit(k)
    return first.filter(~low_signal()).select("external_id", "title_original", "source", "publication_datetime")
