"""Further lanes: mentions by day and entity, unclassified articles by candidate, candidate sources by lift, foreign operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import at, before, blank_to, visible
from ..operators.relational import latest, top_k
from .audit import candidates as json_candidates


def shown(articles: DataFrame, as_of: str, days: int) -> DataFrame:
    return articles.filter(visible() & (F.col("created_at") >= before(as_of, f"{days} days")) & (F.col("created_at") <= at(as_of)))


def mentions_by_day(articles: DataFrame, mentions: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Distinct articles and entities by day of the article."""
    rows = shown(articles, as_of, days).select("external_id", F.to_date("created_at").alias("day"))
    joined = rows.join(mentions.select("article_external_id", "entity_id").distinct(), F.col("external_id") == F.col("article_external_id"))
    return joined.groupBy("day").agg(
        F.countDistinct("external_id").alias("articles"), F.countDistinct("entity_id").alias("entities"), F.count("*").alias("mentions")
    )


def top_entities(articles: DataFrame, mentions: DataFrame, as_of: str, days: int = 30, k: int = 20) -> DataFrame:
    """Entities by distinct articles, with the newest article of each."""
    rows = shown(articles, as_of, days).select("external_id", "created_at", "source")
    joined = rows.join(mentions.select("article_external_id", "entity_id").distinct(), F.col("external_id") == F.col("article_external_id"))
    counts = joined.groupBy("entity_id").agg(
        F.count("*").alias("articles"), F.countDistinct("source").alias("sources"),
        F.max_by("external_id", F.struct("created_at", "external_id")).alias("newest")
    )
    return counts.orderBy(F.desc("articles"), F.asc("entity_id")).limit(k)


def unmentioned(articles: DataFrame, mentions: DataFrame, as_of: str, days: int = 30, k: int = 50) -> DataFrame:
    """The newest visible articles that no mention names."""
    return shown(articles, as_of, days).join(
        mentions, F.col("external_id") == F.col("article_external_id"), "left_anti"
    ).orderBy(F.desc("created_at"), F.desc("external_id")).limit(k).select("external_id", "source", "created_at")


def others_candidates(articles: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Unclassified articles with their best candidate section and its score."""
    rows = articles.filter(
        (blank_to("section", "others") == "others") & (F.col("created_at") >= before(as_of, f"{days} days"))
        & (F.col("created_at") <= at(as_of))
    )
    best = F.expr(
        "array_sort(from_json(candidates, 'array<struct<label:string,score:double>>'), (a, b) -> case when a.score > b.score then -1 when a.score < b.score then 1 when a.label < b.label then -1 when a.label > b.label then 1 else 0 end)[0]"
    )
    return rows.withColumn("candidates", json_candidates()).select("external_id", "source", "created_at", "title_original", best.alias("b")).select(
        "external_id", "source", "created_at", "title_original", F.col("b.label").alias("label"), F.col("b.score").alias("score")
    )


def others_by_section(articles: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    found = others_candidates(articles, as_of, days)
    return found.groupBy("label").agg(
        F.count("*").alias("articles"), F.round(F.avg("score"), 6).alias("mean_score"), F.countDistinct("source").alias("sources")
    )


def others_titles(articles: DataFrame, as_of: str, days: int = 30, k: int = 3) -> DataFrame:
    """The newest k titles of each candidate section."""
    ranked = top_k(others_candidates(articles, as_of, days), ["label"], k, F.desc("created_at"), F.desc("external_id"))
    return ranked.select("label", F.col("rn").cast("long").alias("rn"), "external_id", "title_original")


def candidate_sources(articles: DataFrame, catalog: DataFrame, as_of: str, days: int = 5) -> DataFrame:
    """Sources outside the catalog by titles that catalog sources lack, and what to do with them."""
    title = F.lower(blank_to("title_original"))
    rows = articles.filter(
        (F.col("created_at") >= before(as_of, f"{days} days")) & (F.col("created_at") <= at(as_of))
    ).select("source", title.alias("title")).filter("title is not null")
    known = catalog.select(F.col("catalog_source").alias("source"))
    current = rows.join(known, "source", "left_semi").select("title").distinct()
    new = rows.join(known, "source", "left_anti")
    raw = new.groupBy("source").agg(F.count("*").alias("raw"), F.countDistinct("title").alias("titles"))
    lift = new.distinct().join(current, "title", "left_anti").groupBy("source").agg(F.count("*").alias("lift"))
    out = raw.join(lift, "source", "left").na.fill(0, ["lift"])
    return out.withColumn("recommendation", F.when(F.col("lift") >= 3, "add_now").otherwise("monitor"))


def foreign_operated(articles: DataFrame, catalog: DataFrame) -> DataFrame:
    """Sources whose articles are mostly about another country than their catalog country."""
    counts = articles.filter(blank_to("country").isNotNull()).groupBy("source", "country").agg(F.count("*").alias("n"))
    main = latest(counts, ["source"], F.desc("n"), F.asc("country")).select("source", F.col("country").alias("main_country"))
    listed = catalog.select(F.col("catalog_source").alias("source"), "catalog_country")
    return main.join(listed, "source").select(
        "source", "catalog_country", "main_country", (F.col("main_country") != F.col("catalog_country")).alias("foreign_operated")
    )
