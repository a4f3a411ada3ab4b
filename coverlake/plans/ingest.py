"""Ingest plans over the fixtures: batch dedupe, upsert, watermarks, rollups, clusters, lift, breaker, feeds and scalars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as x
from ..functions.exprs import at, before, blank_to
from ..functions.text import dedupe_text
from ..operators import folds, merge
from ..sources import fixtures as fx
from ..sources.fixtures import AS_OF
from . import ops

COLUMNS = [
    "external_id", "stable_id", "publication_datetime", "created_at", "source", "source_country", "title_original", "title_quality", "url",
    "primary_section", "primary_topic", "feed_categories", "topics", "sections_normalized"
]
SPLIT, AGAIN = "2024-01-16 00:00:00", "2024-01-10 00:00:00"


def existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was stored by a day."""
    return fx.articles(spark, sf_dir).filter(F.col("created_at") < at(SPLIT)).select(*COLUMNS)


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came since an earlier day, some of it for the second time and changed."""
    rows = fx.articles(spark, sf_dir).filter(F.col("created_at") >= at(AGAIN))
    changed = {
        "title_quality": F.expr("if(event_id % 10 = 0, 'suspect', title_quality)"),
        "title_original": F.expr("if(event_id % 15 = 0, url, title_original)"),
        "topics": F.concat("topics", F.array(F.lit("again"), F.lit(" "))),
        "created_at": F.expr("created_at + interval 1 hour"),
    }
    return rows.withColumns(changed).select(*COLUMNS, F.col("event_id").alias("seq"))


def flat(df: DataFrame) -> DataFrame:
    """Lists as texts."""
    return df.select(*[F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])


def batch_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(merge.dedupe_batch(incoming(spark, sf_dir)))


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(merge.upsert(existing(spark, sf_dir), incoming(spark, sf_dir).drop("seq")))


def upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.upsert_counts(existing(spark, sf_dir), incoming(spark, sf_dir))


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.resolve_ids(incoming(spark, sf_dir), existing(spark, sf_dir)).select("seq", "external_id")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.runs(spark, sf_dir).select("id", "outlet_id", "method", "ran_at", F.col("newest_item_published_at").alias("published_at"))


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _items(spark, sf_dir).filter(F.col("ran_at") < at(AGAIN))
    return old.groupBy("outlet_id", "method").agg(F.max("published_at").alias("last_publication_at"))


def watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.upsert_watermarks(_marks(spark, sf_dir), _items(spark, sf_dir).filter(F.col("ran_at") >= at(AGAIN)))


def past_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _items(spark, sf_dir).filter(F.col("ran_at") >= at(AGAIN))
    return merge.past_watermark(new, _marks(spark, sf_dir), before(AGAIN, "7 days")).select("id", "outlet_id", "method", "published_at")


def rollup_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fx.runs(spark, sf_dir)
    keys = ["bucket", "runner", "outlet_id", "method"]
    return merge.add_rollup(
        ops.rollup(r.filter(F.col("ran_at") < at(SPLIT)), "day"), ops.rollup(r.filter(F.col("ran_at") >= at(SPLIT)), "day"), keys
    )


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fx.articles(spark, sf_dir)
    kept = merge.retained(a, at(AS_OF), 3)
    return a.agg(F.count("*").alias("before")).crossJoin(F.broadcast(kept.agg(F.count("*").alias("kept"))))


def quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.runs(spark, sf_dir).filter("newest_item_published_at is null").select(
        F.col("requested_url").alias("candidate_id"), F.coalesce("error", F.lit("")).alias("snippet")
    )
    none = rows.limit(0).withColumn("seen_count", F.lit(0).cast("long")).select("candidate_id", "seen_count", "snippet")
    return merge.quarantine(none, rows)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed items as parsed, some without address, title or date."""
    return fx.articles(spark, sf_dir).select(
        "external_id", "stable_id", F.expr("if(event_id % 10 = 0, '  ', if(event_id % 10 = 1, concat(url, '?a=1&amp;b=2 '), url))").alias("link"), F.col("title_original").alias("title"),
        F.expr("concat(language_hint, '  is  ', repeat('so ', cast(event_id % 5 as int)))").alias("description"), F.expr("if(event_id % 14 = 0, null, publication_datetime)").alias("published_at"),
        F.expr("event_id % 3 = 1").alias("fallback_date"), "title_quality", F.col("feed_categories").alias("categories"), F.col("event_id").alias("seq"),
    )


def persistable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.persistable(items(spark, sf_dir), at(AS_OF)).select("external_id", "link", "title", "description", "published_at")


def preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = merge.prefer_items(items(spark, sf_dir).withColumn("seq", F.col("seq")))
    return kept.select("external_id", "stable_id", "link", "published_at", F.array_join("categories", "|").alias("categories"))


def lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fx.articles(spark, sf_dir)
    return folds.greedy_order(
        a.select(F.coalesce("country", F.lit("none")).alias("network"), "source", F.lower(blank_to("title_original", "")).alias("title"))
    )


def title_fingerprint(title: Column) -> Column:
    """The normalised title; null where it is too short to tell a story: under 32 characters or five words of three."""
    plain = dedupe_text(title)
    return F.when((F.length(plain) >= 32) & (F.size(F.filter(F.split(plain, " "), lambda t: F.length(t) >= 3)) >= 5), plain)


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fx.articles(spark, sf_dir)
    return folds.syndication_clusters(
        a.select(
            F.col("country").alias("network"), title_fingerprint(F.col("title_original")).alias("fingerprint"), "external_id",
            F.col("publication_datetime").alias("published_at")
        )
    )


def breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source has a working duplicate if it was asked by two methods that day and one of them worked."""
    r = fx.runs(spark, sf_dir).filter("attempted").withColumn(
        "failure", x.failure_kind(F.col("status_code"), F.col("error"))
    ).withColumn("day", F.to_date("ran_at"))
    alive = r.groupBy("source", "day").agg(((F.countDistinct("method") > 1) & F.bool_or("ok")).alias("duplicate"))
    return folds.breaker_states(r.join(alive, ["source", "day"]).select("outlet_id", "ran_at", "id", "ok", "failure", "duplicate"))


def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by what they brought in a day: head, warm or cold; cold ones wait in one of twelve stable buckets."""
    counts = fx.articles(spark, sf_dir).filter(
        (F.col("created_at") >= before(AS_OF, "24 hours")) & (F.col("created_at") <= at(AS_OF))
    ).groupBy("source").agg(F.count("*").alias("n"))
    every = fx.articles(spark, sf_dir).select("source").distinct()
    rows = every.join(counts, "source", "left").na.fill(0, ["n"])
    tier = F.when(F.col("n") >= 50, "head").when(F.col("n") <= 9, "cold").otherwise("warm")
    return rows.select("source", "n", tier.alias("tier"), F.when(tier == "cold", x.stable_bucket(F.col("source"), 12)).alias("bucket"))


def scalar_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions over articles and pages' addresses."""
    a = fx.articles(spark, sf_dir).withColumn("_fnv", x.fnv1a(F.col("url")))
    return a.select(
        "external_id", x.article_id(F.col("url")).alias("article_id"), x.host(F.col("url")).alias("host"), x.path_depth(F.col("url")).alias("depth"), x.base36(F.col("_fnv")).alias("fnv36"), F.pmod("_fnv", F.lit(12)).alias("bucket"),
        x.breaking(F.col("title_original")).alias("breaking"), F.array_join(x.categories(F.concat("feed_categories", F.transform("feed_categories", lambda c: F.concat(F.lit(" "), F.upper(c))))), "|").alias("categories"), x.truncated(F.col("title_original"), 12).alias("short_title"),
    )


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.load(spark, sf_dir, "pages")
    return p.select(
        "page_id", x.host(F.col("url")).alias("host"), x.path_depth(F.col("url")).alias("depth"), x.page_title(F.col("html")).alias("title")
    )


QUERIES = {
    "m03_batch_dedupe": batch_dedupe, "m04_upsert": upsert, "m05_upsert_counts": upsert_counts, "j17_resolved_ids": resolved, "m08_watermarks": watermarks, "f16_past_watermark": past_watermark, "m09_rollup_upsert": rollup_upsert, "sk6_retention": retention, "m07_quarantine": quarantined,
    "f17_persistable": persistable, "m01_preferred_items": preferred, "a30_greedy_lift": lift, "m02_syndication_clusters": clusters, "st5_breaker": breaker, "st7_tiers": tiers, "x_scalar_values": scalar_values, "x_page_titles": page_titles,
}
