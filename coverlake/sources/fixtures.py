"""Adapters that turn the generated tables into the engine's relations (schemas in FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Off the hour on purpose.
AS_OF = "2024-01-20 12:34:56"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """news articles: one for each event."""
    e = load(spark, sf_dir, "events")
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    publisher, place = n.select(
        F.col("n_nationkey").alias("_p"), F.col("n_name").alias("_publisher")
    ), n.select(F.col("n_nationkey").alias("_g"), F.col("n_name").alias("_place"))
    # 25 nations: a fixed table
    rows = e.join(
        F.broadcast(publisher), F.pmod("user_id", F.lit(5)) == F.col("_p")
    ).join(F.broadcast(place), F.pmod("event_id", F.lit(25)) == F.col("_g"))
    rows = rows.withColumn("_k", F.get_json_object("props", "$.k").cast("int"))
    return rows.selectExpr(
        "cast(event_id as string) external_id",
        "event_id",
        "if(event_id % 3 = 0, concat('guid-', cast(event_id div 2 as string)), null) stable_id",
        "if(event_id % 101 = 0, ts + interval 2 hours, ts - make_dt_interval(0, 0, cast(event_id % 97 as int) * 30)) publication_datetime",
        "ts created_at",
        "concat('src', cast(user_id as string)) source",
        "case when event_id % 11 = 0 then '' when event_id % 17 = 0 then null else _publisher end source_country",
        "if(event_id % 19 = 0, null, _place) country",
        "case when event_id % 13 = 0 then 'suspect' when event_id % 7 = 0 then ' ' else 'ok' end title_quality",
        "case when event_id % 23 = 0 then concat('https://src', cast(user_id as string), '.example.com/', event_type, '/', cast(event_id as string)) when event_id % 29 = 0 then null when event_id % 31 = 0 then cast(1000000 + event_id as string) else concat(event_type, ' report ', cast(event_id % 500 as string), ' from desk k', cast(_k as string)) end title_original",
        "concat('https://src', cast(user_id as string), '.example.com/', event_type, '/', cast(event_id as string)) url",
        "case event_type when 'view' then 'world' when 'click' then 'sports' when 'purchase' then 'business' when 'signup' then 'local' else '' end section",
        "case when event_id % 6 = 0 then 'tech' when event_id % 6 = 1 then '  ' else null end primary_section",
        "case when event_id % 4 = 0 then null when event_id % 9 = 0 then '' else concat('topic', cast(_k % 12 as string)) end primary_topic",
        "if(event_id % 5 = 0, cast(array() as array<string>), array(event_type, concat('k', cast(_k % 5 as string)))) feed_categories",
        "if(event_id % 4 = 0, cast(array() as array<string>), array(concat('topic', cast(_k % 12 as string)), event_type)) topics",
        "if(event_id % 8 = 0, cast(array() as array<string>), array(case event_type when 'view' then 'world' when 'click' then 'sports' else 'business' end)) sections_normalized",
        "event_type language_hint",
        "_k k",
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feed health: one fetch attempt for each event."""
    e = load(spark, sf_dir, "events")
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("_p"), F.col("n_name").alias("country"))
    return e.join(F.broadcast(n), F.pmod("user_id", F.lit(5)) == F.col("_p")).selectExpr(
        "event_id id", "ts ran_at", "if(event_id % 9 = 0, 'warm', 'worker') runner", "cast(user_id as string) outlet_id", "concat('src', cast(user_id as string)) source",
        "if(event_id % 2 = 0, 'rss', 'sitemap') method", "country", "event_type <> 'signup' attempted", "event_type <> 'error' ok", "event_id % 37 = 0 circuit_open",
        "case when event_type <> 'error' then 200 when event_id % 5 = 0 then 403 when event_id % 5 = 1 then 404 when event_id % 5 = 2 then 500 else null end status_code",
        "cast(floor(value) as long) fetched_count", "cast(floor(value / 2) as long) parsed_count", "event_id % 41 = 0 sample_capped",
        "concat('https://src', cast(user_id as string), '.example.com/', if(event_id % 2 = 0, 'rss', 'sitemap'), '/', cast(event_id % 3 as string)) requested_url",
        "case event_id % 3 when 0 then null when 1 then '' else concat('timeout ', event_type) end error",
        "case when event_id % 10 < 6 then 'healthy' when event_id % 10 = 6 then 'warning' when event_id % 10 = 7 then ' Degraded ' when event_id % 10 = 8 then 'failing' else null end health_classification",
        "if(event_id % 4 = 0, null, ts - make_dt_interval(cast(event_id % 40 as int))) newest_item_published_at",
        "cast(event_id % 3 as long) missing_title_count", "cast(event_id % 2 as long) missing_link_count",
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source catalog: one source for each supplier."""
    s = load(spark, sf_dir, "supplier")
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("_p"), F.col("n_name").alias("catalog_country"))
    return s.join(F.broadcast(n), F.pmod("s_suppkey", F.lit(5)) == F.col("_p")).selectExpr(
        "concat('src', cast(s_suppkey as string)) catalog_source", "catalog_country",
        "if(s_suppkey % 7 = 0, 'portal', 'publisher') distribution_class", "s_name publisher", "s_acctbal"
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """article mentions: one for each order line."""
    line, part = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    n = load(spark, sf_dir, "events").agg(F.count("*").alias("_n"))  # one row
    return line.join(part, line["l_partkey"] == part["p_partkey"]).crossJoin(F.broadcast(n)).selectExpr(
        "cast(l_orderkey % _n as string) article_external_id", "p_type entity_type", "cast(l_suppkey as string) entity_id",
        "l_shipdate mentioned_at"
    )
