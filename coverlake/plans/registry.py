"""Every registered query of the analytics engine, with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import at
from ..sources import fixtures as fx
from ..sources.fixtures import AS_OF
from . import audit, audit_sql, benchmark, benchmark_sql, coverage, coverage_sql, dashboard, dashboard_sql, dossier, dossier_sql, endpoints, endpoints_sql, ingest, ingest_sql, landed, landed_sql, lanes, lanes_sql, ops, ops_sql, repair, repair_sql, replays, replays_sql, ruled, ruled_sql, tables, tables_sql, taxonomy, taxonomy_sql, urls, urls_sql

Query = Callable[[SparkSession, str], DataFrame]
DAY = "2024-01-19"


def over(plan: Callable[..., DataFrame], *relations: Callable[[SparkSession, str], DataFrame], **how) -> Query:
    """The plan over adapters of the generated tables."""
    return lambda spark, sf_dir: plan(*[r(spark, sf_dir) for r in relations], **how)


def of(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fx.load(spark, sf_dir, name)


A, R, C, M = fx.articles, fx.runs, fx.catalog, fx.mentions
SERIES = over(benchmark.daily_series, A, C)
HEALTH = over(coverage.latest_health, R, as_of=AS_OF)
CHECKED = over(coverage.checked_by_country, R, as_of=AS_OF)


def metrics(window: str) -> Query:
    return over(coverage.source_metrics, A, as_of=AS_OF, window=window)


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = fx.load(spark, sf_dir, "nation"), fx.load(spark, sf_dir, "region")
    return n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select("n_name", "r_name")  # fixed tables


def response(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, c = A(spark, sf_dir), C(spark, sf_dir)
    week = benchmark.day_rows(SERIES(spark, sf_dir), "2024-01-13", DAY)
    return benchmark.response(benchmark.hourly(a, c, AS_OF), benchmark.daily(a, c, DAY), week)


def parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's snapshot against the series of all days: no differences."""
    a, c = A(spark, sf_dir), C(spark, sf_dir)
    stored = benchmark.daily(a, c, DAY).filter("published > 0 or inserted > 0")
    counted = SERIES(spark, sf_dir).filter(F.col("day_bucket") == F.lit(DAY).cast("date"))
    return benchmark.parity(stored, counted, ["country"], ["published", "inserted", "fresh", "late", "active_sources", "top1_bps"])


def dated_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of which one in four tells its date in the address."""
    url = F.when(
        F.col("event_id") % 4 == 0,
        F.concat(
            F.lit("https://"), F.col("source"), F.lit(".example.com/2024/01/1"), (F.col("event_id") % 3).cast("string"), F.lit("/"),
            F.col("external_id")
        )
    ).otherwise(F.col("url"))
    return A(spark, sf_dir).withColumn("url", url)


def spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles whose source and publisher country are spelled in several ways, or missing."""
    source = F.expr("if(event_id % 3 = 1, concat(' ', upper(source), ' '), source)")
    country = F.expr(
        "case event_id % 4 when 0 then concat(lower(source_country), '  ') when 1 then null when 2 then 'Elsewhere' else source_country end"
    )
    return A(spark, sf_dir).select("external_id", source.alias("source"), country.alias("source_country"))


def sources_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with country and publisher; some have a city in their name."""
    s = fx.load(spark, sf_dir, "supplier")
    city = F.when(
        F.col("s_suppkey") % 4 == 1, F.concat(F.lit(" Town"), (F.col("s_suppkey") % 6).cast("string"), F.lit(" Daily"))
    ).otherwise("")
    return s.select(
        F.concat(F.lit("src"), F.col("s_suppkey").cast("string"), city).alias("source"),
        F.concat(F.lit("C"), (F.col("s_suppkey") % 7).cast("string")).alias("country"), F.col("s_name").alias("publisher"), "s_suppkey"
    )


def seats_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places on every rung: (rung, name, country, lat, lon)."""
    s = sources_of(spark, sf_dir)
    k = F.col("s_suppkey")
    rung = lambda rows, rung, name, lat: rows.select(
        F.lit(rung).alias("rung"), name.alias("name"), "country", lat.cast("double").alias("lat"), F.lit(1.5).alias("lon")
    )
    lands = s.select("country").distinct()
    n = F.substring("country", 2, 1).cast("int")
    towns = lands.select("country", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("t"))
    parts = [
        rung(s.filter(k % 5 == 0), "headquarters", F.col("source"), k), rung(s.filter(k % 5 == 1), "publisher-headquarters", F.col("publisher"), k + 1000),
        rung(towns, "inferred-city", F.concat(F.lit("Town"), F.col("t").cast("string")), F.col("t") + 2000), rung(s.filter(k % 3 == 0), "foreign-operated", F.col("publisher"), k + 3000),
        rung(lands.filter(n % 2 == 0), "hub", F.lit(""), n + 4000), rung(lands.filter(n < 6), "country-fallback", F.lit(""), n + 5000),
    ]
    return reduce(DataFrame.unionByName, parts)


SEARCH = audit.NewsQuery(text="report 1", sections=["world, sports", "world"], hours=720, limit=50, offset=20)

QUERIES: dict[str, Query] = {
    "q01_dashboard_totals": over(dashboard.totals, A, as_of=AS_OF),
    "q02_checked_sources": over(dashboard.checked_sources, R, C, as_of=AS_OF),
    "q03_section_totals": over(dashboard.section_totals, A, as_of=AS_OF),
    "q04_preview_date": over(dashboard.preview_date, A, as_of=AS_OF),
    "q05_recent_dates": over(dashboard.recent_dates, A, as_of=AS_OF),
    "q06_topic_groups": over(dashboard.topic_groups, A, as_of=AS_OF),
    "q07_category_coverage": over(dashboard.category_coverage, A, as_of=AS_OF),
    "q07_top_categories": over(dashboard.top_categories, A, as_of=AS_OF),
    "q08_preview_countries": over(dashboard.preview_countries, A, C, as_of=AS_OF),
    "q09_preview_headlines": over(dashboard.preview_headlines, A, as_of=AS_OF),
    "q10_news_search": over(audit.search, A, query=SEARCH, as_of=AS_OF),
    "q10_keyset_page": over(audit.after, A, created_at="2024-01-15 00:00:00", external_id="5000", k=100),
    "q11_filter_values": over(audit.filter_values, A),
    "q12_benchmark_hourly": over(benchmark.hourly, A, C, as_of=AS_OF),
    "q13_benchmark_daily": over(benchmark.daily, A, C, day=DAY),
    "q13_benchmark_source_daily": over(benchmark.daily_sources, A, C, day=DAY),
    "q14_latest_windows": over(benchmark.latest_windows, SERIES),
    "q15_day_rows": over(benchmark.day_rows, SERIES, first="2024-01-10", last=DAY),
    "q16_period_totals": over(benchmark.period_totals, SERIES),
    "q17_period_countries": over(benchmark.period_countries, SERIES),
    "q18_benchmark_response": response,
    "q19_source_metrics_24h": metrics("24h"),
    "q20_source_metrics_1h": metrics("1h"),
    "q20_source_metrics_7d": metrics("7d"),
    "q21_latest_health": HEALTH,
    "q22_hourly_by_country": over(coverage.hourly_counts, A, as_of=AS_OF),
    "q22_hourly_by_source": over(coverage.hourly_counts, A, as_of=AS_OF, key="source"),
    "q23_checked_by_country": CHECKED,
    "q24_hourly_running": over(audit.per_hour, A),
    "q25_country_metrics": over(coverage.country_metrics, metrics("24h"), C, CHECKED),
    "q26_publishers": over(coverage.publishers, metrics("24h"), C),
    "q27_country_sources": over(coverage.country_sources, metrics("24h"), C, HEALTH),
    "q27_regions": over(coverage.regions, metrics("24h"), C, nations),
    "q28_source_detail": over(coverage.source_detail, metrics("7d"), HEALTH),
    "q30_ops_hourly": over(lambda r: ops.listing(ops.rollup(r), AS_OF), R),
    "q30_ops_daily": over(lambda r: ops.listing(ops.rollup(r, "day"), AS_OF, hours=480), R),
    "q31_failure_reasons": over(ops.failure_reasons, R, as_of=AS_OF),
    "q32_latest_diagnostics": over(ops.latest_diagnostics, R, as_of=AS_OF),
    "q33_day_summary": over(ops.day_summary, R, A, as_of=AS_OF),
    "q34_failing_endpoints": over(ops.failing_endpoints, R, as_of=AS_OF, minutes=20160, percent_failed=30.0),
    "q35_earliest_recent": over(ops.earliest_and_recent, A, as_of=AS_OF),
    "q36_outlet_page": over(lambda r: ops.paged(ops.outlet_table(r, AS_OF), "runs", True, "outlet_id", 2, 20), R),
    "q37_mention_summary": over(audit.mention_summary, A, M, as_of=AS_OF),
    "q37_mention_lane": over(audit.mention_lane, A, M, as_of=AS_OF),
    "q38_latest_snapshots": over(audit.latest_snapshots, of("orders")),
    "q38_roster": over(audit.roster, of("customer"), of("orders")),
    "q39_head_watchlist": over(ops.head_watchlist, A, R, as_of=AS_OF),
    "q40_failure_watchlist": over(ops.failure_watchlist, R, as_of=AS_OF, least=6, failures=5, in_a_row=3, rate_watch=0.25),
    "q41_stale_watchlist": over(ops.stale_watchlist, R, as_of=AS_OF, high_value_countries=("NATION_3",), high_value_sources=r"^src[0-9]*7$"),
    "q42_repair_pairs": over(ops.repair_pairs, R, as_of=AS_OF),
    "q43_blocked_backlog": over(ops.blocked_backlog, R, C, as_of=AS_OF),
    "q44_stability": over(ops.stability, R, as_of=AS_OF),
    "q45_ops_report": over(ops.report, R, as_of=AS_OF),
    "q46_country_report": over(audit.country_report, A, C, as_of=AS_OF),
    "q47_taxonomy_totals": over(audit.taxonomy_totals, A, as_of=AS_OF),
    "q47_taxonomy_by_source": over(audit.taxonomy_by_source, A, as_of=AS_OF),
    "q47_category_sections": over(audit.category_sections, A, as_of=AS_OF),
    "q48_others_by_source": over(lambda a: audit.others_by_source(a.withColumn("candidates", audit.candidates()), AS_OF), A),
    "q49_topic_audit": over(audit.topic_audit, A, as_of=AS_OF),
    "q50_url_sample": over(audit.url_sample, A, as_of=AS_OF),
    "q51_url_drift": over(audit.url_drift, dated_urls),
    "q52_category_prediction": over(audit.category_prediction, A),
    "q53_title_lift": over(audit.title_lift, A, as_of=AS_OF),
    "q54_country_stats": over(audit.country_stats, A, as_of=AS_OF),
    "q55_parity": parity,
    **ingest.QUERIES,
    **landed.QUERIES,
    **ruled.QUERIES,
    **endpoints.QUERIES,
    **replays.QUERIES,
    "m12_signature_backfill": over(repair.signature_backfill, dated_urls, least=3, share=0.3),
    "x36_located": lambda spark, sf_dir: repair.located(sources_of(spark, sf_dir), seats_of(spark, sf_dir)),
    "o04_search_estimate": over(audit.search_estimated, A, query=SEARCH, as_of=AS_OF),
    "f09_run_search": over(ops.run_table, R, as_of=AS_OF, hours=480, q="Src1", sort="failedRuns", limit=40, offset=10),
    "f09_no_wild_cards": over(ops.run_table, R, as_of=AS_OF, hours=480, q="src_"),
    "f14_outlet_runs": over(ops.run_table, R, as_of=AS_OF, hours=480, outlets=["1", "2"], sources=["src3"], sort="source", limit=500),
    "f14_source_runs": over(ops.run_table, R, as_of=AS_OF, hours=480, sources=["src3"], sort="valid_count; drop table", direction="asc"),
    "f10_source_prefix": over(repair.drift_scope, A, as_of=AS_OF, source_prefix="src1"),
    "f11_topic_keys": over(repair.topic_keys, A, as_of=AS_OF, hours=480, primary_section="tech", categories=["k1", "k3", "view"], limit=100),
    "sk7_report_lines": lambda spark, sf_dir: ops.markdown(ops.failure_reasons(R(spark, sf_dir), AS_OF), "Failures"),
    "j15_country_lookup": over(lambda a, c: benchmark.resolve_country(a, c).select("external_id", "country"), spellings, C),
    "q36_ingest_runs": over(tables.ingest_runs, R, as_of=AS_OF),
    "q36_feed_status": over(tables.feed_status, R, as_of=AS_OF),
    "q36_benchmark_metrics": over(tables.benchmark_metrics, SERIES),
    "q36_map_metrics": lambda spark, sf_dir: tables.map_snapshots(tables.snapshot(QUERIES["q25_country_metrics"](spark, sf_dir), "24h", "v1", AS_OF)),
    "q49_topics_by_section": over(tables.topics_by_section, A, as_of=AS_OF),
    "q49_unassigned_categories": over(tables.unassigned_categories, A, as_of=AS_OF),
    "q49_unassigned_sources": over(tables.unassigned_sources, A, as_of=AS_OF),
    "q47_others_categories": over(tables.others_categories, A, as_of=AS_OF),
    "q24_day_counts_by_source": over(tables.day_counts_by_source, A),
    "s2_schedule_gaps": over(tables.schedule, A, R, as_of=AS_OF),
    "q37_mentions_by_day": over(lanes.mentions_by_day, A, M, as_of=AS_OF),
    "q37_top_entities": over(lanes.top_entities, A, M, as_of=AS_OF),
    "q37_unmentioned": over(lanes.unmentioned, A, M, as_of=AS_OF),
    "q48_others_by_section": over(lanes.others_by_section, A, as_of=AS_OF),
    "q48_others_titles": over(lanes.others_titles, A, as_of=AS_OF),
    "q53_candidate_sources": over(lanes.candidate_sources, A, C, as_of=AS_OF),
    "x39_foreign_operated": over(lanes.foreign_operated, A, C),
    "q56_coverage": over(dossier.coverage, dossier.persons),
    "q56_priorities": over(dossier.priorities, dossier.persons),
    "q57_overlay": over(dossier.overlay, dossier.persons, dossier.edits),
    "f15_not_articles": over(urls.flagged, A),
    "x42_title_overlap": over(urls.title_overlap, of("pages")),
    "x09_assess_titles": over(repair.assess_titles, A),
    "m11_country_repairs": over(repair.country_repairs, A, C),
    "m06_category_backfill": over(repair.category_backfill, A),
    "x19_local_hours": over(repair.local_hours, R),
    "x36_seats": lambda spark, sf_dir: repair.seats(A(spark, sf_dir), repair.seat_table(C(spark, sf_dir), nations(spark, sf_dir))),
    "x25_hybrid_sections": over(taxonomy.classify, A),
    "x27_section_candidates": over(taxonomy.candidates, A),
    "x28_primary_section": over(taxonomy.primary_section, A),
    "x29_topic_scores": over(taxonomy.topic_scores, A),
    "x34_places": over(taxonomy.places, A),
    "x37_publishers": over(taxonomy.publisher_match, A, rules=taxonomy.PUBLISHERS),
    "a24_endpoint_classes": over(taxonomy.endpoint_classes, R),
    "x46_freshness": lambda spark, sf_dir: taxonomy.freshness(R(spark, sf_dir), at(AS_OF)),
}
ORACLE: dict[str, str] = {
    **dashboard_sql.SQL, **benchmark_sql.SQL, **coverage_sql.SQL, **ops_sql.SQL, **audit_sql.SQL, **ingest_sql.SQL, **landed_sql.SQL,
    **taxonomy_sql.SQL, **ruled_sql.SQL, **endpoints_sql.SQL, **replays_sql.SQL, **tables_sql.SQL, **repair_sql.SQL, **urls_sql.SQL,
    **dossier_sql.SQL, **lanes_sql.SQL
}
