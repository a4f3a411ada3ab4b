"""DuckDB statements beside the table plans."""

from .benchmark_sql import SERIES
from .coverage_sql import CHECKED, META, metrics
from .coverage_sql import SQL as COVERAGE
from .ops_sql import rolled
from .oracle import ARTICLES, AS_OF, CATALOG, RUNS, statement

RECENT = f"publication_datetime >= {AS_OF} - interval 30 day and created_at <= {AS_OF}"
SECTION, TOPIC = "coalesce(nullif(trim(primary_section, ' '), ''), 'others')", "nullif(trim(primary_topic, ' '), '')"
COUNTRY_ROWS = COVERAGE["q25_country_metrics"][COVERAGE["q25_country_metrics"].rindex("select t.country") :]
DAY = f"created_at >= {AS_OF} - interval 1 day and created_at <= {AS_OF}"
RAN = f"attempted and ran_at >= {AS_OF} - interval 1 day and ran_at <= {AS_OF}"

SQL = {
    "q36_ingest_runs": statement("select *, (select count(*) from t) as total from t order by fetched_count desc nulls last, row_key limit 25", RUNS, f"t as (select *, strftime(bucket, '%Y%m%d%H') || '/' || runner || '/' || outlet_id || '/' || method as row_key from ({rolled('hour')}) where bucket <= {AS_OF})"),
    "q36_feed_status": statement(
        "select *, (select count(*) from t) as total from t order by lag_hours desc nulls last, row_key limit 25",
        RUNS,
        f"t as (select outlet_id, method, last_publication_at, last_fetched_at, round((epoch({AS_OF}) - floor(epoch(coalesce(last_publication_at, last_fetched_at)))) / 3600.0, 3)::double as lag_hours, outlet_id || '/' || method as row_key from (select outlet_id, method, max(newest_item_published_at) as last_publication_at, max(ran_at) as last_fetched_at from runs where ran_at <= {AS_OF} and ok group by 1, 2))",
    ),
    "q36_benchmark_metrics": statement("select row_key, published, inserted, active_sources, top1_bps, (select count(*) from series) as total from (select *, strftime(day_bucket, '%Y%m%d') || '/' || country as row_key from series) order by published desc, row_key limit 25", ARTICLES, CATALOG, SERIES),
    "q36_map_metrics": statement(f"select '24h' as metric_window, 'v1' as metric_version, {AS_OF} as generated_at, count(*) as row_count, cast(sum(published) as bigint) as published, cast(sum(active_sources) as bigint) as active_sources from ({COUNTRY_ROWS})", ARTICLES, RUNS, CATALOG, metrics("24h"), META, CHECKED),
    "q49_topics_by_section": statement(f"select {SECTION} as section, {TOPIC} as topic, count(*) as articles from articles where {RECENT} group by 1, 2", ARTICLES),
    "q49_unassigned_categories": statement(f"select section, coalesce(nullif(trim(c, ' '), ''), '(empty)') as category, count(*) as articles from (select {SECTION} as section, unnest(case when len(feed_categories) = 0 then [null] else feed_categories end) as c from articles where {RECENT} and {TOPIC} is null) group by 1, 2", ARTICLES),
    "q49_unassigned_sources": statement(f"select {SECTION} as section, source, count(*) as articles from articles where {RECENT} and {TOPIC} is null group by 1, 2", ARTICLES),
    "q47_others_categories": statement(
        """select category, articles, sources, sample_sources from (select category, cast(sum(n) as bigint) as articles, count(*) as sources, string_agg(source, ', ' order by rn) filter (where rn <= 3) as sample_sources from (
             select *, row_number() over (partition by category order by n desc, source) as rn from (select category, source, count(*) as n from e where category is not null group by 1, 2)) group by 1) order by articles desc, category limit 20""",
        ARTICLES,
        f"e as (select source, nullif(trim(unnest(feed_categories), ' '), '') as category from articles where {RECENT} and {SECTION} = 'others')",
    ),
    "q24_day_counts_by_source": statement("select source, cast(created_at as date) as day, count(*) as articles, count(distinct country) as countries from articles group by 1, 2", ARTICLES),
    "s2_schedule_gaps": statement(f"select source, 'unchecked' as side from (select source from articles where {DAY} except select source from runs where {RAN}) union all select source, 'silent' from (select source from runs where {RAN} except select source from articles where {DAY})", ARTICLES, RUNS),
}
