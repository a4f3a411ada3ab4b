"""DuckDB statements beside the dashboard plans."""

from .oracle import ARTICLES, AS_OF, CATALOG, LOW_SIGNAL, RUNS, VISIBLE, section_of, statement

WINDOW = f"{VISIBLE} and publication_datetime >= {AS_OF} - interval 31 day and publication_datetime <= {AS_OF} + interval 30 minute"
RECENT = f"{VISIBLE} and publication_datetime >= {AS_OF} - interval 24 hour and publication_datetime <= {AS_OF}"
STORED = "coalesce(nullif(trim(primary_section, ' '), ''), nullif(trim(section, ' '), ''), 'others')"

SQL = {
    "q01_dashboard_totals": statement(f"select count(*) as total_rows, count(*) filter (where created_at >= {AS_OF} - interval 24 hour) as inserted, count(*) filter (where publication_datetime >= {AS_OF} - interval 24 hour and publication_datetime <= {AS_OF}) as published, max(created_at) as newest from articles where {WINDOW}", ARTICLES),
    "q02_checked_sources": statement(f"select count(distinct source) as checked_sources from runs where attempted and ran_at >= {AS_OF} - interval 24 hour and ran_at <= {AS_OF} and source in (select catalog_source from catalog)", RUNS, CATALOG),
    "q03_section_totals": statement(f"select {section_of(STORED)} as section, count(*) as articles from articles where {WINDOW} group by 1", ARTICLES),
    "q04_preview_date": statement(f"select max(d) as latest_date, coalesce(max(d) filter (where d < cast({AS_OF} as date)), max(d)) as preview_date from (select cast(publication_datetime as date) as d from articles where {WINDOW})", ARTICLES),
    "q05_recent_dates": statement(f"select cast(publication_datetime as date) as day, count(*) as articles from articles where {WINDOW} group by 1 order by 1 desc limit 7", ARTICLES),
    "q06_topic_groups": statement(
        """select section, articles, unassigned, topic, count, rn from (
             select t.section, s.articles, s.unassigned, t.topic, t.n as count, row_number() over (partition by t.section order by t.n desc, t.topic) as rn
             from (select section, topic, count(*) as n from w where topic is not null group by 1, 2) t
             join (select section, count(*) as articles, count(*) filter (where topic is null) as unassigned from w group by 1) s using (section))
           where rn <= 30 and ((section = 'tech' and topic in ('topic1','topic2','topic3')) or (section = 'world' and topic in ('topic1','topic4','topic7','topic10')) or (section = 'sports' and topic in ('topic0','topic5')))""",
        ARTICLES,
        f"w as (select * from (select {STORED} as section, nullif(trim(primary_topic, ' '), '') as topic from articles where {WINDOW}) where section <> 'others')",
    ),
    "q07_category_coverage": statement(f"select count(*) as articles, count(*) filter (where len(feed_categories) > 0) as with_categories, count(*) filter (where len(feed_categories) = 0) as without_categories from articles where {WINDOW}", ARTICLES),
    "q07_top_categories": statement(f"select category, count(*) as articles, count(distinct source) as sources from (select source, nullif(trim(unnest(feed_categories), ' '), '') as category from articles where {WINDOW}) where category is not null group by 1 order by 2 desc, 1 limit 24", ARTICLES),
    "q08_preview_countries": statement(
        f"""select country, sum(n)::bigint as articles, count(*) as sources from (
              select coalesce(nullif(trim(source_country, ' '), ''), 'Global') as country, source, count(*) as n from articles where {RECENT} group by 1, 2) a
            left join catalog on source = catalog_source where coalesce(distribution_class, 'publisher') = 'publisher' group by 1 order by 2 desc, 1 limit 6""",
        ARTICLES,
        CATALOG,
    ),
    "q09_preview_headlines": statement(f"select external_id, title_original, source, publication_datetime from (select * from articles where {RECENT} order by publication_datetime desc, created_at desc, external_id limit 8) where not {LOW_SIGNAL}", ARTICLES),
}
