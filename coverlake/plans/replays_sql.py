"""DuckDB statements beside the forms of streams and stores: what comes out whatever came twice."""

from .oracle import ARTICLES, AS_OF, RUNS, statement

AGED = "aged as (select * replace (case when event_id % 12 = 0 then null when event_id % 8 = 0 then created_at - interval 9 day when event_id % 16 = 4 then created_at - interval 7 day else publication_datetime end as publication_datetime) from articles)"
LATENESS = "case when publication_datetime is null then 'undated' when publication_datetime < created_at - interval 7 day then 'old' when publication_datetime < created_at - interval 24 hour then 'late' else 'fresh' end"


def shot(window: str, hours: int, day: str) -> str:
    return f"""select '{window}' as metric_window, 'v1' as metric_version, TIMESTAMP '{day} 00:00:00' as generated_at, row_number() over (order by country) - 1 as place, country, articles, sources, cast(null as varchar) as nothing
      from (select coalesce(country, 'Global') as country, count(*) as articles, count(distinct source) as sources from articles where created_at >= {AS_OF} - interval {hours} hour and created_at <= {AS_OF} group by 1)"""


SQL = {
    "m10_rollup_replay": statement(
        """select date_trunc('hour', ran_at) as bucket, runner, outlet_id, method, cast(sum(cast(attempted as int)) as bigint) as attempted_runs, cast(sum(cast(attempted and not ok as int)) as bigint) as failed_runs,
             cast(sum(coalesce(fetched_count, 0)) as bigint) as fetched_count, count(*) as diagnostics from runs group by 1, 2, 3, 4""",
        RUNS,
    ),
    "st2_lateness": statement("select cast(created_at as date) as day, " + ", ".join(f"count(*) filter (where {LATENESS} = '{x}') as {x}" for x in ("fresh", "late", "old", "undated")) + " from aged group by 1", ARTICLES, AGED),
    "st2_late_rows": statement(f"select {LATENESS} as lateness, count(*) as seen, case when {LATENESS} = 'old' then 0 else count(*) end as kept from aged group by 1", ARTICLES, AGED),
    "sk5_variant_snapshots": statement(shot("24h", 24, "2024-01-20") + " union all " + shot("7d", 168, "2024-01-19"), ARTICLES),
    "sc05_list_pages": statement(
        """select source, ['data', 'cards', 'dated', 'state'][kind + 1] as extractor, rank,
             'https://www.' || source || '.s' || kind || '.example.com' || case kind when 0 then '/d/' when 1 then '/a/' when 2 then '/n/' || day || '/' else '/artikel/' end || external_id as link, 'No ' || external_id || ' <& of ' || language_hint as title,
             case when kind = 2 then cast(day as timestamp) + interval 12 hour else date_trunc('second', publication_datetime) end as date
           from (select *, cast(substr(source, 4) as int) % 4 as kind, strftime(publication_datetime, '%Y-%m-%d') as day, row_number() over (partition by source order by event_id) as rank from articles) where rank <= 20""",
        ARTICLES,
    ),
    "sc07_all_signals": statement(
        """select page_id, array_to_string(told, '|') as signals, len(told) as n from (select external_id as page_id, list_concat(
             case when event_id % 4 = 1 then ['meta:' || language_hint || ' & more'] else [] end, case when event_id % 3 = 0 then ['article_section:' || language_hint] else [] end, case when event_id % 5 < 2 then ['article_section:' || language_hint || ' one'] else [] end,
             case when event_id % 3 = 0 then ['breadcrumb:Home', 'breadcrumb:' || language_hint || ' pages'] else [] end, case when event_id % 4 = 1 then ['keywords:x', 'keywords:y', 'keywords:' || language_hint] else [] end,
             case when event_id % 3 = 0 then ['keywords:k1', 'keywords:' || language_hint] else [] end, case when event_id % 5 < 2 then ['keywords:a b', 'keywords:' || language_hint] else [] end) as told from articles) where len(told) > 0""",
        ARTICLES,
    ),
    "x01_addresses": statement(
        """select external_id, ['https://src', 'https://xn--mnchen-3ya.src', 'http://src', 'https://u@src'][event_id % 4 + 1] || k || '.example.com' || case when event_id % 3 = 0 and event_id % 4 = 2 then ':443' when event_id % 3 = 1 then ':8080' else '' end
             || '/a/c%20d/%C3%A9?a=%7E%C3%BC&B=' || external_id || '&z=1' as address from articles""",
        ARTICLES,
    ),
    "sk2_replaced_partitions": statement(
        """select section, version, count(*) as articles from (select coalesce(nullif(section, ''), 'others') as section, event_id, case when section in ('world', 'tech', 'local') then 2 else 1 end as version from articles) where version = 1 or event_id % 3 = 0 group by 1, 2""",
        ARTICLES,
    ),
    "sk1_merged_table": statement("select external_id, source, title_original, created_at, array_to_string(list_sort(list_distinct(topics)), '|') as topics from articles", ARTICLES),
    "sc02_catalog_file": """
      select country, source, min_by(url, k) filter (where url is not null) as url, min_by(sitemap, k) filter (where sitemap is not null) as sitemap, max(class) as distribution_class from (
        select s_suppkey as k, 'C' || (s_suppkey % 100 - s_suppkey % 4) as country, 'src' || (s_suppkey - s_suppkey % 4) as source, case when s_suppkey % 4 > 0 then 'https://e.org/' || s_suppkey end as url,
          case when s_suppkey % 4 <> 1 then 'https://m.org/' || s_suppkey end as sitemap, case when s_suppkey % 4 = 2 then 'portal' else 'publisher' end as class from supplier) group by 1, 2""",
    "sc09_landed_bytes": statement("select external_id, case when event_id % 5 = 3 then '<?xml version=\"1.0\" encoding=\"iso-8859-1\"?>' else '' end || 'Größe é ' || coalesce(title_original, '') as body from articles", ARTICLES),
    "x51_names_and_handles": """select s_suppkey, case s_suppkey % 5 when 0 then 'src' || s_suppkey when 1 then 'src' || s_suppkey when 3 then 'src_' || s_suppkey end as handle,
      case s_suppkey % 3 when 0 then 'First' || s_suppkey || ' Last' || s_suppkey when 1 then 'Name X' || s_suppkey else '' end as name from supplier""",
}
