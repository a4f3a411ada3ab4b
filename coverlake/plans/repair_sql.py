"""DuckDB statements beside the repair plans."""

from .oracle import ARTICLES, AS_OF, CATALOG, LOW_SIGNAL, RUNS, TITLE, statement

BARE = f"{TITLE} = ''"
PART = "list_filter(string_split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)), '/'), lambda x: x <> '' and x not in ('www', 'news', 'story', 'article', 'index') and not regexp_matches(x, '^[0-9]+$') and not regexp_matches(x, '^[0-9a-f]{12,}$'))[1]"

PARTS = PART.removesuffix("[1]") + "[1:2]"

SQL = {
    "m12_signature_backfill": statement(
        """select external_id, depth, signature, categories, samples from (select e.external_id, e.depth, e.signature, categories, samples, row_number() over (partition by e.external_id order by e.depth desc) as rn from each_one e join known using (source, depth, signature) where len(e.feed_categories) = 0) where rn = 1""",
        ARTICLES,
        f"""parts as (select external_id, source, feed_categories, list_filter(string_split(lower(regexp_extract(address, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)), '/'), lambda x: x <> '' and x not in ('www', 'news', 'story', 'article', 'index') and not regexp_matches(x, '^[0-9]+$') and not regexp_matches(x, '^[0-9a-f]{{12,}}$'))[1:2] as p
                   from (select *, case when event_id % 4 = 0 then 'https://' || source || '.example.com/2024/01/1' || (event_id % 3) || '/' || external_id else url end as address from articles))""",
        "each_one as (select external_id, source, feed_categories, cast(d as bigint) as depth, array_to_string(p[1:d], '/') as signature from parts, range(1, 3) r(d) where d <= len(p))",
        "samples as (select source, depth, signature, count(*) as samples from each_one where len(feed_categories) > 0 group by 1, 2, 3 having count(*) >= 3)",
        "tags as (select source, depth, signature, category, count(*) as n from (select source, depth, signature, unnest(list_distinct(feed_categories)) as category from each_one) group by 1, 2, 3, 4)",
        "known as (select source, depth, signature, samples, string_agg(category, '|' order by n desc, category) as categories from tags join samples using (source, depth, signature) where n >= 0.3 * samples group by 1, 2, 3, 4)",
    ),
    "x36_located": """with s as (select *, 'src' || s_suppkey || case when s_suppkey % 4 = 1 then ' Town' || (s_suppkey % 6) || ' Daily' else '' end as source, s_suppkey % 7 as land from supplier),
      r as (select *, case when s_suppkey % 5 = 0 then 'headquarters' when s_suppkey % 5 = 1 then 'publisher-headquarters' when s_suppkey % 4 = 1 and s_suppkey % 6 <= 3 then 'inferred-city' when s_suppkey % 3 = 0 then 'foreign-operated' when land % 2 = 0 then 'hub' else 'country-fallback' end as rung from s)
      select source, 'C' || land as country, rung, case rung when 'publisher-headquarters' then 'headquarters' else rung end as location_kind,
        cast(case rung when 'headquarters' then s_suppkey when 'publisher-headquarters' then s_suppkey + 1000 when 'inferred-city' then s_suppkey % 6 + 2000 when 'foreign-operated' then s_suppkey + 3000 when 'hub' then land + 4000 else land + 5000 end as double) as lat, 1.5 as lon from r""",
    "f10_source_prefix": statement(f"select external_id, stable_id, source, publication_datetime from articles where publication_datetime >= {AS_OF} - interval 168 hour and source like 'src1%'", ARTICLES),
    "f11_topic_keys": statement(f"select external_id, created_at from articles where created_at >= {AS_OF} - interval 480 hour and coalesce(nullif(trim(primary_section, ' '), ''), 'others') = 'tech' and list_has_any(feed_categories, ['k1', 'k3', 'view']) order by created_at desc, external_id desc limit 100", ARTICLES),
    "x09_assess_titles": statement(f"select external_id, case when {BARE} or {LOW_SIGNAL} then 'suspect' when coalesce(nullif(trim(title_quality, ' '), ''), 'ok') = 'recovered' then 'recovered' else 'ok' end as quality, case when {BARE} then 'missing_title' when {LOW_SIGNAL} then 'low_signal_title' else 'feed_title_ok' end as reason, case when {BARE} or {LOW_SIGNAL} then 'pending' else 'not_needed' end as repair from articles", ARTICLES),
    "m11_country_repairs": statement("select external_id, nullif(trim(source_country, ' '), '') as old_country, catalog_country as new_country from articles join catalog on source = catalog_source where nullif(trim(source_country, ' '), '') is distinct from catalog_country", ARTICLES, CATALOG),
    "m06_category_backfill": statement(
        "select external_id, category, support from r join (select * from (select *, row_number() over (partition by source, part order by support desc, category) as rn from (select source, part, category, count(*) as support from (select source, part, unnest(feed_categories) as category from r) where part is not null group by 1, 2, 3 having count(*) >= 3)) where rn = 1) b using (source, part) where len(feed_categories) = 0",
        ARTICLES,
        f"r as (select external_id, source, {PART} as part, feed_categories from articles)",
    ),
    "x19_local_hours": statement("select hour((ran_at at time zone 'UTC') at time zone 'America/Chicago') as hour, count(*) as attempts from runs group by 1", RUNS),
    "x36_seats": statement(
        """select source, coalesce(p.publisher, n.r_name) as seat, case when p.publisher is not null then 'source' when n.r_name is not null then 'country' else 'none' end as basis
           from (select source, first(nullif(trim(source_country, ' '), '') order by nullif(trim(source_country, ' '), '') is null, created_at, external_id) as country from articles group by 1) a
           left join catalog p on source = catalog_source left join (select n_name, r_name from nation join region on n_regionkey = r_regionkey) n on country = n_name""",
        ARTICLES,
        CATALOG,
    ),
}
