"""DuckDB statements beside the audit and search plans."""

from .oracle import ARTICLES, AS_OF, CATALOG, MENTIONS, VISIBLE, statement

SECTION = "coalesce(nullif(trim(section, ' '), ''), 'others')"
CLAIMED = "least(publication_datetime, created_at)"


def seen(interval: str) -> str:
    return f"created_at >= {AS_OF} - interval {interval} and created_at <= {AS_OF}"


TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce(title_original, '')), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 4))"

SQL = {
    "q10_news_search": statement(
        f"""select external_id, title_original, source, nullif(trim(source_country, ' '), '') as source_country, {SECTION} as section, publication_datetime, array_to_string(topics, ',') as topics, total, total > 70 as has_more from (
              select *, count(*) over () as total from articles where {VISIBLE} and created_at <= {AS_OF} and {CLAIMED} > {AS_OF} - interval 720 hour
                and (list_has_any(sections_normalized, ['world', 'sports']) or (len(sections_normalized) = 0 and {SECTION} in ('world', 'sports')))
                and (coalesce(title_original, '') ilike '%report 1%' or source ilike '%report 1%' or array_to_string(feed_categories, ' ') ilike '%report 1%')
              order by publication_datetime desc, external_id limit 50 offset 20)""",
        ARTICLES,
    ),
    "q10_keyset_page": statement("select external_id, created_at, source from articles where (created_at, external_id) < (TIMESTAMP '2024-01-15 00:00:00', '5000') order by created_at desc, external_id desc limit 100", ARTICLES),
    "q11_filter_values": statement(f"select distinct kind, value from (select unnest([{{'kind': 'country', 'value': nullif(trim(source_country, ' '), '')}}, {{'kind': 'source', 'value': nullif(trim(source, ' '), '')}}, {{'kind': 'section', 'value': nullif(trim(section, ' '), '')}}], recursive := true) from articles where {VISIBLE}) where value is not null", ARTICLES),
    "q37_mention_summary": statement(
        f"""select entity_type, count(*) as articles, count(distinct source) as sources, count(distinct case when {SECTION} = 'world' then source end) as world_sources, bool_or(section = 'sports') as any_sports, array_to_string(list_sort(list(distinct source))[1:5], ',') as first_sources
            from articles join (select distinct article_external_id, entity_type from mentions) on external_id = article_external_id where {VISIBLE} and {seen('30 day')} group by 1""",
        ARTICLES, MENTIONS,
    ),
    "q37_mention_lane": statement(f"select count(*) as articles, count(*) filter (where external_id in (select article_external_id from mentions)) as named from articles where {VISIBLE} and {seen('30 day')}", ARTICLES, MENTIONS),
    "q38_latest_snapshots": "select o_custkey, o_orderkey, o_orderstatus, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) where rn = 1",
    "q38_roster": "select c_custkey, c_mktsegment, rn, o_orderkey, o_totalprice from customer left join (select * from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders) where rn <= 2) on c_custkey = o_custkey",
    "q46_country_report": statement(
        f"""select coalesce(p.country, a.country, c.country) as country, coalesce(core_inserted, 0) as core_inserted, coalesce(portal_inserted, 0) as portal_inserted, coalesce(late, 0) as late, coalesce(covered, 0) as covered,
              case when coalesce(core_inserted + portal_inserted, 0) > 0 then round(late / (core_inserted + portal_inserted), 6) else 0.0 end as late_share
            from (select coalesce(catalog_country, nullif(trim(source_country, ' '), ''), 'Global') as country, count(*) filter (where {seen('24 hour')} and coalesce(distribution_class, 'publisher') <> 'portal') as core_inserted, count(*) filter (where {seen('24 hour')} and coalesce(distribution_class, 'publisher') = 'portal') as portal_inserted, count(*) filter (where {seen('24 hour')} and publication_datetime < {AS_OF} - interval 24 hour) as late from articles left join catalog on source = catalog_source group by 1) p
            full join (select coalesce(nullif(trim(country, ' '), ''), 'Global') as country, count(*) filter (where {seen('24 hour')}) as covered from articles group by 1) a on p.country = a.country
            full join (select distinct catalog_country as country from catalog) c on coalesce(p.country, a.country) = c.country""",
        ARTICLES, CATALOG,
    ),
    "q47_taxonomy_totals": statement(f"select count(*) as articles, round(100.0 * count(*) filter (where {SECTION} = 'others') / count(*), 1)::double as others_percent, round(100.0 * count(*) filter (where len(feed_categories) > 0) / count(*), 1)::double as categories_percent, round(100.0 * count(*) filter (where nullif(trim(primary_topic, ' '), '') is not null) / count(*), 1)::double as topic_percent from articles where {seen('720 hour')}", ARTICLES),
    "q47_taxonomy_by_source": statement(f"select *, round(100.0 * others / articles, 1)::double as others_percent from (select source, count(*) as articles, count(*) filter (where {SECTION} = 'others') as others, count(*) filter (where len(feed_categories) = 0) as without_categories, count(*) filter (where nullif(trim(primary_topic, ' '), '') is null) as without_topic from articles where {seen('720 hour')} group by 1 having count(*) >= 5)", ARTICLES),
    "q47_category_sections": statement(
        f"""select category, sum(n)::bigint as articles, string_agg(section || ':' || n, ', ' order by rn) as sections from (select *, row_number() over (partition by category order by n desc, section) as rn from (select category, section, count(*) as n from (select {SECTION} as section, unnest(feed_categories) as category from articles where {seen('720 hour')}) group by 1, 2)) where rn <= 3 group by 1""",
        ARTICLES,
    ),
    "q48_others_by_source": statement(
        f"""select source, label, n, rn from (select *, row_number() over (partition by source order by n desc, label) as rn from (select source, label, count(*) as n from (
              select source, case when (k % 7) / 10.0 > (k % 5) / 10.0 and (k % 7) / 10.0 > (k % 3) / 10.0 then 'world'
                when (k % 5) / 10.0 > (k % 3) / 10.0 and (k % 5) / 10.0 >= (k % 7) / 10.0 then 'tech' when (k % 3) / 10.0 >= (k % 5) / 10.0 and (k % 3) / 10.0 >= (k % 7) / 10.0 then 'sports' else 'tech' end as label
              from articles where {SECTION} = 'others' and {seen('30 day')}) group by 1, 2)) where rn <= 3""",
        ARTICLES,
    ),
    "q49_topic_audit": statement(f"select coalesce(nullif(trim(t, ' '), ''), '(empty)') as topic, count(*) as articles, count(distinct source) as sources from (select source, unnest(case when len(topics) = 0 then [null] else topics end) as t from articles where {seen('30 day')}) group by 1", ARTICLES),
    "q50_url_sample": statement(f"select source, external_id, url from (select *, row_number() over (partition by source order by created_at desc, external_id desc) as rn from articles where {seen('240 hour')}) where rn = 1", ARTICLES),
    "q51_url_drift": statement(
        """select external_id, other_id, overlap, containment, jaccard, gap from (select *, row_number() over (partition by external_id order by containment desc, jaccard desc, gap, other_id) as rn from (
              select *, round(overlap / least(len(a_tokens), len(b_tokens)), 6) as containment, round(overlap / (len(a_tokens) + len(b_tokens) - overlap), 6) as jaccard from (
                select a.external_id, b.external_id as other_id, a.tokens as a_tokens, b.tokens as b_tokens, len(list_intersect(a.tokens, b.tokens)) as overlap, cast(abs(a.at - b.at) as bigint) as gap
                from t a join t b on a.source = b.source and a.stable_id is null and b.stable_id is not null and abs(a.at - b.at) <= 36 * 3600 and (a.day is null or b.day is null or a.day = b.day))
              where overlap >= 4 and containment >= 0.6 and jaccard >= 0.5)) where rn = 1""",
        ARTICLES, f"t as (select external_id, stable_id, source, floor(epoch(publication_datetime)) as at, case when event_id % 4 = 0 then event_id % 3 end as day, {TOKENS} as tokens from articles where len({TOKENS}) >= 4)",
    ),
    "o04_search_estimate": statement(
        f"""select external_id, title_original, source, publication_datetime, cast(least((select count(*) from shown), 50) + 20 + (case when (select count(*) from shown) > 50 then 1 else 0 end) as bigint) as total, (select count(*) from shown) > 50 as has_more, true as total_is_estimate
            from (select * from shown order by publication_datetime desc, external_id limit 50)""",
        ARTICLES,
        f"""shown as (select external_id, title_original, source, publication_datetime from articles where {VISIBLE} and created_at <= {AS_OF} and {CLAIMED} > {AS_OF} - interval 720 hour
                and (list_has_any(sections_normalized, ['world', 'sports']) or (len(sections_normalized) = 0 and {SECTION} in ('world', 'sports')))
                and (coalesce(title_original, '') ilike '%report 1%' or source ilike '%report 1%' or array_to_string(feed_categories, ' ') ilike '%report 1%')
              order by publication_datetime desc, external_id limit 51 offset 20)""",
    ),
    "q52_category_prediction": statement(
        """select token, category, support, articles, round(support / articles, 6) as share from (select token, category, count(*) as support from (select token, unnest(feed_categories) as category from (select feed_categories, unnest(tokens) as token from t)) group by 1, 2)
           join (select token, count(*) as articles from (select unnest(tokens) as token from t) group by 1) using (token) where support >= 3 and round(support / articles, 6) >= 0.4""",
        ARTICLES, "t as (select feed_categories, list_distinct(list_filter(string_split(regexp_extract(url, '^https?://[^/]+/(.*)$', 1), '/'), lambda x: length(x) >= 3 and not regexp_matches(x, '^[0-9]+$'))) as tokens from articles)",
    ),
    "q53_title_lift": statement(
        f"""select source, titles, coalesce(new_titles, 0) as new_titles from (select source, count(*) as titles from new group by 1) left join (select source, count(*) as new_titles from new where title not in (select title from rows0 where not new) group by 1) using (source)""",
        ARTICLES, f"rows0 as (select source, lower(nullif(trim(title_original, ' '), '')) as title, created_at >= {AS_OF} - interval 5 day as new from articles where created_at <= {AS_OF} and nullif(trim(title_original, ' '), '') is not null)", "new as (select distinct source, title from rows0 where new)",
    ),
    "q54_country_stats": statement(f"select coalesce(nullif(trim(country, ' '), ''), 'Global') as country, count(*) as total, count(*) filter (where {seen('24 hour')}) as last_24h, max(publication_datetime) as newest from articles group by 1", ARTICLES),
    "q24_hourly_running": statement("select day, hour, articles, cast(sum(articles) over (partition by day order by hour) as bigint) as running from (select cast(created_at as date) as day, hour(created_at) as hour, count(*) as articles from articles group by 1, 2)", ARTICLES),
}
