"""DuckDB statements beside the lane plans."""

from .oracle import ARTICLES, AS_OF, CATALOG, MENTIONS, VISIBLE, statement

SEEN = f"created_at >= {AS_OF} - interval 30 day and created_at <= {AS_OF}"
SHOWN = f"shown as (select * from articles where {VISIBLE} and {SEEN})"
SECTION = "coalesce(nullif(trim(section, ' '), ''), 'others')"
W, T, S = "(k % 7) / 10.0", "(k % 5) / 10.0", "(k % 3) / 10.0"
BEST = f"best as (select *, case when {S} >= {T} and {S} >= {W} then 'sports' when {T} >= {W} then 'tech' else 'world' end as label, greatest({W}, {T}, {S}) as score from articles where {SECTION} = 'others' and {SEEN})"
FIVE = f"created_at >= {AS_OF} - interval 5 day and created_at <= {AS_OF}"

SQL = {
    "q37_mentions_by_day": statement("select cast(created_at as date) as day, count(distinct external_id) as articles, count(distinct entity_id) as entities, count(*) as mentions from shown join (select distinct article_external_id, entity_id from mentions) on external_id = article_external_id group by 1", ARTICLES, MENTIONS, SHOWN),
    "q37_top_entities": statement("select entity_id, count(*) as articles, count(distinct source) as sources, last(external_id order by created_at, external_id) as newest from shown join (select distinct article_external_id, entity_id from mentions) on external_id = article_external_id group by 1 order by 2 desc, 1 limit 20", ARTICLES, MENTIONS, SHOWN),
    "q37_unmentioned": statement("select external_id, source, created_at from shown where external_id not in (select article_external_id from mentions) order by created_at desc, external_id desc limit 50", ARTICLES, MENTIONS, SHOWN),
    "q48_others_by_section": statement("select label, count(*) as articles, round(avg(score::double), 6) as mean_score, count(distinct source) as sources from best group by 1", ARTICLES, BEST),
    "q48_others_titles": statement("select label, rn, external_id, title_original from (select *, row_number() over (partition by label order by created_at desc, external_id desc) as rn from best) where rn <= 3", ARTICLES, BEST),
    "q53_candidate_sources": statement(
        "select source, raw, titles, coalesce(lift, 0) as lift, case when coalesce(lift, 0) >= 3 then 'add_now' else 'monitor' end as recommendation from (select source, count(*) as raw, count(distinct title) as titles from fresh group by 1) left join (select source, count(distinct title) as lift from fresh where title not in (select title from r where source in (select catalog_source from catalog)) group by 1) using (source)",
        ARTICLES,
        CATALOG,
        f"r as (select source, lower(nullif(trim(title_original, ' '), '')) as title from articles where {FIVE} and nullif(trim(title_original, ' '), '') is not null)",
        "fresh as (select * from r where source not in (select catalog_source from catalog))",
    ),
    "x39_foreign_operated": statement("select source, catalog_country, country as main_country, country <> catalog_country as foreign_operated from (select *, row_number() over (partition by source order by n desc, country) as rn from (select source, country, count(*) as n from articles where nullif(trim(country, ' '), '') is not null group by 1, 2)) join catalog on source = catalog_source where rn = 1", ARTICLES, CATALOG),
}
