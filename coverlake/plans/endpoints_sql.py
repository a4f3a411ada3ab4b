"""DuckDB statements beside the plans over endpoints, places, words of addresses and the news API."""

from .endpoints import INDEX, JITTER, NEWS, PROFILES, STOP
from .oracle import ARTICLES, AS_OF, RUNS, VISIBLE, statement

SITE = "'https://src' || s_suppkey || '.example.com'"
ENDPOINTS = f"""ends0 as (
  select 'src' || s_suppkey as source, 'C' || (s_suppkey % 7) as country, s_suppkey % 3 <> 0 as has_rss,
    lower(case s_suppkey % 8 when 0 then '' when 7 then null else {SITE} || ['/sitemap-index.xml', '/news-sitemap.xml', '/sitemap.xml', '/maps/NEWS.xml?x=1', '/sitemaps/index-2.xml', '/map_news/1'][s_suppkey % 8] end) as map from supplier
),
ends1 as (select *, case when coalesce(map, '') = '' then 'none' when regexp_matches(map, '{INDEX}') then 'sitemap_index' when regexp_matches(map, '{NEWS}') then 'news_sitemap' else 'other_sitemap' end as kind from ends0),
ends as (select *, case when kind = 'none' then 'rss_only' when has_rss then 'rss_plus_' || kind else kind || '_only' end as profile from ends1)"""
LOW = "case s_suppkey % 3 " + " ".join(f"when {k} then {b[0]}::double" for k, b in enumerate(JITTER.values())) + " end"
HIGH = "case s_suppkey % 3 " + " ".join(f"when {k} then {b[1]}::double" for k, b in enumerate(JITTER.values())) + " end"
WORDS = """list_filter(list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]{{2,}}')), lambda w: w not in ({1}) and not regexp_full_match(w, '[0-9]+'))"""
STOPPED = ", ".join(f"'{w}'" for w in STOP)
LANGUAGE = """news as (
  select *, case when event_id % 9 = 0 then ' ' when event_id % 10 = 0 then null else ['en', 'De', 'fr ', 'es'][event_id % 4 + 1] end as language, created_at + (event_id % 50) * interval 1 hour as updated_at,
    least(publication_datetime, created_at) as claimed from articles
)"""
SHOWN = "external_id, source, language, country, claimed as published_at, updated_at"


def page(where: str, limit: int, offset: int) -> str:
    return statement(
        f"""select {SHOWN}, total, total > {offset + limit} as has_more from (select *, count(*) over () as total from news where {VISIBLE} and claimed <= {AS_OF} + interval 15 minute and {where})
            order by claimed desc, created_at desc, external_id limit {limit} offset {offset}""",
        ARTICLES, LANGUAGE,
    )


ASKED = ", ".join(f"('{k}', '{m}')" for k in (1, 2, 3, 5, 8, 13, 999) for m in ("rss", "sitemap"))

SQL = {
    "sc10_asked_watermarks": statement("select outlet_id, method, max(newest_item_published_at) as last_publication_at from wanted left join runs using (outlet_id, method) group by 1, 2", RUNS, f"wanted(outlet_id, method) as (values {ASKED})"),
    "x38_headquarters": """select case when s_suppkey % 2 = 0 then ' ' || upper(s_name) else s_name end as publisher, 'C' || (s_suppkey % 4) as country, case when s_suppkey % 5 > 0 and s_suppkey % 3 > 0 then 'First ' else 'Second ' end || s_suppkey as city,
      cast(s_suppkey + case when s_suppkey % 5 > 0 and s_suppkey % 3 > 0 then 1 else 2 end as double) as lat, cast(-s_suppkey as double) as lon from supplier""",
    "a24_endpoint_profiles": "with " + ENDPOINTS + " select country, " + ", ".join(f"count(*) filter (where profile = '{p}') as {p}" for p in PROFILES) + " from ends group by 1",
    "x40_sitemap_kinds": "with " + ENDPOINTS + " select source, kind, profile from ends",
    "x35_moved_places": f"""
      with a as (select s_suppkey, cast(s_suppkey % 170 - 85 as double) as lat, cast(s_suppkey % 360 - 180 as double) as lon, cast('0x' || substr(md5(s_name || '|' || s_suppkey), 1, 8) as bigint) as h from supplier),
      b as (select *, (h % 360) * (3.141592653589793::double / 180) as angle, {LOW} + ((h >> 8) % 100) / 100 * ({HIGH} - {LOW}) as radius from a)
      select s_suppkey, round(lat + sin(angle) * radius, 4) as lat, round(lon + cos(angle) * radius * greatest(0.35::double, cos(lat * 3.141592653589793::double / 180)), 4) as lon from b""",
    "x49_url_words": statement(
        f"select external_id, array_to_string(list_sort({WORDS.format("'src' || user_id || '.example.com /' || event_type || '/' || event_id || '/latest-src' || user_id || '/café_2024+x1.html'", STOPPED)}), ',') as words from (select *, cast(substr(source, 4) as int) as user_id, language_hint as event_type from articles)",
        ARTICLES,
    ),
    "q52_word_predictions": statement(
        f"""select source, word, category, support, samples, share from (
              select *, round(support / samples, 6) as share from (select source, word, category, count(*) as support from told, unnest(words) w(word), unnest(categories) c(category) group by all)
              join (select source, word, count(*) as samples from told, unnest(words) w(word) group by all having count(*) >= 3) using (source, word)) where share >= 0.4""",
        ARTICLES, f"told as (select source, {WORDS.format("source || '.example.com ' || language_hint || '/' || event_id", STOPPED)} as words, list_distinct(feed_categories) as categories from articles where len(feed_categories) > 0)",
    ),
    "q10_news_read": page(
        """source in ('src1', 'src2', 'src3') and language in ('en', 'De') and (list_has_any(sections_normalized, ['world', 'sports', 'business']) or len(sections_normalized) = 0 and coalesce(nullif(trim(section, ' '), ''), 'others') in ('world', 'sports', 'business'))
           and (coalesce(title_original, '') ilike '%k1%' or source ilike '%k1%' or coalesce(country, '') ilike '%k1%' or array_to_string(feed_categories, ' ') ilike '%k1%')
           and claimed >= TIMESTAMP '2024-01-03 00:00:00' and claimed <= TIMESTAMP '2024-01-19 12:00:00' and created_at >= TIMESTAMP '2024-01-02 00:00:00' and updated_at <= TIMESTAMP '2024-01-20 00:00:00'""", 40, 0
    ),
    "q10_news_recent": page(f"claimed > {AS_OF} - interval 96 hour", 25, 10),
    "q11_filter_lists": statement(
        f"""select kind, row_number() over (partition by kind order by lower(value), value) as place, value from (
              select 'country' as kind, trim(country, ' ') as value from news where {VISIBLE} union select 'language', trim(language, ' ') from news where {VISIBLE} union select 'source', trim(source, ' ') from news where {VISIBLE}) where value <> ''""",
        ARTICLES, LANGUAGE,
    ),
}
