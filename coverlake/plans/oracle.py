"""Shared parts of the DuckDB statements: the adapters' relations as common table expressions."""

AS_OF = "TIMESTAMP '2024-01-20 12:34:56'"

ARTICLES = """
art0 as (
  select e.*, p.n_name as _publisher, g.n_name as _place, cast(json_extract_string(props, '$.k') as integer) as k
  from events e join nation p on e.user_id % 5 = p.n_nationkey join nation g on e.event_id % 25 = g.n_nationkey
),
articles as (
  select cast(event_id as varchar) as external_id, event_id,
    case when event_id % 3 = 0 then 'guid-' || cast(event_id // 2 as varchar) end as stable_id,
    case when event_id % 101 = 0 then ts + interval 2 hour else ts - (event_id % 97) * interval 30 minute end as publication_datetime,
    ts as created_at, 'src' || user_id as source,
    case when event_id % 11 = 0 then '' when event_id % 17 = 0 then null else _publisher end as source_country,
    case when event_id % 19 = 0 then null else _place end as country,
    case when event_id % 13 = 0 then 'suspect' when event_id % 7 = 0 then ' ' else 'ok' end as title_quality,
    case when event_id % 23 = 0 then 'https://src' || user_id || '.example.com/' || event_type || '/' || event_id when event_id % 29 = 0 then null
      when event_id % 31 = 0 then cast(1000000 + event_id as varchar) else event_type || ' report ' || (event_id % 500) || ' from desk k' || k end as title_original,
    'https://src' || user_id || '.example.com/' || event_type || '/' || event_id as url,
    case event_type when 'view' then 'world' when 'click' then 'sports' when 'purchase' then 'business' when 'signup' then 'local' else '' end as section,
    case when event_id % 6 = 0 then 'tech' when event_id % 6 = 1 then '  ' end as primary_section,
    case when event_id % 4 = 0 then null when event_id % 9 = 0 then '' else 'topic' || (k % 12) end as primary_topic,
    case when event_id % 5 = 0 then cast([] as varchar[]) else [event_type, 'k' || (k % 5)] end as feed_categories,
    case when event_id % 4 = 0 then cast([] as varchar[]) else ['topic' || (k % 12), event_type] end as topics,
    case when event_id % 8 = 0 then cast([] as varchar[]) else [case event_type when 'view' then 'world' when 'click' then 'sports' else 'business' end] end as sections_normalized,
    event_type as language_hint, k
  from art0
)"""

RUNS = """
runs as (
  select event_id as id, ts as ran_at, case when event_id % 9 = 0 then 'warm' else 'worker' end as runner, cast(user_id as varchar) as outlet_id, 'src' || user_id as source,
    case when event_id % 2 = 0 then 'rss' else 'sitemap' end as method, n_name as country, event_type <> 'signup' as attempted, event_type <> 'error' as ok, event_id % 37 = 0 as circuit_open,
    case when event_type <> 'error' then 200 when event_id % 5 = 0 then 403 when event_id % 5 = 1 then 404 when event_id % 5 = 2 then 500 end as status_code,
    cast(floor(value) as bigint) as fetched_count, cast(floor(value / 2) as bigint) as parsed_count, event_id % 41 = 0 as sample_capped,
    'https://src' || user_id || '.example.com/' || case when event_id % 2 = 0 then 'rss' else 'sitemap' end || '/' || (event_id % 3) as requested_url,
    case event_id % 3 when 0 then null when 1 then '' else 'timeout ' || event_type end as error,
    case when event_id % 10 < 6 then 'healthy' when event_id % 10 = 6 then 'warning' when event_id % 10 = 7 then ' Degraded ' when event_id % 10 = 8 then 'failing' end as health_classification,
    case when event_id % 4 = 0 then null else ts - (event_id % 40) * interval 1 day end as newest_item_published_at,
    event_id % 3 as missing_title_count, event_id % 2 as missing_link_count
  from events join nation on user_id % 5 = n_nationkey
)"""

CATALOG = """
catalog as (
  select 'src' || s_suppkey as catalog_source, n_name as catalog_country, case when s_suppkey % 7 = 0 then 'portal' else 'publisher' end as distribution_class, s_name as publisher, s_acctbal
  from supplier join nation on s_suppkey % 5 = n_nationkey
)"""

MENTIONS = """
mentions as (
  select cast(l_orderkey % (select count(*) from events) as varchar) as article_external_id, p_type as entity_type, cast(l_suppkey as varchar) as entity_id, l_shipdate as mentioned_at
  from lineitem join part on l_partkey = p_partkey
)"""

VISIBLE = "coalesce(nullif(trim(title_quality, ' '), ''), 'ok') <> 'suspect'"
TITLE = "coalesce(nullif(trim(title_original, ' '), ''), '')"
#: The same fixed values as in functions.exprs: titles that say nothing, as whole-title patterns.
LOW_SIGNAL = f"""(coalesce(nullif(trim(title_quality, ' '), ''), 'ok') = 'suspect' or {TITLE} = coalesce(url, '') or {TITLE} ilike 'http%'
  or regexp_matches({TITLE}, '^(c[0-9]+\\s+[0-9]+(?:\\.html)?|art[- ]?[0-9]+(?:\\.html)?|story[0-9]{{8}}(?:[-_ ]?[0-9]+)?(?:\\.html)?|[0-9]{{6,}}|news|latest|domestic|international|photo|video)$', 'i')
  or regexp_matches({TITLE}, '^[0-9a-f]{{32}}$', 'i') or regexp_matches({TITLE}, '^Cision[[:alnum:]]+$', 'i') or regexp_matches({TITLE}, '^Catalog(?:\\.aspx)?(?:\\?.+)?$', 'i')
  or (source ilike '%oricon%' and regexp_matches({TITLE}, '^(full|news|anime|comic|voiceactor)$', 'i'))
  or (source ilike '%abema times%' and regexp_matches({TITLE}, '^(full|news|anime)$', 'i'))
  or (source ilike '%parapolitika%' and regexp_matches({TITLE}, '^[a-z0-9_-]{{4,180}}$', 'i')))"""


def statement(select: str, *relations: str) -> str:
    return "with " + ",\n".join(relations) + "\n" + select


def section_of(column: str) -> str:
    return f"case when lower(trim({column}, ' ')) in ('world','politics','conflicts','business','tech','sports','health','entertainment','lifestyle','arts','science','climate','others') then lower(trim({column}, ' ')) else 'others' end"
