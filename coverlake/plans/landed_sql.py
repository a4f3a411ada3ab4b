"""DuckDB statements beside the plans over landed documents: the rows that the documents were written from."""

from .oracle import ARTICLES, AS_OF, statement

WHOLE = "date_trunc('second', publication_datetime)"

RULE = "case language_hint when 'view' then 'world' when 'click' then 'sports' when 'purchase' then 'business' when 'signup' then 'tech' when 'error' then 'science' end"
KIND = "case when event_id % 3 = 0 then 'meta' when event_id % 3 = 1 then 'breadcrumb' when event_id % 2 = 0 then 'keywords' when event_id % 5 <> 0 then 'context' else 'none' end"

SQL = {
    "sc06_sitemap_tree": statement(
        "select source as root, 'https://' || source || '.example.com/sitemap/news/leaf-' || n || '.xml' as url, n + 1 as depth from (select distinct source from articles), range(4) r(n)", ARTICLES
    ),
    "sc06_sitemap_children": statement(
        f"""select source, loc, cast(score as integer) as score, rank from (select *, row_number() over (partition by source order by score desc, changed desc nulls last, dated desc nulls last, event_id desc) as rank from (
              select *, [180, 520, 600, -420, 80, -220, 180, 0][event_id % 8 + 1] + case when changed >= {AS_OF} - interval 2 day then 220 when changed < {AS_OF} - interval 60 day then -120 else 0 end as score from (
                select source, event_id, 'https://' || source || '.example.com' || replace(['/sitemap/news/%.xml', '/a%/video-sitemap.xml', '/a%/news-sitemap.xml.gz', '/tag-%.xml', '/2024/01/x%.xml', '/2023-11/z%.xml', '/posts/%.xml', '/plain-%.xml'][event_id % 8 + 1], '%', cast(event_id as varchar)) as loc,
                  case when event_id % 5 = 0 then TIMESTAMP '2023-10-01 00:00:00' when event_id % 3 <> 0 then {WHOLE} end as changed, case event_id % 8 when 4 then DATE '2024-01-01' when 5 then DATE '2023-11-01' end as dated from articles)) where score > 0) where rank <= 24""",
        ARTICLES,
    ),
    "sc07_page_sections": statement(
        f"""select external_id as page_id, case when kind = 'none' then 'others' else {RULE} end as section, kind, case kind when 'meta' then language_hint when 'breadcrumb' then language_hint || ' pages' when 'keywords' then language_hint || ' one' end as signal
            from (select *, {KIND} as kind from articles)""",
        ARTICLES,
    ),
    "m12_stable_ids": statement("select external_id, 'late-' || external_id as stable_id from articles where stable_id is null and event_id % 2 = 0", ARTICLES),
    "sc03_feed_items": statement(
        f"""select source as doc_id, rn - 1 as at, title, url as link, stable_id as feed_id, date as published_at, array_to_string(feed_categories, '|') as categories,
              array_to_string(list_filter([case when title = '' then 'title' end, 'description', case when date is null then 'published_at' end], lambda v: v is not null), '|') as missing
            from (select *, coalesce(trim(regexp_replace(title_original, '\\s+', ' ', 'g'), ' '), '') as title, case when event_id % 3 <> 0 then {WHOLE} end as date, row_number() over (partition by source order by event_id) as rn from articles) where rn <= 10""",
        ARTICLES,
    ),
    "sc04_sitemap_entries": statement(
        f"""select source as doc_id, rank, url as link, date as published_at from (select *, row_number() over (partition by source order by date desc nulls last, event_id) as rank from (
              select *, case when event_id % 4 <> 0 then {WHOLE} end as date from articles where event_id % 7 <> 0)) where rank <= 12""",
        ARTICLES,
    ),
    "x_text_values": statement(
        f"""select external_id, url || '?a=1&b=2' as address, case when stable_id is null then '' else 'feed:' || source || '.example.com:' || stable_id end as feed_id, trim(regexp_replace('A & B ' || coalesce(title_original, ''), '\\s+', ' ', 'g'), ' ') as plain,
              'elan ' || source as folded, 'Mayor of ' || language_hint as linked_title, date_trunc('second', created_at) - interval 1 hour as moment, case when event_id % 4 > 0 then make_date(2024, 2, cast(event_id % 4 as integer)) end as day, {AS_OF} - (event_id % 50) * interval 1 hour as since from articles""",
        ARTICLES,
    ),
}
