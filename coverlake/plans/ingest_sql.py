"""DuckDB statements beside the ingest plans."""

from .oracle import ARTICLES, AS_OF, RUNS, statement
from .ops_sql import rolled

OLD = "old as (select * from articles where created_at < TIMESTAMP '2024-01-16 00:00:00')"
NEW = """fresh as (select * replace (case when event_id % 10 = 0 then 'suspect' else title_quality end as title_quality, case when event_id % 15 = 0 then url else title_original end as title_original, list_concat(topics, ['again', ' ']) as topics, created_at + interval 1 hour as created_at), event_id as seq
  from articles where created_at >= TIMESTAMP '2024-01-10 00:00:00')"""
GOOD = lambda c: f"coalesce(nullif(trim({c}, ' '), ''), 'ok')"
UNITED = lambda c: f"list_sort(list_distinct(list_filter({c}, lambda v: v is not null and trim(v, ' ') <> '')))"
RANK = "case title_quality when 'suspect' then 0 when 'recovered' then 2 else 1 end"


def deduped(source: str, key: str) -> str:
    keep = "external_id, publication_datetime, created_at, source, title_original, title_quality, url, primary_section, primary_topic, seq"
    firsts = ", ".join(f"first({c} order by rn) as {c}" for c in keep.split(", "))
    filled = ", ".join(
        f"first({c} order by rn) filter (where nullif(trim({c}, ' '), '') is not null) as {c}" for c in ("stable_id", "source_country")
    )
    lists = ", ".join(UNITED(f"flatten(list({c}))") + f" as {c}" for c in ("feed_categories", "topics", "sections_normalized"))
    return f"select {firsts}, {filled}, {lists} from (select *, {key} as grp, row_number() over (partition by {key} order by {RANK} desc, publication_datetime desc, seq) as rn from {source}) group by grp"


KEEP_QUALITY = f"({GOOD('o.title_quality')} in ('ok', 'recovered') and {GOOD('n.title_quality')} = 'suspect')"
KEEP_TITLE = f"({KEEP_QUALITY} or coalesce((n.title_original = n.url or n.title_original like 'http%') and o.title_original is not null and o.title_original <> '' and not (o.title_original = o.url or o.title_original like 'http%'), false))"
RULES = {
    "created_at": "o.created_at", "publication_datetime": "least(n.publication_datetime, o.created_at)", "stable_id": "coalesce(n.stable_id, o.stable_id)", "primary_section": "coalesce(n.primary_section, o.primary_section)", "primary_topic": "coalesce(n.primary_topic, o.primary_topic)",
    "source_country": "coalesce(n.source_country, o.source_country)", "title_original": f"case when {KEEP_TITLE} then o.title_original else n.title_original end", "title_quality": f"case when {KEEP_QUALITY} then o.title_quality else n.title_quality end",
    "sections_normalized": UNITED("list_concat(o.sections_normalized, n.sections_normalized)"), "topics": UNITED("list_concat(o.topics, n.topics)"), "feed_categories": "list_sort(list_distinct(list_concat(o.feed_categories, n.feed_categories)))",
}
PLAIN = [
    "external_id", "stable_id", "publication_datetime", "created_at", "source", "source_country", "title_original", "title_quality", "url",
    "primary_section", "primary_topic"
]
LISTS = ["feed_categories", "topics", "sections_normalized"]
merged = ", ".join(
    f"case when n.external_id is null then o.{c} when o.external_id is null then n.{c} else {RULES.get(c, 'n.' + c)} end as {c}"
    for c in PLAIN + LISTS
)
shown = ", ".join(PLAIN + [f"array_to_string({c}, '|') as {c}" for c in LISTS])
MARKS = "marks as (select outlet_id, method, max(newest_item_published_at) as last from runs where ran_at < TIMESTAMP '2024-01-10 00:00:00' group by 1, 2)"
FNV = "list_reduce(list_transform(string_split(url, ''), lambda c: cast(ascii(c) as hugeint)), lambda h, u: (xor(h, u) * 16777619) % 4294967296, cast(2166136261 as hugeint))"
HOST = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)), '^www\\.', '')"
DEPTH = "cast(len(list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda v: v <> '')) as bigint)"

#: Feed items as ingest.items makes them.
ITEMS = """items as (select external_id, stable_id, case when event_id % 10 = 0 then '  ' when event_id % 10 = 1 then url || '?a=1&amp;b=2 ' else url end as link, title_original as title, language_hint || '  is  ' || repeat('so ', cast(event_id % 5 as bigint)) as description,
  case when event_id % 14 = 0 then null else publication_datetime end as published_at, event_id % 3 = 1 as fallback_date, title_quality, feed_categories as categories, event_id as seq from articles)"""
WORDS = lambda c: f"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda v: length(v) >= 4))"
SCORED = f"""scored as (select *, coalesce(nullif(trim(stable_id, ' '), ''), link) as grp, coalesce(epoch_us(published_at), 0) as moment,
    round(case when len(tw) > 0 and len(pw) > 0 then len(list_intersect(tw, pw)) / len(tw) + least(depth, 6) * 0.01 else 0.0 end + least(length(coalesce(description, '')), 400) / 10000 + case when fallback_date then 0.0 else 0.02 end + case title_quality when 'suspect' then 0 when 'recovered' then 2 else 1 end * 0.05, 9) as score
  from (select *, {WORDS('title')} as tw, {WORDS('place')} as pw, len(list_filter(string_split(place, '/'), lambda v: v <> '')) as depth from (select *, regexp_extract(link, '^[a-z]+://[^/?#]*([^?#]*)', 1) as place from items)))"""
#: Failures after an outlet's last success, numbered.
FAILURES = """tried as (select *, cast(ran_at as date) as day from runs where attempted),
alive as (select source, day, count(distinct method) > 1 and bool_or(ok) as duplicate from tried group by 1, 2),
last as (select outlet_id, max((ran_at, id)) as last from tried where ok group by 1),
f as (select outlet_id, ran_at, duplicate, row_number() over (partition by outlet_id order by ran_at, id) as k,
    case when status_code = 410 or status_code in (301, 308) then 'permanent' when status_code in (403, 404, 500, 502, 503, 504) or contains(lower(coalesce(error, '')), 'timeout') then 'temporary' end as kind,
    case when status_code in (410, 404, 403, 500, 502, 503, 504) then 'http_' || status_code when contains(lower(coalesce(error, '')), 'timeout') then 'timeout' end as reason
  from tried join alive using (source, day) left join last using (outlet_id) where not ok and (last is null or (ran_at, id) > last)),
states as (
  select distinct outlet_id, cast(0 as bigint) as k, 'active' as status, cast(null as varchar) as reason, cast(null as timestamp) as until, cast(null as timestamp) as since from tried
  union all
  select f.outlet_id, f.k,
    case when f.kind = 'permanent' or (f.reason = 'http_404' and (duplicate or f.k >= 3)) then 'disabled_permanent' when f.kind = 'temporary' and f.k >= 2 then 'disabled_temporary' else s.status end,
    case when f.kind = 'permanent' or (f.reason = 'http_404' and (duplicate or f.k >= 3)) or (f.kind = 'temporary' and f.k >= 2) then f.reason else s.reason end,
    case when f.kind = 'permanent' or (f.reason = 'http_404' and (duplicate or f.k >= 3)) then ran_at + interval 30 day when f.kind = 'temporary' and f.k >= 2 then ran_at + interval 7 day
      when f.kind is null and s.status <> 'active' and (s.until is null or s.until <= ran_at) then ran_at + case s.status when 'disabled_temporary' then interval 7 day else interval 30 day end else s.until end,
    case when f.kind = 'permanent' or (f.reason = 'http_404' and (duplicate or f.k >= 3)) or (f.kind = 'temporary' and f.k >= 2) then coalesce(s.since, ran_at) else s.since end
  from states s join f on f.outlet_id = s.outlet_id and f.k = s.k + 1
)"""
PLAIN_TITLE = "trim(regexp_replace(lower(coalesce(title_original, '')), '[^a-z0-9]+', ' ', 'g'), ' ')"
STORIES = f"""told as (select country as network, external_id, publication_datetime as t, case when length({PLAIN_TITLE}) >= 32 and len(list_filter(string_split({PLAIN_TITLE}, ' '), lambda v: length(v) >= 3)) >= 5 then {PLAIN_TITLE} end as fingerprint from articles),
heads as (
  select network, fingerprint, max(t) as head, cast(0 as bigint) as cluster from told where network is not null and fingerprint is not null group by 1, 2
  union all
  select h.network, h.fingerprint, max(x.t), h.cluster + 1 from heads h join told x on x.network = h.network and x.fingerprint = h.fingerprint and x.t < h.head - interval 36 hour group by h.network, h.fingerprint, h.cluster
),
placed as (select told.*, cluster from told left join heads h on told.network = h.network and told.fingerprint = h.fingerprint and t <= head and t >= head - interval 36 hour)"""
LIFT = """t as (select distinct coalesce(country, 'none') as network, source, lower(coalesce(nullif(trim(title_original, ' '), ''), '')) as title from articles),
sets as (select network, source, list(title) as titles, count(*) as total from t group by 1, 2),
greedy as (
  select distinct network, cast(0 as bigint) as rank, '' as source, cast(0 as bigint) as lift, cast(0 as bigint) as duplicates, cast([] as varchar[]) as seen, cast([] as varchar[]) as done from t
  union all
  select network, rank + 1, source, lift, total - lift, list_distinct(list_concat(seen, titles)), list_append(done, source) from (
    select *, row_number() over (partition by network order by lift desc, total desc, source) as best from (
      select g.network, g.rank, g.seen, g.done, s.source, s.titles, s.total, s.total - len(list_intersect(s.titles, g.seen)) as lift from greedy g join sets s on g.network = s.network and not list_contains(g.done, s.source)))
  where best = 1
)"""

SQL = {
    "f17_persistable": statement(
        f"""select external_id, trim(replace(link, '&amp;', '&'), ' ') as link, trim(left(regexp_replace(title, '\\s+', ' ', 'g'), 400), ' ') as title, trim(left(regexp_replace(description, '\\s+', ' ', 'g'), 1200), ' ') as description, published_at
            from items where trim(link, ' ') <> '' and trim(title, ' ') <> '' and published_at >= {AS_OF} - interval 7 day""",
        ARTICLES, ITEMS,
    ),
    "m01_preferred_items": statement(
        f"select w.external_id, w.stable_id, w.link, w.published_at, array_to_string({UNITED('cats')}, '|') as categories from (select *, row_number() over (partition by grp order by moment desc, score desc, seq) as rn from scored) w join (select grp, flatten(list(categories)) as cats from scored group by 1) using (grp) where rn = 1",
        ARTICLES, ITEMS, SCORED,
    ),
    "a30_greedy_lift": "with recursive " + ", ".join((ARTICLES, LIFT)) + " select network, source, rank, lift, duplicates from greedy where rank > 0",
    "m02_syndication_clusters": "with recursive " + ", ".join((ARTICLES, STORIES)) + " select network, fingerprint, external_id, cluster, case when cluster is null then 1 else count(*) over (partition by network, fingerprint, cluster) end as size from placed",
    "st5_breaker": "with recursive " + ", ".join((RUNS, FAILURES)) + " select outlet_id, status, reason, k as failures, until as disabled_until, since as disabled_since from (select *, row_number() over (partition by outlet_id order by k desc) as rn from states) where rn = 1",
    "m03_batch_dedupe": statement(f"select {shown}, seq from b", ARTICLES, NEW, f"a as ({deduped('fresh', 'coalesce(stable_id, external_id)')})", f"b as ({deduped('a', 'external_id')})"),
    "m04_upsert": statement(f"select {shown} from (select {merged} from old o full join fresh n on o.external_id = n.external_id)", ARTICLES, OLD, NEW),
    "m05_upsert_counts": statement("select count(*) filter (where external_id not in (select external_id from old)) as inserted, count(*) filter (where external_id in (select external_id from old)) as updated from fresh", ARTICLES, OLD, NEW),
    "j17_resolved_ids": statement("select seq, coalesce(known, external_id) as external_id from fresh left join (select stable_id, min(external_id) as known from old where stable_id is not null group by 1) using (stable_id)", ARTICLES, OLD, NEW),
    "m08_watermarks": statement("select outlet_id, method, max(newest_item_published_at) as last_publication_at from runs group by 1, 2", RUNS),
    "f16_past_watermark": statement("select id, outlet_id, method, newest_item_published_at as published_at from runs left join marks using (outlet_id, method) where ran_at >= TIMESTAMP '2024-01-10 00:00:00' and (newest_item_published_at is null or newest_item_published_at > greatest(coalesce(last, TIMESTAMP '2024-01-03 00:00:00'), TIMESTAMP '2024-01-03 00:00:00'))", RUNS, MARKS),
    "m09_rollup_upsert": statement(rolled("day"), RUNS),
    "sk6_retention": statement(f"select count(*) as before, count(*) filter (where created_at >= {AS_OF} - interval 3 day) as kept from articles", ARTICLES),
    "m07_quarantine": statement("select candidate_id, seen_count, snippet from (select requested_url as candidate_id, count(*) as seen_count, max_by(coalesce(error, ''), lpad(length(coalesce(error, ''))::varchar, 9, '0') || coalesce(error, '')) as snippet from runs where newest_item_published_at is null group by 1)", RUNS),
    "x_scalar_values": statement(
        f"""select external_id, sha256(url) as article_id, {HOST} as host, {DEPTH} as depth, lower(to_base(cast({FNV} as bigint), 36)) as fnv36, cast({FNV} % 12 as bigint) as bucket,
              regexp_matches(lower(coalesce(title_original, '')), 'breaking|urgent|developing|just in|ultima hora|última hora|urgente|en vivo|alert|flash') as breaking, array_to_string(feed_categories, '|') as categories, trim(left(coalesce(title_original, ''), 12), ' ') as short_title from articles""",
        ARTICLES,
    ),
    "x_page_titles": f"select page_id, {HOST} as host, {DEPTH} as depth, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g'), ' '), '') as title from pages",
    "st7_tiers": statement(
        f"""select source, n, tier, case when tier = 'cold' then cast(list_reduce(list_transform(string_split(source, ''), lambda c: cast(ascii(c) as hugeint)), lambda h, u: (xor(h, u) * 16777619) % 4294967296, cast(2166136261 as hugeint)) % 12 as bigint) end as bucket
            from (select source, n, case when n >= 50 then 'head' when n <= 9 then 'cold' else 'warm' end as tier from (select source, count(*) filter (where created_at >= {AS_OF} - interval 24 hour and created_at <= {AS_OF}) as n from articles group by 1))""",
        ARTICLES,
    ),
}
