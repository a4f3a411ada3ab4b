"""DuckDB statements beside the coverage plans."""

from .oracle import ARTICLES, AS_OF, CATALOG, RUNS, VISIBLE, statement

SINCE = {"1h": f"({AS_OF} - interval 1 hour)", "24h": f"({AS_OF} - interval 24 hour)", "7d": f"({AS_OF} - interval 7 day)"}


def counters(n: str) -> str:
    s = SINCE[n]
    return f"count(*) filter (where publication_datetime >= {s}) as pub_{n}, count(*) filter (where publication_datetime >= {s} and created_at >= {s}) as fresh_{n}, count(*) filter (where created_at >= {s} and publication_datetime < {s}) as late_{n}, count(*) filter (where created_at >= {s}) as first_seen_{n}"


def zeros(n: str) -> str:
    return ", ".join(f"cast(0 as bigint) as {m}_{n}" for m in ("pub", "fresh", "late", "first_seen"))


def metrics(window: str) -> str:
    columns = ", ".join(counters(n) if window == "7d" or n == window else zeros(n) for n in SINCE)
    return f"""metrics as (select nullif(trim(source_country, ' '), '') as source_country, nullif(trim(country, ' '), '') as article_country, coalesce(nullif(trim(source_country, ' '), ''), nullif(trim(country, ' '), '')) as country, source, {columns}
      from articles where {VISIBLE} and created_at <= {AS_OF} and (publication_datetime >= {SINCE[window]} or created_at >= {SINCE[window]}) group by 1, 2, 3, 4)"""


STATUS = "case when lower(trim(coalesce(health_classification, ''), ' ')) in ('healthy','warning','degraded','failing') then lower(trim(health_classification, ' ')) else 'unknown' end"
RANK = "case status when 'healthy' then 0 when 'warning' then 1 when 'degraded' then 2 when 'failing' then 3 else 4 end"
HEALTH = f"""past as (select * from runs where ran_at <= {AS_OF}),
newest as (select * from (select *, row_number() over (partition by source, method order by ran_at desc, id desc) as rn from past) where rn = 1),
fails as (select source, method, count(*) filter (where attempted) as attempts_24h, count(*) filter (where attempted and not ok) as failures_24h from past where ran_at >= {AS_OF} - interval 24 hour group by 1, 2),
statuses as (select n.*, {STATUS} as status, lower(n.source) as source_key, coalesce(f.attempts_24h, 0) as attempts_24h, coalesce(f.failures_24h, 0) as failures_24h from newest n left join fails f using (source, method)),
health as (select source_key, source, method, status, ok, ran_at, attempts_24h, failures_24h from (select *, row_number() over (partition by source_key order by {RANK}, source, method) as best from statuses) where best = 1)"""
META = "meta as (select m.*, lower(m.source) as source_key, catalog_country, publisher, distribution_class, coalesce(distribution_class, 'publisher') as class from metrics m left join catalog on lower(m.source) = lower(catalog_source))"
CHECKED = f"checked as (select country, count(distinct lower(source)) as checked_sources from runs where attempted and ran_at >= {AS_OF} - interval 24 hour and ran_at <= {AS_OF} group by 1)"

SQL = {
    "q19_source_metrics_24h": statement("select * from metrics", ARTICLES, metrics("24h")),
    "q20_source_metrics_1h": statement("select * from metrics", ARTICLES, metrics("1h")),
    "q20_source_metrics_7d": statement("select * from metrics", ARTICLES, metrics("7d")),
    "q21_latest_health": statement("select * from health", RUNS, HEALTH),
    "q22_hourly_by_country": statement(f"select coalesce(nullif(trim(source_country, ' '), ''), 'Global') as member, date_trunc('hour', publication_datetime) as hour_bucket, count(*) as articles from articles where {VISIBLE} and publication_datetime >= {AS_OF} - interval 24 hour and publication_datetime <= {AS_OF} group by 1, 2", ARTICLES),
    "q22_hourly_by_source": statement(f"select source as member, date_trunc('hour', publication_datetime) as hour_bucket, count(*) as articles from articles where {VISIBLE} and publication_datetime >= {AS_OF} - interval 24 hour and publication_datetime <= {AS_OF} group by 1, 2", ARTICLES),
    "q23_checked_by_country": statement("select * from checked", RUNS, CHECKED),
    "q25_country_metrics": statement(
        """select t.country, published, fresh, late, first_seen, case when first_seen > 0 then round(late / first_seen, 6) else 0.0 end as late_share, active_sources, portal_published, coalesce(configured_sources, 0) as configured_sources, least(coalesce(checked_sources, 0), coalesce(configured_sources, 0)) as checked_sources
           from (select place as country, sum(p)::bigint as published, sum(f)::bigint as fresh, sum(l)::bigint as late, sum(s)::bigint as first_seen, count(*) filter (where p > 0) as active_sources, coalesce(sum(p) filter (where class = 'portal'), 0)::bigint as portal_published
             from (select coalesce(catalog_country, country) as place, source_key, sum(pub_24h) as p, sum(fresh_24h) as f, sum(late_24h) as l, sum(first_seen_24h) as s, max(class) as class from meta where coalesce(catalog_country, country) is not null group by 1, 2) group by 1) t
           left join (select catalog_country as country, count(*) as configured_sources from catalog group by 1) c using (country) left join checked k using (country)""",
        ARTICLES, RUNS, CATALOG, metrics("24h"), META, CHECKED,
    ),
    "q26_publishers": statement(
        """select t.name, published, active_sources, countries, case when vote >= 2.6 then 'high' when vote >= 1.6 then 'medium' else 'low' end as confidence, coalesce(top_countries, '') as top_countries
           from (select coalesce(publisher, source) as name, sum(pub_24h)::bigint as published, count(*) filter (where pub_24h > 0) as active_sources, count(distinct country) as countries, avg(case when publisher is not null then 3 else 1 end) as vote from meta group by 1) t
           left join (select name, string_agg(country || ':' || n, ',' order by rn) as top_countries from (select *, row_number() over (partition by name order by n desc, country) as rn from (select coalesce(publisher, source) as name, country, sum(pub_24h)::bigint as n from meta where country is not null group by 1, 2)) where rn <= 3 group by 1) c using (name)""",
        ARTICLES, CATALOG, metrics("24h"), META,
    ),
    "q27_country_sources": statement(
        """select r.country, r.rn, r.source_key, r.published, r.class, coalesce(status, 'unknown') as status from (
             select *, row_number() over (partition by country order by published desc, source_key) as rn from (select country, source_key, sum(pub_24h)::bigint as published, max(class) as class from meta where country is not null group by 1, 2)) r
           left join health using (source_key) where rn <= 20""",
        ARTICLES, RUNS, CATALOG, metrics("24h"), META, HEALTH,
    ),
    "q27_regions": statement(
        """select region, published, sources from (select coalesce(r_name, '(unmapped)') as region, max(case when r_name is null then 1 else 0 end) as u, sum(pub_24h)::bigint as published, count(distinct source_key) as sources
             from meta left join (select n_name, r_name from nation join region on n_regionkey = r_regionkey) on country = n_name group by 1) order by u, published desc, sources desc, region limit 5""",
        ARTICLES, CATALOG, metrics("24h"), META,
    ),
    "q28_source_detail": statement(
        """select m.*, coalesce(status, 'unknown') as status, case when attempts_24h > 0 then round(failures_24h / attempts_24h, 6) end as fail_rate from (
             select lower(source) as source_key, """ + ", ".join(f"sum({m}_{n})::bigint as {m}_{n}" for n in SINCE for m in ("pub", "first_seen")) + """ from metrics group by 1) m left join health using (source_key)""",
        ARTICLES, RUNS, metrics("7d"), HEALTH,
    ),
}
