"""DuckDB statements beside the benchmark plans."""

from .oracle import ARTICLES, AS_OF, CATALOG, LOW_SIGNAL, statement


def by(keys: str, counts: str) -> str:
    """Totals and concentration of relation `by_source` with columns keys, source and counts."""
    sums = ", ".join(f"sum({c})::bigint as {c}" for c in counts.split(", "))
    share = lambda k: f"case when sum(published) > 0 then cast(floor(coalesce(sum(published) filter (where rn <= {k}), 0) * 10000.0 / sum(published) + 0.5) as bigint) else 0 end as top{k}_bps"
    return f"""select {keys}, {sums}, count(*) filter (where published > 0 or inserted > 0) as active_sources, {share(1)}, {share(5)}, {share(10)}
      from (select *, row_number() over (partition by {keys} order by published desc, source) as rn from by_source) group by {keys}"""


def window(start: str, end: str, hour: str | None = None) -> str:
    eff = "least(publication_datetime, created_at)"
    more = f", count(*) filter (where created_at >= {hour} and created_at < {end}) as inserted_1h" if hour else ""
    return f"""counts as (select nullif(trim(source_country, ' '), '') as source_country, source,
        count(*) filter (where created_at >= {start} and created_at < {end}) as inserted,
        count(*) filter (where {eff} >= {start} and {eff} < {end}) as published,
        count(*) filter (where created_at >= {start} and created_at < {end} and {eff} >= {start} and {eff} < {end}) as fresh,
        count(*) filter (where created_at >= {start} and created_at < {end} and {eff} < {start}) as late{more}
      from articles where not {LOW_SIGNAL} and ((created_at >= {start} and created_at < {end}) or (publication_datetime >= {start} and publication_datetime < {end})) group by 1, 2),
    by_source as (select coalesce(source_country, catalog_country, '(unknown)') as country, source, sum(inserted)::bigint as inserted, sum(published)::bigint as published, sum(fresh)::bigint as fresh, sum(late)::bigint as late{", sum(inserted_1h)::bigint as inserted_1h" if hour else ""}
      from counts left join catalog on source = catalog_source group by 1, 2)"""


DAY = "TIMESTAMP '2024-01-19 00:00:00'"
HOURLY = window(f"{AS_OF} - interval 24 hour", AS_OF, f"{AS_OF} - interval 1 hour")
DAILY = window(DAY, f"{DAY} + interval 1 day")
SERIES = f"""each_row as (select nullif(trim(source_country, ' '), '') as source_country, source, cast(created_at as date) as seen, cast(least(publication_datetime, created_at) as date) as claimed from articles where not {LOW_SIGNAL}),
days as (select *, seen as day_bucket from each_row union all select *, claimed as day_bucket from each_row where claimed <> seen),
counts as (select day_bucket, source_country, source, count(*) filter (where seen = day_bucket) as inserted, count(*) filter (where claimed = day_bucket) as published, count(*) filter (where seen = day_bucket and claimed = day_bucket) as fresh, count(*) filter (where seen = day_bucket and claimed < day_bucket) as late from days group by 1, 2, 3),
by_source as (select day_bucket, coalesce(source_country, catalog_country, '(unknown)') as country, source, sum(inserted)::bigint as inserted, sum(published)::bigint as published, sum(fresh)::bigint as fresh, sum(late)::bigint as late from counts left join catalog on source = catalog_source group by 1, 2, 3),
series as ({by("day_bucket, country", "inserted, published, fresh, late")})"""
PERIOD = "date_trunc('month', day_bucket)::date as month, cast((day(day_bucket) - 1) // 7 + 1 as integer) as week"
COUNTS = "inserted, published, fresh, late"

SQL = {
    "q12_benchmark_hourly": statement(f"select date_trunc('hour', {AS_OF}) as hour_bucket, 'v1' as metric_version, * from ({by('country', COUNTS + ', inserted_1h')})", ARTICLES, CATALOG, HOURLY),
    "q13_benchmark_daily": statement(f"select cast({DAY} as date) as day_bucket, 'v1' as metric_version, * from ({by('country', COUNTS)})", ARTICLES, CATALOG, DAILY),
    "q13_benchmark_source_daily": statement("select * from by_source", ARTICLES, CATALOG, DAILY),
    "q14_latest_windows": statement("select min(day_bucket) as first_day, max(day_bucket) as last_day, count(distinct day_bucket) as days, count(distinct country) as countries from series", ARTICLES, CATALOG, SERIES),
    "q15_day_rows": statement("select day_bucket, country, published, inserted, fresh, late, active_sources, top1_bps from series where day_bucket between date '2024-01-10' and date '2024-01-19'", ARTICLES, CATALOG, SERIES),
    "q16_period_totals": statement(f"select {PERIOD}, sum(published)::bigint as published, sum(inserted)::bigint as inserted, sum(fresh)::bigint as fresh, sum(late)::bigint as late, count(distinct day_bucket) as days, max(active_sources) as peak_active_sources from series group by 1, 2", ARTICLES, CATALOG, SERIES),
    "q17_period_countries": statement(f"select {PERIOD}, country, sum(published)::bigint as published, sum(late)::bigint as late, cast(floor(sum(active_sources)::double / count(*) + 0.5) as bigint) as mean_active_sources, cast(floor(sum(top1_bps * published)::double / nullif(sum(published), 0) + 0.5) as bigint) as top1_bps from series group by 1, 2, 3", ARTICLES, CATALOG, SERIES),
    "q18_benchmark_response": statement(
        """select coalesce(h.country, d.country, w.country) as country, coalesce(h.published, 0) as published_24h, coalesce(h.inserted_1h, 0) as inserted_1h, coalesce(d.published, 0) as published_day, coalesce(d.top5_bps, 0) as top5_bps_day, coalesce(w.published_week, 0) as published_week
           from hour_rows h full join day_rows d on h.country = d.country full join week_rows w on coalesce(h.country, d.country) = w.country""",
        ARTICLES,
        CATALOG,
        f"hour_rows as (with {HOURLY} {by('country', COUNTS + ', inserted_1h')})",
        f"day_rows as (with {DAILY} {by('country', COUNTS)})",
        f"week_rows as (with {SERIES} select country, sum(published)::bigint as published_week from series where day_bucket between date '2024-01-13' and date '2024-01-19' group by 1)",
    ),
    "j15_country_lookup": statement(
        """select external_id, coalesce(canonical, nullif(trim(own, ' '), ''), by_name, by_spelling, '(unknown)') as country from told
           left join (select lower(catalog_country) as l, min(catalog_country) as canonical from catalog group by 1) on trim(lower(own), ' ') = l
           left join (select catalog_source as e, min(catalog_country) as by_name from catalog group by 1) on trim(source, ' ') = e
           left join (select lower(catalog_source) as s, min(catalog_country) as by_spelling from catalog group by 1) on trim(lower(source), ' ') = s""",
        ARTICLES,
        CATALOG,
        "told as (select external_id, case when event_id % 3 = 1 then ' ' || upper(source) || ' ' else source end as source, case event_id % 4 when 0 then lower(source_country) || '  ' when 1 then null when 2 then 'Elsewhere' else source_country end as own from articles)",
    ),
    "q55_parity": "select cast(null as varchar) as country, cast(null as varchar) as difference where false",
}
