"""DuckDB statements beside the operations plans."""

from .oracle import ARTICLES, AS_OF, CATALOG, RUNS, statement


def since(interval: str) -> str:
    return f"ran_at >= {AS_OF} - interval {interval} and ran_at <= {AS_OF}"


def rolled(unit: str) -> str:
    return f"""select date_trunc('{unit}', ran_at)::timestamp as bucket, runner, outlet_id, method, count(*) filter (where attempted) as attempted_runs, count(*) filter (where attempted and ok) as successful_runs, count(*) filter (where attempted and not ok) as failed_runs,
      sum(fetched_count)::bigint as fetched_count, sum(parsed_count)::bigint as valid_count, sum(missing_title_count)::bigint as missing_title_count, sum(missing_link_count)::bigint as missing_link_count from runs group by 1, 2, 3, 4"""


REASON = "coalesce(nullif(concat_ws(' ', case when status_code is not null then 'HTTP ' || status_code end, nullif(trim(error, ' '), '')), ''), 'unknown')"
CLASS = "case when status_code in (401, 403, 429) then 'blocked' when status_code in (404, 410) then 'permanent' when status_code >= 500 then 'temporary' else 'other' end"
TRIED = f"tried as (select * from runs where attempted and {since('30 day')})"

def run_table(where: str, order: str, limit: int, offset: int = 0) -> str:
    page = f"by_hour as (select date_trunc('hour', ran_at)::timestamp as hour_bucket, outlet_id, source, country, method, count(*) filter (where attempted) as attempted_runs, count(*) filter (where attempted and not ok) as failed_runs, sum(fetched_count)::bigint as fetched_count, sum(parsed_count)::bigint as valid_count from runs where {where} group by all)"
    kept = f"kept as (select * from by_hour where hour_bucket > {AS_OF} - interval 480 hour and hour_bucket <= {AS_OF})"
    return statement(
        f"select *, (select count(*) from kept) as total from kept order by {order}, hour_bucket desc, outlet_id, method limit {limit} offset {offset}",
        RUNS, page, kept
    )


REASONS = f"reasons as (select method, {REASON} as reason, count(*) as failures, count(distinct source) as sources from tried where not ok group by 1, 2 order by 3 desc, 1, 2 limit 50)"

SQL = {
    "f09_run_search": run_table("contains(lower(source), 'src1') or contains(lower(outlet_id), 'src1') or contains(lower(country), 'src1')", "failed_runs desc", 40, 10),
    "f09_no_wild_cards": run_table("contains(lower(source), 'src_') or contains(lower(outlet_id), 'src_') or contains(lower(country), 'src_')", "hour_bucket desc", 50),
    "f14_outlet_runs": run_table("outlet_id in ('1', '2')", "source", 200),
    "f14_source_runs": run_table("source = 'src3'", "hour_bucket", 50),
    "sk7_report_lines": statement("select unnest(['# Failures', '', '| method | reason | failures | sources |', '| --- | --- | --- | --- |']) as value union all select '| ' || method || ' | ' || reason || ' | ' || failures || ' | ' || sources || ' |' from reasons", RUNS, TRIED, REASONS),
    "q30_ops_hourly": statement(f"select * from ({rolled('hour')}) where runner = 'worker' and bucket >= {AS_OF} - interval 48 hour and bucket <= {AS_OF} order by bucket desc, outlet_id, method limit 200", RUNS),
    "q30_ops_daily": statement(f"select * from ({rolled('day')}) where runner = 'worker' and bucket >= {AS_OF} - interval 480 hour and bucket <= {AS_OF} order by bucket desc, outlet_id, method limit 200", RUNS),
    "q31_failure_reasons": statement(f"select method, {REASON} as reason, count(*) as failures, count(distinct source) as sources from tried where not ok group by 1, 2 order by 3 desc, 1, 2 limit 50", RUNS, TRIED),
    "q32_latest_diagnostics": statement(f"select outlet_id, method, ran_at, ok, status_code, fetched_count from (select *, row_number() over (partition by outlet_id, method order by ran_at desc, id desc) as rn from runs where {since('2880 minute')}) where rn = 1", RUNS),
    "q33_day_summary": statement(
        f"""select coalesce(r.country, a.country) as country, coalesce(attempts, 0) as attempts, coalesce(failures, 0) as failures, coalesce(run_sources, 0) as run_sources, coalesce(inserted, 0) as inserted, coalesce(sources, 0) as sources, cast(0 as bigint) as seen_total, cast(0 as bigint) as duplicates
            from (select country, count(*) filter (where attempted) as attempts, count(*) filter (where attempted and not ok) as failures, count(distinct source) as run_sources from runs where {since('24 hour')} group by 1) r
            full join (select coalesce(nullif(trim(source_country, ' '), ''), 'Global') as country, count(*) as inserted, count(distinct source) as sources from articles where created_at >= {AS_OF} - interval 24 hour and created_at <= {AS_OF} group by 1) a on r.country = a.country""",
        ARTICLES, RUNS,
    ),
    "q34_failing_endpoints": statement(f"select * from (select *, round(100.0 * failures / greatest(attempts, 1), 1)::double as fail_percent from (select outlet_id, method, count(*) filter (where attempted) as attempts, count(*) filter (where attempted and not ok) as failures from runs where {since('20160 minute')} group by 1, 2)) where attempts >= 4 and fail_percent >= 30", RUNS),
    "q35_earliest_recent": statement(f"select * from (select source, min(created_at) as earliest, count(*) filter (where created_at >= {AS_OF} - interval 72 hour and created_at <= {AS_OF}) as recent from articles group by 1) where recent > 0", ARTICLES),
    "q36_outlet_page": statement(f"select *, (select count(*) from t) as total from t order by runs desc, outlet_id limit 20 offset 20", RUNS, f"t as (select outlet_id, count(*) as runs, max(ran_at) as last_ran_at, round((epoch({AS_OF}) - floor(epoch(max(ran_at)))) / 3600.0, 3)::double as lag_hours, sum(fetched_count)::bigint as fetched from runs where ran_at <= {AS_OF} group by 1)"),
    "q39_head_watchlist": statement(
        f"""select source, created, peak_1h, coalesce(rss_ok, 0) as rss_ok, coalesce(rss_failed, 0) as rss_failed, min_fetched, median_fetched, coalesce(capped, 0) as capped,
              case when min_fetched is null or peak_1h is null then 'UNKNOWN' when peak_1h >= min_fetched then 'STRICT' when 2 * peak_1h >= min_fetched then 'ONE_MISS' else 'SAFE' end as band
            from (select source, count(*) as created from articles where created_at > {AS_OF} - interval 240 hour and created_at <= {AS_OF} group by 1 having count(*) >= 10) h
            left join (select source, max(n) as peak_1h from (select source, date_trunc('hour', publication_datetime) as h, count(*) as n from articles where publication_datetime > {AS_OF} - interval 30 day and publication_datetime <= {AS_OF} group by 1, 2) group by 1) p using (source)
            left join (select source, count(*) filter (where attempted and ok and method = 'rss') as rss_ok, count(*) filter (where attempted and not ok and method = 'rss') as rss_failed, min(fetched_count) filter (where attempted and ok and method = 'rss') as min_fetched,
              percentile_disc(0.5) within group (order by fetched_count) filter (where attempted and ok and method = 'rss') as median_fetched, count(*) filter (where attempted and ok and method = 'rss' and sample_capped) as capped
              from runs where runner = 'worker' and ran_at > {AS_OF} - interval 240 hour and ran_at <= {AS_OF} group by 1) f using (source)""",
        ARTICLES, RUNS,
    ),
    "q40_failure_watchlist": statement(
        f"""select *, case when failures >= 5 and leading_failures >= 3 and (fail_rate >= 0.9 or (failures = attempts and permanent >= 0.8 * failures)) then 'DISABLE' when fail_rate >= 0.25 then 'WATCH' else 'OK' end as action from (
              select c.outlet_id, c.method, attempts, failures, permanent, l.run as leading_failures, m.reason, round(failures / attempts, 4) as fail_rate
              from (select outlet_id, method, count(*) as attempts, count(*) filter (where not ok) as failures, count(*) filter (where not ok and {CLASS} = 'permanent') as permanent from ordered group by 1, 2 having count(*) >= 6) c
              join (select outlet_id, method, count(*) filter (where good = 0) as run from (select *, sum(case when ok then 1 else 0 end) over (partition by outlet_id, method order by rn) as good from ordered) group by 1, 2) l using (outlet_id, method)
              left join (select outlet_id, method, reason from (select *, row_number() over (partition by outlet_id, method order by n desc, first) as best from (select outlet_id, method, {REASON} as reason, count(*) as n, min(rn) as first from ordered where not ok group by 1, 2, 3)) where best = 1) m using (outlet_id, method))""",
        RUNS, TRIED, "ordered as (select *, row_number() over (partition by outlet_id, method order by ran_at desc, id desc) as rn from tried)",
    ),
    "q41_stale_watchlist": statement(
        f"""select source, newest, methods, age_days, case when age_days <= -1 then 'future_hold' when methods = 'sitemap' and age_days >= 30 and (archive or year(newest) < 2020) then 'archive_exempt' when valued then 'high_value_hold' when age_days >= 28 then 'disable' else 'candidate' end as action from (
              select bool_or(regexp_matches(lower(concat_ws(' ', source, requested_url)), 'sitemap|archive|googlenews|\\.xml\\.gz')) as archive, bool_or(country = 'NATION_3' or regexp_matches(source, '^src[0-9]*7$')) as valued, source, max(newest_item_published_at) as newest, string_agg(method, '+' order by method) as methods, date_diff('day', cast(max(newest_item_published_at) as date), cast({AS_OF} as date)) as age_days
              from (select *, row_number() over (partition by source, method order by ran_at desc, id desc) as rn from runs where attempted and ok and newest_item_published_at is not null and ran_at <= {AS_OF}) where rn = 1 group by source)
            where age_days >= 14 or age_days <= -1""",
        RUNS,
    ),
    "q42_repair_pairs": statement(
        """select outlet_id, fail_url, success_url, fetched_count, case when fail_method <> success_method then fail_method || '->' || success_method else 'same_method' end as swap from (
             select b.outlet_id, b.method as fail_method, b.requested_url as fail_url, g.method as success_method, g.requested_url as success_url, g.fetched_count,
               row_number() over (partition by b.outlet_id, b.requested_url order by (b.method = g.method) desc, g.fetched_count desc, g.ran_at desc, g.requested_url) as best
             from newest b join newest g on b.outlet_id = g.outlet_id and not b.ok and g.ok and b.requested_url <> g.requested_url) where best = 1""",
        RUNS, TRIED, "newest as (select * from (select *, row_number() over (partition by outlet_id, method, requested_url order by ran_at desc, id desc) as rn from tried) where rn = 1)",
    ),
    "q43_blocked_backlog": statement(
        """select r.source, r.method, requested_url, ran_at, other_url, distribution_class is not null as in_catalog, case when other_url is not null then 'swap' when r.method = 'rss' then 'cooldown' else 'review' end as action
           from (select * from newest where status_code = 403 and not ok) r left join (select source, min(requested_url) as other_url from newest where ok group by 1) w using (source) left join catalog on r.source = catalog_source""",
        RUNS, CATALOG, TRIED, "newest as (select * from (select *, row_number() over (partition by source, method order by ran_at desc, id desc) as rn from tried) where rn = 1)",
    ),
    "q44_stability": statement(
        f"""select *, case when attempts < 4 then 'no_data' when valid = 0 then 'unstable' when 100.0 * successes / attempts >= 95 then 'stable' when 100.0 * successes / attempts >= 80 then 'warning' else 'unstable' end as status
            from (select source, method, count(*) as attempts, count(*) filter (where ok) as successes, sum(parsed_count)::bigint as valid, count(distinct cast(ran_at as date)) as days from runs where attempted and {since('14 day')} group by 1, 2)""",
        RUNS,
    ),
    "q45_ops_report": statement(
        f"""select coalesce(method, '(all)') as method, coalesce(country, '(all)') as country, attempted, failed, fetched, case when failed > 0 then 'degraded' else 'ok' end as status
            from (select method, country, count(*) filter (where attempted) as attempted, count(*) filter (where attempted and not ok) as failed, sum(fetched_count)::bigint as fetched from runs where {since('7 day')} group by rollup (method, country))""",
        RUNS,
    ),
}
