"""DuckDB statements beside the dossier plans."""

PEOPLE = """people as (
  select c_custkey as person_id, c_name as name, c_mktsegment as team, coalesce(official, 0) as official, coalesce(reported, 0) as reported, coalesce(rumor, 0) as rumor, c_custkey % 4 as controversy, c_custkey % 11 = 0 as captain,
    case c_custkey % 5 when 0 then 'first' when 1 then 'second' else 'other' end as prestige, cast(floor(abs(c_acctbal) * 100) as bigint) as followers, c_custkey % 7 as human_interest,
    case when c_custkey % 2 = 0 then '1990' end as birth, case when c_custkey % 3 = 0 then '' else c_mktsegment end as club, case when c_custkey % 5 = 0 then null else 'P' end as position, case when c_custkey % 3 = 1 then null else 'text' end as biography, case when c_custkey % 4 = 0 then '@x' end as social
  from customer left join (select o_custkey, count(*) filter (where o_orderstatus = 'F') as official, count(*) filter (where o_orderstatus = 'O') as reported, count(*) filter (where o_orderstatus = 'P') as rumor from orders group by 1) on c_custkey = o_custkey)"""
FIELDS = ["birth", "club", "position", "biography", "social"]
filled = lambda f: f"coalesce(trim({f}, ' ') <> '', false)"
HAVE = "(" + " + ".join(f"cast({filled(f)} as integer)" for f in FIELDS) + ")"
SEED = f"human_interest + least(28, 5 * official) + least(26, 4 * reported) + least(14, 2 * rumor + 3 * controversy) + case when captain then 10 else 0 end + case prestige when 'first' then 26 when 'second' then 14 else 0 end + case when followers > 0 then 4 + least(36, cast(round(6 * log10(followers + 10)) as bigint)) else 0 end + case when {filled('biography')} then 6 else 0 end"

SQL = {
    "q56_coverage": f"with {PEOPLE} select team, count(*) as persons, {', '.join(f'count(*) filter (where {filled(f)}) as {f}' for f in FIELDS)}, cast(round(100 * sum({HAVE}) / (count(*) * 5)) as bigint) as percent from people group by 1",
    "q56_priorities": f"""with {PEOPLE}, seeds as (select *, cast({SEED} as bigint) as seed from people), best as (select *, max(seed) over (partition by team) as top from seeds)
      select team, rank, person_id, seed, priority from (select *, row_number() over (partition by team order by priority desc, person_id) as rank from (select *, cast(seed + case when prestige = 'first' then 22 else 10 end + floor(0.55 * (top - seed) + 0.5) + 2 * (5 - {HAVE}) + case when {filled('biography')} then 0 else 32 end as bigint) as priority from best)) where rank <= 10""",
    "q57_overlay": f"with {PEOPLE} select person_id, name, team, coalesce(nullif(trim(b, ' '), ''), biography) as biography, h is not null as edited from people left join (select s_suppkey * 3 as person_id, case when s_suppkey % 2 = 0 then s_name else ' ' end as b, s_suppkey % 9 = 0 as h from supplier) using (person_id) where not coalesce(h, false)",
}
