"""DuckDB statements beside the taxonomy plans."""

from .oracle import ARTICLES, AS_OF, RUNS, statement

TITLE = "lower(coalesce(title_original, ''))"


def word(text: str, words: str) -> str:
    return f"regexp_matches({text}, '(?:^|[^\\p{{L}}\\p{{N}}])(?:{words})(?:$|[^\\p{{L}}\\p{{N}}])')"


def rules(text: str, table: list[tuple[str, str]], other: str) -> str:
    return "case " + " ".join(f"when {word(text, w)} then '{label}'" for label, w in table) + f" else {other} end"


HIGH, MEDIUM = [("world", "view"), ("sports", "click"), ("business", "purchase")], [("tech", "signup"), ("science", "error")]
CATS = "array_to_string(list_transform(feed_categories, lambda c: lower(trim(c, ' '))), ' ')"
DIRECT = "case list_filter(list_transform(feed_categories, lambda c: lower(trim(c, ' '))), lambda c: c in ('view', 'click', 'k1', 'k2'))[1] when 'view' then 'world' when 'click' then 'sports' when 'k1' then 'tech' when 'k2' then 'health' end"
EVIDENCE = f"""evidence as (select *, {rules(TITLE, HIGH, 'null')} as kh, {rules(TITLE, MEDIUM, 'null')} as km, {DIRECT} as cd, {rules(CATS, HIGH, 'null')} as ch, {rules(CATS, MEDIUM, 'null')} as cm from articles),
scored as (select *, coalesce(kh, km, 'others') as keyword_section, case when kh is not null then 0.84 when km is not null then 0.72 else 0.51 end as kc, coalesce(cd, ch, cm, 'others') as category_section, case when cd is not null then 0.9 when ch is not null then 0.86 when cm is not null then 0.75 else 0.55 end as cc from evidence)"""
PART = "lower(regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '^/([^/]+)', 1))"
CANDIDATES = f"""labels as (
  select external_id, nullif(trim(primary_section, ' '), '') as label, 85 as w from scored union all select external_id, category_section, 55 from scored union all select external_id, keyword_section, 20 from scored
  union all select external_id, case {PART} when 'view' then 'world' when 'click' then 'sports' when 'k1' then 'tech' when 'k2' then 'health' end, 35 from scored
),
candidates as (select external_id, label, least(sum(w), 100) / 100 as score from labels where label is not null and label <> 'others' group by 1, 2)"""
NEED = "case label when 'politics' then 0.7 when 'tech' then 0.7 when 'business' then 0.65 when 'conflicts' then 0.65 when 'sports' then 0.65 when 'health' then 0.65 when 'entertainment' then 0.65 when 'arts' then 0.6 when 'lifestyle' then 0.55 else 0.7 end"
ORDER = "list_position(['world','politics','conflicts','business','tech','sports','health','entertainment','lifestyle','arts','science','climate','others'], label)"
TOPICS = [("desk one", ["k1", "k10", "k11"]), ("desk two", ["k2", "k20", "report"]), ("views", ["view", "report"])]
COUNTED = " union all ".join(
    f"select external_id, '{t}' as topic, " + " + ".join(f"cast({word(TITLE, w)} as integer)" for w in words) + " as n from articles"
    for t, words in TOPICS
)
PLACE = rules(TITLE, [("North", "k1|k2|k3"), ("South", "k4|k5"), ("East", "k6")], "null")
COUNTRY = "nullif(trim(source_country, ' '), '')"

SQL = {
    "x25_hybrid_sections": statement("select external_id, keyword_section, category_section, case when cc > kc then category_section else keyword_section end as section, greatest(kc, cc)::double as confidence from scored", ARTICLES, EVIDENCE),
    "x27_section_candidates": statement("select external_id, label, score::double as score from candidates", ARTICLES, EVIDENCE, CANDIDATES),
    "x28_primary_section": statement(f"select external_id, case when stored = 'others' then coalesce(recovered, 'others') else stored end as section from (select external_id, coalesce(nullif(trim(primary_section, ' '), ''), nullif(trim(section, ' '), ''), 'others') as stored from articles) left join (select external_id, label as recovered from (select *, row_number() over (partition by external_id order by score desc, {ORDER}) as rn from candidates where score >= {NEED}) where rn = 1) using (external_id)", ARTICLES, EVIDENCE, CANDIDATES),
    "x29_topic_scores": statement(f"select external_id, topic, cast(least(100, 60 + 15 * (n - 1)) as bigint) as score_percent from ({COUNTED}) where n > 0", ARTICLES),
    "x34_places": statement(f"select external_id, coalesce({PLACE}, {COUNTRY}, 'Global') as place, case when {PLACE} is not null then 'title' when {COUNTRY} is not null then 'publisher' else 'none' end as basis from articles", ARTICLES),
    "x37_publishers": statement("select distinct source, case when lower(source) = 'src1' or lower(source) like 'src2%' then 'First Group' when lower(source) in ('src3', 'src4') or lower(source) like '%9%' then 'Second Group' else source end as publisher, case when lower(source) = 'src1' then 'high' when lower(source) like 'src2%' then 'medium' when lower(source) in ('src3', 'src4') then 'high' else 'low' end as confidence from articles", ARTICLES),
    "a24_endpoint_classes": statement("select country, count(*) filter (where kind = 'rss') as rss, count(*) filter (where kind = 'news_sitemap') as news_sitemap, count(*) filter (where kind = 'index') as index, count(*) filter (where kind = 'sitemap') as sitemap from (select distinct country, requested_url, case when method = 'rss' then 'rss' when requested_url like '%/0' then 'news_sitemap' when requested_url like '%/1' then 'index' else 'sitemap' end as kind from runs) group by 1", RUNS),
    "x46_freshness": statement(f"select source, case when (epoch({AS_OF}) - floor(epoch(last))) / 3600 <= 24 then 'fresh' when (epoch({AS_OF}) - floor(epoch(last))) / 3600 <= 96 then 'aging' else 'stale' end as state, last from (select source, max(ran_at) as last from runs where ok and attempted and ran_at <= {AS_OF} group by 1)", RUNS),
}
