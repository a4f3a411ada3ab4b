"""DuckDB statements beside the plans over rule tables: every rule is tried on every row."""

import json

from .oracle import ARTICLES, statement
from .ruled import KEYWORD_FILE, SECTION_FILE

NUMBERED = "numbered as (select 2 * p_partkey as n, p_name as name from part union all select 2 * c_custkey + 1, c_name from customer)"
HOST = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)), '^www\\.', '')"
PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
# titles of the fixtures have one space between words, so words stand between spaces once all else is a space
ROWS = f"""rows0 as (
  select external_id, lower(source) as src, source, {HOST} as host, {PATH} as path, lower(coalesce(title_original, '')) as title,
    ' ' || regexp_replace(lower(coalesce(title_original, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' ' as words, nullif(trim(source_country, ' '), '') as own from articles
)"""
KIND = "['view', 'click', 'purchase', 'signup', 'error'][n % 5 + 1]"
CONTEXT = f"""(n % 3 <> 0 or contains(words, ' k' || (n % 100) || ' ') or contains(words, ' report ' || n || ' ')) and (n % 2 <> 0 or starts_with(path, '/' || {KIND} || '/' || n))
  and (n % 5 >= 3 or ends_with(host, (n % 10) || '.example.com')) and (n % 7 <> 0 or cast(substr(src, 4) as bigint) between n % 150 and n % 150 + 19)
  and (not (n % 6 = 1 or n % 30 = 5) or contains(title, 'desk k' || (n % 10)) or contains(title, {KIND} || ' report '))
  and (n % 3 = 0 or n % 2 = 0 or n % 5 < 3 or n % 7 = 0 or n % 6 = 1 or n % 30 = 5)"""


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def clause(c: dict) -> str:
    if c["field"] == "lang":
        return f"lang in ({', '.join(quoted(v) for v in c['exact'])})"
    words = [f"regexp_matches(t, {quoted(f'(?:^|[^\\p{{L}}\\p{{N}}]){v}(?:$|[^\\p{{L}}\\p{{N}}])')})" for v in c.get("word", [])]
    return "(" + " or ".join(words + [f"contains(t, {quoted(v)})" for v in c.get("part", [])]) + ")"


def keywords() -> str:
    with open(KEYWORD_FILE, encoding="utf-8") as f:
        table = json.load(f)
    cases = " ".join(f"when {' and '.join(clause(c) for c in r['clauses'])} then {k}" for k, r in enumerate(table))
    label = " ".join(f"when {k} then {quoted(r['label'])}" for k, r in enumerate(table))
    weight = " ".join(f"when {k} then {0.84 if r['attributes']['weight'] == 'high' else 0.72}" for k, r in enumerate(table))
    return f"""select doc_id, case rule {label} else 'others' end as section, cast(case rule {weight} else 0.51 end as double) as confidence, cast(rule as bigint) as rule
      from (select *, case {cases} end as rule from (select doc_id, lang, lower(strip_accents(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) as t from documents))"""


def hybrid() -> str:
    with open(SECTION_FILE, encoding="utf-8") as f:
        table = json.load(f)

    def first(text: str, direct: bool) -> str:
        whens = []
        for k, r in enumerate(table):
            c = r["clauses"][0]
            if c["field"] == "category":
                whens += [f"when {text} in ({', '.join(quoted(v) for v in c['exact'])}) then {k}"] if direct else []
            else:
                words = [f"regexp_matches({text}, {quoted(f'(?:^|[^\\p{{L}}\\p{{N}}]){v}(?:$|[^\\p{{L}}\\p{{N}}])')})" for v in c["word"]]
                whens.append(f"when {' or '.join(words)} then {k}")
        return f"case {' '.join(whens)} end"

    label = lambda rule: f"case {rule} {' '.join(f'when {k} then {quoted(r['label'])}' for k, r in enumerate(table))} end"
    score = lambda rule, marks: f"case {rule} {' '.join(f'when {k} then {marks[r['attributes']['weight']]}' for k, r in enumerate(table))} end"
    words = {"direct": 0.84, "high": 0.84, "medium": 0.72}
    return statement(
        f"""select external_id, keyword_section, category_section, hint_section, case when kc >= coalesce(cc, 0) and kc >= coalesce(hc, 0) then keyword_section when coalesce(cc, 0) >= coalesce(hc, 0) then category_section else hint_section end as section,
              cast(greatest(kc, coalesce(cc, 0), coalesce(hc, 0)) as double) as confidence from (
            select external_id, coalesce({label('tr')}, 'others') as keyword_section, coalesce({score('tr', words)}, 0.51) as kc, {label('hr')} as hint_section, greatest({score('hr', words)}, 0.68) as hc,
              case when seen then coalesce({label('cr')}, 'others') end as category_section, case when seen then coalesce({score('cr', {'direct': 0.9, 'high': 0.86, 'medium': 0.75})}, 0.55) end as cc from (
                select *, {first('title', False)} as tr, {first('hint', False)} as hr from told left join cats using (external_id)))""",
        ARTICLES,
        "told as (select external_id, lower(coalesce(title_original, '')) as title, trim(regexp_replace(lower(source || ' ' || source || '.example.com' || ' /' || language_hint || '/' || event_id), '[\\s._/+?&=%-]+', ' ', 'g')) as hint from articles)",
        f"each as (select external_id, i, lower(trim(c)) as c from (select external_id, unnest(feed_categories) as c, generate_subscripts(feed_categories, 1) as i from articles))",
        f"cats as (select external_id, true as seen, arg_min(rule, i) filter (where rule is not null) as cr from (select *, {first('c', True)} as rule from each) group by 1)",
    )


SQL = {
    "x37_publisher_rules": statement(
        """, met as (
  select p.source, p.source_country, n, name, case when n % 4 < 2 then 'exact' when n % 4 = 2 then 'prefix' else 'part' end as kind from pairs p, numbered
  where (n % 3 = 0 or p.source_country = 'NATION_' || (n % 5)) and case when n % 4 < 2 then lower(source) = 'src' || n when n % 4 = 2 then starts_with(lower(source), 'src' || n) else contains(lower(source), cast(n as varchar)) end
),
best as (select * from met qualify row_number() over (partition by source, source_country order by n) = 1)
select p.source, p.source_country, coalesce(name || ' ' || n, p.source) as publisher, case when n % 50 = 0 then 'checked' when kind = 'exact' then 'high' when kind = 'prefix' then 'medium' else 'low' end as confidence, coalesce(kind, 'fallback') as matched_by
from pairs p left join best b on p.source = b.source and p.source_country is not distinct from b.source_country""",
        ARTICLES, NUMBERED, "pairs as (select distinct source, source_country from articles)",
    ),
    "x26_keyword_lists": keywords(),
    "x25_hybrid_rules": hybrid(),
    "x31_context_rules": statement(
        f"""select external_id, rule, case when rule is null then 'others' else ['world', 'sports', 'tech', 'arts', 'health', 'science', 'climate'][rule % 7 + 1] end as section
from articles left join (select external_id, min(n) as rule from rows0, numbered where {CONTEXT} group by 1) using (external_id)""",
        ARTICLES, NUMBERED, ROWS,
    ),
    "f15_address_rules": statement(
        """select source, count(*) filter (where rule is not null) as not_articles, count(*) as articles from rows0 left join (
  select external_id, min(n) as rule from rows0, numbered where (n % 3 <> 0 or ends_with(host, 'src' || (n % 200) || '.example.com')) and starts_with(path, '/' || ['view', 'error', 'tag', 'signup'][n % 4 + 1] || '/' || n) group by 1
) using (external_id) group by 1""",
        ARTICLES, NUMBERED, ROWS,
    ),
    "x29_topic_rules": statement(
        """select 'topic ' || n as topic, count(*) as titles, cast(sum(least(100, 60 + 15 * (found - 1))) as bigint) as points from (
  select n, cast(contains(words, ' report ' || (n % 500) || ' ') as int) + cast(n % 25 = 0 and contains(words, ' k' || (n % 100) || ' ') as int) as found from rows0, numbered
) where found > 0 group by 1""",
        ARTICLES, NUMBERED, ROWS,
    ),
    "x34_place_rules": statement(
        """select external_id, coalesce('Town ' || n, own, 'Global') as place, case when n is not null then 'title' when own is not null then 'publisher' else 'none' end as basis
from rows0 left join (select external_id, min(n) as n from rows0, numbered where n % 3 = 1 and contains(words, ' report ' || n || ' ') group by 1) using (external_id)""",
        ARTICLES, NUMBERED, ROWS,
    ),
}
SQL["x37_publisher_rules"] = SQL["x37_publisher_rules"].replace("from articles)\n, met", "from articles),\nmet")
