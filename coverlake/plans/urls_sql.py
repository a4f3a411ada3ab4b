"""DuckDB statements beside the address plans."""

from .oracle import ARTICLES, statement

HOST = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)), '^www\\.', '')"
PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 4))"
TITLE = "nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g'), ' '), '')"
HEADING = "regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g')"

SQL = {
    "f15_not_articles": statement(f"select source, count(*) filter (where regexp_matches({PATH}, '^/(?:tag|author|category|login|search)(?:/|$)') or regexp_matches({PATH}, '^/?$') or (regexp_matches({HOST}, '^src1[0-9]*\\.') and regexp_matches({PATH}, '^/error/'))) as not_articles, count(*) as articles from articles group by 1", ARTICLES),
    "x42_title_overlap": f"select page_id, len(list_intersect(t, h)) as matches, round(len(list_intersect(t, h)) / greatest(3, least(len(h), 8)), 6) as overlap from (select page_id, {TOKENS.format(TITLE)} as t, {TOKENS.format(HEADING)} as h from pages)",
}
