"""DuckDB SQL for those queries that SQL can express; the others are held against plain versions in the tests."""

WORD = r"[^\x20\x09-\x0D]+"

MIX = rf"""
with sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) as bigint) as size, md5(coalesce(cast(doc_id as varchar), '')) as digest from documents
),
sources as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as rank from sized group by source
),
weighed as (select *, [5, 2, 1][(rank - 1) % 3 + 1] as weight, 3 * source_size / [5, 2, 1][(rank - 1) % 3 + 1] as ratio from sources),
levels as (
  select *, (sum(source_size) over () - coalesce(sum(3 * source_size) over (order by ratio, rank rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by ratio, rank rows between current row and unbounded following) as level from weighed
),
targets as (select source, source_size, least(cast(3 * source_size as double), weight * max(level) over ()) as target from levels),
steps as (
  select *, case when source_size > 0 then cast(floor(target / source_size * 1000000000) as bigint) else 0 end as step,
    cast('0x' || substr(md5('mix:' || cast(source is null as varchar) || ':' || coalesce(source, '')), 1, 12) as bigint) % 1000000000 as move from targets
),
placed as (
  select *, row_number() over (partition by source order by length(bin(size)) * 8 + (size >> greatest(length(bin(size)) - 3, 0)), substr(digest, 1, 2), size, digest) as place from sized
),
mixed as (
  select p.*, source_size, target, cast((cast(place as hugeint) * step + move) // 1000000000 - (cast(place - 1 as hugeint) * step + move) // 1000000000 as bigint) as copies
  from placed p join steps s on p.source is not distinct from s.source
)
select doc_id, size, source_size, target, size * copies as taken, source, copies from mixed
"""

ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
VENDOR = r"gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}|[sr]k_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+|-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"


def _kind(rank: int, kind: str, pattern: str, group: int) -> str:
    return f"""select key, {rank} as rank, '{kind}' as kind, unnest(string_split_regex(t, '{pattern}')[1:len(regexp_extract_all(t, '{pattern}', 0))]) as gap, unnest(regexp_extract_all(t, '{pattern}', 0)) as m, unnest(regexp_extract_all(t, '{pattern}', {group})) as value,
      unnest(range(len(regexp_extract_all(t, '{pattern}', 0)))) as i from texts where regexp_matches(t, '{pattern}')"""


SECRETS = f"""
with rows0 as (select doc_id, source, coalesce(text, '') as t, md5(coalesce(text, '')) as key from documents),
texts as (select distinct key, t from rows0),
found as ({_kind(0, "assign", ASSIGN, 2)} union all {_kind(1, "access", "AKIA[A-Z0-9]{14,}", 0)} union all {_kind(2, "hex", "[0-9a-f]{16,}", 0)} union all {_kind(3, "vendor", VENDOR, 0)} union all {_kind(4, "opaque", "[A-Za-z0-9+/_-]{20,}", 0)}),
placed as (select *, sum(length(gap) + length(m)) over (partition by key, rank order by i) as stop from found),
spans0 as (select key, rank, kind, value, stop - length(m) as start, stop from placed where case rank when 0 then length(value) >= 12 when 4 then regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Zg-z]') else true end),
seen as (select distinct value, source, doc_id, kind = 'assign' as named from spans0 join rows0 using (key)),
counts as (select value, count(distinct coalesce('s' || source, 'n')) as owners, count(distinct [coalesce('s' || source, 'n'), coalesce(cast(doc_id as varchar), 'n')]) as repos, bool_or(named) as named from seen group by 1),
judged as (select *, not (owners >= 3 and repos >= 5) and len(list_distinct(string_split(lower(value), ''))) >= 5 as live from spans0 join counts using (value)),
kept as (select * from judged where kind <> 'opaque' or (named and live)),
listed as (
  select key, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex, count(*) filter (where live) as n_live,
    coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) filter (where rank < 3), '') as base, string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) as spans from kept group by 1
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live
from rows0 left join listed using (key)
"""

CONTROLS = r"\\|<</SYS>>|<<SYS>>|\[/INST\]|\[/ROLE\]|\[INST\]|\[ROLE\]|\[TEXT\]|</s>|<s>"
CHAT = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
steps as (select *, coalesce(lag(role) over w, '') as before, row_number() over w as n, count(*) over (partition by conv_id) as last from turns window w as (partition by conv_id order by turn nulls first, role, text)),
checked as (
  select *, case before when '' then role in ('system', 'user') when 'system' then role = 'user' when 'user' then role = 'assistant' when 'assistant' then role = 'user' else false end as ok,
    length(text) + len(regexp_extract_all(text, '{CONTROLS}')) + case role when 'system' then 15 when 'user' then 15 when 'assistant' then 7 else 19 + length(role) + len(regexp_extract_all(role, '{CONTROLS}')) end as size from steps
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256, cast(sum(length(text)) filter (where role = 'assistant') as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by n) filter (where role = 'assistant'), '')) as loss_sha256, cast(sum(size) as bigint) as formatted_chars, bool_and(ok) and bool_or(n = last and role = 'assistant') as valid
from checked group by conv_id
"""
CHAT = CHAT.replace(
    "cast(sum(length(text)) filter (where role = 'assistant') as bigint)",
    "cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint)"
)

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEARCH = f"""
with docs as (select row_number() over () as place, doc_id, regexp_extract_all(translate(text, '{CAPITALS}', '{SMALL}'), '{TERM}') as terms from documents),
each as (select place, doc_id, len(terms) as n, unnest(terms) as term from docs),
total as (select count(*) as docs, sum(len(terms)) as length from docs where len(terms) > 0),
postings as (select place, doc_id, n, term, count(*) as tf from each group by all),
asked as (select item_id, unnest(regexp_extract_all(translate(text, '{CAPITALS}', '{SMALL}'), '{TERM}')) as term from benchmark),
wanted as (select item_id, term, count(*) as times from asked group by all),
weights as (select term, cast(floor(1000 * ln((2.0::double * any_value(docs) + 2) / (2.0::double * count(*) + 1))) as bigint) as w from postings, total group by term),
scores as (
  select item_id, place, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // length))))) as bigint) as score
  from postings join weights using (term) join wanted using (term), total group by all
),
ranked as (select *, cast(row_number() over (partition by item_id order by score desc, doc_id nulls last, place) as int) as rank from scores where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""

COLLOCATIONS = f"""
with pieces as (
  select coalesce(lang, 'und') as lang, row_number() over () as doc, unnest(string_split_regex(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '[.,;:!?\x0A-\x0D]')) as piece from documents
),
numbered as (select lang, row_number() over () as id, regexp_extract_all(piece, '[^\x20\x09]+') as words from pieces),
total as (select lang, cast(sum(len(words)) as bigint) as n from numbered group by lang),
sizes as (select unnest([1, 2, 3, 4]) as words),
found as (select lang, s.words, array_to_string(list_slice(p.words, i, i + s.words - 1), ' ') as phrase from (select lang, words, unnest(range(1, len(words) + 1)) as i from numbered) p, sizes s where i + s.words - 1 <= len(p.words)),
frequent as (select lang, phrase, words, count(*) as f from found group by all having count(*) >= 30),
cuts as (select lang, phrase, f as a, string_split(phrase, ' ') as w, unnest(range(1, words)) as k from frequent where words > 1),
parts as (select lang, phrase, a, k, array_to_string(w[1:k], ' ') as lp, array_to_string(w[k + 1:], ' ') as rp from cuts),
scored as (
  select p.lang, p.phrase, p.a, k, x.f as l, y.f as r, cast((2000000 * cast(a as hugeint)) // (x.f + y.f) as bigint) as score
  from parts p join frequent x on x.lang = p.lang and x.phrase = lp join frequent y on y.lang = p.lang and y.phrase = rp
),
weakest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
longer as (select lang, f, string_split(phrase, ' ') as w, words from frequent where words > 2),
held as (select lang, array_to_string(w[i:i + s.words - 1], ' ') as phrase, max(f) as most from (select *, unnest(range(1, words + 1)) as i from longer) l, sizes s where s.words between 2 and l.words - 1 and i + s.words - 1 <= l.words group by 1, 2),
ranked as (
  select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
  from weakest left join held using (lang, phrase) join total using (lang) where most is null or 100 * cast(most as hugeint) < 80 * cast(a as hugeint)
)
select * from ranked where rank <= 2000
"""

ORACLE: dict[str, str] = {
    "op1_mix_sources": MIX, "op3_secret_scan": SECRETS, "op8_chat_format": CHAT, "op11_lexical_search": SEARCH,
    "op13_collocations": COLLOCATIONS
}
