"""SQL of enriched records, stated on its own, for the queries that build on them."""

from __future__ import annotations

from quillstone.functions.extract import ABBREVIATION, ACRONYM, CAMEL_CASE, IE_NAME, KEYWORD_STOPWORDS, MESSAGE_WORDS, PROCEDURE_NAME
from quillstone.functions.text import GENERIC_ANCHORS
from quillstone.plans.registry import CORPUS, camel, fp, words, ws

_FOUND = {"acronym": (ACRONYM, 0), "camel_case": (CAMEL_CASE, 0), "ie_name": (IE_NAME, 1), "procedure_name": (PROCEDURE_NAME, 1)}


def _hits(kind: str, pattern: str, group: int) -> str:
    all_of = f"regexp_extract_all(t, '{pattern}', {group})"
    return f"select '{kind}' as kind, doc_id, k, unnest({all_of}) as t, generate_subscripts({all_of}, 1) as i from src"


#: CTEs: corpus, src, abbr(doc_id, long_form, short_form), kw(doc_id, word, place), terms(kind, doc_id, term, pos), anchors(doc_id, term, pos).
ENRICHED = rf"""{CORPUS},
src as materialized (select doc_id, k, [clause_title, row_header, text, array_to_string(row_cells, ' ')][k] as t from corpus, (select unnest(range(1, 5)) as k)),
abbr as materialized (
  select doc_id, {ws('l')} as long_form, s as short_form from (select doc_id, unnest(regexp_extract_all(text, '{ABBREVIATION}', 1)) as l, unnest(regexp_extract_all(text, '{ABBREVIATION}', 2)) as s from corpus)
  where contains({ws('l')}, ' ')),
kw as materialized (
  select doc_id, word, row_number() over (partition by doc_id order by n desc, first) as place from (
    select doc_id, lower(w) as word, count(*) as n, min(i) as first from (
      select doc_id, unnest(regexp_extract_all(text, '\b[A-Za-z][A-Za-z0-9\-]{{2,}}\b')) as w, generate_subscripts(regexp_extract_all(text, '\b[A-Za-z][A-Za-z0-9\-]{{2,}}\b'), 1) as i from corpus)
    where lower(w) not in {words(KEYWORD_STOPWORDS)} group by doc_id, lower(w)) qualify place <= 12),
tok as (select doc_id, k, i, t, lower(rtrim(t, '.,;:')) in {words(MESSAGE_WORDS)} as ends, trim(t, '.,;:()') as bare from (
    select doc_id, k, unnest(string_split({ws('t')}, ' ')) as t, generate_subscripts(string_split({ws('t')}, ' '), 1) as i from src) where t <> ''),
halt as (select *, max(case when bare = '' or not (regexp_matches(bare, '^\p{{Lu}}') or regexp_matches(bare, '[0-9]')) then i end)
         over (partition by doc_id, k order by i rows between unbounded preceding and 1 preceding) as before from tok),
msg as (select doc_id, k, i, coalesce(before, 0) + 1 as start from halt where ends and i > coalesce(before, 0) + 1),
raw as (
  {' union all '.join(_hits(kind, *p) for kind, p in _FOUND.items())}
  union all
  select 'message_name', m.doc_id, m.k, string_agg(t.bare, ' ' order by t.i), m.i from msg m join tok t on t.doc_id = m.doc_id and t.k = m.k and t.i between m.start and m.i group by m.doc_id, m.k, m.i),
terms as materialized (
  select kind, doc_id, t as term, row_number() over (partition by kind, doc_id order by k, i) as pos from (
    select * from (select kind, doc_id, k, i, regexp_replace({ws('t')}, '(?i)^(?:the|a|an)\s+', '') as t from raw) where t <> ''
    qualify row_number() over (partition by kind, doc_id, {fp('t')} order by k, i) = 1)),
pool as (
  select doc_id, long_form as t from abbr union select doc_id, short_form from abbr union select doc_id, word from kw where place <= 8
  union select doc_id, row_header from corpus union select doc_id, term from terms),
anchors as materialized (
  select doc_id, a as term, row_number() over (partition by doc_id order by t) as pos from (
    select * from (select doc_id, t, regexp_replace({ws('t')}, '(?i)^(?:the|a|an)\s+', '') as a from pool) where a <> ''
    qualify row_number() over (partition by doc_id, {fp('a')} order by t) = 1))"""

#: CTE: anchor_rows(doc_id, spec_no, row_id, anchor, source, place), on ENRICHED.
ANCHOR_ROWS = f"""named as (
  select doc_id, term as t, kind as source, case kind when 'ie_name' then 1 when 'message_name' then 2 when 'procedure_name' then 3 when 'acronym' then 5 else 6 end as rank, pos from terms
  union all select doc_id, unnest(referenced_specs), 'spec_reference', 4, generate_subscripts(referenced_specs, 1) from corpus
  union all select doc_id, row_header, 'table', 7, 1 from corpus union all select doc_id, clause_title, 'clause_title', 8, 1 from corpus),
anchor_rows as materialized (
  select n.doc_id, c.spec_no, c.row_id, {camel('t')} as anchor, source, rank * 100000 + pos as place from named n join corpus c using (doc_id)
  where lower({camel('t')}) not in {words(['', *GENERIC_ANCHORS])})"""
