"""Queries of text, extraction and array expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import arrays, extract, text
from quillstone.functions.extract import KEYWORD_STOPWORDS, MESSAGE_WORDS, OVERLAP_GENERIC, QUERY_GENERIC, QUERY_STOPWORDS, TRAILING_WORDS
from quillstone.functions.text import GENERIC_ANCHORS
from quillstone.operators import enrich
from quillstone.plans.registry import CORPUS, Registry, camel, fp, hint, strip, words, ws
from quillstone.sources.corpus import corpus
from quillstone.sources.tables import table

R = Registry()
QUERIES, ORACLES, query = R.queries, R.oracles, R.query


@query(rf"""with {CORPUS} select doc_id, {ws('text')} as normal, md5({fp('text')}) as mark, lower({ws('row_header')}) as search,
    regexp_replace({ws('clause_title')}, '(?i)^(?:the|a|an)\s+', '') as no_article,
    case when length({ws('text')}) > 180 then rtrim(substr({ws('text')}, 1, 179)) || '...' else {ws('text')} end as preview from corpus""")
def x1_x2_x5_x9_x11_normal_text(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder).select(
        "doc_id", text.collapse("text").alias("normal"), F.md5(text.fingerprint("text")).alias("mark"), text.search_term("row_header").alias("search"),
        text.without_article(text.collapse("clause_title")).alias("no_article"), text.preview("text").alias("preview"),
    )


@query(f"""with {CORPUS} select doc_id, {camel('clause_title')} as anchor, lower({camel('clause_title')}) in {words(['', *GENERIC_ANCHORS])} as noisy,
    {hint('clause_title')} as hint from corpus""")
def x6_x7_x8_anchor_forms(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder).select(
        "doc_id", text.anchor_term("clause_title").alias("anchor"), text.is_noisy_anchor("clause_title").alias("noisy"), text.hint_term("clause_title").alias("hint")
    )


@query(rf"""with {CORPUS} select doc_id, replace(clause_id, '.', '') as plain,
    coalesce(nullif(trim(regexp_replace(regexp_replace(clause_title, '[<>:"/\\|?*\x00-\x1f]', '', 'g'), '[\s\x0B\x{{85}}\pZ]+', '_', 'g'), '.- '), ''), 'clause-export') as stem,
    url_encode(doc_id) as quoted, case when lower(regexp_replace(stage_hint, '\s+', '', 'g')) in ('stage2', 'stage3') then lower(regexp_replace(stage_hint, '\s+', '', 'g')) else 'else' end as bucket,
    case doc_type when 'passage_doc' then 'passage' when 'table_doc' then 'table' when 'table_row_doc' then 'table_row' when 'entity_doc' then 'entity' else 'clause' end as kind from corpus""")
def x10_x14_x16_x17_x24_labels(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder).select(
        "doc_id", text.undotted("clause_id").alias("plain"), text.file_stem("clause_title").alias("stem"), text.url_quoted("doc_id").alias("quoted"),
        text.stage_bucket("stage_hint").alias("bucket"), text.content_kind("doc_type").alias("kind"),
    )


@query(f"""with t as (select row_id, {strip("coalesce(text, '')")} as t from clauses)
    select row_id, cast(i as integer) as chunk_no, substr(t, i * 2000 + 1, 2000) as chunk from (select *, unnest(range(least(3, cast(ceil(length(t) / 2000.0) as bigint)))) as i from t)""")
def x12_p9_text_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "clauses").select("row_id", F.posexplode(text.chunks("text", most=3)).alias("chunk_no", "chunk"))


@query(f"""with t as (select row_id, {strip("coalesce(text, '')")} as t from clauses)
    select row_id, cast(i as integer) as chunk_no, substr(t, i * 2000 + 1, 2000) as chunk from (select *, unnest(range(cast(ceil(length(t) / 2000.0) as bigint))) as i from t)""")
def x12_p9_all_text_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces of the texts; ``x12_p9_text_chunks`` has the first three."""
    return table(spark, folder, "clauses").select("row_id", F.posexplode(text.chunks("text")).alias("chunk_no", "chunk"))


@query(rf"""with recursive p as materialized (
      select row_id, p, row_number() over (partition by row_id order by i) as n from (
        select row_id, {strip('p')} as p, i from (select row_id, unnest(regexp_split_to_array(text, '\n{{2,}}')) as p, generate_subscripts(regexp_split_to_array(text, '\n{{2,}}'), 1) as i from clauses))
      where p <> ''),
    pack as (
      select row_id, n, p as open, 1 as piece from p where n = 1
      union all
      select p.row_id, p.n, case when length(k.open) + length(p.p) + 2 <= 1200 then k.open || chr(10) || chr(10) || p.p else p.p end,
             case when length(k.open) + length(p.p) + 2 <= 1200 then k.piece else k.piece + 1 end
      from pack k join p on p.row_id = k.row_id and p.n = k.n + 1)
    select row_id, cast(piece - 1 as integer) as piece_no, arg_max(open, n) as piece from pack group by row_id, piece""")
def x13_packed_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "clauses").select("row_id", F.posexplode(text.packed_paragraphs("text", 1200)).alias("piece_no", "piece"))


_BARE = "p_name || ' ; ' || p_name || ' ; ' || p_brand"
_REDUNDANT = f"length({fp('p_type')}) >= 3 and contains({fp(_BARE)}, {fp('p_type')})"
_CELL = "p_name || ' [' || p_type || '] ; ' || p_name || ' [' || p_type || '] ; ' || p_brand"


@query(f"""select p_partkey, {ws("p_name || ' [' || p_type || '] ; ' || p_name || ' ; ' || p_brand")} as brackets, case when {_REDUNDANT} then {ws(_BARE)} else {ws(_CELL)} end as redundant,
    {ws("p_name || ' [' || p_type || ']'")} || '; ' || {ws('p_brand')} as items,
    case when {_REDUNDANT} then {ws('p_name')} || '; ' || {ws('p_brand')} else {ws("p_name || ' [' || p_type || ']'")} || '; ' || {ws('p_name')} || '; ' || {ws('p_brand')} end as cell from part""")
def x18_x19_x20_x21_x22_cells(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    cell = F.concat("p_name", F.lit(" ["), "p_type", F.lit("] ; "), "p_name", F.lit(" ["), "p_type", F.lit("] ; "), "p_brand")
    return part.select(
        "p_partkey", text.without_repeated_brackets(cell).alias("brackets"), text.without_redundant_brackets(cell).alias("redundant"),
        text.without_repeated_items(cell).alias("items"), text.cell_text(cell).alias("cell"),
    )


@query("""with t as (select vec_id, list_transform(embedding, lambda x: printf('%.6f', x::double)) as v from embeddings)
    select vec_id, '[' || array_to_string(v, ',') || ']' as literal from t""")
def x25_tensor_literal(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", text.tensor_literal("embedding").alias("literal"))


@query(rf"""with {CORPUS}, w as (
      select doc_id, lower(w) as word, i from (
        select doc_id, unnest(regexp_extract_all(text, '\b[A-Za-z][A-Za-z0-9\-]{{2,}}\b')) as w, generate_subscripts(regexp_extract_all(text, '\b[A-Za-z][A-Za-z0-9\-]{{2,}}\b'), 1) as i from corpus)
      where lower(w) not in {words(KEYWORD_STOPWORDS)}),
    c as (select doc_id, word, count(*) as n, min(i) as first from w group by doc_id, word)
    select doc_id, word as keyword, n as uses, cast(row_number() over (partition by doc_id order by n desc, first) as integer) as place from c
    qualify row_number() over (partition by doc_id order by n desc, first) <= 12""")
def e1_keywords(spark: SparkSession, folder: str) -> DataFrame:
    return enrich.keywords(corpus(spark, folder), 12)


@query(rf"""with {CORPUS}, a as (
      select doc_id, {ws('l')} as long_form, s as short_form from (
        select doc_id, unnest(regexp_extract_all(text, '\b([A-Za-z][A-Za-z0-9\-/ ]{{3,}}?)\s*\(([A-Z][A-Z0-9\-]{{1,}})\)', 1)) as l,
               unnest(regexp_extract_all(text, '\b([A-Za-z][A-Za-z0-9\-/ ]{{3,}}?)\s*\(([A-Z][A-Z0-9\-]{{1,}})\)', 2)) as s from corpus))
    select * from a where contains(long_form, ' ')""")
def e2_abbreviations(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder).select("doc_id", F.inline(extract.abbreviations("text")))


@query(rf"""with {CORPUS} select doc_id,
    array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '\b\d+(?:\.\d+)*(?:[A-Za-z])?\b'), lambda v: contains(v, '.')))), '|') as clauses,
    array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '\b(?:3GPP\s+)?(?:TS|TR)\s+(\d{{2}}\.\d{{3}}|\d{{5}})\b', 1), lambda v: replace(v, '.', '')))), '|') as specs from corpus""")
def e3_e4_references(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder).select(
        "doc_id", F.array_join(extract.clause_references("text"), "|").alias("clauses"), F.array_join(extract.spec_references("text"), "|").alias("specs")
    )


def _first_terms(pattern: str, group: int = 0) -> str:
    """SQL of the ordered distinct terms over title, row header, text and cells, as rows (kind left to the caller)."""
    texts = "[clause_title, row_header, text, array_to_string(row_cells, ' ')]"
    one = f"flatten(list_transform({texts}, lambda t: regexp_extract_all(t, '{pattern}', {group})))"
    return f"select doc_id, unnest({one}) as t, generate_subscripts({one}, 1) as i from corpus"


def _terms_sql(kinds: dict[str, tuple[str, int]]) -> str:
    parts = " union all ".join(f"select '{k}' as kind, * from ({_first_terms(p, g)})" for k, (p, g) in kinds.items())
    return rf"""with {CORPUS}, t as ({parts}), n as (select kind, doc_id, i, regexp_replace({ws('t')}, '(?i)^(?:the|a|an)\s+', '') as t from t)
    select kind, doc_id, t as term from n where t <> '' qualify row_number() over (partition by kind, doc_id, {fp('t')} order by i) = 1"""


@query(_terms_sql({
    "acronym": (r"\b[A-Z][A-Z0-9\-]{1,}\b", 0),
    "camel_case": (r"\b[a-z]+(?:[A-Z][a-z0-9]+){1,}\b|\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+){1,}\b", 0),
    "ie_name": (r"\b([A-Z][A-Za-z0-9/\-]*(?:\s+[A-Z][A-Za-z0-9/\-]*)*\s+(?:IE|information element))\b", 1),
    "procedure_name": (r"(?i)\b([A-Z0-9][A-Za-z0-9/\-]*(?:\s+[A-Z0-9][A-Za-z0-9/\-]*)*\s+procedures?)\b", 1),
}))
def e5_e6_e7_e8_e11_structured_terms(spark: SparkSession, folder: str) -> DataFrame:
    terms = enrich.structured_terms(corpus(spark, folder))
    kinds = {"acronym": "acronyms", "camel_case": "camel_case_identifiers", "ie_name": "ie_names", "procedure_name": "procedure_names"}
    pairs = F.concat(*[enrich.labelled(c, k, "term", "kind") for k, c in kinds.items()])
    return terms.select("doc_id", F.inline(pairs))


@query(rf"""with {CORPUS}, tok as materialized (
      select doc_id, i, t, lower(rtrim(t, '.,;:')) in {words(MESSAGE_WORDS)} as ends, trim(t, '.,;:()') as bare from (
        select doc_id, unnest(string_split({ws('text')}, ' ')) as t, generate_subscripts(string_split({ws('text')}, ' '), 1) as i from corpus) where t <> ''),
    stop as (select *, max(case when bare = '' or not (regexp_matches(bare, '^\p{{Lu}}') or regexp_matches(bare, '[0-9]')) then i end)
             over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) as before from tok),
    name as (select doc_id, i, coalesce(before, 0) + 1 as start from stop where ends and i > coalesce(before, 0) + 1)
    select n.doc_id, string_agg(t.bare, ' ' order by t.i) as message
    from name n join tok t on t.doc_id = n.doc_id and t.i between n.start and n.i group by n.doc_id, n.i""")
def e9_message_names(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder).select("doc_id", F.explode(extract.message_names("text")).alias("message"))


@query(f"""with {CORPUS} select doc_id, case when lower(trim(clause_title)) = 'front_matter' then 0.2
      when doc_type in ('clause_doc', 'passage_doc') and lower(trim(clause_title)) = 'references' then 0.35
      when doc_type in ('clause_doc', 'passage_doc') and lower(trim(clause_title)) in ('foreword', 'contents', 'scope') then 0.55
      when doc_type = 'table_row_doc' then 1.35 when doc_type = 'table_doc' then 1.15 when doc_type = 'passage_doc' then 1.1 else 1.0 end::double as weight from corpus""")
def e14_retrieval_weight(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder).select("doc_id", extract.retrieval_weight("clause_title", "doc_type").alias("weight"))


@query(rf"""with h as (select row_id, {ws("concat(coalesce(clause_id, ''), ' ', coalesce(clause_title, ''))")} as h, {strip("coalesce(clause_id, '')")} as c, coalesce(clause_title, '') as t from clauses)
    select row_id,
      nullif(case when regexp_matches(h, '^(Annex\s+[A-Z])(?:\s*\([^)]+\))?\s+(.+)$') then regexp_extract(h, '^(Annex\s+[A-Z])(?:\s*\([^)]+\))?\s+(.+)$', 1)
           else regexp_extract(h, '^((?:\d+[A-Za-z]?(?:\.\d+[A-Za-z]?)*)|(?:[A-Z](?:\.\d+[A-Za-z]?)+))\s+(.+)$', 1) end, '') as clause,
      nullif(case when regexp_matches(h, '^(Annex\s+[A-Z])(?:\s*\([^)]+\))?\s+(.+)$') then regexp_extract(h, '^(Annex\s+[A-Z])(?:\s*\([^)]+\))?\s+(.+)$', 2)
           else regexp_extract(h, '^((?:\d+[A-Za-z]?(?:\.\d+[A-Za-z]?)*)|(?:[A-Z](?:\.\d+[A-Za-z]?)+))\s+(.+)$', 2) end, '') as title,
      regexp_matches(c, '^Annex\s') or regexp_matches(c, '^\d+$') or contains(c, '.') or regexp_matches(c, '^\d+[a-z]$') as probable,
      starts_with(lower(c), 'annex') or contains(lower(t), 'change history') as excluded from h""")
def e15_e17_e18_headings(spark: SparkSession, folder: str) -> DataFrame:
    name, title = text.strip_white(F.coalesce("clause_id", F.lit(""))), F.coalesce("clause_title", F.lit(""))
    found = extract.heading(F.concat(F.coalesce("clause_id", F.lit("")), F.lit(" "), title))
    return table(spark, folder, "clauses").select(
        "row_id", found["clause"].alias("clause"), found["title"].alias("title"), extract.is_probable_clause_id(name).alias("probable"),
        extract.is_excluded_clause(name, title).alias("excluded"),
    )


@query(rf"""select row_id, coalesce(nullif(regexp_extract(coalesce(spec_title, ''), '(?i)\b(stage\s+\d+)\b', 1), ''), '') as found,
    case when regexp_matches(coalesce(spec_title, ''), '(?i)\bstage\s+\d+\b') then upper(substr(regexp_extract(spec_title, '(?i)\b(stage\s+\d+)\b', 1), 1, 1)) || lower(substr(regexp_extract(spec_title, '(?i)\b(stage\s+\d+)\b', 1), 2))
         when regexp_matches(coalesce(stage_hint, ''), '(?i)\bstage\s+\d+\b') then upper(substr(regexp_extract(stage_hint, '(?i)\b(stage\s+\d+)\b', 1), 1, 1)) || lower(substr(regexp_extract(stage_hint, '(?i)\b(stage\s+\d+)\b', 1), 2))
         else 'else' end as stage from specs""")
def e23_stage_hints(spark: SparkSession, folder: str) -> DataFrame:
    found = F.regexp_extract(F.coalesce("spec_title", F.lit("")), r"(?i)\b(stage\s+\d+)\b", 1)
    return table(spark, folder, "specs").select("row_id", found.alias("found"), extract.stage_hint("spec_title", "stage_hint").alias("stage"))


@query(rf"""with r as (select doc_id, spec_no, {ws('e')} as e from (select doc_id, coalesce(spec_no, '') as spec_no, unnest(referenced_clauses) as e from records))
    select doc_id, e as keyword, spec_no as spec, regexp_extract(e, '(?i)^(?:clause\s+)?(\d+(?:\.\d+[a-z]?)+)$', 1) as clause from r
    where spec_no <> '' and regexp_matches(e, '(?i)^(?:clause\s+)?(\d+(?:\.\d+[a-z]?)+)$')""")
def e26_clause_targets(spark: SparkSession, folder: str) -> DataFrame:
    refs = table(spark, folder, "records").select("doc_id", F.coalesce("spec_no", F.lit("")).alias("spec_no"), F.explode("referenced_clauses").alias("e"))
    found = refs.withColumn("target", extract.clause_target("e", "spec_no")).filter("target is not null")
    return found.select("doc_id", text.collapse("e").alias("keyword"), "target.spec", "target.clause")


_QUERY = "select distinct term as q from term_hits where term is not null"


@query(rf"""with q as ({_QUERY}), t as (select q, regexp_extract_all(q, '\b[A-Za-z][A-Za-z0-9\-]{{1,}}\b') as raw from q)
    select q, array_to_string(list_filter(raw, lambda t: lower(t) not in {words(QUERY_STOPWORDS)} and not (lower(t) in {words(QUERY_GENERIC)} and len(raw) > 2)
      and (length(t) >= 3 or upper(t) = t)), '|') as tokens from t""")
def e29_query_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return _terms(spark, folder).select("q", F.array_join(extract.query_tokens("q"), "|").alias("tokens"))


def _terms(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "term_hits").select(F.col("term").alias("q")).filter("q is not null").distinct()


@query(rf"""with q as ({_QUERY}), raw as (select q, regexp_extract_all(q, '\b[A-Za-z][A-Za-z0-9\-]{{1,}}\b') as raw from q),
    tok as (select q, raw, list_filter(raw, lambda t: lower(t) not in {words(QUERY_STOPWORDS)} and not (lower(t) in {words(QUERY_GENERIC)} and len(raw) > 2) and (length(t) >= 3 or upper(t) = t)) as t from raw),
    c as (
      select q, unnest(t) as a from tok union
      select q, array_to_string(raw, ' ') from tok where len(raw) >= 4 union
      select q, array_to_string(t[i : i + n - 1], ' ') from (select q, t, n, unnest(range(1, len(t) - n + 2)) as i from tok, (select unnest(range(2, 7)) as n)) where length(array_to_string(t[i : i + n - 1], ' ')) >= 5)
    select q, string_agg(a, '|' order by -least(len(string_split(a, ' ')), 6), -length(a), lower(a), a) as anchors from c group by q""")
def e30_query_anchors(spark: SparkSession, folder: str) -> DataFrame:
    found = _terms(spark, folder).select("q", extract.query_anchors("q").alias("a")).filter(F.size("a") > 0)
    return found.select("q", F.array_join("a", "|").alias("anchors"))


@query(rf"""with q as ({_QUERY}), raw as (select q, regexp_extract_all(q, '\b[A-Za-z][A-Za-z0-9\-]{{1,}}\b') as raw from q),
    a as (
      select q, unnest(regexp_extract_all(q, '\b[A-Z][A-Z0-9\-]{{1,}}\b')) as a from q
      union select q, raw[i] || array_to_string(list_transform(raw[i + 1 : i + n - 1], lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), '') from (select q, raw, n, unnest(range(1, len(raw) - n + 2)) as i from raw, (select unnest([2, 3]) as n))
      where regexp_matches(raw[i], '[0-9]') and len(list_filter(raw[i + 1 : i + n - 1], lambda w: lower(w) in {words(QUERY_STOPWORDS)})) = 0),
    s as (select q, string_agg(a, '|' order by a) as aliases from a where lower(a) not in {words(QUERY_STOPWORDS)} group by q)
    select q, coalesce(aliases, '') as aliases,
      array_to_string(list_sort(list_distinct(list_filter([lower(q), regexp_replace(lower(q), '([a-z]\d)([a-z]\d)', '\1 \2', 'g')], lambda v: v <> ''))), '|') as variants from q left join s using (q)""")
def e28_e31_query_analysis(spark: SparkSession, folder: str) -> DataFrame:
    return _terms(spark, folder).select("q", F.array_join(extract.query_aliases("q"), "|").alias("aliases"), F.array_join(extract.query_variants("q"), "|").alias("variants"))


@query(rf"""with q as ({_QUERY}), v as (select q, {hint('q')} as whole, {hint(camel('trim(q)'))} as split from q),
    w as (select q, whole, split, string_split(split, ' ') as w from v),
    n as (select q, {ws('q')} as t from q)
    select w.q,
      array_to_string(list_filter([whole, case when split <> whole then split end, case when split <> whole and len(w) >= 4 and split <> array_to_string(w[-4:], ' ') then array_to_string(w[-4:], ' ') end,
                                   case when split <> whole and len(w) >= 3 and split <> array_to_string(w[-3:], ' ') and whole <> array_to_string(w[-3:], ' ') then array_to_string(w[-3:], ' ') end], lambda x: x is not null and x <> ''), '|') as compounds,
      case when t = '' then '' when contains(t, ' ') and lower(regexp_extract(t, '(\S+)$', 1)) in {words(TRAILING_WORDS)} then t || '|' || regexp_replace(t, '\s+\S+$', '') else t end as variants
    from w join n using (q)""")
def e32_e34_term_variants(spark: SparkSession, folder: str) -> DataFrame:
    return _terms(spark, folder).select("q", F.array_join(extract.compound_variants("q"), "|").alias("compounds"), F.array_join(extract.term_variants("q"), "|").alias("variants"))


@query("""select row_id, spec_no, case when regexp_matches(replace(spec_no, '.', ''), '^[0-9]{5}$')
      then replace(spec_no, '.', '') || '|' || substr(replace(spec_no, '.', ''), 1, 2) || '.' || substr(replace(spec_no, '.', ''), 3) || '|TS ' || substr(replace(spec_no, '.', ''), 1, 2) || '.' || substr(replace(spec_no, '.', ''), 3)
      else spec_no end as spellings from specs where spec_no is not null""")
def e35_spec_spellings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "specs").filter("spec_no is not null").select("row_id", "spec_no", F.array_join(extract.spec_spellings("spec_no"), "|").alias("spellings"))


@query(rf"""with {CORPUS}, t as (select doc_id, unnest(row_cells) as c, generate_subscripts(row_cells, 1) as i from corpus),
    n as (select doc_id, i, c, regexp_replace({ws('c')}, '(?i)^(?:the|a|an)\s+', '') as t from t),
    d as (select doc_id, string_agg(t, '|' order by i) as terms from (select * from n where t <> '' qualify row_number() over (partition by doc_id, {fp('t')} order by i) = 1) group by doc_id),
    e as (select doc_id, string_agg(c, '|' order by i) as cells, count(*) as kept from (select * from n where {fp('c')} <> '' qualify row_number() over (partition by doc_id, {fp('c')} order by i) = 1) group by doc_id)
    select doc_id, coalesce(terms, '') as terms, coalesce(cells, '') as cells, case when coalesce(kept, 0) > 1 then {ws('row_cells[1]')} else '' end as header
    from corpus left join d using (doc_id) left join e using (doc_id)""")
def a1_a5_a7_row_cells(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder).select(
        "doc_id", F.array_join(arrays.distinct_terms("row_cells"), "|").alias("terms"), F.array_join(arrays.distinct_cells("row_cells"), "|").alias("cells"),
        arrays.row_header("row_cells").alias("header"),
    )


@query(rf"""with l as (select row_id, {ws('l')} as l, i from (select row_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from clauses)),
    f as (select *, lag({fp('l')}) over (partition by row_id order by i) as before from l where l <> '')
    select row_id, md5(string_agg(l, chr(10) order by i)) as body, count(*) as lines from f where before is null or before <> {fp('l')} group by row_id""")
def a4_w3_clause_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "clauses").select("row_id", arrays.without_consecutive(F.split("text", "\n")).alias("l")).filter(F.size("l") > 0)
    return lines.select("row_id", F.md5(F.array_join("l", "\n")).alias("body"), F.size("l").cast("bigint").alias("lines"))


_TABLES = """tab as materialized (
  select row_id, cast(i - 1 as integer) as block_no, b.table_rows as m from (select row_id, unnest(blocks) as b, generate_subscripts(blocks, 1) as i from clauses) where b.block_kind = 'table' and len(b.table_rows) > 0)"""


@query(rf"""with {_TABLES}, r as (select row_id, block_no, m, unnest(m) as r, generate_subscripts(m, 1) as n from tab),
    c as (select row_id, block_no, n, i, {ws("coalesce(r[i], '')")} as v, coalesce(nullif(trim(coalesce(m[1][i], '')), ''), 'column_' || i) as h
          from (select *, unnest(range(1, len(r) + 1)) as i from r where n > 1)),
    k as (select *, lag({fp('v')}) over (partition by row_id, block_no, n order by i) as before from c where v <> '')
    select row_id, block_no, cast(n - 1 as integer) as row_no, string_agg(h || ': ' || v, '; ' order by i) as line from k where before is null or before <> {fp('v')} group by all""")
def a6_p5_table_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = enrich.table_rows(table(spark, folder, "clauses"))
    return rows.filter("line <> ''").select("row_id", "block_no", "row_no", "line")


@query(f"""with {_TABLES}, w as (select *, list_max(list_transform(m, lambda r: len(r))) as w from tab),
    r as (select row_id, block_no, w, unnest(m) as r, generate_subscripts(m, 1) as n from w),
    l as (select row_id, block_no, n, w, '| ' || array_to_string(list_transform(list_resize(list_transform(r, lambda c: coalesce(c, '')), w, ''), lambda c: c), ' | ') || ' |' as l from r)
    select row_id, block_no, md5(string_agg(case when n = 1 then l || chr(10) || '| ' || array_to_string(list_transform(range(w), lambda x: '---'), ' | ') || ' |' else l end, chr(10) order by n)) as markdown from l group by all""")
def a9_table_markdown(spark: SparkSession, folder: str) -> DataFrame:
    return enrich.tables(table(spark, folder, "clauses")).select("row_id", "block_no", F.md5(arrays.table_markdown("matrix")).alias("markdown"))


@query(rf"""with {_TABLES}, t as (select t.*, coalesce(c.clause_title, '') as title from tab t join clauses c using (row_id)),
    r as (select row_id, block_no, m, unnest(m) as r, generate_subscripts(m, 1) as n from t),
    c as (select row_id, block_no, n, i, {ws("coalesce(r[i], '')")} as v, coalesce(nullif(trim(coalesce(m[1][i], '')), ''), 'column_' || i) as h from (select *, unnest(range(1, len(r) + 1)) as i from r where n > 1)),
    k as (select *, lag({fp('v')}) over (partition by row_id, block_no, n order by i) as before from c where v <> ''),
    l as (select row_id, block_no, n, 'row ' || (n - 1) || ': ' || string_agg(h || ': ' || v, '; ' order by i) as line from k where before is null or before <> {fp('v')} group by row_id, block_no, n),
    b as (select row_id, block_no, string_agg(line, chr(10) order by n) as body from l group by all),
    o as (select row_id, block_no, case when title <> '' then 'Table ' || title end as name,
                 case when len(m) = 1 then array_to_string(list_filter(list_transform(m[1], lambda v: {ws("coalesce(v, '')")}), lambda v: v <> ''), '; ') end as head from t)
    select row_id, block_no, array_to_string(list_filter([name, head, body], lambda v: v is not null), chr(10)) as lines from o left join b using (row_id, block_no)""")
def a8_table_texts(spark: SparkSession, folder: str) -> DataFrame:
    return enrich.tables(table(spark, folder, "clauses")).select("row_id", "block_no", arrays.table_text("clause_title", "matrix").alias("lines"))


@query(f"""with {CORPUS} select doc_id, array_to_string(list_filter(case when doc_type = 'table_row_doc'
      then [spec_no, clause_id, clause_title, row_header, array_to_string(row_cells, ' | '), text] else [spec_no, clause_id, clause_title, text] end, lambda x: x <> ''), chr(10)) as body,
    case when content_kind = 'table' then text when content_kind = 'table_row' then coalesce(nullif(text, ''), array_to_string(row_cells, '; ')) else text end as searchable from corpus""")
def a12_k3_record_texts(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder).select(
        "doc_id", enrich.record_body().alias("body"), enrich.searchable_text().alias("searchable")
    )


@query(f"""select row_id, lower(concat_ws(' ', clause_id, clause_title, text, array_to_string(coalesce(clause_path, []), ' '))) as search from clauses""")
def a14_search_text(spark: SparkSession, folder: str) -> DataFrame:
    path = F.array_join(F.coalesce("clause_path", F.array().cast("array<string>")), " ")
    return table(spark, folder, "clauses").select("row_id", F.lower(F.concat_ws(" ", "clause_id", "clause_title", "text", path)).alias("search"))


@query(rf"""select row_id, regexp_extract(source_file, '(\d{{5}})[^/]*$', 1) as spec, regexp_extract(source_file, '/(\d{{4}}-\d{{2}})/', 1) as release_data,
    regexp_extract(source_file, '/(Rel-[^/]+)/', 1) as release, regexp_extract(source_file, '-([a-z]\d{{2}})\.[^./]+$', 1) as version, substr(regexp_extract(source_file, '(\d{{5}})[^/]*$', 1), 1, 2) as series from clauses where source_file is not null""")
def s9_path_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return enrich.path_metadata(table(spark, folder, "clauses").filter("source_file is not null"), "source_file").select("row_id", "spec", "release_data", "release", "version", "series")


@query(rf"""with {CORPUS}, a as (select doc_id, {camel('clause_title')} as a, {camel('row_header')} as b from corpus),
    t as (select doc_id, list_distinct(list_filter(string_split(lower(a), ' '), lambda t: t <> '' and t not in {words(OVERLAP_GENERIC)})) as x,
                 list_distinct(list_filter(string_split(lower(b), ' '), lambda t: t <> '' and t not in {words(OVERLAP_GENERIC)})) as y from a)
    select doc_id, len(list_intersect(x, y)) as overlap from t""")
def r5_u2_token_overlap(spark: SparkSession, folder: str) -> DataFrame:
    both = F.array_intersect(extract.overlap_tokens("clause_title"), extract.overlap_tokens("row_header"))
    return corpus(spark, folder).select("doc_id", F.size(both).cast("bigint").alias("overlap"))
