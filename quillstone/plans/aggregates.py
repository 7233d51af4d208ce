"""Queries of enrichment, aggregations, filters and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions.extract import COMPOUND_TOKEN, QUERY_STOPWORDS, TRAILING_WORDS
from quillstone.lineage import cut
from quillstone.operators import aggregate, enrich, select
from quillstone.operators.aggregate import GENERIC_CANDIDATES, GENERIC_HINTS, GENERIC_SIGNALS, NOISY_HINT
from quillstone.plans.record_sql import ANCHOR_ROWS, ENRICHED
from quillstone.plans.registry import CORPUS, Registry, camel, hint, strip, words, ws
from quillstone.sources.corpus import corpus
from quillstone.sources.tables import DOCUMENT, counted_clauses, current_clauses, table

R = Registry()
QUERIES, ORACLES, query = R.queries, R.oracles, R.query


def _enriched(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """``columns`` (none: all) of the enriched corpus, written once: what uses them several times does not extract them anew."""
    rows = enrich.enriched(corpus(spark, folder))
    return cut(rows.select(*columns) if columns else rows)


#: What a registry of terms is made of.
REGISTRY = ["doc_id", "spec_no", "release_data", "release", "clause_title", "row_header", "anchor_terms", "keywords", "text"]


@query(f"""with {ENRICHED}, a as (select doc_id, string_agg(term, '|' order by pos) as anchor_terms from anchors group by doc_id),
    k as (select doc_id, string_agg(word, '|' order by place) as keywords from kw group by doc_id)
    select doc_id, coalesce(anchor_terms, '') as anchor_terms, coalesce(keywords, '') as keywords from corpus left join a using (doc_id) left join k using (doc_id)""")
def p1_enriched_records(spark: SparkSession, folder: str) -> DataFrame:
    return enrich.enriched(corpus(spark, folder)).select("doc_id", F.array_join("anchor_terms", "|").alias("anchor_terms"), F.array_join("keywords", "|").alias("keywords"))


@query(f"""with {ENRICHED} select doc_id as source_doc_id, case kind when 'ie_name' then 'ie' else 'message' end as entity_type, term as entity_name,
    concat_ws(':', doc_id, 'entity', case kind when 'ie_name' then 'ie' else 'message' end, pos - 1) as doc_id from terms where kind in ('ie_name', 'message_name')""")
def p3_entity_rows(spark: SparkSession, folder: str) -> DataFrame:
    return enrich.entities(enrich.structured_terms(corpus(spark, folder))).select("doc_id", "source_doc_id", "entity_type", "entity_name")


@query(f"""with recursive l as materialized (select row_id, {ws('l')} as l, row_number() over (partition by row_id order by i) as n from (
      select row_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from clauses) where {ws('l')} <> ''),
    pack as (
      select row_id, n, 1 as piece, 1 as ps, length(l) as chars from l where n = 1
      union all
      select l.row_id, l.n, case when k.ps >= 4 or k.chars + 1 + length(l.l) > 1200 then k.piece + 1 else k.piece end,
             case when k.ps >= 4 or k.chars + 1 + length(l.l) > 1200 then 1 else k.ps + 1 end,
             case when k.ps >= 4 or k.chars + 1 + length(l.l) > 1200 then length(l.l) else k.chars + 1 + length(l.l) end
      from pack k join l on l.row_id = k.row_id and l.n = k.n + 1),
    made as (select row_id, piece, count(*) as paragraphs, string_agg(l, chr(10) order by n) as passage from pack join l using (row_id, n) group by row_id, piece)
    select row_id, cast(piece - 1 as integer) as passage_no, paragraphs, passage from made
    qualify count(*) over (partition by row_id) > 1 or length(passage) >= 350""")
def p4_passages(spark: SparkSession, folder: str) -> DataFrame:
    return enrich.passages(table(spark, folder, "clauses"))


def _variants(c: str) -> str:
    generic = rf"contains({ws(c)}, ' ') and lower(regexp_extract({ws(c)}, '(\S+)$', 1)) in {words(TRAILING_WORDS)}"
    return rf"list_distinct(case when {generic} then [{ws(c)}, regexp_replace({ws(c)}, '\s+\S+$', '')] else [{ws(c)}] end)"


_SOURCE_TERMS = f"""st as materialized (select doc_id, spec_no, {ws('t')} as term, source from (
      select doc_id, spec_no, unnest({_variants('clause_title')}) as t, 'clause_title' as source from corpus
      union all select doc_id, spec_no, unnest({_variants('row_header')}), 'row_header' from corpus
      union all select doc_id, spec_no, long_form, 'abbreviation_long' from abbr join corpus using (doc_id)
      union all select doc_id, spec_no, short_form, 'abbreviation_short' from abbr join corpus using (doc_id)
      union all select doc_id, spec_no, unnest(row_cells), 'row_value' from corpus) where {ws('t')} <> '')"""


@query(f"with {ENRICHED}, {_SOURCE_TERMS} select term, source, count(*) as uses from st group by all")
def p8_anchor_source_terms(spark: SparkSession, folder: str) -> DataFrame:
    return enrich.anchor_source_terms(corpus(spark, folder)).groupBy("term", "source").agg(F.count(F.lit(1)).alias("uses"))


@query(f"""with {ENRICHED}, {_SOURCE_TERMS},
    t as (select * from st where length(term) >= 3),
    w as (select term, sum(least(n, 3) * case source when 'clause_title' then 2.0 when 'row_header' then 1.7 when 'abbreviation_long' then 1.2 when 'abbreviation_short' then 1.5 else 0.4 end::double) as w
          from (select term, source, count(*) as n from t group by all) group by term),
    s as (select term, count(distinct nullif(spec_no, '')) as spec_count, count(distinct doc_id) as doc_count from t group by term),
    x as (select *, w + case when spec_count > 1 then least(2.0, 0.6 * (spec_count - 1)) else 0 end - case when lower(term) in {words(GENERIC_CANDIDATES)} then 2.5 else 0 end
          - case when not contains(term, ' ') and lower(term) = term and regexp_matches(term, '\\p{{Ll}}') then 0.5 else 0 end as total from w join s using (term))
    select term, round(total, 3)::double as score, case when round(total, 6) >= 4.5 then 'strong' when round(total, 6) >= 2 then 'normal' else 'reject' end as classification, spec_count, doc_count from x""")
def g1_anchor_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return aggregate.anchor_candidates(corpus(spark, folder))


_REGISTRY_TERMS = rf"""wt as (
      select doc_id, clause_title as t, 2.5::double as w, 0 as a, 1 as b from corpus union all select doc_id, row_header, 2.2, 1, 1 from corpus
      union all select doc_id, term, 1.6, 2, pos from anchors where pos <= 12 union all select doc_id, word, 0.8, 3, place from kw where place <= 8
      union all select doc_id, t, 1.3, 4, i from (select doc_id, unnest(regexp_extract_all(text, '{COMPOUND_TOKEN}')) as t, generate_subscripts(regexp_extract_all(text, '{COMPOUND_TOKEN}'), 1) as i from corpus)
        where regexp_matches(t, '[0-9]') or contains(t, '_') or regexp_matches(t, '[A-Z].*[A-Z]')),
    v as (select doc_id, w, a, b, {hint('t')} as whole, {hint(camel('trim(t)'))} as split from wt),
    e as (
      select doc_id, w, a, b, 1 as c, whole as term from v
      union all select doc_id, w, a, b, 2, split from v where split <> whole
      union all select doc_id, w, a, b, 3, array_to_string(string_split(split, ' ')[-4:], ' ') from v where split <> whole and len(string_split(split, ' ')) >= 4
      union all select doc_id, w, a, b, 4, array_to_string(string_split(split, ' ')[-3:], ' ') from v where split <> whole and len(string_split(split, ' ')) >= 3),
    rt as materialized (
      select doc_id, spec_no, release_data, release, term, w from e join corpus using (doc_id)
      where spec_no <> '' and length(term) >= 4 and term not in {words(GENERIC_HINTS)} and term not in {words(QUERY_STOPWORDS)}
        and not regexp_matches(term, '{NOISY_HINT}')
        and not (not contains(term, ' ') and lower(term) = term and regexp_matches(term, '\p{{Ll}}'))
        and len(list_filter(string_split(term, ' '), lambda x: x not in {words(QUERY_STOPWORDS)})) > 0
      qualify row_number() over (partition by doc_id, term order by a, b, c) = 1)"""


def _registry_sql(scope: str) -> str:
    by, comma = (f"partition by {scope}", f"{scope}, ") if scope else ("", "")
    specs = f"select {comma}count(distinct spec_no) as specs from corpus where spec_no <> '' {f'group by {scope}' if scope else ''}"
    join = f"join ({specs}) using ({scope})" if scope else f"cross join ({specs})"
    return f"""with {ENRICHED}, {_REGISTRY_TERMS},
    f as (select {comma}spec_no, term, sum(w) as tf from rt group by all), s as (select *, count(*) over (partition by {comma}term) as spread from f),
    x as (select {comma}spec_no, term, tf * ln(1 + specs / spread) as score, spread, specs from s {join})
    select {comma}spec_no, term, round(score, 3) as score from x where spread <= greatest(3, specs // 2) and round(score, 9) >= 2.2
    qualify row_number() over (partition by {comma}spec_no order by round(score, 3) desc, term) <= 24"""


@query(_registry_sql(""))
def g2_p7_f12_registry(spark: SparkSession, folder: str) -> DataFrame:
    return aggregate.term_registry(_enriched(spark, folder, *REGISTRY), [])


@query(_registry_sql("release_data, release"))
def g18_release_registries(spark: SparkSession, folder: str) -> DataFrame:
    return aggregate.term_registry(_enriched(spark, folder, *REGISTRY), ["release_data", "release"])


@query(f"""with {ENRICHED}, s as (
      select term as t, 'strong_anchor' as r, 2.0 as w from anchors union all select unnest(referenced_specs), 'referenced_spec', 1.5 from corpus
      union all select unnest(referenced_clauses), 'referenced_clause', 1.0 from corpus union all select row_header, 'row_header', 1.1 from corpus union all select word, 'keyword', 0.6 from kw where place <= 5),
    g as (select t, round(sum(w::double) - case when lower(t) in {words(GENERIC_SIGNALS)} then 1.5 else 0 end, 6) as s, array_to_string(list_sort(list(distinct r)), '|') as reasons from s where trim(t) <> '' group by t)
    select t as signal, round(s, 3) as score, reasons, case when s >= 4 then 'strong' when s >= 1.5 then 'normal' else 'reject' end as classification from g""")
def g4_expansion_signals(spark: SparkSession, folder: str) -> DataFrame:
    return aggregate.expansion_signals(enrich.enriched(corpus(spark, folder)))


@query(f"""with {ENRICHED}, {ANCHOR_ROWS} select arg_min(anchor, (row_id, place)) as anchor, array_to_string(list_sort(list(distinct source)), '|') as sources,
    count(distinct doc_id) as doc_count, count(distinct nullif(spec_no, '')) as spec_count from anchor_rows group by lower(anchor)""")
def g5_anchors(spark: SparkSession, folder: str) -> DataFrame:
    return aggregate.anchors(enrich.structured_terms(corpus(spark, folder)))


_HITS = """hits as (select cast(l_suppkey as varchar) as spec_no, concat(l_orderkey, ':', l_linenumber) as doc_id, round(l_discount * 10, 3) as score,
    case l_returnflag when 'N' then 'direct_hit' when 'A' then 'anchor_hit' else 'table_row_hit' end as reason_type, cast(l_partkey % 50 as varchar) as clause_id, l_linestatus as clause_title from lineitem)"""


def _hits(spark: SparkSession, folder: str) -> DataFrame:
    flag = F.when(F.col("l_returnflag") == "N", "direct_hit").when(F.col("l_returnflag") == "A", "anchor_hit").otherwise("table_row_hit")
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("spec_no"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("doc_id"), F.round(F.col("l_discount") * 10, 3).alias("score"),
        flag.alias("reason_type"), (F.col("l_partkey") % 50).cast("string").alias("clause_id"), F.col("l_linestatus").alias("clause_title"),
    )


@query(f"""with {_HITS} select spec_no || ':' || clause_id as key, max(score) as score, md5(array_to_string(list_sort(list(distinct doc_id)), '|')) as docs,
    array_to_string(list_sort(list(distinct reason_type)), '|') as reasons from hits group by 1""")
def g6_merged_clauses(spark: SparkSession, folder: str) -> DataFrame:
    return aggregate.merged_clauses(_hits(spark, folder)).select("key", "score", F.md5("doc_ids").alias("docs"), "reasons")


@query(f"""with {_HITS}, w as (select *, score * case reason_type when 'direct_hit' then 3.0 when 'anchor_hit' then 2.0 else 1.8 end::double as s from hits),
    t as (select spec_no, sum(s / power(i, 0.8)) as blend from (select *, row_number() over (partition by spec_no order by s desc) as i from w) where i <= 5 group by spec_no),
    d as (select spec_no, count(distinct doc_id) as doc_count, count(distinct reason_type) as reasons from w group by spec_no)
    select spec_no, round(blend + 0.35 * ln(1 + doc_count) + 0.45 * (reasons - 1), 3) as score, doc_count from t join d using (spec_no)""")
def g7_r7_w1_ranked_specs(spark: SparkSession, folder: str) -> DataFrame:
    return aggregate.ranked_specs(_hits(spark, folder))


@query(f"""with {CORPUS} select spec_no, array_to_string(list_filter(['Stage 2', 'Stage 3', 'else'], lambda s: list_contains(list(distinct stage_hint), s)), '|') as stages
    from corpus where stage_hint in ('Stage 2', 'Stage 3', 'else') group by spec_no""".replace("list_filter(['Stage 2', 'Stage 3', 'else'], lambda s: list_contains(list(distinct stage_hint), s))", "list_sort(list(distinct stage_hint))"))
def g8_r9_spec_stages(spark: SparkSession, folder: str) -> DataFrame:
    return aggregate.spec_stages(corpus(spark, folder))


@query(f"""with {CORPUS}, c as (select spec_no, clause_title, count(*) as uses from corpus where clause_title <> '' group by all)
    select *, cast(row_number() over (partition by spec_no order by uses desc, clause_title) as integer) as place from c qualify place <= 48""")
def g8_w2_top_titles(spark: SparkSession, folder: str) -> DataFrame:
    return aggregate.top_values(corpus(spark, folder).filter("clause_title <> ''"), "spec_no", "clause_title", 48)


_COUNTED = f"""counted as materialized (select *, {strip('spec_no')} as spec, {strip('clause_id')} as clause, nullif({strip('parent_clause_id')}, '') as parent from clauses
  where coalesce({strip('spec_no')}, '') <> '' and coalesce({strip('clause_id')}, '') <> ''),
cur as materialized (select * from counted qualify row_number() over (partition by release_data, release, spec, clause order by ingested_at desc nulls last, row_id desc) = 1)"""


def _clauses(spark: SparkSession, folder: str) -> DataFrame:
    keep = {c: F.col(c) for c in ("row_id", "doc_id", "parent", "clause_title", "spec_title", "source_file", "order_in_source", "clause_path", "text")}
    return current_clauses(table(spark, folder, "clauses"), keep)


@query(f"""with {_COUNTED} select release_data, release, spec, count(*) as clauses, cast(count_if(parent is null) as bigint) as roots,
    arg_min_null(spec_title, (coalesce(order_in_source, 0), clause)) as title, arg_min_null(source_file, (coalesce(order_in_source, 0), clause)) as source from cur group by all""")
def g10_document_summaries(spark: SparkSession, folder: str) -> DataFrame:
    return aggregate.document_summaries(_clauses(spark, folder), DOCUMENT)


@query(f"""with {CORPUS}, t as (select spec_no, clause_id, text, min(row_id) as first from corpus where text <> '' group by all),
    h as (select spec_no, clause_id, arg_min(clause_title, row_id) as title from corpus group by all)
    select spec_no, clause_id, title, count(text) as texts, md5(coalesce(string_agg(text, chr(10) order by first), '')) as body from h left join t using (spec_no, clause_id) group by all""")
def g12_merged_texts(spark: SparkSession, folder: str) -> DataFrame:
    return aggregate.merged_texts(corpus(spark, folder), ["spec_no", "clause_id"], ["row_id"])


@query(f"""with {CORPUS}, t as (select spec_no, clause_id, text, min(row_id) as first from corpus where text <> '' group by all)
    select spec_no, clause_id, cast(row_number() over (partition by spec_no, clause_id order by first) as integer) as place, text from t""")
def g12_distinct_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The texts that ``g12_merged_texts`` joins, as rows."""
    return aggregate.distinct_texts(corpus(spark, folder), ["spec_no", "clause_id"], ["row_id"]).select("spec_no", "clause_id", "place", "text")


@query(f"""select coalesce(nullif({strip('release')}, ''), 'unknown-release') as release, coalesce(nullif({strip('spec_no')}, ''), 'unknown-spec') as spec, count(*) as documents from documents group by all""")
def g17_grouped_sources(spark: SparkSession, folder: str) -> DataFrame:
    return select.grouped_sources(table(spark, folder, "documents"))


# --- filters, joins and set operations -----------------------------------------------------------------------------------


@query(f"""with {CORPUS} select doc_id from corpus where contains(lower(concat_ws(' ', clause_title, row_header, text)), 'paging') or contains(lower(concat_ws(' ', clause_title, row_header, text)), 'tunnel profile')""")
def f1_f3_any_term(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder).filter(select.contains_any(["clause_title", "row_header", "text"], ["paging", " tunnel profile ", "", "paging"])).select("doc_id")


@query(f"""with {CORPUS} select doc_id from corpus where stage_hint in ('Stage 2', 'Stage 3') and release = 'Rel-17'
    and spec_no not in ('48491') and not (spec_no = '57913' and clause_id in ('1', '1.1', '1.1.1'))""")
def f2_f4_f5_scope(spark: SparkSession, folder: str) -> DataFrame:
    scope = select.Scope(stages=["Stage 2", "Stage 3"], release="Rel-17", excluded_specs=["48491"], excluded_clauses=[("57913", c) for c in ("1", "1.1", "1.1.1")])
    return corpus(spark, folder).filter(scope.condition()).select("doc_id")


@query(f"""with {CORPUS}, gone as (select distinct {strip('spec_no')} as s from specs where withdrawn_at is not null),
    del as (select distinct {strip('spec_no')} as s, {strip('clause_id')} as c from clauses where deleted_at is not null)
    select doc_id from corpus where clause_id <> '' and spec_no not in (select s from gone where s is not null) and not exists (select 1 from del where s = spec_no and c = clause_id)""")
def f6_f7_f16_exclusions(spark: SparkSession, folder: str) -> DataFrame:
    from quillstone.functions.text import strip_white

    specs = table(spark, folder, "specs").filter("withdrawn_at is not null").select(strip_white("spec_no").alias("spec_no"))
    pairs = table(spark, folder, "clauses").filter("deleted_at is not null").select(strip_white("spec_no").alias("spec_no"), strip_white("clause_id").alias("clause_id"))
    return select.without_excluded(corpus(spark, folder), specs, pairs).select("doc_id")


@query(f"""with {_COUNTED}, hit as (select distinct release_data, release, spec from cur where contains(lower(clause_title), 'paging'))
    select release_data, release, spec, count(*) as clauses from cur semi join hit using (release_data, release, spec) where release = 'Rel-17' group by all""")
def f8_documents_with_clause(spark: SparkSession, folder: str) -> DataFrame:
    clauses = _clauses(spark, folder)
    found = select.documents_with(clauses.filter("release = 'Rel-17'"), clauses.filter(F.contains(F.lower("clause_title"), F.lit("paging"))), DOCUMENT)
    return found.groupBy(*DOCUMENT).agg(F.count(F.lit(1)).alias("clauses"))


@query(f"""with {_COUNTED} select row_id from cur c where parent is null or not exists (
    select 1 from cur p where (p.release_data, p.release, p.spec, p.clause) = (c.release_data, c.release, c.spec, c.parent))""")
def f9_j4_root_clauses(spark: SparkSession, folder: str) -> DataFrame:
    return select.roots(_clauses(spark, folder), DOCUMENT).select("row_id")


@query(f"""with {CORPUS} select doc_id, row_id from corpus where text <> '' qualify row_number() over (partition by lower({ws('text')}) order by row_id) = 1""")
def f14_w7_new_contents(spark: SparkSession, folder: str) -> DataFrame:
    return select.first_per_content(corpus(spark, folder).filter("text <> ''"), "text", ["row_id"]).select("doc_id", "row_id")


@query(f"""with {CORPUS}, {_COUNTED} select c.doc_id, k.clause is not null as known from corpus c left join cur k
    on (c.release_data, c.release, c.spec_no, c.clause_id) = (k.release_data, k.release, k.spec, k.clause)""")
def f15_j1_known_clauses(spark: SparkSession, folder: str) -> DataFrame:
    clauses = _clauses(spark, folder).select("release_data", "release", F.col("spec").alias("spec_no"), F.col("clause").alias("clause_id"), F.lit(True).alias("known"))
    return corpus(spark, folder).join(clauses, ["release_data", "release", "spec_no", "clause_id"], "left").select("doc_id", F.coalesce("known", F.lit(False)).alias("known"))


@query(f"""with {_COUNTED}, {CORPUS}, r as (select release_data, release, spec_no as spec, clause_id as clause, count(*) as records, max(text) as body from corpus where spec_no <> '' and clause_id <> '' group by all)
    select coalesce(c.release_data, r.release_data) as release_data, coalesce(c.release, r.release) as release, coalesce(c.spec, r.spec) as spec, coalesce(c.clause, r.clause) as clause,
           coalesce(records, 0) as records, md5(coalesce(nullif(r.body, ''), c.text, '')) as body
    from cur c full join r on (c.release_data, c.release, c.spec, c.clause) = (r.release_data, r.release, r.spec, r.clause)""")
def j3_clauses_and_records(spark: SparkSession, folder: str) -> DataFrame:
    rich = corpus(spark, folder).filter("spec_no <> '' and clause_id <> ''").groupBy("release_data", "release", F.col("spec_no").alias("spec"), F.col("clause_id").alias("clause"))
    rich = rich.agg(F.count(F.lit(1)).alias("records"), F.max("text").alias("body"))
    both = _clauses(spark, folder).select(*DOCUMENT, "clause", "text").join(rich, [*DOCUMENT, "clause"], "full_outer")
    return both.select(*DOCUMENT, "clause", F.coalesce("records", F.lit(0)).alias("records"), F.md5(F.coalesce(F.nullif("body", F.lit("")), "text", F.lit(""))).alias("body"))


@query("""with base as (select 0 as part, doc_id, text from documents union all select 1, doc_id, 'v2 ' || text from documents where collected_at >= timestamp '2025-06-01')
    select doc_id, md5(text) as body from base qualify row_number() over (partition by doc_id order by part desc) = 1""")
def w8_u4_overlay(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    late = documents.filter("collected_at >= timestamp '2025-06-01'").select("doc_id", F.concat(F.lit("v2 "), "text").alias("text"))
    return select.overlaid([documents.select("doc_id", "text"), late], ["doc_id"]).select("doc_id", F.md5("text").alias("body"))


@query(f"""with {CORPUS} select distinct release_data, release, dense_rank() over (order by release_data, release) as place from corpus where release_data <> '' and release <> ''""")
def o6_release_scopes(spark: SparkSession, folder: str) -> DataFrame:
    scopes = corpus(spark, folder).filter("release_data <> '' and release <> ''").select("release_data", "release").distinct()
    return scopes.withColumn("place", F.row_number().over(Window.orderBy("release_data", "release")).cast("bigint"))


__all__ = ["ORACLES", "QUERIES", "counted_clauses"]
