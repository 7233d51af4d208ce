"""Queries of smaller projections, joins and marks over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import arrays, extract, text
from quillstone.functions.extract import CAPTION, GENERIC_TITLES, RELATIVE_HEADING
from quillstone.functions.text import GENERIC_ANCHORS
from quillstone.operators import enrich, hops, select
from quillstone.plans.registry import CORPUS, Registry, camel, fp, strip, words, ws
from quillstone.schema import with_defaults
from quillstone.sources.corpus import corpus
from quillstone.sources.tables import table

R = Registry()
QUERIES, ORACLES, query = R.queries, R.oracles, R.query


_STAGE = r"lower(regexp_replace(stage_hint, '[\s\x0B\x{85}\pZ]+', '', 'g'))"


@query(f"""select row_id, case {_STAGE} when 'else' then 'else' else 'Stage ' || right({_STAGE}, 1) end as stage from specs where {_STAGE} in ('stage2', '2', 'stage3', '3', 'else')""")
def x15_stage_filters(spark: SparkSession, folder: str) -> DataFrame:
    known = F.lower(F.regexp_replace("stage_hint", r"(?U)\s+", "")).isin("stage2", "2", "stage3", "3", "else")
    return table(spark, folder, "specs").filter(known).select("row_id", text.stage_filter("stage_hint").alias("stage"))


@query(rf"""with {CORPUS}, c as (select doc_id, unnest(row_cells) as c, generate_subscripts(row_cells, 1) as i from corpus),
    a as (select doc_id, string_agg(t, '|' order by i) as once from (select doc_id, trim(c) as t, i from c where trim(c) <> '' qualify row_number() over (partition by doc_id, trim(c) order by i) = 1) group by doc_id),
    b as (select doc_id, string_agg(t, '|' order by i) as words from (select * from (select doc_id, {ws('c')} as t, i from c where {ws('c')} <> '' qualify row_number() over (partition by doc_id, lower({ws('c')}) order by i) = 1)
          qualify row_number() over (partition by doc_id order by i) <= 2) group by doc_id)
    select doc_id, coalesce(once, '') as once, coalesce(words, '') as words from corpus left join a using (doc_id) left join b using (doc_id)""")
def a2_a3_row_words(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder).select("doc_id", F.array_join(arrays.distinct_trimmed("row_cells"), "|").alias("once"), F.array_join(arrays.keyword_list("row_cells", 2), "|").alias("words"))


@query(rf"""with c as (select row_id, {ws("concat('.', coalesce(clause_id, ''), ' ', coalesce(clause_title, ''))")} as l, {ws("concat('Table ', coalesce(clause_id, ''), ': ', coalesce(clause_title, ''))")} as t,
      coalesce(clause_title, '') as title, coalesce(len(clause_path), 0) as n from clauses)
    select row_id, nullif(regexp_extract(l, '{RELATIVE_HEADING}', 1), '') as relative, nullif(regexp_extract(l, '{RELATIVE_HEADING}', 2), '') as relative_title, regexp_matches(t, '{CAPTION}') as caption,
           lower({camel('title')}) not in {words(['', *GENERIC_ANCHORS, *GENERIC_TITLES])} as next_hop, cast(n as integer) as level from c""")
def e16_e19_e36_e37_line_kinds(spark: SparkSession, folder: str) -> DataFrame:
    name, title = F.coalesce("clause_id", F.lit("")), F.coalesce("clause_title", F.lit(""))
    relative = extract.relative_heading(F.concat(F.lit("."), name, F.lit(" "), title))
    depth = F.coalesce(F.nullif(F.size("clause_path"), F.lit(-1)), F.lit(0))
    return table(spark, folder, "clauses").select(
        "row_id", relative["clause"].alias("relative"), relative["title"].alias("relative_title"), extract.is_caption(F.concat(F.lit("Table "), name, F.lit(": "), title)).alias("caption"),
        extract.is_next_hop_title(title).alias("next_hop"), extract.style_level(F.concat(F.lit("Heading "), depth)).alias("level"),
    )


@query(rf"""with h as (select row_id, {ws("concat(coalesce(clause_id, ''), ' ', coalesce(clause_title, ''))")} as l, row_id % 3 as s from clauses)
    select row_id, s = 2 or (s = 0 and (regexp_matches(l, '{extract.ANNEX_HEADING}') or regexp_matches(l, '{extract.NUMBERED_HEADING}')) and not starts_with(l, 'Annex') and not ends_with(l, '.')) as heading from h""")
def e21_heading_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """A third of the lines has a heading style, a third no style, and a third an outline level."""
    line = F.concat(F.coalesce("clause_id", F.lit("")), F.lit(" "), F.coalesce("clause_title", F.lit("")))
    rows = table(spark, folder, "clauses").select("row_id", line.alias("line"), F.when(F.col("row_id") % 3 == 0, "Heading 1").otherwise("Normal").alias("style"), F.when(F.col("row_id") % 3 == 2, 1).alias("level"))
    return rows.select("row_id", extract.is_heading("line", "style", F.col("level")).alias("heading"))


@query("""select row_id, coalesce(doc_type, 'clause_doc') as doc_type, coalesce(content_kind, 'clause') as content_kind, coalesce(spec_no, '') as spec_no, coalesce(embedding_dim, 0) as embedding_dim,
    len(coalesce(row_cells, [])) as cells, 1.0::double as retrieval_weight, cast(-1 as integer) as row_index, '' as summary from records""")
def s2_p11_p12_full_records(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "records")
    full = with_defaults(rows.withColumn("source_doc_id", F.col("row_id").cast("string")))
    return full.select(F.col("source_doc_id").cast("bigint").alias("row_id"), "doc_type", "content_kind", "spec_no", "embedding_dim", F.size("row_cells").cast("bigint").alias("cells"), "retrieval_weight", "row_index", "summary")


@query(f"""with {CORPUS}, v as (select doc_id, bool_or(term_source = 'clause_title') as relevant from term_hits where doc_id is not null group by doc_id),
    k as (select doc_id, string_agg(term, '|' order by term) as keywords from (select distinct doc_id, term from term_hits where term is not null and doc_id is not null) group by doc_id)
    select doc_id, coalesce(relevant, false) as relevant, coalesce(keywords, '') as keywords from corpus left join v using (doc_id) left join k using (doc_id)""")
def p10_j2_m9_judged_hits(spark: SparkSession, folder: str) -> DataFrame:
    hits = table(spark, folder, "term_hits")
    verdicts = hits.select("doc_id", (F.col("term_source") == "clause_title").alias("relevant"))
    shown = hops.judged(corpus(spark, folder).select("doc_id"), verdicts, hits.select("doc_id", F.col("term").alias("keyword")))
    return shown.select("doc_id", "relevant", F.array_join("keywords", "|").alias("keywords"))


@query(f"""with x as (select distinct lower({ws('term')}) as t from candidate_scores where classification = 'reject' and term is not null)
    select hit_id from term_hits where term is not null and lower({ws('term')}) not in (select t from x)""")
def f13_without_keywords(spark: SparkSession, folder: str) -> DataFrame:
    excluded = table(spark, folder, "candidate_scores").filter("classification = 'reject' and term is not null").select(text.search_term("term").alias("_term")).distinct()
    return table(spark, folder, "term_hits").filter("term is not null").withColumn("_term", text.search_term("term")).join(excluded, "_term", "left_anti").select("hit_id")


@query(rf"""with {CORPUS}, r as (select spec_no, {ws('e')} as e from (select spec_no, unnest(referenced_clauses) as e from corpus)),
    t as (select distinct spec_no, regexp_extract(e, '(?i)^(?:clause\s+)?(\d+(?:\.\d+[a-z]?)+)$', 1) as clause_id from r where spec_no <> '' and regexp_matches(e, '(?i)^(?:clause\s+)?(\d+(?:\.\d+[a-z]?)+)$'))
    select doc_id, 99.0::double as score from corpus semi join t using (spec_no, clause_id)""")
def j12_m7_clause_targets(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus(spark, folder)
    targets = rows.select(F.explode("referenced_clauses").alias("e"), "spec_no").select(extract.clause_target("e", "spec_no").alias("t")).filter("t is not null").select("t.spec", "t.clause")
    return hops.clause_targets(rows, targets).select("doc_id", "score")


@query(f"""select arg_min(term, hit_id) as keyword, min(hit_id) as first from term_hits where lower({ws('term')}) <> '' group by lower({ws('term')})""")
def g13_collected_keywords(spark: SparkSession, folder: str) -> DataFrame:
    words_of = table(spark, folder, "term_hits").filter("term is not null").select(F.col("term").alias("keyword"), "hit_id")
    return select.collected(words_of, "keyword", ["hit_id"]).select("keyword", F.col("first.hit_id").alias("first"))


@query(f"""with {CORPUS}, v as (select doc_id from term_hits where term_source = 'clause_title' and doc_id is not null group by doc_id)
    select spec_no, clause_id, substr({strip('text')}, 1, 240) as preview from corpus semi join v using (doc_id) where spec_no <> '' and clause_id <> ''
    qualify row_number() over (partition by spec_no, clause_id order by row_id) = 1""")
def m10_hit_views(spark: SparkSession, folder: str) -> DataFrame:
    relevant = table(spark, folder, "term_hits").filter("term_source = 'clause_title' and doc_id is not null").select("doc_id", F.lit(True).alias("relevant")).distinct()
    return select.hit_views(corpus(spark, folder).join(relevant, "doc_id", "left"), ["row_id"])


@query(rf"""with {CORPUS}, s as (select doc_id, {strip('clause_title')} as a, {strip('row_header')} as b, {strip('substr(text, 1, 1200)')} as c, {strip("array_to_string(row_cells, ' ')")} as d from corpus)
    select doc_id, array_to_string(list_filter([a, b, c], lambda x: x <> ''), chr(10)) as context, array_to_string(list_filter([c, d], lambda x: x <> ''), chr(10)) as content from s""")
def a13_record_contexts(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus(spark, folder).withColumns({c: F.lit("") for c in ("spec_title", "table_title", "summary", "table_markdown")})
    return rows.select("doc_id", enrich.record_context().alias("context"), enrich.content_text().alias("content"))


@query(rf"""with l as (select row_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '\r?\n'), lambda v: {strip('v')}), lambda v: v <> '')) as block_text,
      generate_subscripts(list_filter(list_transform(regexp_split_to_array(text, '\r?\n'), lambda v: {strip('v')}), lambda v: v <> ''), 1) as n from clauses where blocks is null or len(blocks) = 0)
    select row_id, cast(n - 1 as integer) as block_no, 'paragraph' as block_kind, block_text from l""")
def a15_fallback_blocks(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "clauses").filter("blocks is null or size(blocks) = 0")
    return rows.select("row_id", F.posexplode(enrich.fallback_blocks("text")).alias("block_no", "b")).select("row_id", "block_no", "b.block_kind", "b.block_text")


_LIST = "coalesce(spec_no, '') || ':' || coalesce(clause_id, '') || ', ' || chr(10) || coalesce(spec_no, '') || ',x:'"


@query(rf"""with t as (select row_id, unnest(regexp_split_to_array({_LIST}, '\r?\n|,')) as p from clauses), s as (select row_id, {strip('p')} as p from t where {strip('p')} <> '')
    select row_id, count(*) as items, count_if({strip("string_split(p, ':')[1]")} <> '' and coalesce({strip("string_split(p, ':')[2]")}, '') <> '')::bigint as pairs from s group by row_id""")
def e38_exclusion_texts(spark: SparkSession, folder: str) -> DataFrame:
    name, clause = F.coalesce("spec_no", F.lit("")), F.coalesce("clause_id", F.lit(""))
    entered = F.concat(name, F.lit(":"), clause, F.lit(", \n"), name, F.lit(",x:"))
    rows = table(spark, folder, "clauses").select("row_id", entered.alias("t"))
    return rows.select("row_id", F.size(select.excluded_specs("t")).cast("bigint").alias("items"), F.size(select.excluded_clauses("t")).cast("bigint").alias("pairs"))


@query(r"""with c as (select row_id, source_file, regexp_extract(source_file, '([^/]*)$', 1) as name, regexp_extract(source_file, '/(Rel-[^/]+)/', 1) as hinted,
      regexp_extract(source_file, '(\d{5})[^/]*$', 1) as digits from clauses where source_file is not null),
    o as (select source, max((release, spec)) as o from (select source_file as source, 'by-path' as release, null as spec from clauses where row_id % 5 = 0 and source_file is not null
          union all select regexp_extract(source_file, '([^/]*)$', 1), 'by-name', '00000' from clauses where row_id % 3 = 0 and source_file is not null) group by source)
    select row_id, coalesce(coalesce(p.o, n.o)[1], hinted) as release, coalesce(coalesce(p.o, n.o)[2], digits) as spec from c left join o p on p.source = source_file left join o n on n.source = name""")
def s18_j11_overridden_metadata(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "clauses").filter("source_file is not null").select("row_id", "source_file")
    by_path = files.filter("row_id % 5 = 0").select(F.col("source_file").alias("source"), F.lit("by-path").alias("release"), F.lit(None).cast("string").alias("spec"))
    by_name = files.filter("row_id % 3 = 0").select(F.regexp_extract("source_file", r"([^/]*)$", 1).alias("source"), F.lit("by-name").alias("release"), F.lit("00000").alias("spec"))
    return enrich.with_metadata(files, "source_file", by_path.unionByName(by_name), ["release", "spec"]).select("row_id", "release", "spec")
