"""Queries of query analysis: what is asked, which specifications it speaks for, and what a search then considers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text
from quillstone.functions.extract import QUERY_GENERIC, QUERY_SPEC, QUERY_STOPWORDS, QUERY_TOKEN, abbreviations
from quillstone.operators import aggregate, select
from quillstone.operators import queries as asking
from quillstone.plans.aggregates import REGISTRY, _enriched, _registry_sql
from quillstone.plans.record_sql import ENRICHED
from quillstone.plans.registry import CORPUS, Registry, fp, words, ws
from quillstone.sources.corpus import corpus
from quillstone.sources.tables import table

R = Registry()
QUERIES, ORACLES, query = R.queries, R.oracles, R.query

#: Every hundredth record asks by its title, every second of these also for its specification and stage.
ASKED_SQL = """asked as materialized (select row_id as query_id, clause_title || case when row_id % 200 = 0 then ' of TS ' || spec_no || ' ' || stage_hint else '' end as query from corpus where row_id % 100 = 0)"""


def asked(spark: SparkSession, folder: str) -> DataFrame:
    named = F.when(F.col("row_id") % 200 == 0, F.concat(F.lit(" of TS "), "spec_no", F.lit(" "), "stage_hint")).otherwise("")
    rows = corpus(spark, folder).filter("row_id % 100 = 0")
    return asking.normalised(rows.select(F.col("row_id").alias("query_id"), F.concat("clause_title", named).alias("query")))


_RAW = f"regexp_extract_all(q, '{QUERY_TOKEN}')"
_TOKENS = f"list_filter(raw, lambda t: lower(t) not in {words(QUERY_STOPWORDS)} and not (lower(t) in {words(QUERY_GENERIC)} and len(raw) > 2) and (length(t) >= 3 or upper(t) = t))"
_GLUED = "raw[i] || list_aggregate(list_transform(raw[i + 1 : i + n - 1], lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), 'string_agg', '')"
#: CTEs over ``qs`` (query_id, q): raw and kept tokens, aliases, anchors, specifications and stages of each query.
ANALYSED = rf"""tk as materialized (select query_id, q, {_RAW} as raw from qs),
    kept as materialized (select query_id, q, raw, {_TOKENS} as t from tk),
    al as (
      select query_id, unnest(regexp_extract_all(q, '\b[A-Z][A-Z0-9\-]{{1,}}\b')) as a from tk
      union select query_id, {_GLUED} from (select query_id, raw, n, unnest(range(1, len(raw) - n + 2)) as i from tk, (select unnest([2, 3]) as n))
      where regexp_matches(raw[i], '\d') and len(list_filter(raw[i + 1 : i + n - 1], lambda w: lower(w) in {words(QUERY_STOPWORDS)})) = 0),
    aliases as (select query_id, string_agg(a, '|' order by a) as aliases from al where lower(a) not in {words(QUERY_STOPWORDS)} group by query_id),
    an as (
      select query_id, unnest(t) as a from kept union select query_id, array_to_string(raw, ' ') from kept where len(raw) >= 4
      union select query_id, array_to_string(t[i : i + n - 1], ' ') from (select query_id, t, n, unnest(range(1, len(t) - n + 2)) as i from kept, (select unnest(range(2, 7)) as n)) where length(array_to_string(t[i : i + n - 1], ' ')) >= 5),
    anchors_of as (select query_id, string_agg(a, '|' order by -least(len(string_split(a, ' ')), 6), -length(a), lower(a), a) as anchors from an group by query_id),
    parts as (select query_id, list_sort(list_distinct(list_transform(regexp_extract_all(q, '{QUERY_SPEC}', 1), lambda v: replace(v, '.', '')))) as specs,
                     list_sort(list_distinct(list_transform(regexp_extract_all(q, '(?i)\b(stage\s+\d+)\b', 1), lambda v: upper(v[1]) || lower(v[2:])))) as stages,
                     regexp_matches(q, '(?i)\belse\b') as other,
                     list_sort(list_distinct(list_filter([lower(q), regexp_replace(lower(q), '([a-z]\d)([a-z]\d)', '\1 \2', 'g')], lambda v: v <> ''))) as variants from qs)"""


@query(f"""with qs as (select row_number() over () as query_id, {ws('q')} as q, q as term from (select distinct term as q from term_hits where term is not null)), {ANALYSED}
    select term as q, coalesce(aliases, '') as aliases, array_to_string(variants, '|') as variants from qs join parts using (query_id) left join aliases using (query_id)""")
def e28_e33_query_aliases(spark: SparkSession, folder: str) -> DataFrame:
    terms = table(spark, folder, "term_hits").select(F.col("term").alias("q")).filter("q is not null").distinct()
    return asking.normalised(terms, "q").select("q", F.array_join("aliases", "|").alias("aliases"), F.array_join("variants", "|").alias("variants"))


@query(f"""with {CORPUS}, {ASKED_SQL}, qs as (select query_id, {ws('query')} as q from asked), {ANALYSED}
    select query_id, q as normal, array_to_string(t, '|') as tokens, array_to_string(specs, '|') as specs, array_to_string(stages, '|') as stages,
           array_to_string(case when other then list_append(stages, 'else') else stages end, '|') as stage_filters, coalesce(aliases, '') as aliases, coalesce(anchors, '') as anchors
    from kept join parts using (query_id) left join aliases using (query_id) left join anchors_of using (query_id)""")
def e27_e31_normal_queries(spark: SparkSession, folder: str) -> DataFrame:
    listed = ["tokens", "specs", "stages", "stage_filters", "aliases", "anchors"]
    return asked(spark, folder).select("query_id", "normal", *[F.array_join(c, "|").alias(c) for c in listed])


@query(f"""{_registry_sql('').replace('with ', 'with reg as (with ', 1)}), {CORPUS.replace('corpus as', 'recs as')}, {ASKED_SQL.replace('from corpus', 'from recs')},
    qs as (select query_id, {ws('query')} as q from asked), {ANALYSED}
    select query_id, spec_no, round(sum(score), 3) as score from parts join reg on len(list_filter(variants, lambda v: contains(v, reg.term))) > 0
    where len(specs) = 0 group by all having round(sum(score), 3) >= 2""")
def g3_j6_inferred_specs(spark: SparkSession, folder: str) -> DataFrame:
    return asking.inferred_specs(asked(spark, folder), aggregate.term_registry(_enriched(spark, folder, *REGISTRY), []))


@query(f"""with {ENRICHED}, asked as (select distinct {ws('term')} as query from term_hits where term is not null),
    m as (select distinct short_form as canonical, long_form as alias from abbr union select distinct short_form, short_form from abbr),
    g as (select distinct query as query_id, canonical from asked join m on contains(lower(query), lower(alias)))
    select distinct query_id, alias from g join m using (canonical)""")
def e28_alias_closure(spark: SparkSession, folder: str) -> DataFrame:
    """The abbreviations of the corpus are the aliases of each other."""
    pairs = corpus(spark, folder).select(F.inline(abbreviations("text"))).select(F.col("short_form").alias("canonical"), F.col("long_form").alias("alias")).distinct()
    terms = table(spark, folder, "term_hits").filter("term is not null").select(text.collapse("term").alias("query_id")).distinct()
    return asking.known_aliases(terms.withColumn("normal", F.col("query_id")), pairs)


#: One query for the predicate, with a specification that is inferred.
PREDICATE = "Paging Window handling N1N2 message transfer Stage 2 PSF"


def _like(c: str, terms: list[str]) -> str:
    return " or ".join(f"contains(lower({c}), '{t.lower()}')" for t in terms)


_A = ["Paging Window handling N1N2 message transfer Stage PSF", "Paging Window handling N1N2 transfer PSF", "Paging Window handling N1N2 transfer", "Window handling N1N2 transfer PSF", "Paging Window handling N1N2", "Window handling N1N2 transfer"]


@query(f"""with {ENRICHED}, k as (select doc_id, lower(string_agg(term, chr(10))) as terms from (select doc_id, term from terms where kind in ('ie_name', 'message_name', 'procedure_name') union all select doc_id, term from anchors) group by doc_id)
    select doc_id from corpus left join k using (doc_id)
    where stage_hint = 'Stage 2' and release = 'Rel-17' and ({' or '.join(_like(c, _A[:2]) for c in ('clause_title', 'row_header', 'text'))}
      or {_like('text', ['Paging', 'Window', 'handling', 'N1N2', 'transfer', 'PSF', 'N1N2', 'N1N2Message', 'N1N2MessageTransfer', '48491', '48.491'])}
      or {' or '.join(_like(c, _A) for c in ('clause_title', 'row_header'))} or {_like("coalesce(terms, '')", [*_A, 'N1N2', 'N1N2Message', 'N1N2MessageTransfer', 'PSF'])}
      or spec_no = '48491' or stage_hint = 'Stage 2')""")
def f4_search_predicate(spark: SparkSession, folder: str) -> DataFrame:
    wanted = ["doc_id", "spec_no", "release", "release_data", "stage_hint", "clause_id", "clause_title", "row_header", "text", "anchor_terms", "ie_names", "message_names", "procedure_names"]
    rows = _enriched(spark, folder, *wanted)
    return rows.filter(asking.Asked.of(rows, PREDICATE, ["48491"]).condition(select.Scope(release="Rel-17"))).select("doc_id")


_COMPATIBLE = """array_to_string(list_transform(string_split(term, ''), lambda c: case when unicode(c) between 65281 and 65374 then chr(unicode(c) - 65248)
      when unicode(c) between 8203 and 8207 or unicode(c) in (8288, 65279) then '' else c end), '')"""


@query(f"""with t as (select distinct term from term_hits where term is not null), n as (select term, {_COMPATIBLE} as c from t)
    select term, {ws('c')} as normal, {fp('c')} as mark from n""")
def x3_x4_normal_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Of what NFKC makes one, term_hits has full-width forms and no-break spaces, which the SQL knows by rule."""
    terms = table(spark, folder, "term_hits").select("term").filter("term is not null").distinct()
    return terms.select("term", text.normal_space("term").alias("normal"), text.term_mark("term").alias("mark"))
