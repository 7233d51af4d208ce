"""Queries of search, ranking, hops, hierarchy navigation and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.extract import GENERIC_TITLES, OVERLAP_GENERIC
from quillstone.functions import embeddings
from quillstone.functions.text import spec_number
from quillstone.lineage import cut
from quillstone.operators import aggregate, enrich, evaluate, hops, ranking, search, select, trees
from quillstone.operators import queries as asking
from quillstone.operators.hierarchy import hierarchy
from quillstone.operators.search import ENRICHED_PROFILES, GENERIC_ANCHOR_TERMS, PROFILES
from quillstone.plans.aggregates import _COUNTED, REGISTRY, _clauses, _enriched, _registry_sql
from quillstone.plans.record_sql import ANCHOR_ROWS, ENRICHED
from quillstone.plans.registry import CORPUS, Registry, camel, strip, words
from quillstone.sources import records as record_files
from quillstone.sources.corpus import corpus
from quillstone.sources.tables import DOCUMENT, current_records, table

R = Registry()
QUERIES, ORACLES, query = R.queries, R.oracles, R.query

#: The searches below ask for this.
QUERY = "Paging Window handling during Tunnel Setup Request"
TERMS = ["paging window", "tunnel setup request", "handling", "PSF"]


@query(f"""with {ENRICHED}, a as (select doc_id, lower(string_agg(term, ' ' order by pos)) as a from anchors group by doc_id),
    c as (select doc_id, lower(concat_ws(' ', spec_no, clause_title, row_header, text, array_to_string(row_cells, ' '))) as t, coalesce(a, '') as a from corpus left join a using (doc_id)),
    s as (select doc_id, {' + '.join(f"case when contains(t, '{t.lower()}') then 1.0 + case when contains(a, '{t.lower()}') then 0.3 else 0 end else 0 end" for t in TERMS)} as s from c)
    select doc_id, round(s::double, 3) as score from s where s > 0""")
def r1_lexical_scores(spark: SparkSession, folder: str) -> DataFrame:
    texts = [F.col(c) for c in ("spec_no", "clause_title", "row_header", "text")] + [F.array_join("row_cells", " ")]
    wanted = _enriched(spark, folder, "doc_id", "spec_no", "clause_title", "row_header", "text", "row_cells", "anchor_terms")
    scored = wanted.select("doc_id", F.round(search.lexical_score(TERMS, texts, F.array_join("anchor_terms", " ")), 3).alias("score"))
    return scored.filter("score > 0")


def _tier(t: str) -> str:
    n = len(t)
    long = n >= 4
    shared = f"len(list_filter({[w for w in t.split()]}, lambda w: list_contains(string_split({camel('lower(clause_title)')}, ' '), w)))"
    overlap = f"case when {shared} >= 2 then 2.5 + 1.3 * {shared} else 0 end"
    title = f"case when lower(clause_title) = '{t}' then 14 when {n >= 5} and contains(lower(clause_title), '{t}') then 8 else {overlap} end"
    tiers = [("lower(row_header)", 4), ("ie", 5), ("msg", 5.5), ("proc", 5), ("anc", 3), ("lower(text)", 1)]
    return f"greatest({title}, {', '.join(f'case when {long} and contains({c}, {chr(39)}{t}{chr(39)}) then {v} else 0 end' for c, v in tiers)})::double"


@query(f"""with {ENRICHED}, k as (select doc_id, lower(string_agg(term, ' ' order by pos) filter (kind = 'ie_name')) as ie, lower(string_agg(term, ' ' order by pos) filter (kind = 'message_name')) as msg,
      lower(string_agg(term, ' ' order by pos) filter (kind = 'procedure_name')) as proc from terms group by doc_id),
    a as (select doc_id, lower(string_agg(term, ' ' order by pos)) as anc from anchors group by doc_id),
    c as (select corpus.*, coalesce(ie, '') as ie, coalesce(msg, '') as msg, coalesce(proc, '') as proc, coalesce(anc, '') as anc from corpus left join k using (doc_id) left join a using (doc_id)),
    s as (select doc_id, round({' + '.join(_tier(t.lower()) for t in [*TERMS, TERMS[0]])}, 3) as score from c)
    select * from s where score > 0""")
def r2_tiered_scores(spark: SparkSession, folder: str) -> DataFrame:
    tiers = ["clause_title", "row_header", "ie_names", "message_names", "procedure_names", "anchor_terms", "text"]
    return _enriched(spark, folder, "doc_id", *tiers).select("doc_id", search.tiered_score([*TERMS, TERMS[0]]).alias("score")).filter("score > 0")


_NEEDLES = [*TERMS, *QUERY.split()]


def _any(list_sql: str, needles: list[str]) -> str:
    return "(" + " + ".join(f"case when len(list_filter({list_sql}, lambda h: contains(lower(h), '{n.lower()}'))) > 0 then 1 else 0 end" for n in needles) + ")"


_EXACT = "greatest(" + ", ".join(f"case when lower(trim(clause_title)) = '{n.lower()}' then 2 when {len(n) >= 5} and contains(lower(trim(clause_title)), '{n.lower()}') then 1 else 0 end" for n in _NEEDLES) + ")"


@query(f"""with {ENRICHED}, k as (select doc_id, list(term) filter (kind = 'ie_name') as ie, list(term) filter (kind = 'message_name') as msg, list(term) filter (kind = 'procedure_name') as proc from terms group by doc_id),
    c as (select corpus.*, coalesce(ie, []) as ie, coalesce(msg, []) as msg, coalesce(proc, []) as proc from corpus left join k using (doc_id)),
    s as (select doc_id, round(4.8 * {_EXACT} + 1.8 * {_any('[clause_title]', _NEEDLES)} + 2.2 * {_any('ie', TERMS)} + 2.2 * {_any('msg', TERMS)} + 1.8 * {_any('proc', TERMS)} + 1.5 * {_any('[row_header]', TERMS)}
      + 1.2 * {_any('row_cells', TERMS)} + 1.0 * case when list_has_any(referenced_specs, ['48491', '57913']) then 1 else 0 end, 3)::double as score from c)
    select * from s where score > 0""")
def r3_g9_relevance(spark: SparkSession, folder: str) -> DataFrame:
    signals = search.relevance_signals(TERMS, QUERY.split(), ["48491", "57913"])
    return enrich.structured_terms(corpus(spark, folder)).select("doc_id", search.relevance_score(signals).alias("score")).filter("score > 0")


_WORDS = search.query_words(QUERY)
_OVERLAP = lambda c: f"len(list_intersect(list_distinct(list_filter(string_split(lower({camel(c)}), ' '), lambda t: t <> '' and t not in {words(OVERLAP_GENERIC)})), {_WORDS}))"


@query(rf"""with {ENRICHED}, {ANCHOR_ROWS},
    a as (select arg_min(anchor, (row_id, place)) as anchor, list(distinct source) as sources, count(distinct doc_id) as docs, count(distinct nullif(spec_no, '')) as specs from anchor_rows group by lower(anchor)),
    o as (select *, {_OVERLAP('anchor')} as overlap, len(regexp_split_to_array(trim(anchor), '\s+')) as n from a),
    s as (select anchor, round((list_sum(list_transform(sources, lambda k: case k when 'ie_name' then 2.5 when 'message_name' then 2.5 when 'procedure_name' then 1.8 when 'table' then 1.5 when 'spec_reference' then 1.4 when 'clause_title' then 1.2 else 1.0 end::double))
      + 0.2 * docs + 0.4 * greatest(specs - 1, 0) + 0.8 * overlap
      - case when lower(trim(anchor)) in {words(GENERIC_ANCHOR_TERMS)} then 3.0 else 0 end - case when regexp_matches(trim(anchor), '^\d+$') then 2.4 else 0 end - case when n >= 8 then 2.2 else 0 end
      - case when list_contains(sources, 'procedure_name') and n >= 6 then 1.6 else 0 end - case when list_contains(sources, 'acronym') and length(trim(anchor)) <= 4 then 1.8 else 0 end
      - case when regexp_matches(lower(anchor), '\bthis request\b') then 2.5 else 0 end)::double, 3) as score from o where overlap > 0 or list_contains(sources, 'clause_title'))
    select * from s where score > 0 order by score desc, lower(anchor), anchor limit 50""")
def r4_f10_selected_anchors(spark: SparkSession, folder: str) -> DataFrame:
    return search.selected_anchors(aggregate.anchors(enrich.structured_terms(corpus(spark, folder))), QUERY, 50).select("anchor", "score")


@query(f"""with {CORPUS}, m as (select spec_no || ':' || coalesce(nullif(clause_id, ''), doc_id) as key, max(length(text))::double as s, arg_min(clause_title, doc_id) as title from corpus group by 1)
    select key, round(s + 1.2 * {_OVERLAP('title')} - case when lower(trim(title)) in {words(GENERIC_TITLES)} then 6 else 0 end, 3)::double as score from m""")
def r6_reranked_clauses(spark: SparkSession, folder: str) -> DataFrame:
    hits = corpus(spark, folder).select("doc_id", "spec_no", "clause_id", "clause_title", F.lit("direct_hit").alias("reason_type"), F.length("text").cast("double").alias("score"))
    return search.reranked(aggregate.merged_clauses(hits), QUERY).select("key", "score")


def _bm25_sql(weights: dict[str, float]) -> str:
    fields = " union all ".join(f"select doc_id, '{f}' as field, {w}::double as w, list_filter(regexp_split_to_array(lower({f}), '[^A-Za-z0-9]+'), lambda t: t <> '') as ts from corpus" for f, w in weights.items())
    return f"""{CORPUS}, f as materialized ({fields}), av as (select field, avg(len(ts)) as average, count(*) as n from f group by field),
    q as materialized (select query_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(query), '[^A-Za-z0-9]+'), lambda t: t <> ''))) as token from (select row_id as query_id, clause_title as query from corpus where row_id % 100 = 0)),
    p as materialized (select token, field, doc_id, w, dl, count(*) as tf from (select doc_id, field, w, len(ts) as dl, unnest(ts) as token from f) group by all),
    d as (select token, field, count(*) as df from p group by all),
    t as (select token, doc_id, sum(w * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / average))) as part from p join d using (token, field) join av using (field) group by all),
    s as (select query_id, doc_id, round(sum(part), 6) as score from q join t using (token) group by all),
    top as materialized (select *, cast(row_number() over (partition by query_id order by score desc, doc_id) as integer) as place from s qualify place <= 10)"""


def _searched(spark: SparkSession, folder: str, weights: dict[str, float]) -> DataFrame:
    """What a search by BM25 reads of the current records several times, written once."""
    return cut(corpus(spark, folder).select("row_id", "doc_id", *dict.fromkeys(["clause_title", *weights])))


def _titles(rows: DataFrame) -> DataFrame:
    """Queries of a search: every record whose id is divisible by 100, by its title."""
    return rows.filter("row_id % 100 = 0").select(F.col("row_id").alias("query_id"), F.col("clause_title").alias("query"))


@query(f"with {_bm25_sql(PROFILES['bm25'])} select query_id, place, score from top")
def r10_o1_bm25(spark: SparkSession, folder: str) -> DataFrame:
    rows = _searched(spark, folder, PROFILES["bm25"])
    return search.bm25(rows, _titles(rows), PROFILES["bm25"], 10).select("query_id", "place", "score")


_WEIGHT = """case when lower(trim(clause_title)) = 'front_matter' then 0.2 when doc_type in ('clause_doc', 'passage_doc') and lower(trim(clause_title)) = 'references' then 0.35
      when doc_type in ('clause_doc', 'passage_doc') and lower(trim(clause_title)) in ('foreword', 'contents', 'scope') then 0.55
      when doc_type = 'table_row_doc' then 1.35 when doc_type = 'table_doc' then 1.15 when doc_type = 'passage_doc' then 1.1 else 1.0 end::double"""
_LISTED = {"anchor_terms": "select doc_id, term, pos from anchors", **{f"{k}s": f"select doc_id, term, pos from terms where kind = '{k}'" for k in ("ie_name", "message_name", "procedure_name")}}


def _profiles_sql(profiles: dict[str, dict[str, float]]) -> str:
    """CTEs: enriched records, and ps (profile, query_id, doc_id, score) of every match."""
    names = list(dict.fromkeys(f for p in profiles.values() for f in p))
    listed = lambda f: f"(select doc_id, string_agg(term, ' ' order by pos) as v from ({_LISTED[f]}) group by doc_id)"
    source = lambda f: f"select doc_id, '{f}' as field, coalesce(v, '') as v from corpus left join {listed(f)} using (doc_id)" if f in _LISTED else f"select doc_id, '{f}' as field, {f} as v from corpus"
    weights = ", ".join(f"('{p}', '{f}', {w}::double)" for p, fs in profiles.items() for f, w in fs.items())
    return f"""{ENRICHED}, wide as ({' union all '.join(map(source, names))}),
    fld as materialized (select doc_id, field, list_filter(regexp_split_to_array(lower(v), '[^A-Za-z0-9]+'), lambda t: t <> '') as ts from wide),
    av as (select field, avg(len(ts)) as average, count(*) as n from fld group by field), rw as (select doc_id, {_WEIGHT} as counts from corpus), pw(profile, field, w) as (values {weights}),
    q as materialized (select query_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(query), '[^A-Za-z0-9]+'), lambda t: t <> ''))) as token from (select row_id as query_id, clause_title as query from corpus where row_id % 100 = 0)),
    po as materialized (select token, field, doc_id, dl, count(*) as tf from (select doc_id, field, len(ts) as dl, unnest(ts) as token from fld) where token in (select token from q) group by all),
    df as (select token, field, count(*) as df from po group by all),
    bt as materialized (select profile, token, doc_id, sum(counts * w * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / average))) as part
      from po join df using (token, field) join av using (field) join pw using (field) join rw using (doc_id) group by all),
    ps as materialized (select profile, query_id, doc_id, round(sum(part), 6) as score from q join bt using (token) group by all)"""


_UNITS = """v as (select doc_id, row_id, list_transform(dense_vector, lambda x: x::double) as v from (
      select * from records where doc_id is not null qualify row_number() over (partition by doc_id order by indexed_at desc nulls last, row_id desc) = 1)
      where len(dense_vector) = 64 and len(list_filter(dense_vector, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(dense_vector, lambda x: x <> 0)) > 0)"""
_CLOSE = "case when d.v is null or a.v is null then 0 else 1 / (1 + acos(greatest(least(list_cosine_similarity(d.v, a.v), 1), -1))) end"


def _ranked_records(spark: SparkSession, folder: str, profiles: dict[str, dict[str, float]]) -> DataFrame:
    """What a search by enriched profiles reads of the records, written once."""
    return _enriched(spark, folder, "row_id", "doc_id", "retrieval_weight", *dict.fromkeys(["clause_title", *(f for p in profiles.values() for f in p)]))


@query(f"""with {_profiles_sql(ENRICHED_PROFILES)}
    select profile, query_id, cast(row_number() over (partition by profile, query_id order by score desc, doc_id) as integer) as place, doc_id, score from ps qualify place <= 10""")
def r10_r11_enriched_bm25(spark: SparkSession, folder: str) -> DataFrame:
    """The profiles with their extracted fields and the records' weights; ``r10_o1_bm25`` ranks by plain fields alone."""
    rows = _ranked_records(spark, folder, ENRICHED_PROFILES)
    found = ranking.best(rows, _titles(rows), ENRICHED_PROFILES, {p: ranking.Score(p) for p in ENRICHED_PROFILES}, 10, "retrieval_weight")
    return found.select(F.col("ranking").alias("profile"), "query_id", "place", "doc_id", "score")


@query("""with q as (select list_transform(embedding, lambda x: x::double) as q from embeddings where vec_id = 0)
    select vec_id, round(1 / (1 + acos(greatest(least(list_cosine_similarity(list_transform(embedding, lambda x: x::double), q), 1), -1))), 6) as score from embeddings, q order by 2 desc, 1 limit 20""")
def v2_v3_nearest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    asked = vectors.filter("vec_id = 0").first()
    return search.nearest(vectors if asked else vectors.limit(0), "embedding", asked["embedding"] if asked else [1.0], 20, "vec_id")


@query("""with v as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
    s as (select q.vec_id as query_id, v.vec_id, round(1 / (1 + acos(greatest(least(list_cosine_similarity(v.v, q.v), 1), -1))), 6) as score from v join v q on q.vec_id % 100 = 0)
    select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as place, vec_id, score from s qualify place <= 20""")
def v2_v3_all_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest of every vector whose id is divisible by 100; ``v2_v3_nearest`` asks for one."""
    vectors = table(spark, folder, "embeddings")
    asked = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return search.nearest_to_each(vectors, asked, "embedding", 20, "vec_id").select("query_id", "place", "vec_id", "score")


def _vectors(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Vectors of the current records, and those of the questions, which are records themselves."""
    rows = current_records(table(spark, folder, "records"), {"row_id": F.col("row_id"), "v": F.when(F.size("dense_vector") == 64, F.col("dense_vector"))})
    return {"vectors": rows, "asked_vectors": rows.filter("row_id % 100 = 0").select(F.col("row_id").alias("query_id"), "v")}


@query(f"""with {_profiles_sql({search.SINGLE.profile: search.SINGLE.weights()})}, {_UNITS},
    h as (select query_id, ps.doc_id, round(score * {search.SINGLE.sparse} + {_CLOSE} * 9 * {search.SINGLE.vector}, 4) as score from ps left join v d on d.doc_id = ps.doc_id left join v a on a.row_id = ps.query_id)
    select query_id, cast(row_number() over (partition by query_id order by score desc, doc_id) as integer) as place, doc_id, score from h qualify place <= 10""")
def r11_r12_r13_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    """Every lexical match of each question, ranked by BM25 and closeness together."""
    single = search.SINGLE
    profiles = {single.profile: single.weights()}
    rows = _ranked_records(spark, folder, profiles)
    scores = {"hybrid": ranking.Score(single.profile, single.sparse, single.vector)}
    return ranking.best(rows, _titles(rows), profiles, scores, 10, "retrieval_weight", **_vectors(spark, folder)).select("query_id", "place", "doc_id", "score")


@query(f"""with {CORPUS}, s as (select doc_id, stage_hint, length(text)::double as score from corpus where stage_hint in ('Stage 2', 'Stage 3'))
    select * from s qualify row_number() over (partition by stage_hint order by score desc, doc_id) <= 10""")
def r14_m5_stage_fan_out(spark: SparkSession, folder: str) -> DataFrame:
    hits = corpus(spark, folder).select("doc_id", "stage_hint", F.length("text").cast("double").alias("score"))
    return hops.staged(hits, ["Stage 2", "Stage 3"], 10)


_ENTRY_TERMS = list(dict.fromkeys(t.lower() for t in [QUERY, *TERMS, "paging", "tunnel"]))


def _entry(t: str) -> str:
    mutual = f"case when contains(lower(term), '{t}') or contains('{t}', lower(term)) then 0.55 else 0 end" if len(t) >= 5 else "0"
    return f"case when lower(term) = '{t}' then 1.0 else {mutual} end"


@query(f"""{_registry_sql('').replace('with ', 'with reg as (with ', 1)}),
    {CORPUS.replace('corpus as', 'recs as')},
    tt as (select spec_no, clause_title from (select spec_no, clause_title, count(*) as n from recs where clause_title <> '' group by all) qualify row_number() over (partition by spec_no order by n desc, clause_title) <= 16),
    ss as (select spec_no, list(distinct stage_hint) as st from recs where stage_hint in ('Stage 2', 'Stage 3', 'else') group by spec_no),
    st as (select v as spec_no, arg_min(spec_title, row_id) as title from (select *, replace(regexp_extract(spec_no, '([0-9]{{2}}[.]?[0-9]{{3}})', 1), '.', '') as v from specs where spec_title is not null) group by v),
    u as (select spec_no, score * ({' + '.join(_entry(t) for t in _ENTRY_TERMS)}) as s from reg
      union all select spec_no, case when lower(title) = '{QUERY.lower()}' then 8 when contains(lower(title), '{QUERY.lower()}') then 4.2 else 0 end from st
      union all select spec_no, case when lower(clause_title) = '{QUERY.lower()}' then 9.5 when contains(lower(clause_title), '{QUERY.lower()}') then 5 else 0 end
        + {' + '.join(f"case when contains(lower(clause_title), '{a.lower()}') then 2.6 else 0 end" for a in TERMS if len(a) >= 5)} from tt),
    t as (select spec_no, sum(s::double) as s from u group by spec_no having sum(s) > 0)
    select spec_no, round(s + case when list_has_any(st, ['Stage 2']) then 1.5 else 0 end + 1e-7, 3) as score from t left join ss using (spec_no) order by score desc, spec_no limit 20""")
def r8_entry_specs(spark: SparkSession, folder: str) -> DataFrame:
    rows = _enriched(spark, folder, *REGISTRY, "stage_hint")
    named = table(spark, folder, "specs").filter("spec_title is not null").groupBy(spec_number("spec_no").alias("spec_no")).agg(F.min_by("spec_title", "row_id").alias("title"))
    titles = aggregate.top_values(rows.filter("clause_title <> ''"), "spec_no", "clause_title", 16)
    return search.entry_specs(aggregate.term_registry(rows, []), titles, named, aggregate.spec_stages(rows), QUERY, ["paging", "tunnel"], TERMS, ["Stage 2"], 20)


@query(f"""with {CORPUS}, x as (select distinct classification as label, lower(term) as term from candidate_scores where length(term) >= 8 and classification = 'strong')
    select doc_id, array_to_string(list_sort(list(distinct label)), '|') as labels from corpus join x on contains(lower(text), x.term) group by doc_id""")
def e13_s17_labels(spark: SparkSession, folder: str) -> DataFrame:
    taxonomy = table(spark, folder, "candidate_scores").filter("length(term) >= 8 and classification = 'strong'").select(F.col("classification").alias("label"), "term")
    return select.labelled_by(corpus(spark, folder), F.col("text"), "doc_id", taxonomy)


@query(f"""with {CORPUS}, x as (select distinct classification as label, lower(term) as term from candidate_scores)
    select doc_id, array_to_string(list_sort(list(distinct label)), '|') as labels from corpus join x on contains(lower(text), x.term) group by doc_id""")
def e13_s17_all_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The labels of the whole taxonomy; ``e13_s17_labels`` looks for its long strong terms."""
    taxonomy = table(spark, folder, "candidate_scores").select(F.col("classification").alias("label"), "term")
    return select.labelled_by(corpus(spark, folder), F.col("text"), "doc_id", taxonomy)


@query(f"""with {CORPUS} select doc_id, instr(text, trim(row_header)) - 1 as start from corpus where trim(row_header) <> '' and contains(text, trim(row_header))""".replace("instr(text, trim(row_header)) - 1 as start", "cast(instr(text, trim(row_header)) - 1 as integer) as start"))
def t11_quoted_ranges(spark: SparkSession, folder: str) -> DataFrame:
    ranges = select.quoted_ranges(F.col("text"), F.array("row_header", "row_header"))
    return corpus(spark, folder).select("doc_id", F.inline(ranges)).select("doc_id", "start")


@query("""select row_id as post_id from specs where contains(lower(spec_title), 'paging') or contains(lower(stage_hint), 'paging')""")
def b1_o4_found_posts(spark: SparkSession, folder: str) -> DataFrame:
    posts = table(spark, folder, "specs").select(
        F.col("row_id").alias("post_id"), F.col("spec_title").alias("title"), F.col("stage_hint").alias("body"), F.col("registered_at").alias("created_at"), F.coalesce("withdrawn_at", "registered_at").alias("updated_at")
    )
    return select.found_posts(posts, " Paging ").select("post_id")


def _asked(rows: DataFrame) -> list[str]:
    """The terms that the analysis of ``QUERY`` finds, which a hop begins with."""
    return asking.Asked.of(rows, QUERY).terms()


def _phrases(words_of: list[str]) -> list[str]:
    """The words, their runs of two to six, and all of them, in lower case: what the analysis makes of ``QUERY``, none of whose words is dropped."""
    runs = [" ".join(words_of[i : i + n]) for n in range(1, 7) for i in range(len(words_of) - n + 1)]
    return [r.lower() for r in [*runs, " ".join(words_of)]]


_TITLE_WORDS = f"string_split({camel('lower(clause_title)')}, ' ')"
#: The tier of a row of ``c`` for its column ``term``.
_TERM_TIER = f"""greatest(case when clause_title <> '' and term = lower(clause_title) then 14 when length(term) >= 5 and contains(lower(clause_title), term) then 8
      else case when len(list_filter(string_split({camel('term')}, ' '), lambda w: w <> '' and list_contains({_TITLE_WORDS}, w))) >= 2
                then 2.5 + 1.3 * len(list_filter(string_split({camel('term')}, ' '), lambda w: w <> '' and list_contains({_TITLE_WORDS}, w))) else 0 end end,
      {', '.join(f'case when length(term) >= 4 and contains({c}, term) then {v} else 0 end' for c, v in (('lower(row_header)', 4), ('ie', 5), ('msg', 5.5), ('proc', 5), ('anc', 3), ('lower(text)', 1)))})::double"""
_NAMES = """k as (select doc_id, lower(string_agg(term, ' ' order by pos) filter (kind = 'ie_name')) as ie, lower(string_agg(term, ' ' order by pos) filter (kind = 'message_name')) as msg,
      lower(string_agg(term, ' ' order by pos) filter (kind = 'procedure_name')) as proc from terms group by doc_id),
    a as (select doc_id, lower(string_agg(term, ' ' order by pos)) as anc from anchors group by doc_id),
    c as materialized (select corpus.*, coalesce(ie, '') as ie, coalesce(msg, '') as msg, coalesce(proc, '') as proc, coalesce(anc, '') as anc from corpus left join k using (doc_id) left join a using (doc_id))"""
_WHOLE = "lower(concat_ws(' ', clause_title, row_header, text, array_to_string(row_cells, ' '))) || ' ' || anc"


@query(f"""with {ENRICHED}, {_NAMES}, qt as (select unnest({_phrases(QUERY.split())}) as term),
    direct as materialized (select doc_id, spec_no, doc_type, sum(1.0 + case when contains(anc, term) then 0.3 else 0 end)::double as score
      from c join qt on contains(lower(concat_ws(' ', spec_no, clause_title, row_header, text, array_to_string(row_cells, ' '))), term) group by all),
    seed as (select doc_id from direct order by round(score, 6) desc, doc_id limit 10),
    sg as (select term as t, 'strong_anchor' as r, 2.0 as w from anchors semi join seed using (doc_id) union all select unnest(referenced_specs), 'referenced_spec', 1.5 from corpus semi join seed using (doc_id)
      union all select unnest(referenced_clauses), 'referenced_clause', 1.0 from corpus semi join seed using (doc_id) union all select row_header, 'row_header', 1.1 from corpus semi join seed using (doc_id)
      union all select word, 'keyword', 0.6 from kw semi join seed using (doc_id) where place <= 5),
    sc as (select t, round(sum(w::double) - case when lower(t) in {words(aggregate.GENERIC_SIGNALS)} then 1.5 else 0 end, 6) as s from sg where trim(t) <> '' group by t),
    more as (select lower(t) as term from sc where s >= 1.5 order by round(s, 3) desc, t limit 10),
    found as (select doc_id, spec_no, {_TERM_TIER} as score from c join more on contains({_WHOLE}, term)),
    hits as (select doc_id, spec_no, score, case when doc_type = 'table_row_doc' then 'table_row_hit' else 'direct_hit' end as reason_type from direct union all select doc_id, spec_no, score, 'anchor_hit' from found where score > 0),
    one as (select *, score * case reason_type when 'direct_hit' then 3.0 when 'anchor_hit' then 2.0 else 1.8 end::double as s, case when {strip('spec_no')} = '' then 'unknown' else {strip('spec_no')} end as spec from hits
      qualify row_number() over (partition by doc_id order by score desc, reason_type) = 1),
    b as (select spec, sum(s / power(i, 0.8)) as blend from (select spec, s, row_number() over (partition by spec order by s desc) as i from one) where i <= 5 group by spec),
    d as (select spec, count(distinct doc_id) as doc_count, count(distinct reason_type) as reasons from one group by spec)
    select spec as spec_no, round(blend + 0.35 * ln(1 + doc_count) + 0.45 * (reasons - 1), 3) as score, doc_count from b join d using (spec)""")
def m1_two_phase(spark: SparkSession, folder: str) -> DataFrame:
    rows = _enriched(spark, folder)
    return hops.two_phase(rows, _asked(rows))


_FOUND = list(dict.fromkeys(_phrases(QUERY.split())))
_ASKING = [*_FOUND, *(w.lower() for w in QUERY.split())]
_EXACT_ASKED = "greatest(" + ", ".join(f"case when lower(trim(clause_title)) = '{n}' then 2 when {len(n) >= 5} and contains(lower(trim(clause_title)), '{n}') then 1 else 0 end" for n in _ASKING) + ")"
#: CTE: scored anchors (anchor, score) of the rows of ``seed`` (doc_id).
_SEED_ANCHORS = rf"""sa as (select arg_min(anchor, (row_id, place)) as anchor, list(distinct source) as sources, count(distinct doc_id) as docs, count(distinct nullif(spec_no, '')) as specs
      from anchor_rows semi join seed using (doc_id) group by lower(anchor)),
    so as (select *, {_OVERLAP('anchor')} as overlap, len(regexp_split_to_array(trim(anchor), '\s+')) as n from sa),
    ss as (select anchor, round((list_sum(list_transform(sources, lambda k: case k when 'ie_name' then 2.5 when 'message_name' then 2.5 when 'procedure_name' then 1.8 when 'table' then 1.5 when 'spec_reference' then 1.4 when 'clause_title' then 1.2 else 1.0 end::double))
      + 0.2 * docs + 0.4 * greatest(specs - 1, 0) + 0.8 * overlap
      - case when lower(trim(anchor)) in {words(GENERIC_ANCHOR_TERMS)} then 3.0 else 0 end - case when regexp_matches(trim(anchor), '^\d+$') then 2.4 else 0 end - case when n >= 8 then 2.2 else 0 end
      - case when list_contains(sources, 'procedure_name') and n >= 6 then 1.6 else 0 end - case when list_contains(sources, 'acronym') and length(trim(anchor)) <= 4 then 1.8 else 0 end
      - case when regexp_matches(lower(anchor), 'this request') then 2.5 else 0 end)::double, 3) as score from so where overlap > 0 or list_contains(sources, 'clause_title')),
    more as (select lower(anchor) as term, score as boost from ss where score > 0 order by score desc, lower(anchor), anchor limit 8)"""
_MERGED = f"""mc as (select spec_no || ':' || coalesce(nullif(clause_id, ''), doc_id) as key, max(score) as s, array_to_string(list_sort(list(distinct doc_id)), '|') as doc_ids,
      array_to_string(list_sort(list(distinct reason_type)), '|') as reasons, arg_min(clause_title, doc_id) as title from hits group by 1)
    select key, round(s + 1.2 * {_OVERLAP('title')} - case when lower(trim(title)) in {words(GENERIC_TITLES)} then 6 else 0 end, 3)::double as score, doc_ids, reasons, title from mc"""


@query(f"""with {ENRICHED}, {ANCHOR_ROWS}, {_NAMES},
    kl as (select doc_id, list(term) filter (kind = 'ie_name') as ies, list(term) filter (kind = 'message_name') as msgs, list(term) filter (kind = 'procedure_name') as procs from terms group by doc_id),
    r as materialized (select *, round({' + '.join(_tier(t) for t in _FOUND)}, 3) as retrieved from c),
    top as (select r.*, coalesce(ies, []) as ies, coalesce(msgs, []) as msgs, coalesce(procs, []) as procs from r left join kl using (doc_id) where retrieved > 0 order by retrieved desc, doc_id limit 20),
    rel as (select *, round(round(4.8 * {_EXACT_ASKED}, 3) + round(1.8 * {_any('[clause_title]', _ASKING)}, 3) + round(2.2 * {_any('ies', _FOUND)}, 3) + round(2.2 * {_any('msgs', _FOUND)}, 3) + round(1.8 * {_any('procs', _FOUND)}, 3)
      + round(1.5 * {_any('[row_header]', _FOUND)}, 3) + round(1.2 * {_any('row_cells', _FOUND)}, 3) + round(1.4 * retrieved, 3), 3)::double as score from top),
    seed as materialized (select doc_id, spec_no, clause_id, clause_title, score from rel where score > 0 order by retrieved desc, doc_id limit 10),
    {_SEED_ANCHORS},
    hop as (select doc_id, spec_no, clause_id, clause_title, {_TERM_TIER} as tier, boost from c join more on contains({_WHOLE}, term)),
    hits as (select *, 'direct_hit' as reason_type from seed union all select doc_id, spec_no, clause_id, clause_title, tier + boost, 'anchor_hit' from hop where tier > 0),
    {_MERGED}""")
def m2_multi_hop(spark: SparkSession, folder: str) -> DataFrame:
    rows = _enriched(spark, folder)
    return hops.multi_hop(rows, QUERY, _asked(rows))


@query(f"""with {ENRICHED}, {ANCHOR_ROWS}, {_NAMES},
    r as materialized (select *, round({' + '.join(_tier(t) for t in _FOUND)}, 3) as retrieved from c),
    st as (select * from r where retrieved > 0 and stage_hint in ('Stage 2', 'Stage 3', 'else') qualify row_number() over (partition by stage_hint order by retrieved desc, doc_id) <= 30),
    seed as materialized (select doc_id, spec_no, clause_id, clause_title, retrieved as score from st order by retrieved desc, doc_id limit 10),
    sup as (select spec_no from seed group by spec_no order by count(*) desc, spec_no limit 8),
    {_SEED_ANCHORS},
    hop as (select doc_id, spec_no, clause_id, clause_title, term, boost, {_TERM_TIER} as tier from c join more on contains({_WHOLE}, term) where spec_no in (select spec_no from sup)),
    hb as (select doc_id, spec_no, clause_id, clause_title, tier + boost as score from hop where tier > 0 qualify row_number() over (partition by doc_id order by tier + boost desc, term) = 1 order by score desc, doc_id limit 10),
    hits as (select *, 'seed' as reason_type from seed union all select *, 'anchor_hit' from hb),
    {_MERGED}""")
def m3_centred(spark: SparkSession, folder: str) -> DataFrame:
    rows = _enriched(spark, folder)
    return hops.centred(rows, QUERY, _asked(rows), ["Stage 2", "Stage 3", "else"])


@query()
def m4_m6_m7_iterative(spark: SparkSession, folder: str) -> DataFrame:
    rows = _enriched(spark, folder)
    return hops.iterative(rows, _asked(rows))


# --- hierarchy -------------------------------------------------------------------------------------------------------

_WALK = f"""{_COUNTED}, walk as (
    select release_data, release, spec, clause, parent as up, [clause] as path from cur
    union all
    select w.release_data, w.release, w.spec, w.clause, c.parent, list_prepend(c.clause, w.path) from walk w
    join cur c on (w.release_data, w.release, w.spec, w.up) = (c.release_data, c.release, c.spec, c.clause) where not list_contains(w.path, c.clause)),
  paths as materialized (select release_data, release, spec, clause, arg_max(path, len(path)) as path, arg_max(up, len(path)) as up from walk group by all),
  ok as materialized (select * from paths where up is null or not list_contains(path, up) and not exists (select 1 from cur c where (c.release_data, c.release, c.spec, c.clause) = (paths.release_data, paths.release, paths.spec, paths.up)))"""
_WALK = _WALK.replace("arg_max(up, len(path)) as up from walk", "arg_max_null(up, len(path)) as up from walk")


@query(f"with recursive {_WALK} select release_data, release, spec, clause, len(path) as depth from ok where list_contains(path, '1')")
def t3_subtree(spark: SparkSession, folder: str) -> DataFrame:
    tree = hierarchy(_clauses(spark, folder), DOCUMENT)
    return trees.subtree(tree, "1").select(*DOCUMENT, "clause", F.size("path").cast("bigint").alias("depth"))


@query(f"""with {_COUNTED} select release_data, release, spec, parent, count(*) as children, string_agg(clause, '|' order by coalesce(order_in_source, 0), clause) as names from cur where parent is not null group by all""")
def t4_children(spark: SparkSession, folder: str) -> DataFrame:
    return trees.children(_clauses(spark, folder), DOCUMENT)


@query(f"""with {_COUNTED}, p as (select release_data, release, spec, clause, coalesce(order_in_source, 0) as o, clause_path, len(clause_path) as n, unnest(range(1, len(clause_path))) as i from cur),
    l as (select *, clause_path[i] as a from p where coalesce(clause_path[i], '') <> '' and not exists (select 1 from cur c where (c.release_data, c.release, c.spec, c.clause) = (p.release_data, p.release, p.spec, p.clause_path[i])))
    select release_data, release, spec, a as clause, case when i > 1 then clause_path[i - 1] end as parent, cast(i - 1 as integer) as depth, cast(greatest(0, o - (n - i)) as integer) as order_in_source, clause as found_in from l
    qualify row_number() over (partition by release_data, release, spec, a order by o, clause) = 1""")
def t5_missing_ancestors(spark: SparkSession, folder: str) -> DataFrame:
    return trees.missing_ancestors(_clauses(spark, folder), DOCUMENT)


@query(f"""with {_COUNTED}, p as (select row_id, unnest(string_split(clause, '.')) as t, generate_subscripts(string_split(clause, '.'), 1) as i from cur)
    select row_id, string_agg(case when regexp_matches(t, '^[0-9]') then lpad(regexp_extract(t, '^([0-9]*)', 1), 10, '0') || regexp_extract(t, '^[0-9]*(.*)$', 1) else '~' || t end, '.' order by i) as key from p group by row_id""")
def o2_t9_natural_order(spark: SparkSession, folder: str) -> DataFrame:
    return _clauses(spark, folder).select("row_id", trees.natural_key("clause").alias("key"))


@query(f"""with recursive {_WALK}, hit as (select distinct release_data, release, spec, unnest(o.path) as clause from ok o join cur c using (release_data, release, spec, clause) where contains(lower(c.clause_title), 'paging'))
    select release_data, release, spec, clause from ok semi join hit using (release_data, release, spec, clause)""")
def f17_t10_matching_branches(spark: SparkSession, folder: str) -> DataFrame:
    tree = hierarchy(_clauses(spark, folder), DOCUMENT).filter("path is not null")
    return trees.branches_matching(tree, DOCUMENT, F.contains(F.lower("clause_title"), F.lit("paging"))).select(*DOCUMENT, "clause")


@query(f"""with {_COUNTED}, d as (select min((release_data, release)) as d from cur where spec = '48491') select row_id, release_data, release from cur, d where spec = '48491' and (release_data, release) = d""")
def t6_document_of_spec(spark: SparkSession, folder: str) -> DataFrame:
    return trees.in_document(_clauses(spark, folder), "48491").select("row_id", "release_data", "release")


# --- evaluation ------------------------------------------------------------------------------------------------------

_METRICS = """w as (select distinct c.row_id as query_id, d.doc_id from corpus c join corpus d on lower(c.clause_title) = lower(d.clause_title) where c.row_id % 100 = 0 and c.clause_title <> ''),
    n as (select query_id, count(*) as n from w group by query_id),
    f as (select query_id, min(place) as first, sum(case when place <= 5 then 1 / log2(place + 1) else 0 end) as d5, sum(case when place <= 10 then 1 / log2(place + 1) else 0 end) as d10 from top semi join w using (query_id, doc_id) group by query_id),
    i as (select k, sum(1 / log2(j + 1)) as ideal from (select unnest(range(1, 11)) as k), (select unnest(range(1, 11)) as j) where j <= k group by k),
    m as (select query_id, round(coalesce(1 / first, 0), 6)::double as rr, coalesce((first <= 5)::int, 0)::double as recall_5, coalesce((first <= 10)::int, 0)::double as recall_10,
      round(coalesce(d5 / i5.ideal, 0), 6) as ndcg_5, round(coalesce(d10 / i10.ideal, 0), 6) as ndcg_10
      from n left join f using (query_id) join i i5 on i5.k = least(n, 5) join i i10 on i10.k = least(n, 10))"""


def _evaluated(spark: SparkSession, folder: str, profile: str) -> DataFrame:
    rows = _searched(spark, folder, PROFILES[profile])
    return evaluate.metrics_of(*evaluate.titled(search.bm25(rows, _titles(rows), PROFILES[profile], 10), rows))


@query(f"with {_bm25_sql(PROFILES['bm25']).replace(' f as materialized', ' fld as materialized').replace(' from f group by field', ' from fld group by field').replace(' from f) group by all', ' from fld) group by all')}, {_METRICS} select * from m")
def y1_y2_y3_j13_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _evaluated(spark, folder, "bm25")


#: The sweep: profile, sparse and vector weight; each profile by BM25 alone, by vectors alone, and by both.
SWEEP = [(p, sparse, vector) for p in ENRICHED_PROFILES for sparse, vector in ((1.0, 0.0), (0.0, 1.0), (0.45, 1.0))]


@query(f"""with {_profiles_sql(ENRICHED_PROFILES)}, {_UNITS}, sw(sweep, profile, sparse, vector) as (values {', '.join(f"('{p}:{s}:{v}', '{p}', {s}::double, {v}::double)" for p, s, v in SWEEP)}),
    h as (select sweep, query_id, ps.doc_id, round(score * sparse + {_CLOSE} * 9 * vector, 4) as score from ps join sw using (profile) left join v d on d.doc_id = ps.doc_id left join v a on a.row_id = ps.query_id),
    top as materialized (select *, row_number() over (partition by sweep, query_id order by score desc, doc_id) as place from h qualify place <= 10),
    w as (select distinct c.row_id as query_id, d.doc_id from corpus c join corpus d on lower(c.clause_title) = lower(d.clause_title) where c.row_id % 100 = 0 and c.clause_title <> ''),
    nr as (select query_id, count(*) as n from w group by query_id),
    f as (select sweep, query_id, min(place) as first, sum(case when place <= 5 then 1 / log2(place + 1) else 0 end) as d5, sum(1 / log2(place + 1)) as d10 from top semi join w using (query_id, doc_id) group by all),
    i as (select k, sum(1 / log2(j + 1)) as ideal from (select unnest(range(1, 11)) as k), (select unnest(range(1, 11)) as j) where j <= k group by k),
    m as (select s.sweep, query_id, round(coalesce(1 / first, 0), 6)::double as rr, coalesce((first <= 5)::int, 0)::double as recall_5, coalesce((first <= 10)::int, 0)::double as recall_10,
      round(coalesce(d5 / i5.ideal, 0), 6) as ndcg_5, round(coalesce(d10 / i10.ideal, 0), 6) as ndcg_10
      from (select sweep from sw) s cross join nr left join f using (sweep, query_id) join i i5 on i5.k = least(n, 5) join i i10 on i10.k = least(n, 10))
    select sweep as profile, count(*) as queries, round(avg(rr), 4) as rr, round(avg(recall_5), 4) as recall_5, round(avg(recall_10), 4) as recall_10, round(avg(ndcg_5), 4) as ndcg_5, round(avg(ndcg_10), 4) as ndcg_10 from m group by sweep""")
def y4_g15_profile_sweep(spark: SparkSession, folder: str) -> DataFrame:
    rows = _ranked_records(spark, folder, ENRICHED_PROFILES)
    sweep = {f"{p}:{s}:{v}": ranking.Score(p, s, v) for p, s, v in SWEEP}
    hits = ranking.best(rows, _titles(rows), ENRICHED_PROFILES, sweep, 10, "retrieval_weight", **_vectors(spark, folder)).withColumnRenamed("ranking", "profile")
    found, sizes = evaluate.titled(hits, rows)
    each = sizes.crossJoin(F.broadcast(spark.createDataFrame([(name,) for name in sweep], "profile string")))  # a row per member of the sweep
    return evaluate.mean_metrics(evaluate.metrics_of(found, each, ("profile", "query_id")))


# --- sinks and embeddings ----------------------------------------------------------------------------------------------


@query(f"""with {CORPUS} select to_json({{'put': 'id:clauses:record::' || doc_id, 'fields': {{'doc_id': doc_id, 'doc_type': doc_type, 'content_kind': content_kind, 'spec_no': spec_no, 'release': release, 'release_data': release_data,
    'stage_hint': stage_hint, 'clause_id': clause_id, 'clause_title': clause_title, 'row_header': row_header, 'row_cells': row_cells,
    'text': case when content_kind = 'table_row' then coalesce(nullif(text, ''), array_to_string(row_cells, '; ')) else text end}}}})::varchar as value from corpus""")
def k2_k4_feed(spark: SparkSession, folder: str) -> DataFrame:
    fields = ["doc_id", "doc_type", "content_kind", "spec_no", "release", "release_data", "stage_hint", "clause_id", "clause_title", "row_header", "row_cells"]
    return record_files.feed(corpus(spark, folder), "clauses", "record", fields, enrich.searchable_text())


@query(f"""{_registry_sql('').replace('with ', 'with reg as (with ', 1)}) select spec_no, to_json(map_from_entries(list((term, score) order by term)))::varchar as terms from reg group by spec_no""")
def k7_registry_json(spark: SparkSession, folder: str) -> DataFrame:
    return record_files.registry_json(aggregate.term_registry(_enriched(spark, folder, *REGISTRY), []))


@query()
def v1_v4_hash_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.embedded(corpus(spark, folder).select("doc_id", enrich.record_body().alias("body")), F.col("body")).drop("body")


@query(f"""with {CORPUS} select doc_id, row_id from corpus order by row_id limit 500 offset 100""")
def s4_sliced_scan(spark: SparkSession, folder: str) -> DataFrame:
    return record_files.sliced(corpus(spark, folder), ["row_id"], 100, 500).select("doc_id", "row_id")
