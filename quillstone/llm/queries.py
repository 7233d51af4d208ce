"""Queries over the operators for training data, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.text import WHITE
from quillstone.llm.encoding import repaired
from quillstone.llm.mixing import mix_report, mix_sources
from quillstone.llm.neighbours import exact_similar, most_similar, similar_pairs
from quillstone.llm.split import split_oversized
from quillstone.llm.terms import marked_terms
from quillstone.llm.tokens import token_ids
from quillstone.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return marked_terms(table(spark, folder, "term_hits")).filter("mark is not null").select("term", "mark")


def p2_terms(spark: SparkSession, folder: str) -> DataFrame:
    return marked_terms(table(spark, folder, "term_hits"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return similar_pairs(table(spark, folder, "records"))


def p4_similar(spark: SparkSession, folder: str) -> DataFrame:
    return most_similar(table(spark, folder, "records"))


def p4_exact(spark: SparkSession, folder: str) -> DataFrame:
    """The records of row_id % 100 = 0 asked against all, without index: what recall is measured by."""
    return exact_similar(table(spark, folder, "records"), F.col("row_id") % 100 == 0).select("query_id", "place", "doc_id", "score")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    # Every oversized item has a first piece.
    return split_oversized(table(spark, folder, "clauses")).filter("piece_no = 0").select("doc_id", "item_no")


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_oversized(table(spark, folder, "clauses")).select("doc_id", "item_no", "piece_no", "start", "piece")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return token_ids(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    plan, _ = mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))
    return plan.filter("short").select("source")


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return mix_report(*mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets")))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return repaired(table(spark, folder, "documents")).select("doc_id")


def p8_repaired(spark: SparkSession, folder: str) -> DataFrame:
    return repaired(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_terms, p4_found, p4_similar, p4_exact, p5_found, p5_pieces, p6_ids, p7_found, p7_mix, p7_report, p8_found, p8_repaired)}

_WHITE = "||".join(f"chr({ord(c)})" for c in WHITE)
_VECTORS = """cur as (select * from records where doc_id is not null
                     qualify row_number() over (partition by doc_id order by indexed_at desc nulls last, row_id desc) = 1),
        v as (select doc_id, row_id, list_transform(dense_vector, lambda x: x::double) as v from cur
              where len(dense_vector) = 64 and len(list_filter(dense_vector, lambda x: x is null or not isfinite(x))) = 0
                and len(list_filter(dense_vector, lambda x: x <> 0)) > 0)"""
#: Of what NFKC makes one, term_hits has full-width forms and no-break spaces.
_TERMS = f"""n as (
          select doc_id, nullif(trim(spec_no, {_WHITE}), '') as spec, lower(trim(regexp_replace(array_to_string(list_transform(string_split(term, ''),
                 lambda c: case when unicode(c) between 65281 and 65374 then chr(unicode(c) - 65248) when unicode(c) in (8203, 8204, 8205, 65279) then '' else c end), ''), '[\\s\\x0B\\x{{85}}\\pZ]+', ' ', 'g'))) as term from term_hits),
        t as (select term, count(*) as occurrences, count(distinct doc_id) as doc_count, count(distinct spec) as spec_count from n where length(term) >= 3 group by term),
        m as (select *, case when doc_count <= 2 then 'rare' when spec_count <= 1 then 'local' when doc_count >= 0.05 * (select count(distinct doc_id) from term_hits) then 'common' end as mark from t)"""
ORACLES = {
    "p2_found": f"with {_TERMS} select term, mark from m where mark is not null",
    "p2_terms": f"with {_TERMS} select * from m",
    "p4_exact": f"""
        with {_VECTORS},
        s as (select q.doc_id as query_id, v.doc_id, round(1 / (1 + acos(greatest(least(list_cosine_similarity(v.v, q.v), 1), -1))), 6) as score
              from v join v q on q.row_id % 100 = 0 and v.doc_id <> q.doc_id)
        select query_id, cast(row_number() over (partition by query_id order by score desc, doc_id) as integer) as place, doc_id, score from s qualify place <= 5""",
    "p4_found": f"""
        with {_VECTORS},
        s as (select a.doc_id as a, b.doc_id as b, list_cosine_similarity(a.v, b.v) as c from v a join v b on a.doc_id <> b.doc_id),
        t as (select * from s where c >= 0.9 qualify row_number() over (partition by a order by c desc, b) <= 5)
        select distinct least(a, b) as doc_id_a, greatest(a, b) as doc_id_b from t""",
    "p5_found": f"""
        with white as (select {_WHITE} as w),
        cur as (
          select doc_id, text, blocks from clauses, white
          where coalesce(trim(spec_no, w), '') <> '' and coalesce(trim(clause_id, w), '') <> ''
          qualify row_number() over (partition by release_data, release, trim(spec_no, w), trim(clause_id, w)
                                     order by ingested_at desc nulls last, row_id desc) = 1),
        b as (select doc_id, unnest(blocks) as b, unnest(range(len(blocks))) as i from cur)
        select doc_id, cast(-1 as integer) as item_no from cur where length(text) > 4000
        union all
        select doc_id, cast(i as integer) from b
        where case b.block_kind when 'paragraph' then length(b.block_text)
              when 'table' then list_sum(list_transform(flatten(b.table_rows), lambda c: coalesce(length(c), 0))) end > 4000""",
}
__all__ = ["ORACLES", "QUERIES"]
