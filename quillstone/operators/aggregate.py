"""Aggregations over records, terms and hits.

Each groups by its key with partial aggregation before the shuffle. Top-N per key uses row_number, for which Spark keeps
only N rows per key and task before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions.extract import QUERY_STOPWORDS
from quillstone.functions.text import anchor_term, filled, is_noisy_anchor
from quillstone.lineage import cut
from quillstone.operators.enrich import anchor_source_terms, labelled, registry_terms

# Weights of the sources of a term, and terms that count less.
CANDIDATE_WEIGHTS = {"clause_title": 2.0, "table_title": 1.8, "row_header": 1.7, "abbreviation_long": 1.2, "abbreviation_short": 1.5, "row_value": 0.4}
GENERIC_CANDIDATES = [
    "general", "introduction", "overview", "procedure", "description", "parameters", "message", "messages", "information", "network", "service", "requirements",
]
GENERIC_HINTS = [
    "general", "overview", "introduction", "procedure", "procedures", "message", "messages", "service", "services", "system", "network", "stage 2",
    "release 18", "inputs", "outputs", "semantics", "components", "cardinality", "operation definition", "information element definitions",
    "successful operation", "criticality", "yaml",
]
NOISY_HINT = r"\b(?:sp-\d+[a-z]?|\d{2}-\d{4}|\d{4}-\d{2}|v\d+(?:\.\d+)+|release \d+|annex [a-z]|change history)\b"
GENERIC_SIGNALS = ["general", "overview", "introduction", "procedure", "procedures", "network", "service"]
REASON_WEIGHTS = {"direct_hit": 3.0, "anchor_hit": 2.0, "table_row_hit": 1.8, "referenced_spec_hit": 1.2}
STAGES = ["Stage 2", "Stage 3", "else"]


def looked_up(values: dict[str, float], key: Column, otherwise: float) -> Column:
    table = F.create_map(*[F.lit(v) for pair in values.items() for v in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit(otherwise))


def one_lower_word(term: Column) -> Column:
    return ~F.contains(term, F.lit(" ")) & (F.lower(term) == term) & term.rlike(r"\p{Ll}")


def anchor_candidates(records: DataFrame) -> DataFrame:
    """term, score, classification, spec_count and doc_count: how good an anchor each term of the records is."""
    terms = anchor_source_terms(records).filter(F.length("term") >= 3)
    sources = terms.groupBy("term", "source").agg(F.count(F.lit(1)).alias("n"))
    weighed = sources.groupBy("term").agg(F.sum(looked_up(CANDIDATE_WEIGHTS, F.col("source"), 0.0) * F.least(F.col("n"), F.lit(3))).alias("weight"))
    spread = terms.groupBy("term").agg(F.countDistinct(F.nullif("spec_no", F.lit(""))).alias("spec_count"), F.countDistinct("doc_id").alias("doc_count"))
    bonus = F.when(F.col("spec_count") > 1, F.least(F.lit(2.0), 0.6 * (F.col("spec_count") - 1))).otherwise(0.0)
    minus = F.when(F.lower("term").isin(GENERIC_CANDIDATES), 2.5).otherwise(0.0) + F.when(one_lower_word(F.col("term")), 0.5).otherwise(0.0)
    total = F.col("weight") + bonus - minus
    # Weights have one decimal: the classes compare sums rid of binary noise.
    exact = F.round(total, 6)
    kind = F.when(exact >= 4.5, "strong").when(exact >= 2.0, "normal").otherwise("reject")
    return weighed.join(spread, "term").select("term", F.round(total, 3).alias("score"), kind.alias("classification"), "spec_count", "doc_count")


def is_hint(term: Column) -> Column:
    """Whether a registry term tells a specification from others."""
    plain = F.forall(F.split(term, " "), lambda w: w.isin(QUERY_STOPWORDS))
    return (F.length(term) >= 4) & ~term.isin(GENERIC_HINTS) & ~term.isin(QUERY_STOPWORDS) & ~term.rlike(NOISY_HINT) & ~one_lower_word(term) & ~plain


def term_registry(records: DataFrame, scope: list[str], most: int = 24, least: float = 2.2) -> DataFrame:
    """scope, spec_no, term, score: the terms that tell a specification, by weight and rarity, at most ``most`` each.

    Of a term repeated in an enriched record the first weight counts. Every ``scope`` (none: everything) has its own
    numbers of specifications. The terms are gone through once; what follows works on their sums.
    """
    named = records.filter("spec_no <> ''")
    kept = registry_terms(named).filter(is_hint(F.col("term")))
    first = kept.groupBy(*scope, "spec_no", "doc_id", "term").agg(F.min_by("weight", "at").alias("weight"))
    by_spec = cut(first.groupBy(*scope, "spec_no", "term").agg(F.sum("weight").alias("tf")))
    spread = by_spec.groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("spread"))
    specs = named.groupBy(*scope).agg(F.countDistinct("spec_no").alias("specs"))
    known = by_spec.join(spread, [*scope, "term"])
    known = known.join(specs, scope) if scope else known.crossJoin(F.broadcast(specs))  # one row
    score = F.col("tf") * F.log1p(F.col("specs") / F.col("spread"))
    rare = known.filter(F.col("spread") <= F.greatest(F.lit(3), F.floor(F.col("specs") / 2))).withColumn("score", F.round(score, 3)).filter(F.round(score, 9) >= least)
    best = Window.partitionBy(*scope, "spec_no").orderBy(F.desc("score"), "term")
    return rare.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= most).select(*scope, "spec_no", "term", "score")


def expansion_signals(records: DataFrame) -> DataFrame:
    """signal, score, reasons and classification of what enriched records suggest to search for next."""
    weight = {"strong_anchor": 2.0, "referenced_spec": 1.5, "referenced_clause": 1.0, "row_header": 1.1, "keyword": 0.6}
    every = F.concat(
        labelled("anchor_terms", "strong_anchor"), labelled("referenced_specs", "referenced_spec"), labelled("referenced_clauses", "referenced_clause"),
        labelled(F.array("row_header"), "row_header"), labelled(F.slice("keywords", 1, 5), "keyword"),
    )
    counted = records.select(F.inline(every)).filter(F.trim("term") != "").groupBy("term", "source").agg(F.count(F.lit(1)).alias("n"))
    summed = counted.groupBy("term").agg(
        F.sum(F.col("n") * looked_up(weight, F.col("source"), 0.0)).alias("sum"), F.array_join(F.array_sort(F.collect_set("source")), "|").alias("reasons")
    )
    score = F.round(F.col("sum") - F.when(F.lower("term").isin(GENERIC_SIGNALS), 1.5).otherwise(0.0), 6)
    kind = F.when(score >= 4.0, "strong").when(score >= 1.5, "normal").otherwise("reject")
    return summed.select(F.col("term").alias("signal"), F.round(score, 3).alias("score"), "reasons", kind.alias("classification"))


def anchors(records: DataFrame) -> DataFrame:
    """anchor, sources, doc_count, spec_count of the anchors of enriched records, regardless of case; the first spelling stands."""
    lists = {"ie_names": "ie_name", "message_names": "message_name", "procedure_names": "procedure_name", "referenced_specs": "spec_reference", "acronyms": "acronym", "camel_case_identifiers": "camel_case"}
    every = F.concat(*[labelled(c, k) for c, k in lists.items()], labelled(F.array("row_header"), "table"), labelled(F.array("clause_title"), "clause_title"))
    rows = records.select("row_id", "doc_id", "spec_no", F.posexplode(every).alias("at", "s")).filter(~is_noisy_anchor("s.term"))
    named = rows.select("row_id", "doc_id", "spec_no", "at", anchor_term("s.term").alias("anchor"), F.col("s.source").alias("source"))
    return (
        named.groupBy(F.lower("anchor").alias("key"))
        .agg(
            F.min_by("anchor", F.struct("row_id", "at")).alias("anchor"),
            F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"),
            F.countDistinct("doc_id").alias("doc_count"),
            F.countDistinct(F.nullif("spec_no", F.lit(""))).alias("spec_count"),
        )
        .drop("key")
    )


def merged_clauses(hits: DataFrame) -> DataFrame:
    """key, score, doc_ids, reasons, title: hits of one clause of a specification made one."""
    key = F.concat_ws(":", "spec_no", F.coalesce(F.nullif("clause_id", F.lit("")), "doc_id"))
    return hits.groupBy(key.alias("key")).agg(
        F.max("score").alias("score"),
        F.array_join(F.array_sort(F.collect_set("doc_id")), "|").alias("doc_ids"),
        F.array_join(F.array_sort(F.collect_set("reason_type")), "|").alias("reasons"),
        F.min_by("clause_title", "doc_id").alias("title"),
    )


def ranked_specs(hits: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """spec_no, score, doc_count: the five best hits with falling weight, and bonuses for many documents and reasons."""
    score = F.col("score") * looked_up({**REASON_WEIGHTS, **(weights or {})}, F.col("reason_type"), 1.0)
    known = hits.select(F.coalesce(filled("spec_no"), F.lit("unknown")).alias("spec_no"), "doc_id", "reason_type", score.alias("weighed"))
    best = Window.partitionBy("spec_no").orderBy(F.desc("weighed"))
    top = known.withColumn("i", F.row_number().over(best)).filter("i <= 5").groupBy("spec_no").agg(F.sum(F.col("weighed") / F.pow(F.col("i"), 0.8)).alias("blend"))
    spread = known.groupBy("spec_no").agg(F.countDistinct("doc_id").alias("doc_count"), F.countDistinct("reason_type").alias("reasons"))
    total = F.col("blend") + 0.35 * F.log1p("doc_count") + 0.45 * (F.col("reasons") - 1)
    return top.join(spread, "spec_no").select("spec_no", F.round(total, 3).alias("score"), "doc_count")


def spec_stages(records: DataFrame) -> DataFrame:
    """spec_no and the stages its records have, in the usual order."""
    seen = records.filter(F.col("stage_hint").isin(STAGES)).groupBy("spec_no").agg(F.collect_set("stage_hint").alias("s"))
    return seen.select("spec_no", F.array_join(F.array_intersect(F.array(*map(F.lit, STAGES)), "s"), "|").alias("stages"))


def top_values(rows: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """key, value, uses, place of the ``most`` frequent values of each key; equal ones by name."""
    best = Window.partitionBy(key).orderBy(F.desc("uses"), value)
    counted = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("uses"))
    return counted.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= most)


def document_summaries(clauses: DataFrame, document: list[str]) -> DataFrame:
    """Per document: clauses, top-level clauses, and the title and source of the first clause in order."""
    first = F.struct(F.coalesce("order_in_source", F.lit(0)), F.col("clause"))
    return clauses.groupBy(*document).agg(
        F.count(F.lit(1)).alias("clauses"), F.count_if(F.col("parent").isNull()).alias("roots"),
        F.min_by("spec_title", first).alias("title"), F.min_by("source_file", first).alias("source"),
    )


def distinct_texts(hits: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key its distinct texts as rows, with their place from 1 in order of first use; empty ones are left out."""
    first = hits.filter("text <> ''").groupBy(*keys, "text").agg(F.min(F.struct(*order)).alias("_first"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("_first", "text"))).drop("_first")


def merged_texts(hits: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key the first title and the distinct texts in order, joined; for keys whose distinct texts fit a row.

    Equal texts are dropped before the texts of a key are gathered. ``distinct_texts`` has them as rows, for keys of any size.
    """
    titles = hits.groupBy(*keys, "text").agg(F.min_by("clause_title", F.struct(*order)).alias("title"), F.min(F.struct(*order)).alias("first"))
    each = F.when(F.col("text") != "", F.struct("first", "text"))
    rows = titles.groupBy(*keys).agg(F.min_by("title", "first").alias("title"), F.array_sort(F.collect_list(each)).alias("rows"))
    texts = F.transform("rows", lambda r: r["text"])
    return rows.select(*keys, "title", F.size(texts).cast("bigint").alias("texts"), F.md5(F.array_join(texts, "\n")).alias("body"))
