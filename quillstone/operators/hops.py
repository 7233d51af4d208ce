"""Searches that expand: two phases, several hops, and judged rounds.

A hop's terms are those a caller lists, or as many signals, anchors or keywords as a parameter states; they travel as a
broadcast of that size. Hits and seen documents stay DataFrames.
What judges hits is a function from DataFrame to DataFrame, so that a model can take the place of the heuristic.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions.extract import clause_target, is_next_hop_title
from quillstone.lineage import cut
from quillstone.operators import aggregate, search
from quillstone.operators.select import best_per_key, first_per_content, unseen

Judge = Callable[[DataFrame], DataFrame]


def search_terms(records: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, term, score and ``boost`` of enriched records that hold one of ``terms`` (term, boost), a caller's list or a stated number."""
    few = F.broadcast(terms.select(F.lower("term").alias("term"), "boost"))
    whole = F.lower(F.concat_ws(" ", "clause_title", "row_header", "text", F.array_join("row_cells", " "), F.array_join("anchor_terms", " ")))
    return records.join(few, F.contains(whole, F.col("term"))).withColumn("score", search.term_tier(F.col("term"))).filter("score > 0")


def first_hits(most: int) -> Judge:
    """The heuristic judge: the best hits are relevant."""

    def judge(hits: DataFrame) -> DataFrame:
        return search.top(hits, most)

    return judge


def two_phase(records: DataFrame, query_terms: Sequence[str], seeds: int = 10, signals: int = 10) -> DataFrame:
    """spec_no, score, doc_count: a direct search, a second one for what its best hits suggest, and specifications ranked by both."""
    texts = [F.col(c) for c in ("spec_no", "clause_title", "row_header", "text")] + [F.array_join("row_cells", " ")]
    direct = records.withColumn("score", search.lexical_score(query_terms, texts, F.array_join("anchor_terms", " "))).filter("score > 0")
    reason = F.when(F.col("doc_type") == "table_row_doc", "table_row_hit").otherwise("direct_hit")
    direct = cut(direct.withColumn("reason_type", reason))
    best = aggregate.expansion_signals(search.top(direct, seeds)).filter("classification <> 'reject'")
    more = best.orderBy(F.desc("score"), "signal").limit(signals).select(F.col("signal").alias("term"), F.col("score").alias("boost"))
    expanded = search_terms(records, more).withColumn("reason_type", F.lit("anchor_hit"))
    hits = direct.select("doc_id", "spec_no", "score", "reason_type").unionByName(expanded.select("doc_id", "spec_no", "score", "reason_type"))
    return aggregate.ranked_specs(best_per_key(hits, ["doc_id"], [F.desc("score"), "reason_type"]))


def multi_hop(records: DataFrame, query: str, query_terms: Sequence[str], most: int = 10, anchors: int = 8, specs: Sequence[str] = ()) -> DataFrame:
    """Merged clauses of a tiered search, and of searches for the anchors of its most relevant hits, ranked for the query."""
    hits = records.withColumn("retrieved", search.tiered_score(query_terms)).filter("retrieved > 0")
    hits = search.top(hits, max(2 * most, 10), "retrieved")
    signals = search.relevance_signals(query_terms, query.split(), specs, F.col("retrieved"))
    seeds = cut(hits.withColumn("score", search.relevance_score(signals)).filter("score > 0").orderBy(F.desc("retrieved"), "doc_id").limit(most))
    chosen = search.selected_anchors(aggregate.anchors(seeds), query, anchors)
    hops = search_terms(records, chosen.select(F.col("anchor").alias("term"), F.col("score").alias("boost"))).withColumn("score", F.col("score") + F.col("boost"))
    kept = ["doc_id", "spec_no", "clause_id", "clause_title", "score"]
    every = seeds.select(*kept).withColumn("reason_type", F.lit("direct_hit")).unionByName(hops.select(*kept).withColumn("reason_type", F.lit("anchor_hit")))
    return search.reranked(aggregate.merged_clauses(every), query)


def staged(hits: DataFrame, stages: Sequence[str], most: int) -> DataFrame:
    """The ``most`` best hits of each stage, each document once."""
    per = Window.partitionBy("stage_hint").orderBy(F.desc("score"), "doc_id")
    best = hits.filter(F.col("stage_hint").isin(list(stages))).withColumn("_n", F.row_number().over(per)).filter(F.col("_n") <= most).drop("_n")
    return best_per_key(best, ["doc_id"], [F.desc("score"), "stage_hint"])


def centred(records: DataFrame, query: str, query_terms: Sequence[str], stages: Sequence[str], judge: Judge | None = None, most: int = 10, entry_specs: int = 8) -> DataFrame:
    """A search by stages whose judged hits centre further searches for their anchors within their specifications."""
    judge = judge or first_hits(most)
    hits = records.withColumn("score", search.tiered_score(query_terms)).filter("score > 0")
    seeds = cut(judge(staged(hits, stages, max(3 * most, 12))))
    support = seeds.groupBy("spec_no").agg(F.count(F.lit(1)).alias("support")).orderBy(F.desc("support"), "spec_no").limit(entry_specs)
    chosen = search.selected_anchors(aggregate.anchors(seeds), query).select(F.col("anchor").alias("term"), F.col("score").alias("boost"))
    inside = records.join(F.broadcast(support), "spec_no", "left_semi")
    hops = search_terms(inside, chosen).withColumn("score", F.col("score") + F.col("boost"))
    hops = judge(best_per_key(hops, ["doc_id"], [F.desc("score"), "term"]))
    kept = ["doc_id", "spec_no", "clause_id", "clause_title", "score"]
    every = seeds.select(*kept).withColumn("reason_type", F.lit("seed")).unionByName(hops.select(*kept).withColumn("reason_type", F.lit("anchor_hit")))
    return search.reranked(aggregate.merged_clauses(every), query)


def next_actions(relevant: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """What to search for after a round: term, or spec and clause where a keyword names a clause; at most ``most`` not known before."""
    words = relevant.select("doc_id", "score", "spec_no", F.explode(F.concat(F.slice("keywords", 1, 5), F.array("clause_title"))).alias("term"))
    usable = words.filter((F.length("term") >= 3) & is_next_hop_title("term")).withColumn("target", clause_target("term", "spec_no"))
    first = best_per_key(usable.withColumn("term", F.lower("term")), ["term"], [F.desc("score"), "doc_id"])
    fresh = first.join(known.select("term"), "term", "left_anti")
    return fresh.orderBy(F.desc("score"), "term").limit(most).select("term", "target.spec", "target.clause", F.lit(0.0).alias("boost"))


def clause_targets(records: DataFrame, targets: DataFrame) -> DataFrame:
    """The records of the clauses that ``targets`` (spec, clause) name, with a score above any search."""
    named = targets.filter("clause is not null").select(F.col("spec").alias("spec_no"), F.col("clause").alias("clause_id")).distinct()
    return records.join(named, ["spec_no", "clause_id"], "left_semi").withColumn("score", F.lit(99.0))


def iterative(records: DataFrame, query_terms: Sequence[str], judge: Judge | None = None, rounds: int = 2, most: int = 10) -> DataFrame:
    """doc_id, spec_no, clause_id, clause_title, score and round of the relevant records of up to ``rounds`` + 1 searches.

    Each round searches for the keywords of the records found relevant in the last, leaves out documents and contents
    seen before, and ends when there is nothing left to ask or nothing new. Terms and seen documents are written to the
    checkpoint folder after each round.
    """
    judge = judge or first_hits(most)
    spark = records.sparkSession
    shape = "term string, spec string, clause string, boost double"
    asked = spark.createDataFrame([(t.lower(), None, None, 0.0) for t in dict.fromkeys(query_terms) if t.strip()], shape)
    known, seen, found = asked, None, None
    kept = ["doc_id", "spec_no", "clause_id", "clause_title", "score"]
    for turn in range(rounds + 1):
        shown = [*records.columns, "score"]
        hits = search_terms(records, asked.filter("clause is null")).select(shown).unionByName(clause_targets(records, asked).select(shown))
        hits = first_per_content(best_per_key(hits, ["doc_id"], [F.desc("score")]), "text", [F.desc("score"), "doc_id"])
        hits = hits.withColumn("content", F.md5(F.lower("text")))
        if seen is not None:
            hits = unseen(hits, seen, ["doc_id", "content"])
        relevant = cut(judge(hits))
        if relevant.isEmpty():
            break
        new = relevant.select(*kept).withColumn("round", F.lit(turn))
        found = new if found is None else found.unionByName(new)
        marks = relevant.select("doc_id", "content")
        seen = marks if seen is None else cut(seen.unionByName(marks))
        if turn == rounds:
            break
        asked = cut(next_actions(relevant, known, 2 * most))
        if asked.isEmpty():
            break
        known = known.unionByName(asked)
    if found is None:
        return records.limit(0).select(*kept[:-1], F.lit(0.0).alias("score"), F.lit(0).alias("round"))
    return found


def judged(hits: DataFrame, judgements: DataFrame, keywords: DataFrame) -> DataFrame:
    """Hits with what was said of them: ``relevant`` (false without judgement) and ``keywords``; only judgements on offered hits count."""
    verdicts = judgements.groupBy("doc_id").agg(F.bool_or("relevant").alias("relevant"))
    named = keywords.groupBy("doc_id").agg(F.array_sort(F.collect_set("keyword")).alias("keywords"))
    none: Column = F.array().cast("array<string>")
    return hits.join(verdicts, "doc_id", "left").join(named, "doc_id", "left").withColumns({"relevant": F.coalesce("relevant", F.lit(False)), "keywords": F.coalesce("keywords", none)})
