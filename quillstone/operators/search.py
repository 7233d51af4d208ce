"""Scoring and ranking of records: lexical, BM25, vector and hybrid; anchors and merged clauses.

One query is a handful of literals, so a search is scan, filter, score and top-k without a shuffle but the last merge.
Many queries at once meet the records in blocks (``ranking.best``), or go through token postings, joined on the token.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions.extract import GENERIC_TITLES, OVERLAP_GENERIC, once, overlap_tokens
from quillstone.functions.text import anchor_term, col
from quillstone.operators.aggregate import looked_up
from quillstone.operators.select import distinct_words

# Weights of relevance signals, of the sources of an anchor, and of the fields of a rank profile.
SIGNAL_WEIGHTS = {
    "title_exact": 4.8, "title": 1.8, "ie_name": 2.2, "message_name": 2.2, "procedure_name": 1.8, "table_header": 1.5, "table_row": 1.2, "spec_reference": 1.0, "similarity": 1.4,
}
ANCHOR_WEIGHTS = {"ie_name": 2.5, "message_name": 2.5, "procedure_name": 1.8, "table": 1.5, "spec_reference": 1.4, "acronym": 1.0, "camel_case": 1.0, "clause_title": 1.2}
GENERIC_ANCHOR_TERMS = ["note", "ts", "ran", "path", "paths", "end", "message", "messages", "procedure", "procedures"]
PROFILES = {
    "bm25": {"text": 1.0, "clause_title": 1.8, "row_header": 1.5, "stage_hint": 1.1},
    "table_focus": {"text": 0.8, "row_header": 1.9},
    "anchor_boost": {"text": 0.9, "clause_title": 1.8, "row_header": 1.5, "stage_hint": 1.2},
    "hybrid": {"text": 0.7, "clause_title": 1.5, "row_header": 1.0, "stage_hint": 1.2},
}
#: The profiles over ``enriched`` records, with the fields that are extracted.
ENRICHED_PROFILES = {
    "bm25": {**PROFILES["bm25"], "anchor_terms": 1.7, "ie_names": 1.9, "message_names": 1.9, "procedure_names": 1.5},
    "table_focus": {**PROFILES["table_focus"], "anchor_terms": 1.4},
    "anchor_boost": {**PROFILES["anchor_boost"], "anchor_terms": 2.3, "ie_names": 2.0, "message_names": 2.0},
    "hybrid": {**PROFILES["hybrid"], "anchor_terms": 0.5, "ie_names": 1.7, "message_names": 1.7, "procedure_names": 1.3},
}
K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Ranking:
    """Boosts of a hybrid query; the defaults are those of a single query."""

    profile: str = "hybrid"
    sparse: float = 1.25
    vector: float = 0.45
    anchor: float = 1.15
    title: float = 1.2
    stage: float = 1.1

    def weights(self) -> dict[str, float]:
        """The field weights of the profile, boosted."""
        boosts = {"anchor_terms": self.anchor, "clause_title": self.title, "stage_hint": self.stage}
        return {f: w * boosts.get(f, 1.0) for f, w in ENRICHED_PROFILES[self.profile].items()}


#: The default boosts of a single query, and of the rounds of an iterative search, which go by vectors alone.
SINGLE = Ranking()
ITERATIVE = Ranking(sparse=0.0, vector=1.0)


def _sum(parts: list[Column]) -> Column:
    return reduce(Column.__add__, parts, F.lit(0.0))


def _joined(c: str) -> Column:
    return F.lower(F.array_join(F.col(c), " "))


def _literals(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def lexical_score(terms: Sequence[str], texts: Sequence[Column], anchors: Column) -> Column:
    """1 for each distinct term that the texts hold, and 0.3 more if the anchors hold it."""
    low = _literals(list(dict.fromkeys(t.lower() for t in distinct_words(terms))))
    held = F.struct(F.lower(F.concat_ws(" ", *texts)).alias("whole"), F.lower(anchors).alias("named"))
    one = lambda r, t: F.when(F.contains(r["whole"], t), 1.0 + F.when(F.contains(r["named"], t), 0.3).otherwise(0.0)).otherwise(0.0)
    return once(held, lambda r: F.aggregate(low, F.lit(0.0), lambda total, t: total + one(r, t)))


def matched_terms(terms: Sequence[str], texts: Sequence[Column], most: int = 5) -> Column:
    whole = F.lower(F.concat_ws(" ", *texts))
    found = [F.when(F.contains(whole, F.lit(t.lower())), F.lit(t.lower())) for t in distinct_words(terms)]
    return F.array_join(F.slice(F.array_compact(F.array(*found)), 1, most), ", ")


def _tiers() -> Column:
    """What the tiers of a record of ``enriched`` are looked up in, found once however many terms ask."""
    return F.struct(
        F.lower("clause_title").alias("title"), F.split(anchor_term(F.lower("clause_title")), " ").alias("words"), F.lower("row_header").alias("row"), F.lower("text").alias("text"),
        *[_joined(c).alias(c) for c in ("ie_names", "message_names", "procedure_names", "anchor_terms")],
    )


def _tier(r: Column, term: Column, words: Column) -> Column:
    """The best tier in which a record holds the term: title, row header, names, anchors, text; or 2.5 and 1.3 per word shared
    with the title from two words on."""
    long = F.length(term) >= 4
    held = lambda name, value: F.when(long & F.contains(r[name], term), value).otherwise(0.0)
    shared = F.size(F.filter(words, lambda w: F.array_contains(r["words"], w)))
    by_title = (
        F.when((r["title"] != "") & (term == r["title"]), 14.0).when((F.length(term) >= 5) & F.contains(r["title"], term), 8.0)
        .when(shared >= 2, 2.5 + 1.3 * shared).otherwise(0.0)
    )
    names = {"row": 4.0, "ie_names": 5.0, "message_names": 5.5, "procedure_names": 5.0, "anchor_terms": 3.0, "text": 1.0}
    return F.when(term != "", F.greatest(by_title, *[held(n, v) for n, v in names.items()])).otherwise(0.0)


def term_tier(term: Column) -> Column:
    """The tier of one term, in lower case, in a record of ``enriched``."""
    asked = F.struct(term.alias("t"), F.filter(F.split(anchor_term(term), " "), lambda w: w != "").alias("w"), _tiers().alias("r"))
    return once(asked, lambda x: _tier(x["r"], x["t"], x["w"]))


def tiered_score(terms: Sequence[str]) -> Column:
    """Sum of the tiers of all terms; a term given twice counts twice."""
    low = [t.lower().strip() for t in terms if t.strip()]
    if not low:
        return F.lit(0.0)
    asked = F.array(*[F.struct(F.lit(t).alias("t"), _literals(re.sub("[_/]+", " ", t).split()).alias("w")) for t in low])
    return F.round(once(_tiers(), lambda r: F.aggregate(asked, F.lit(0.0), lambda total, x: total + _tier(r, x["t"], x["w"]))), 3)


def _held(needles: Sequence[str], texts: Column) -> Column:
    """How many needles occur in one of the texts."""
    low = F.filter(F.transform(texts, lambda t: F.lower(F.coalesce(t, F.lit("")))), lambda t: t != "")
    asked = _literals([n.strip().lower() for n in needles if n.strip()])
    return once(low, lambda held: F.size(F.filter(asked, lambda n: F.exists(held, lambda h: F.contains(h, n)))).cast("double"))


def relevance_signals(anchors: Sequence[str], tokens: Sequence[str], specs: Sequence[str], similarity: Column | None = None) -> dict[str, Column]:
    """The signals of a record of ``structured_terms`` for a query's anchors, tokens and specifications."""
    every = [*anchors, *tokens]
    low = _literals([n.strip().lower() for n in every if n.strip()])
    level = lambda title, n: F.when(title == n, 2.0).when((F.length(n) >= 5) & F.contains(title, n), 1.0).otherwise(0.0)
    exact = once(F.lower(F.trim("clause_title")), lambda title: F.when(title != "", F.array_max(F.transform(low, lambda n: level(title, n)))))
    signals = {
        "title_exact": F.coalesce(exact, F.lit(0.0)),
        "title": _held(every, F.array("clause_title")),
        "ie_name": _held(anchors, F.col("ie_names")),
        "message_name": _held(anchors, F.col("message_names")),
        "procedure_name": _held(anchors, F.col("procedure_names")),
        "table_header": _held(anchors, F.array("row_header")),
        "table_row": _held(anchors, F.col("row_cells")),
        "spec_reference": F.when(F.arrays_overlap("referenced_specs", F.array(*map(F.lit, specs))), 1.0).otherwise(0.0) if specs else F.lit(0.0),
    }
    signals["similarity"] = F.greatest(similarity, F.lit(0.0)) if similarity is not None else F.lit(0.0)
    return signals


def relevance_score(signals: dict[str, Column]) -> Column:
    return F.round(_sum([F.round(s * SIGNAL_WEIGHTS[k], 3) for k, s in signals.items()]), 3)


def top(hits: DataFrame, most: int, score: str = "score", key: str = "doc_id") -> DataFrame:
    return hits.orderBy(F.desc(score), key).limit(most)


def anchor_penalty(anchor: Column | str, sources: Column | str) -> Column:
    name = F.trim(col(anchor))
    low, n = F.lower(name), F.size(F.split(name, r"\s+"))
    has = lambda s: F.array_contains(F.split(col(sources), r"\|"), s)
    rules = [
        (low.isin(GENERIC_ANCHOR_TERMS), 3.0), (name.rlike(r"^\d+$"), 2.4), (n >= 8, 2.2), (has("procedure_name") & (n >= 6), 1.6),
        (has("acronym") & (F.length(name) <= 4), 1.8), (low.rlike(r"\bthis request\b"), 2.5),
    ]
    return _sum([F.when(test, value).otherwise(0.0) for test, value in rules])


def selected_anchors(anchors: DataFrame, query: str, most: int = 8) -> DataFrame:
    """``anchors`` that share a word with the query or stem from a title, by weight of their sources and spread; the best ``most``."""
    words = F.array(*[F.lit(w) for w in query_words(query)]).cast("array<string>")
    overlap = F.size(F.array_intersect(overlap_tokens("anchor"), words))
    weight = F.aggregate(F.split("sources", r"\|"), F.lit(0.0), lambda s, k: s + looked_up(ANCHOR_WEIGHTS, k, 0.0))
    score = weight + 0.2 * F.col("doc_count") + 0.4 * F.greatest(F.col("spec_count") - 1, F.lit(0)) + 0.8 * overlap - anchor_penalty("anchor", "sources")
    kept = anchors.withColumn("_overlap", overlap).filter((F.col("_overlap") > 0) | F.array_contains(F.split("sources", r"\|"), "clause_title"))
    scored = kept.withColumn("score", F.round(score, 3)).filter("score > 0").drop("_overlap")
    return scored.orderBy(F.desc("score"), F.lower("anchor"), "anchor").limit(most)


def query_words(query: str) -> list[str]:
    """The words of a query that count in comparisons."""
    split = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", re.sub(r"[_/]+", " ", query))
    return [w for w in dict.fromkeys(split.lower().split()) if w not in OVERLAP_GENERIC]


def reranked(merged: DataFrame, query: str) -> DataFrame:
    """Merged clauses with 1.2 more per word shared with the query, and 6 less for titles that say nothing."""
    words = F.array(*[F.lit(w) for w in query_words(query)]).cast("array<string>")
    bonus = 1.2 * F.size(F.array_intersect(overlap_tokens("title"), words))
    minus = F.when(F.lower(F.trim("title")).isin(GENERIC_TITLES), 6.0).otherwise(0.0)
    return merged.withColumn("score", F.round(F.col("score") + bonus - minus, 3))


# --- BM25 ------------------------------------------------------------------------------------------------------------


def tokens(x: Column | str) -> Column:
    return F.filter(F.split(F.lower(col(x)), "[^A-Za-z0-9]+"), lambda t: t != "")


def bm25(records: DataFrame, queries: DataFrame, weights: dict[str, float], most: int, key: str = "doc_id") -> DataFrame:
    """query_id, key, score, place: the ``most`` best records for each query (query_id, query), by weighted BM25 per field.

    All matches are scored, in blocks of queries and records (``ranking.best``), which read ``records`` several times.
    """
    from quillstone.operators import ranking

    found = ranking.best(records, queries, {"bm25": weights}, {"bm25": ranking.Score("bm25")}, most, key=key)
    return found.select("query_id", key, "score", "place")


def profile_scores(records: DataFrame, queries: DataFrame, profiles: dict[str, dict[str, float]], weight: str = "retrieval_weight", key: str = "doc_id") -> DataFrame:
    """profile, query_id, key and score of every record that a query (query_id, query) matches in a field of the profile.

    The score is the weighted BM25 per field times the record's ``weight``. Fields may be texts or arrays of terms. The
    postings are the same for all profiles; the profiles' weights are a row per profile and field. Every match is a row:
    for the best of each query alone, ``ranking.best`` lists none of the others.
    """
    arrays = {f for f, kind in records.dtypes if kind.startswith("array")}
    names = list(dict.fromkeys(f for p in profiles.values() for f in p))
    of = lambda f: tokens(F.array_join(f, " ") if f in arrays else f)
    held = records.select(key, F.col(weight).alias("counts"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), of(f).alias("tokens")) for f in names])))
    held = held.withColumn("length", F.size("tokens"))
    averages = held.groupBy("field").agg(F.avg("length").alias("average"), F.count(F.lit(1)).alias("n"))  # a row per field
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens("query"))).alias("token"))
    spread = held.select(key, "counts", "field", "length", F.explode("tokens").alias("token")).join(asked.select("token").distinct(), "token", "left_semi")
    postings = spread.groupBy("token", "field", key, "counts", "length").agg(F.count(F.lit(1)).alias("tf"))
    frequencies = postings.groupBy("token", "field").agg(F.count(F.lit(1)).alias("df"))
    weights = records.sparkSession.createDataFrame([(p, f, float(w)) for p, fs in profiles.items() for f, w in fs.items()], "profile string, field string, weight double")
    known = postings.join(frequencies, ["token", "field"]).join(F.broadcast(averages), "field").join(F.broadcast(weights), "field")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("counts") * F.col("weight") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("average")))
    by_token = known.groupBy("profile", "token", key).agg(F.sum(part).alias("part"))
    return asked.join(by_token, "token").groupBy("profile", "query_id", key).agg(F.round(F.sum("part"), 6).alias("score"))


def placed(scores: DataFrame, by: Sequence[str], most: int, key: str = "doc_id") -> DataFrame:
    """The ``most`` best rows per ``by`` with their place from 1."""
    best = Window.partitionBy(*by).orderBy(F.desc("score"), key)
    return scores.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= most)


# --- vectors ---------------------------------------------------------------------------------------------------------


def cosine(vector: Column | str, query: Sequence[float]) -> Column:
    """Cosine of an array column and a literal vector, in double precision."""
    v = F.transform(col(vector), lambda x: x.cast("double"))
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return dot / F.nullif(norm * float(sum(x * x for x in query) ** 0.5), F.lit(0.0))


def closeness(cos: Column) -> Column:
    """1 / (1 + angle); null where there is no cosine."""
    return F.when(cos.isNotNull(), 1 / (1 + F.acos(F.greatest(F.least(cos, F.lit(1.0)), F.lit(-1.0)))))


def nearest(vectors: DataFrame, vector: str, query: Sequence[float], most: int, key: str) -> DataFrame:
    """The ``most`` nearest rows to one query vector, exactly: a scan and a top-k."""
    scored = vectors.select(key, F.round(closeness(cosine(vector, query)), 6).alias("score")).filter("score is not null")
    return top(scored, most, key=key)


def nearest_to_each(vectors: DataFrame, asked: DataFrame, vector: str, most: int, key: str, rows: int = 2048) -> DataFrame:
    """query_id, key, score and place of the ``most`` nearest rows to each of many vectors (query_id, ``vector``), exactly.

    Both sides are packed into blocks of about ``rows`` vectors, and every block of queries is sent to every block of rows:
    a pair of blocks is one row, spread by both. It is a matrix product, of which the best of each query are kept; these are
    merged by score. Vectors without direction, or of another length, have no closeness.
    """
    import numpy as np
    import pyarrow as pa

    def blocks(frame: DataFrame, name: str, block: str) -> tuple[DataFrame, int]:
        known = frame.select(F.col(name).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v")).filter("v is not null and size(v) > 0 and not exists(v, x -> x is null)")
        parts = max(1, -(-frame.count() // rows))
        return known.groupBy(F.pmod(F.xxhash64("id", "v"), F.lit(parts)).alias(block), F.size("v").alias("n")).agg(F.collect_list(F.struct("id", "v")).alias("r")), parts

    left, of_queries = blocks(asked, "query_id", "i")
    right, of_rows = blocks(vectors, key, "j")
    left = left.select("i", "n", F.col("r.id").alias("qi"), F.flatten("r.v").alias("qv"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(of_rows - 1).cast("bigint"))).alias("j"))
    right = right.select("j", "n", F.col("r.id").alias("ki"), F.flatten("r.v").alias("kv"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(of_queries - 1).cast("bigint"))).alias("i"))

    def best(batches):
        def units(flat, n):
            x = flat.values.to_numpy(zero_copy_only=False).reshape(-1, n)
            with np.errstate(divide="ignore", invalid="ignore"):
                x = x / np.abs(x).max(1, keepdims=True)
                return x / np.sqrt((x * x).sum(1, keepdims=True))

        for batch in batches:
            for i in range(batch.num_rows):
                n = batch.column("n")[i].as_py()
                qi, ki = (batch.column(c)[i].values for c in ("qi", "ki"))
                close = 1 / (1 + np.arccos(np.clip(units(batch.column("qv")[i], n) @ units(batch.column("kv")[i], n).T, -1, 1)))
                close = np.where(np.isfinite(close), close, -1.0)
                last = min(most, len(ki))
                # Scores that round alike are decided by key after the merge, so all that may round to the last one go on.
                least = np.maximum(np.partition(close, -last, axis=1)[:, -last] - 2e-6, 0)
                q, k = np.nonzero(close >= least[:, None])
                yield pa.RecordBatch.from_arrays([qi.take(pa.array(q)), ki.take(pa.array(k)), pa.array(close[q, k])], ["query_id", key, "score"])

    pairs = left.join(right, ["i", "j", "n"]).select("n", "qi", "qv", "ki", "kv")
    of = lambda frame, name: frame.schema[name].dataType.simpleString()
    found = pairs.mapInArrow(best, f"query_id {of(asked, 'query_id')}, `{key}` {of(vectors, key)}, score double")
    return placed(found.withColumn("score", F.round("score", 6)), ["query_id"], most, key)


def unit(vector: Column | str, size: int) -> Column:
    """The vector of length 1 in double precision; null unless it has ``size`` finite elements and a direction."""
    v = F.transform(col(vector), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    fit = (F.size(v) == size) & (norm > 0) & (norm < float("inf"))
    return F.when(fit, F.transform(v, lambda x: x / norm))


def hybrid(sparse: DataFrame, vectors: DataFrame, asked: DataFrame, by: Sequence[str], most: int, key: str = "doc_id") -> DataFrame:
    """The ``most`` best per ``by`` of all rows of ``sparse`` by BM25 and closeness, with score and place.

    ``sparse`` (``by``, query_id, key, score, sparse, vector) has every lexical match, its score times its record's weight,
    and the boosts; ``vectors`` (key, unit) and ``asked`` (query_id, unit) have unit vectors. A row without vector has
    closeness 0. As closeness is at most 1, a row whose best possible score is below the ``most``-th lexical part of its
    query cannot be among the best, and needs no vector; the result is the same as without this.
    """
    rows = sparse.withColumn("lexical", F.col("score") * F.col("sparse"))
    rank = Window.partitionBy(*by).orderBy(F.desc("lexical"))
    floor = rows.withColumn("n", F.row_number().over(rank)).filter(F.col("n") == most).select(*by, F.col("lexical").alias("floor"))
    possible = rows.join(floor, list(by), "left").filter(F.col("floor").isNull() | (F.col("lexical") + 9 * F.col("vector") >= F.col("floor") - 1e-3))
    pairs = possible.join(vectors.select(key, F.col("unit").alias("_v")), key, "left").join(asked.select("query_id", F.col("unit").alias("_q")), "query_id", "left")
    cos = F.aggregate(F.zip_with("_v", "_q", lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    close = F.coalesce(closeness(cos), F.lit(0.0))
    return placed(pairs.withColumn("score", F.round(F.col("lexical") + close * 9 * F.col("vector"), 4)).drop("_v", "_q", "lexical", "floor"), by, most, key)


def hybrid_score(sparse: Column, close: Column, weight: Column, ranking: Ranking) -> Column:
    return sparse * weight * ranking.sparse + close * 9 * ranking.vector


# --- routing -----------------------------------------------------------------------------------------------------------


def _phrase(phrase: str, text: Column, equal: float, within: float) -> Column:
    """``equal`` if the text is the phrase, ``within`` if it holds a phrase of at least 5 characters."""
    if not phrase:
        return F.lit(0.0)
    inside = F.when(F.contains(text, F.lit(phrase)), within).otherwise(0.0) if len(phrase) >= 5 else F.lit(0.0)
    return F.when(text == phrase, equal).otherwise(inside)


def entry_specs(
    registry: DataFrame, titles: DataFrame, spec_titles: DataFrame, stages: DataFrame, query: str, terms: Sequence[str], anchors: Sequence[str],
    requested: Sequence[str], most: int,
) -> DataFrame:
    """spec_no and score of the ``most`` specifications in which to begin a search.

    ``registry`` (spec_no, term, score), ``titles`` (spec_no, clause_title, place), ``spec_titles`` (spec_no, title) and
    ``stages`` (spec_no, stages joined by '|') are summaries of bounded size per specification.
    """
    phrase = query.strip().lower()
    low = list(dict.fromkeys(t.lower() for t in distinct_words([phrase, *anchors, *terms])))
    term = F.lower("term")

    def held(t: str) -> Column:
        mutual = F.contains(term, F.lit(t)) | F.contains(F.lit(t), term)
        return F.when(term == t, 1.0).otherwise(F.when(mutual, 0.55).otherwise(0.0) if len(t) >= 5 else F.lit(0.0))

    by_term = registry.select("spec_no", (F.col("score") * _sum([held(t) for t in low])).alias("s"))
    by_name = spec_titles.select("spec_no", _phrase(phrase, F.lower("title"), 8.0, 4.2).alias("s"))
    title = F.lower("clause_title")
    named = _phrase(phrase, title, 9.5, 5.0) + _sum([F.when(F.contains(title, F.lit(a.lower())), 2.6).otherwise(0.0) for a in list(anchors)[:8] if len(a) >= 5])
    by_title = titles.filter("place <= 16").select("spec_no", named.alias("s"))
    total = by_term.unionByName(by_name).unionByName(by_title).groupBy("spec_no").agg(F.sum("s").alias("s")).filter("s > 0")
    fits = F.arrays_overlap(F.split("stages", r"\|"), F.array(*map(F.lit, requested)))
    scored = total.join(stages, "spec_no", "left").withColumn("score", F.round(F.col("s") + F.when(fits, 1.5).otherwise(0.0) + 1e-7, 3))  # halves up, whatever the order of summing
    return scored.orderBy(F.desc("score"), "spec_no").limit(most).select("spec_no", "score")
