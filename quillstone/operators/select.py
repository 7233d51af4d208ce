"""Filters, exclusions, semi- and anti-joins, and best rows per key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions.text import col, filled, search_term, strip_white


def distinct_words(terms: Sequence[str]) -> list[str]:
    """Trimmed, without empty ones, each once, in order."""
    return list(dict.fromkeys(t.strip() for t in terms if t.strip()))


def contains_any(columns: Sequence[str], terms: Sequence[str]) -> Column:
    """Whether the texts hold one of the terms, regardless of case; no terms: false."""
    whole = F.lower(F.concat_ws(" ", *columns))
    return reduce(Column.__or__, [F.contains(whole, F.lit(t.lower())) for t in distinct_words(terms)], F.lit(False))


@dataclass
class Scope:
    """Hard filters of a search; empty ones do not filter. They reach the scan as pushed-down predicates."""

    specs: Sequence[str] = ()
    stages: Sequence[str] = ()
    release: str = ""
    release_data: str = ""
    excluded_specs: Sequence[str] = ()
    excluded_clauses: Sequence[tuple[str, str]] = field(default_factory=tuple)

    def condition(self) -> Column:
        tests = [F.lit(True)]
        if self.specs:
            tests.append(F.col("spec_no").isin(list(self.specs)))
        if self.stages:
            tests.append(F.col("stage_hint").isin(list(self.stages)))
        for name in ("release", "release_data"):
            if getattr(self, name).strip():
                tests.append(F.col(name) == getattr(self, name).strip())
        if self.excluded_specs:
            tests.append(~F.col("spec_no").isin(list(self.excluded_specs)))
        tests += [~((F.col("spec_no") == s) & (F.col("clause_id") == c)) for s, c in self.excluded_clauses]
        return reduce(Column.__and__, tests)


def without_excluded(hits: DataFrame, specs: DataFrame, clauses: DataFrame) -> DataFrame:
    """Hits of neither an excluded specification nor an excluded (spec_no, clause_id); hits without clause are excluded."""
    return hits.filter("clause_id <> ''").join(specs, "spec_no", "left_anti").join(clauses, ["spec_no", "clause_id"], "left_anti")


def documents_with(clauses: DataFrame, wanted: DataFrame, document: list[str]) -> DataFrame:
    """The clauses of documents that have one of the wanted clauses."""
    return clauses.join(wanted.select(*document).distinct(), document, "left_semi")


def roots(clauses: DataFrame, document: list[str]) -> DataFrame:
    """Clauses without parent, or whose parent has no row."""
    known = clauses.select(*document, F.col("clause").alias("parent"))
    return clauses.join(known, [*document, "parent"], "left_anti")


def first_per_content(rows: DataFrame, text: str, order: list[str]) -> DataFrame:
    """Of rows with equal text (regardless of case and white space) the first."""
    best = Window.partitionBy(F.md5(search_term(text))).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def best_per_key(hits: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(*order)
    return hits.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def overlaid(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """The union of the parts, of rows with equal keys the one of the last part."""
    every = reduce(DataFrame.unionByName, [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
    return best_per_key(every, keys, [F.desc("_part")]).drop("_part")


def unseen(hits: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hits none of whose ``keys`` was seen before."""
    return reduce(lambda rows, k: rows.join(seen.select(k).distinct(), k, "left_anti"), keys, hits)


def grouped_sources(documents: DataFrame) -> DataFrame:
    named = lambda c, other: F.coalesce(filled(c), F.lit(other))
    return documents.groupBy(named("release", "unknown-release").alias("release"), named("spec_no", "unknown-spec").alias("spec")).agg(F.count(F.lit(1)).alias("documents"))


#: Lengths of the grams by which terms and texts are joined; a term has the longest that it holds.
GRAMS = (8, 5, 3, 2, 1)


def _grams(text: Column, size: int) -> Column:
    """The distinct substrings of ``size`` characters."""
    last = F.length(text) - size + 1
    each = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))
    return F.when(last > 0, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def containing(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """text, term: every distinct text of ``texts`` (text) with each distinct term of ``terms`` (term) that it contains, as written.

    A term is looked up by its gram that the fewest texts hold, among the distinct grams of the texts, and then verified.
    Only grams that some term has are shuffled. Null texts and null or empty terms are left out.
    """
    texts = texts.select("text").filter("text is not null").distinct().withColumn("_id", F.xxhash64("text", F.lit(1)))
    size = F.coalesce(*[F.when(F.length("term") >= n, F.lit(n)) for n in GRAMS])
    of_terms = terms.select("term").filter("term is not null and term <> ''").distinct().withColumn("_size", size)
    of_terms = of_terms.select("term", F.explode(F.coalesce(*[F.when(F.col("_size") == n, _grams(F.col("term"), n)) for n in GRAMS])).alias("gram"))
    grams = texts.select("_id", F.explode(F.concat(*[_grams(F.col("text"), n) for n in GRAMS])).alias("gram"))
    held = grams.join(of_terms.select("gram").distinct(), "gram", "left_semi")
    uses = held.groupBy("gram").agg(F.count(F.lit(1)).alias("uses"))
    # A gram that no text holds rules its term out.
    rarest = of_terms.join(uses, "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "gram")).alias("r")).filter("r.uses > 0")
    pairs = held.join(rarest.select("term", F.col("r.gram").alias("gram")), "gram").select("_id", "term")
    return pairs.join(texts, "_id").filter(F.contains(F.col("text"), F.col("term"))).select("text", "term").distinct()


def labelled_by(rows: DataFrame, text: Column, key: str, taxonomy: DataFrame) -> DataFrame:
    """key and the labels, joined, of which ``text`` holds a term regardless of case; ``taxonomy`` has label and term.

    Equal texts are searched once. A key on several rows has all their labels.
    """
    low = rows.select(key, F.lower(text).alias("text")).filter("text is not null")
    terms = taxonomy.select("label", F.lower("term").alias("term")).filter("term is not null and label is not null").distinct()
    found = containing(low, terms).join(terms, "term").select("text", "label").distinct()
    anywhere = terms.filter("term = ''").select("label").distinct().crossJoin(low.select("text").distinct())  # as contains has it; at most a row per label
    by_text = found.unionByName(anywhere).groupBy("text").agg(F.collect_set("label").alias("_labels"))
    by_key = low.join(by_text, "text").groupBy(key).agg(F.array_distinct(F.flatten(F.collect_set("_labels"))).alias("_l"))
    return by_key.select(key, F.array_join(F.array_sort("_l"), "|").alias("labels"))


def excluded_specs(x: Column | str) -> Column:
    """The specifications of an exclusion text: parted by commas and line ends, trimmed."""
    return F.filter(F.transform(F.split(col(x), r"\r?\n|,"), strip_white), lambda v: v != "")


def excluded_clauses(x: Column | str) -> Column:
    """struct(spec, clause) of each 'spec:clause' of an exclusion text; parts that lack one of both are left out."""
    pair = lambda v: F.struct(strip_white(F.get(F.split(v, ":"), F.lit(0))).alias("spec"), strip_white(F.get(F.split(v, ":"), F.lit(1))).alias("clause"))
    return F.filter(F.transform(excluded_specs(x), pair), lambda p: (p["spec"] != "") & (F.coalesce(p["clause"], F.lit("")) != ""))


def hit_views(hits: DataFrame, order: list[Column | str], size: int = 240) -> DataFrame:
    """spec_no, clause_id and preview of the hits that are judged relevant, each clause once; hits without either are left out."""
    named = hits.filter(F.coalesce("relevant", F.lit(False))).withColumns({c: strip_white(c) for c in ("spec_no", "clause_id")}).filter("spec_no <> '' and clause_id <> ''")
    first = best_per_key(named, ["spec_no", "clause_id"], order)
    return first.select("spec_no", "clause_id", F.substring(strip_white(F.coalesce("text", F.lit(""))), 1, size).alias("preview"))


def collected(words: DataFrame, word: str, order: list[str]) -> DataFrame:
    """``word`` and place of the distinct words (by ``search_term``) of all hits, as first written, in order of first use."""
    first = words.withColumn("_key", search_term(word)).filter("_key <> ''").groupBy("_key").agg(F.min_by(word, F.struct(*order)).alias(word), F.min(F.struct(*order)).alias("first"))
    return first.drop("_key")


def found_posts(posts: DataFrame, query: str) -> DataFrame:
    """Posts whose title or body holds the query, the last changed first."""
    word = query.strip().lower()
    hit = F.contains(F.lower("title"), F.lit(word)) | F.contains(F.lower("body"), F.lit(word)) if word else F.lit(True)
    return posts.filter(hit).orderBy(F.desc("updated_at"), F.desc("created_at"), F.desc("post_id"))


def quoted_ranges(text: Column, quotes: Column) -> Column:
    """struct(start, end, quote) of the first place of each quote in the text, in order; a quote that overlaps an earlier one is left out."""
    none = F.array().cast("array<struct<start:int,end:int,quote:string>>")

    def add(acc: Column, quote: Column) -> Column:
        word = F.trim(quote)
        at = F.instr(text, word) - 1
        free = (word != "") & (at >= 0) & ~F.exists(acc, lambda r: (at < r["end"]) & (at + F.length(word) > r["start"]))
        return F.when(free, F.array_append(acc, F.struct(at.alias("start"), (at + F.length(word)).alias("end"), word.alias("quote")))).otherwise(acc)

    return F.array_sort(F.aggregate(F.array_compact(quotes), none, add))
