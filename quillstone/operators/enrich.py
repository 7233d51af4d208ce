"""Enrichment of records: keywords, structured terms, entities, tables, registry and anchor terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions import arrays, extract
from quillstone.functions.arrays import distinct_terms, first_by, joined
from quillstone.functions.extract import KEYWORD_STOPWORDS, WORD, matches
from quillstone.functions.text import collapse, strip_white


def labelled(terms: Column | str, label: str, term: str = "term", kind: str = "source") -> Column:
    """struct(term, kind) of each of ``terms``."""
    return F.transform(terms, lambda t: F.struct(t.alias(term), F.lit(label).alias(kind)))


def keywords(records: DataFrame, most: int) -> DataFrame:
    """doc_id, keyword, uses and place of the most frequent words of ``text``; equal ones in the order of first use."""
    words = records.select("doc_id", F.posexplode(matches("text", WORD)).alias("at", "word")).withColumn("keyword", F.lower("word"))
    counted = (
        words.filter(~F.col("keyword").isin(KEYWORD_STOPWORDS)).groupBy("doc_id", "keyword").agg(F.count(F.lit(1)).alias("uses"), F.min("at").alias("first"))
    )
    best = Window.partitionBy("doc_id").orderBy(F.desc("uses"), "first")
    return counted.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= most).select("doc_id", "keyword", "uses", "place")


def keyword_arrays(records: DataFrame, most: int = 12) -> DataFrame:
    """``records`` with their ``keywords`` as an array, without a shuffle."""
    found = F.filter(F.transform(matches("text", WORD), F.lower), lambda w: ~w.isin(KEYWORD_STOPWORDS))
    # Sorted, equal words stand in runs: the length of a run is the word's count, its first element has the first place.
    words = records.withColumn("_w", F.array_sort(F.transform(found, lambda w, i: F.struct(w.alias("w"), i.alias("i")))))
    new = lambda i: (i == 0) | (F.get("_w", i)["w"] != F.get("_w", i - 1)["w"])
    places = F.when(F.size("_w") > 0, F.filter(F.sequence(F.lit(0), F.size("_w") - 1), new)).otherwise(F.array().cast("array<int>"))
    runs = words.withColumn("_s", places)
    count = lambda s, k: F.coalesce(F.get("_s", k + 1), F.size("_w")) - s
    ranked = F.array_sort(F.transform("_s", lambda s, k: F.struct((-count(s, k)).alias("n"), F.get("_w", s)["i"].alias("i"), F.get("_w", s)["w"].alias("w"))))
    return runs.withColumn("keywords", F.slice(F.transform(ranked, lambda r: r["w"]), 1, most)).drop("_w", "_s")


def source_texts() -> list[Column]:
    return [F.col("clause_title"), F.col("row_header"), F.col("text"), F.array_join("row_cells", " ")]


def structured_terms(records: DataFrame) -> DataFrame:
    """``records`` with acronyms, camelCase identifiers, and IE, procedure and message names."""
    texts = source_texts()
    return records.withColumns(
        {
            "acronyms": extract.terms_of(texts, extract.ACRONYM),
            "camel_case_identifiers": extract.terms_of(texts, extract.CAMEL_CASE),
            "ie_names": extract.terms_of(texts, extract.IE_NAME, 1),
            "procedure_names": extract.terms_of(texts, extract.PROCEDURE_NAME, 1),
            "message_names": distinct_terms(F.flatten(F.array(*[extract.message_names(t) for t in texts]))),
        }
    )


def enriched(records: DataFrame) -> DataFrame:
    """Records with structured terms, keywords, retrieval weight and anchor terms.

    Anchor terms are all terms of the record, each fingerprint once; of several spellings the smallest stands.
    """
    full = keyword_arrays(structured_terms(records)).withColumn("retrieval_weight", extract.retrieval_weight("clause_title", "doc_type"))
    pairs = extract.abbreviations("text")
    pool = F.concat(
        F.transform(pairs, lambda p: p["long_form"]), F.transform(pairs, lambda p: p["short_form"]), F.slice("keywords", 1, 8), F.array("row_header"),
        "ie_names", "message_names", "procedure_names", "acronyms", "camel_case_identifiers",
    )
    return full.withColumn("anchor_terms", distinct_terms(F.array_sort(F.array_distinct(pool))))


def entities(records: DataFrame) -> DataFrame:
    """A row for each IE and message name of the records of ``structured_terms``, under the record's scope."""
    named = lambda c, kind: F.transform(F.col(c), lambda n, i: F.struct(F.lit(kind).alias("entity_type"), n.alias("entity_name"), i.alias("entity_no")))
    rows = records.select("*", F.inline(F.concat(named("ie_names", "ie"), named("message_names", "message"))))
    return rows.select(
        F.concat_ws(":", "doc_id", F.lit("entity"), "entity_type", "entity_no").alias("doc_id"), F.col("doc_id").alias("source_doc_id"), F.lit("entity_doc").alias("doc_type"),
        F.lit("entity").alias("content_kind"), "spec_no", "release", "release_data", "clause_id", "clause_title", "entity_type", "entity_name", F.col("entity_name").alias("text"),
    )


def tables(clauses: DataFrame) -> DataFrame:
    """row_id, block_no, clause_title and matrix of every table block that has rows."""
    blocks = clauses.select("row_id", F.coalesce("clause_title", F.lit("")).alias("clause_title"), F.posexplode("blocks").alias("block_no", "b"))
    return blocks.filter((F.col("b.block_kind") == "table") & (F.size("b.table_rows") > 0)).select("row_id", "block_no", "clause_title", F.col("b.table_rows").alias("matrix"))


def table_rows(clauses: DataFrame) -> DataFrame:
    """A row for each row below the header of each table: row_no from 1, its cells, header and line."""
    rows = tables(clauses).select("row_id", "block_no", "clause_title", F.col("matrix")[0].alias("head"), F.posexplode(F.slice("matrix", F.lit(2), F.size("matrix"))).alias("at", "cells"))
    return rows.select(
        "row_id", "block_no", "clause_title", (F.col("at") + 1).alias("row_no"), "cells", arrays.row_header("cells").alias("row_header"), arrays.row_text("head", "cells").alias("line")
    )


def record_body() -> Column:
    """The embedding text of a record of the corpus, which has no spec title, table title or headers."""
    cells = F.array_join("row_cells", " | ")
    row = joined([F.col("spec_no"), F.col("clause_id"), F.col("clause_title"), F.col("row_header"), cells, F.col("text")], "\n")
    return F.when(F.col("doc_type") == "table_row_doc", row).otherwise(joined([F.col("spec_no"), F.col("clause_id"), F.col("clause_title"), F.col("text")], "\n"))


def record_context(size: int = 1200) -> Column:
    """What tells a reader where a record stands: titles, row header, summary and the first ``size`` characters of its text, a line each."""
    return _lines(["spec_title", "clause_title", "table_title", "row_header", "summary"], F.substring("text", 1, size))


def content_text(size: int = 1200) -> Column:
    """What a record says: summary, the first ``size`` characters of its text, its table and its cells."""
    return _lines(["summary"], F.substring("text", 1, size), F.col("table_markdown"), F.array_join("row_cells", " "))


def _lines(columns: list[str], *more: Column) -> Column:
    return joined([strip_white(c) for c in [*map(F.col, columns), *more]], "\n")


def fallback_blocks(text: str) -> Column:
    """A paragraph for each line of a text that is not blank, for clauses without blocks."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), strip_white), lambda v: v != "")
    return F.transform(lines, lambda v: F.struct(F.lit("paragraph").alias("block_kind"), v.alias("block_text")))


def with_metadata(files: DataFrame, path: str, overrides: DataFrame, fields: list[str]) -> DataFrame:
    """``path_metadata`` of ``files``, with the fields that ``overrides`` (source, ``fields``) gives for the whole path, or else for the file's name.

    An override counts as a whole: where the path has one, that of the name is not looked at. A null field of it is filled
    from the path.
    """
    hinted = path_metadata(files, path).withColumn("_name", F.regexp_extract(path, r"([^/]*)$", 1))
    given = overrides.groupBy("source").agg(F.max(F.struct(*fields)).alias("o"))
    by_path = given.select(F.col("source").alias(path), F.col("o").alias("_p"))
    by_name = given.select(F.col("source").alias("_name"), F.col("o").alias("_n"))
    both = hinted.join(by_path, path, "left").join(by_name, "_name", "left").withColumn("_o", F.coalesce("_p", "_n"))
    return both.withColumns({f: F.coalesce(f"_o.{f}", f) for f in fields}).drop("_p", "_n", "_o", "_name")


def searchable_text() -> Column:
    """The text under which a record is found: a table's text, a row's text or cells, else the record's text."""
    filled = F.nullif("text", F.lit(""))
    return F.when(F.col("content_kind") == "table_row", F.coalesce(filled, F.array_join("row_cells", "; "))).otherwise(F.col("text"))


def passages(records: DataFrame, size: int = 1200, most: int = 4, least: int = 350) -> DataFrame:
    """row_id, passage_no, paragraphs and text of the passages of ``text``.

    Paragraphs (lines) are packed greedily up to ``size`` characters and ``most`` paragraphs. A text of one short
    paragraph has none, and a single passage below ``least`` characters is dropped.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), collapse), lambda p: p != "")
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"))
    chars = lambda ps: F.aggregate(ps, F.lit(0), lambda n, p: n + F.length(p) + 1) - 1

    def add(acc: Column, p: Column) -> Column:
        full = (F.size(acc["open"]) > 0) & ((F.size(acc["open"]) >= most) | (chars(acc["open"]) + 1 + F.length(p) > size))
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array(p)).otherwise(F.array_append(acc["open"], p)).alias("open"),
        )

    packed = F.aggregate(lines, start, add, lambda acc: F.when(F.size(acc["open"]) > 0, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]))
    every = records.select("row_id", packed.alias("p"))
    kept = every.filter((F.size("p") > 1) | ((F.size("p") == 1) & (chars(F.col("p")[0]) >= least)))
    return kept.select("row_id", F.posexplode("p").alias("passage_no", "ps")).select(
        "row_id", "passage_no", F.size("ps").cast("bigint").alias("paragraphs"), F.array_join("ps", "\n").alias("passage")
    )


def anchor_source_terms(records: DataFrame) -> DataFrame:
    """doc_id, spec_no, term, source: the terms of titles, row headers, abbreviations and cells, as often as they occur."""
    pairs = extract.abbreviations("text")
    named = lambda terms, source: labelled(F.transform(terms, collapse), source)
    every = F.concat(
        named(extract.term_variants("clause_title"), "clause_title"),
        named(extract.term_variants("row_header"), "row_header"),
        named(F.transform(pairs, lambda p: p["long_form"]), "abbreviation_long"),
        named(F.transform(pairs, lambda p: p["short_form"]), "abbreviation_short"),
        named("row_cells", "row_value"),
    )
    return records.select("doc_id", "spec_no", F.inline(every)).filter("term <> ''")


def registry_terms(records: DataFrame) -> DataFrame:
    """doc_id, spec_no, release columns, term, weight, at: the weighted terms of a record in order, compounds expanded.

    A term that a record repeats is expanded once, where it comes first.
    """
    weighted = lambda terms, w: F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(w).alias("weight")))
    compounds = F.filter(matches("text", extract.COMPOUND_TOKEN), lambda t: t.rlike(r"\d") | F.contains(t, F.lit("_")) | t.rlike("[A-Z].*[A-Z]"))
    every = F.concat(
        weighted(F.array("clause_title"), 2.5), weighted(F.array("row_header"), 2.2), weighted(F.slice("anchor_terms", 1, 12), 1.6),
        weighted(F.slice("keywords", 1, 8), 0.8), weighted(compounds, 1.3),
    )
    expanded = F.flatten(F.transform(first_by(every, lambda s: s["term"]), lambda s: weighted_variants(s)))
    return records.select("doc_id", "spec_no", "release_data", "release", F.posexplode(expanded).alias("at", "s")).select(
        "doc_id", "spec_no", "release_data", "release", "at", "s.term", "s.weight"
    )


def weighted_variants(s: Column) -> Column:
    return F.transform(extract.compound_variants(s["term"]), lambda t: F.struct(t.alias("term"), s["weight"].alias("weight")))


def path_metadata(files: DataFrame, path: str) -> DataFrame:
    """``files`` with spec, series, release, release_data and version as their paths tell; empty where they do not."""
    p = F.col(path)
    spec = F.regexp_extract(p, r"(\d{5})[^/]*$", 1)
    return files.withColumns(
        {
            "release_data": F.regexp_extract(p, r"/(\d{4}-\d{2})/", 1),
            "release": F.regexp_extract(p, r"/(Rel-[^/]+)/", 1),
            "spec": spec,
            "series": F.substring(spec, 1, 2),
            "version": F.regexp_extract(p, r"-([a-z]\d{2})\.[^./]+$", 1),
        }
    )
