"""Extraction and classification by patterns, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.arrays import distinct_terms
from quillstone.functions.text import anchor_term, col, collapse, hint_term, is_noisy_anchor, once, split_camel

# The patterns of terms and references in specification texts.
WORD = r"\b[A-Za-z][A-Za-z0-9\-]{2,}\b"
CLAUSE_REFERENCE = r"\b\d+(?:\.\d+)*(?:[A-Za-z])?\b"
SPEC_REFERENCE = r"\b(?:3GPP\s+)?(?:TS|TR)\s+(\d{2}\.\d{3}|\d{5})\b"
ABBREVIATION = r"\b([A-Za-z][A-Za-z0-9\-/ ]{3,}?)\s*\(([A-Z][A-Z0-9\-]{1,})\)"
ACRONYM = r"\b[A-Z][A-Z0-9\-]{1,}\b"
CAMEL_CASE = r"\b[a-z]+(?:[A-Z][a-z0-9]+){1,}\b|\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+){1,}\b"
IE_NAME = r"\b([A-Z][A-Za-z0-9/\-]*(?:\s+[A-Z][A-Za-z0-9/\-]*)*\s+(?:IE|information element))\b"
PROCEDURE_NAME = r"(?i)\b([A-Z0-9][A-Za-z0-9/\-]*(?:\s+[A-Z0-9][A-Za-z0-9/\-]*)*\s+procedures?)\b"
QUERY_SPEC = r"\b(?:3GPP\s+)?(?:TS|TR)?\s*(\d{2}\.\d{3}|\d{5})\b"
QUERY_TOKEN = r"\b[A-Za-z][A-Za-z0-9\-]{1,}\b"
COMPOUND_TOKEN = r"\b[A-Za-z][A-Za-z0-9_/-]{4,}\b"
NUMBERED_HEADING = r"^((?:\d+[A-Za-z]?(?:\.\d+[A-Za-z]?)*)|(?:[A-Z](?:\.\d+[A-Za-z]?)+))\s+(.+)$"
RELATIVE_HEADING = r"^\.(\d+[A-Za-z]?(?:\.\d+[A-Za-z]?)*)\s+(.+)$"
ANNEX_HEADING = r"^(Annex\s+[A-Z])(?:\s*\([^)]+\))?\s+(.+)$"
CAPTION = r"^(?:Figure|Table)\s+[A-Za-z0-9.\-]+\s*:"

# Words that end a message name, words that are no keywords, no query words, and titles of little content.
MESSAGE_WORDS = ["request", "response", "accept", "reject", "command", "complete", "transfer", "notification", "indication", "message"]
KEYWORD_STOPWORDS = [
    "shall", "should", "that", "with", "this", "from", "have", "when", "into", "between", "table", "clause", "figure", "support", "stage", "release",
]
QUERY_STOPWORDS = [
    "a", "an", "and", "are", "for", "from", "how", "in", "of", "on", "or", "show", "spec", "specification", "stage", "the", "document", "tr", "ts", "to",
    "what", "when", "where", "which", "with", "is", "defined", "end", "path", "paths",
]
QUERY_GENERIC = ["end", "path", "paths", "message", "messages", "procedure", "procedures"]
TRAILING_WORDS = ["handling", "procedures", "procedure", "values", "value", "support"]
GENERIC_TITLES = ["general", "feature negotiation", "successful operation", "resource definition", "references", "introduction", "overview"]
OVERLAP_GENERIC = ["message", "messages", "procedure", "procedures", "path", "paths", "end", "request"]


def matches(x: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(col(x), F.lit("")), F.lit(pattern), group)


def abbreviations(x: Column | str) -> Column:
    """(long_form, short_form) of 'Long Form (SF)' with a long form of at least two words."""
    pairs = F.arrays_zip(F.transform(matches(x, ABBREVIATION, 1), collapse).alias("long_form"), matches(x, ABBREVIATION, 2).alias("short_form"))
    return F.filter(pairs, lambda p: F.contains(p["long_form"], F.lit(" ")))


def clause_references(x: Column | str) -> Column:
    """Dotted numbers, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.filter(matches(x, CLAUSE_REFERENCE), lambda v: F.contains(v, F.lit(".")))))


def spec_references(x: Column | str) -> Column:
    """Numbers after TS or TR, without dot, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.transform(matches(x, SPEC_REFERENCE, 1), lambda v: F.translate(v, ".", ""))))


def terms_of(texts: list[Column], pattern: str, group: int = 0) -> Column:
    """Matches over several texts in order, each term once."""
    return distinct_terms(F.flatten(F.array(*[matches(t, pattern, group) for t in texts])))


def message_names(x: Column | str) -> Column:
    """Runs of capitalised or numbered words that end in a message word, of at least two words, each without punctuation; in one pass."""
    tokens = F.filter(F.split(collapse(F.coalesce(col(x), F.lit(""))), " "), lambda t: t != "")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("run"))

    def add(acc: Column, t: Column) -> Column:
        bare = F.btrim(t, F.lit(".,;:()"))
        ends = (acc["run"] != "") & F.lower(F.rtrim(t, F.lit(".,;:"))).isin(MESSAGE_WORDS)
        return F.struct(
            F.when(ends, F.array_append(acc["out"], F.concat(acc["run"], bare))).otherwise(acc["out"]).alias("out"),
            F.when(bare.rlike(r"^\p{Lu}|\d"), F.concat(acc["run"], bare, F.lit(" "))).otherwise("").alias("run"),
        )

    # Most texts have no such word and need not be gone through.
    some = F.coalesce(col(x), F.lit("")).rlike(rf"(?iu)(?:{'|'.join(MESSAGE_WORDS)})[.,;:]*(?:(?U)\s|$)")
    return F.when(some, F.aggregate(tokens, start, add, lambda acc: acc["out"])).otherwise(F.array().cast("array<string>"))


def retrieval_weight(title: Column | str, doc_type: Column | str) -> Column:
    """How much a record counts, by its title and kind; the first rule that holds."""
    name, kind = F.lower(F.trim(F.coalesce(col(title), F.lit("")))), col(doc_type)
    body = kind.isin("clause_doc", "passage_doc")
    return (
        F.when(name == "front_matter", 0.2)
        .when(body & (name == "references"), 0.35)
        .when(body & name.isin("foreword", "contents", "scope"), 0.55)
        .when(kind == "table_row_doc", 1.35)
        .when(kind == "table_doc", 1.15)
        .when(kind == "passage_doc", 1.1)
        .otherwise(1.0)
    )


def heading(x: Column | str) -> Column:
    """struct(clause, title) of 'Annex A (normative) Title' or '4.2a.1 Title'; null if it is none."""
    line = collapse(x)
    parts = lambda p: F.struct(F.regexp_extract(line, p, 1).alias("clause"), F.regexp_extract(line, p, 2).alias("title"))
    return F.when(line.rlike(ANNEX_HEADING), parts(ANNEX_HEADING)).when(line.rlike(NUMBERED_HEADING), parts(NUMBERED_HEADING))


def relative_heading(x: Column | str) -> Column:
    line = collapse(x)
    return F.when(line.rlike(RELATIVE_HEADING), F.struct(F.regexp_extract(line, RELATIVE_HEADING, 1).alias("clause"), F.regexp_extract(line, RELATIVE_HEADING, 2).alias("title")))


def is_probable_clause_id(x: Column | str) -> Column:
    return col(x).rlike(r"^Annex\s") | col(x).rlike(r"^\d+$") | F.contains(col(x), F.lit(".")) | col(x).rlike(r"^\d+[a-z]$")


def is_excluded_clause(clause: Column | str, title: Column | str) -> Column:
    return F.startswith(F.lower(col(clause)), F.lit("annex")) | F.contains(F.lower(col(title)), F.lit("change history"))


def style_level(style: Column | str) -> Column:
    """The heading level of a paragraph style ('Heading 2', 'head', 'h3'); null for other styles."""
    name = F.lower(collapse(style))
    level = F.regexp_extract(name, r"^(?:heading|head)\s*(\d+)?(?:\s+char)?$", 1)
    return (
        F.when(name.rlike(r"^(?:heading|head)\s*(\d+)?(?:\s+char)?$"), F.coalesce(F.nullif(level, F.lit("")).cast("int"), F.lit(1)))
        .when(name.rlike(r"^h\d+$"), F.substring(name, 2, 9).cast("int"))
    )


def is_heading(line: Column | str, style: Column | str, level: Column) -> Column:
    """A paragraph with an outline level, or with a heading style and a numbered text that is no sentence."""
    text = collapse(line)
    return level.isNotNull() | (heading(line).isNotNull() & style_level(style).isNotNull() & ~text.rlike("^Annex") & ~F.endswith(text, F.lit(".")))


def stage_hint(title: Column | str, cover: Column | str) -> Column:
    """'Stage N' from the title, else from the cover, else 'else'."""
    found = lambda x: F.nullif(F.regexp_extract(F.coalesce(col(x), F.lit("")), r"(?i)\b(stage\s+\d+)\b", 1), F.lit(""))
    return F.coalesce(F.initcap(found(title)), F.initcap(found(cover)), F.lit("else"))


def clause_target(keyword: Column | str, spec: Column | str) -> Column:
    """struct(spec, clause) of '5.2.1 of TS 23.501', or of a bare '5.2.1' within ``spec``; null otherwise."""
    word = collapse(keyword)
    full = r"(?i)^(?:clause\s+)?(\d+(?:\.\d+[a-z]?)+)\s+(?:of|in)\s+(?:3GPP\s+)?(?:TS|TR)\s*(\d{2}\.?\d{3})$"
    bare = r"(?i)^(?:clause\s+)?(\d+(?:\.\d+[a-z]?)+)$"
    pair = lambda s, c: F.struct(s.alias("spec"), c.alias("clause"))
    return F.when(word.rlike(full), pair(F.translate(F.regexp_extract(word, full, 2), ".", ""), F.regexp_extract(word, full, 1))).when(
        word.rlike(bare) & (col(spec) != ""), pair(col(spec), F.regexp_extract(word, bare, 1))
    )


def is_caption(x: Column | str) -> Column:
    return collapse(x).rlike(CAPTION)


def is_next_hop_title(x: Column | str) -> Column:
    return ~is_noisy_anchor(x) & ~F.lower(anchor_term(x)).isin(GENERIC_TITLES)


# --- queries ---------------------------------------------------------------------------------------------------------


def query_specs(x: Column | str) -> Column:
    """The specifications that a query names, TS and TR being optional; without dot, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.transform(matches(x, QUERY_SPEC, 1), lambda v: F.translate(v, ".", ""))))


def query_stages(x: Column | str) -> Column:
    """'Stage N' as often as a query names stages, each once; sorted."""
    return F.array_sort(F.array_distinct(F.transform(matches(x, r"(?i)\b(stage\s+\d+)\b", 1), F.initcap)))


def query_stage_filters(x: Column | str) -> Column:
    """The stages of a query, and 'else' if it has that word."""
    other = F.when(col(x).rlike(r"(?i)\belse\b"), F.array(F.lit("else"))).otherwise(F.array().cast("array<string>"))
    return F.concat(query_stages(x), other)


def query_tokens(x: Column | str) -> Column:
    """Words to search for: no stop words; generic words only in short queries; short ones only in capitals."""
    raw = matches(x, QUERY_TOKEN)
    return F.filter(
        raw,
        lambda t: ~F.lower(t).isin(QUERY_STOPWORDS) & ~(F.lower(t).isin(QUERY_GENERIC) & (F.size(raw) > 2)) & ((F.length(t) >= 3) | (F.upper(t) == t)),
    )


def query_aliases(x: Column | str) -> Column:
    """Acronyms, and compounds of 2 or 3 words the first of which holds a digit; sorted."""
    raw = matches(x, QUERY_TOKEN)
    caps = F.filter(matches(x, r"\b[A-Z][A-Z0-9\-]{1,}\b"), lambda a: ~F.lower(a).isin(QUERY_STOPWORDS))

    def compounds(size: int) -> Column:
        def at(i: Column) -> Column:
            words = F.slice(raw, i, size)
            rest = F.slice(words, 2, size - 1)
            glued = F.concat(words[0], F.array_join(F.transform(rest, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), ""))
            return F.when(words[0].rlike(r"\d") & ~F.exists(rest, lambda w: F.lower(w).isin(QUERY_STOPWORDS)), glued)

        return F.when(F.size(raw) >= size, F.array_compact(F.transform(F.sequence(F.lit(1), F.size(raw) - size + 1), at))).otherwise(F.array())

    return F.array_sort(F.array_distinct(F.concat(caps, compounds(2), compounds(3))))


def query_anchors(x: Column | str) -> Column:
    """Tokens, their runs of 2 to 6 and the whole phrase of 4 words or more: more words first, then longer, then by name."""
    raw, tokens = matches(x, QUERY_TOKEN), query_tokens(x)

    def runs(size: int) -> Column:
        at = lambda i: F.array_join(F.slice(tokens, i, size), " ")
        return F.when(F.size(tokens) >= size, F.filter(F.transform(F.sequence(F.lit(1), F.size(tokens) - size + 1), at), lambda p: F.length(p) >= 5)).otherwise(F.array())

    phrase = F.when(F.size(raw) >= 4, F.array(F.array_join(raw, " "))).otherwise(F.array())
    every = F.array_distinct(F.concat(tokens, phrase, *[runs(n) for n in range(2, 7)]))
    keyed = F.transform(every, lambda p: F.struct((-F.least(F.size(F.split(p, " ")), F.lit(6))).alias("w"), (-F.length(p)).alias("l"), F.lower(p).alias("n"), p.alias("p")))
    return F.transform(F.array_sort(keyed), lambda s: s["p"])


def query_variants(x: Column | str) -> Column:
    """The query in lower case, and with runs like 'n1n2' split."""
    low = F.lower(col(x))
    return F.array_sort(F.array_distinct(F.filter(F.array(low, F.regexp_replace(low, r"([a-z]\d)([a-z]\d)", "$1 $2")), lambda v: v != "")))


def term_variants(x: Column | str) -> Column:
    """The term, and without a generic last word if another word is left."""
    term = collapse(x)
    cut = F.regexp_replace(term, r"\s+\S+$", "")
    generic = F.contains(term, F.lit(" ")) & F.lower(F.regexp_extract(term, r"(\S+)$", 1)).isin(TRAILING_WORDS)
    return F.filter(F.array_distinct(F.when(generic, F.array(term, cut)).otherwise(F.array(term))), lambda t: t != "")


def compound_variants(x: Column | str) -> Column:
    """The hint form of a term; with its compounds split; and the last 4 and last 3 words of that."""
    def variants(s: Column) -> Column:
        words = F.split(s["split"], " ")
        tail = lambda n: F.when(F.size(words) >= n, F.array_join(F.slice(words, -n, n), " "))
        more = F.when(s["split"] != s["whole"], F.array(s["split"], tail(4), tail(3))).otherwise(F.array())
        return F.array_distinct(F.filter(F.concat(F.array(s["whole"]), more), lambda t: t.isNotNull() & (t != "")))

    return once(F.struct(hint_term(x).alias("whole"), hint_term(split_camel(F.trim(col(x)))).alias("split")), variants)


def spec_spellings(x: Column | str) -> Column:
    """'23501' as 23501, 23.501 and TS 23.501."""
    plain = F.translate(col(x), ".", "")
    dotted = F.concat(F.substring(plain, 1, 2), F.lit("."), F.substring(plain, 3, 9))
    return F.when(plain.rlike(r"^\d{5}$"), F.array(plain, dotted, F.concat(F.lit("TS "), dotted))).otherwise(F.array(col(x)))


def overlap_tokens(x: Column | str) -> Column:
    """The words of a term that count when terms are compared."""
    return F.array_distinct(F.filter(F.split(F.lower(anchor_term(x)), " "), lambda t: (t != "") & ~t.isin(OVERLAP_GENERIC)))
