"""Text normalisation as Column expressions; nothing here leaves the JVM but ``nfkc``, and that only for texts beyond ASCII."""

from __future__ import annotations

from unicodedata import normalize

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The characters that Unicode counts as white space, plus the four separators of ASCII.
WHITE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(value: Column, use) -> Column:  # noqa: ANN001
    """``use(value)`` with ``value`` evaluated once, however often it is used; within lambdas nothing else shares it."""
    return F.transform(F.array(value), use)[0]


def strip_white(x: Column | str) -> Column:
    """Without white space of any kind at both ends; null stays null."""
    return F.btrim(col(x), F.lit(WHITE))


def filled(x: Column | str) -> Column:
    """Trimmed text, or null when nothing is left of it."""
    return F.nullif(strip_white(x), F.lit(""))


def spec_number(x: Column | str) -> Column:
    """The five-digit specification number in any spelling ('TS 23.501', '23501,'), dots dropped; null if there is none."""
    found = F.regexp_extract(col(x), r"(?<![0-9])([0-9]{2}\.?[0-9]{3})(?![0-9])", 1)
    return F.nullif(F.translate(found, ".", ""), F.lit(""))


def clause_number(x: Column | str) -> Column:
    """The clause number in any spelling ('subclause 4.2a.1', '(A.3).'): at least two segments; null if there is none."""
    found = F.regexp_extract(col(x), r"(?<![A-Za-z0-9.])((?:[0-9]+|[A-Z])(?:\.[0-9]+[A-Za-z]?)+)(?![A-Za-z0-9])", 1)
    return F.nullif(found, F.lit(""))


# --- normalisation of terms and titles -------------------------------------------------------------------------------

#: Anchors and titles that say too little to search for.
GENERIC_ANCHORS = ["general", "overview", "message", "messages", "procedure", "procedures", "information element", "ie"]


def collapse(x: Column | str) -> Column:
    """Runs of white space made one blank, trimmed."""
    return F.trim(F.regexp_replace(col(x), r"(?U)\s+", " "))


def fingerprint(x: Column | str) -> Column:
    """Lower case without any white space."""
    return F.regexp_replace(F.lower(col(x)), r"(?U)\s+", "")


#: Characters without width, which terms are rid of.
ZERO_WIDTH = r"[\x{200b}-\x{200f}\x{2060}\x{feff}]"
#: Single characters with a compatible single one (full-width letters, styled digits, odd blanks), by rule.
_ODD = [c for c in map(chr, range(0xA0, 0xFFFF)) if not 0xD800 <= ord(c) < 0xE000 and len(normalize("NFKC", c)) == 1 and normalize("NFKC", c) != c]
_COMPATIBLE = ("".join(_ODD), "".join(normalize("NFKC", c) for c in _ODD))
BEYOND_ASCII = r"[^\x00-\x7f]"


def compatible(x: Column | str) -> Column:
    """Single characters made their compatible ones, and those without width dropped: NFKC as far as it maps one to one.

    An expression, so it works within arrays; ``nfkc`` also composes marks and expands ligatures.
    """
    plain = F.regexp_replace(F.translate(col(x), *_COMPATIBLE), ZERO_WIDTH, "")
    return F.when(F.coalesce(col(x), F.lit("")).rlike(BEYOND_ASCII), plain).otherwise(col(x))


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: normalize("NFKC", t), na_action="ignore")


def nfkc(x: Column | str) -> Column:
    """Unicode NFKC; texts of ASCII alone do not leave the JVM."""
    odd = F.when(col(x).rlike(BEYOND_ASCII), col(x))
    return F.coalesce(_nfkc(odd), col(x))


def normal_space(x: Column | str) -> Column:
    """NFKC, without characters of no width, on one line."""
    return collapse(F.regexp_replace(nfkc(x), ZERO_WIDTH, ""))


def term_mark(x: Column | str) -> Column:
    """What equal terms share: ``normal_space`` in lower case without white space."""
    return fingerprint(normal_space(x))


def search_term(x: Column | str) -> Column:
    return F.lower(collapse(x))


def without_article(x: Column | str) -> Column:
    return F.regexp_replace(col(x), r"(?i)^(?:the|a|an)\s+", "")


def split_camel(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(x), r"[_/]+", " "), r"(?<=[a-z0-9])(?=[A-Z])", " ")


def anchor_term(x: Column | str) -> Column:
    """camelCase, '_' and '/' split into words."""
    return collapse(split_camel(x))


def is_noisy_anchor(x: Column | str) -> Column:
    term = F.lower(anchor_term(x))
    return (term == "") | term.isin(GENERIC_ANCHORS)


def hint_term(x: Column | str) -> Column:
    """Lower case, single blanks, nothing but letters and digits at the ends."""
    return F.regexp_replace(F.regexp_replace(search_term(x), r"^[^a-z0-9]+", ""), r"[^a-z0-9]+$", "")


def undotted(x: Column | str) -> Column:
    return F.translate(col(x), ".", "")


def preview(x: Column | str, size: int = 180) -> Column:
    whole = collapse(x)
    return F.when(F.length(whole) > size, F.concat(F.rtrim(F.substring(whole, 1, size - 1)), F.lit("..."))).otherwise(whole)


def file_stem(x: Column | str, default: str = "clause-export") -> Column:
    r"""A name for a file: without <>:"/\|?* and control characters, blanks made '_', without '.', '-' and blanks at the ends."""
    kept = F.regexp_replace(col(x), r'[<>:"/\\|?*\x00-\x1f]', "")
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(kept, r"(?U)\s+", "_"), F.lit(".- ")), F.lit("")), F.lit(default))


def url_quoted(x: Column | str) -> Column:
    return F.replace(F.url_encode(col(x)), F.lit("+"), F.lit("%20"))


def chunks(x: Column | str, size: int = 2000, most: int | None = None) -> Column:
    """The pieces of ``size`` characters of the trimmed text, all or the first ``most``; empty for an empty text."""
    whole = strip_white(F.coalesce(col(x), F.lit("")))
    count = F.ceil(F.length(whole) / size).cast("int")
    count = count if most is None else F.least(count, F.lit(most))
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(whole, i * size + 1, F.lit(size)))).otherwise(F.array())


def stage_filter(x: Column | str) -> Column:
    """'Stage 2', 'Stage 3' or 'else' from their spellings; another value is an error."""
    stage = F.lower(F.regexp_replace(strip_white(x), r"(?U)\s+", ""))
    known = F.when(stage.isin("stage2", "2"), "Stage 2").when(stage.isin("stage3", "3"), "Stage 3").when(stage == "else", "else")
    return known.otherwise(F.raise_error(F.concat(F.lit("unknown stage "), F.coalesce(stage, F.lit("null")))))


def stage_bucket(x: Column | str) -> Column:
    """The routing bucket of a stage: stage2, stage3, or else for anything other."""
    stage = F.lower(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"(?U)\s+", ""))
    return F.when(stage.isin("stage2", "stage3"), stage).otherwise("else")


#: The content kind of each kind of record.
CONTENT_KINDS = {"clause_doc": "clause", "passage_doc": "passage", "table_doc": "table", "table_row_doc": "table_row", "entity_doc": "entity"}


def content_kind(x: Column | str) -> Column:
    kinds = F.create_map(*[F.lit(v) for pair in CONTENT_KINDS.items() for v in pair])
    return F.coalesce(F.try_element_at(kinds, col(x)), F.lit("clause"))


def tensor_literal(x: Column | str) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(col(x), lambda v: F.format_string("%.6f", v.cast("double"))), ","), F.lit("]"))


def packed_paragraphs(x: Column | str, limit: int = 12000) -> Column:
    """Paragraphs packed greedily into texts of at most ``limit`` characters; a longer paragraph stands alone."""
    parts = F.filter(F.transform(F.split(col(x), r"\n{2,}"), strip_white), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, p: Column) -> Column:
        fits = (acc["open"] != "") & (F.length(acc["open"]) + F.length(p) + 2 <= limit)
        closed = F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"]))
        return F.struct(
            F.when(fits, acc["done"]).otherwise(closed).alias("done"),
            F.when(fits, F.concat(acc["open"], F.lit("\n\n"), p)).otherwise(p).alias("open"),
        )

    return F.aggregate(parts, start, add, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))


# --- cells of tables ---------------------------------------------------------------------------------------------------


def without_repeated_brackets(x: Column | str) -> Column:
    """Later '[...]' with a content seen before (compared by fingerprint) dropped."""
    parts = F.regexp_extract_all(col(x), F.lit(r"\[[^\[\]]*\]|[^\[\]]+|[\[\]]"), 0)
    start = F.struct(F.lit("").alias("text"), F.array().cast("array<string>").alias("seen"))

    def add(acc: Column, p: Column) -> Column:
        inner = fingerprint(F.regexp_replace(p, r"^\[|\]$", ""))
        bracket = p.rlike(r"^\[[^\[\]]*\]$")
        again = bracket & F.array_contains(acc["seen"], inner)
        return F.struct(
            F.when(again, acc["text"]).otherwise(F.concat(acc["text"], p)).alias("text"),
            F.when(bracket & ~again, F.array_append(acc["seen"], inner)).otherwise(acc["seen"]).alias("seen"),
        )

    return collapse(F.aggregate(parts, start, add, lambda acc: acc["text"]))


def without_redundant_brackets(x: Column | str) -> Column:
    """'[inner]' of at least 3 characters dropped where the same stands outside of brackets."""
    whole = col(x)
    outside = fingerprint(F.regexp_replace(whole, r"\[[^\[\]]*\]", " "))
    parts = F.regexp_extract_all(whole, F.lit(r"\[[^\[\]]*\]|[^\[\]]+|[\[\]]"), 0)
    inner = lambda p: fingerprint(F.regexp_replace(p, r"^\[|\]$", ""))
    kept = F.filter(parts, lambda p: ~(p.rlike(r"^\[[^\[\]]*\]$") & (F.length(inner(p)) >= 3) & F.contains(outside, inner(p))))
    return collapse(F.array_join(kept, ""))


def _without_repeats(parts: Column, long: int) -> Column:
    """Consecutive repeats dropped always, others from ``long`` characters on (compared by fingerprint)."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("seen"), F.lit("").alias("last"))

    def add(acc: Column, p: Column) -> Column:
        mark = fingerprint(p)
        again = (mark == acc["last"]) | ((F.length(p) >= long) & F.array_contains(acc["seen"], mark))
        return F.struct(
            F.when(again, acc["out"]).otherwise(F.array_append(acc["out"], p)).alias("out"),
            F.when(again, acc["seen"]).otherwise(F.array_append(acc["seen"], mark)).alias("seen"),
            mark.alias("last"),
        )

    return F.aggregate(F.filter(parts, lambda p: p != ""), start, add, lambda acc: acc["out"])


def without_repeated_items(x: Column | str) -> Column:
    """Items between semicolons: consecutive repeats and repeats from 14 characters on dropped; joined by '; '."""
    whole = col(x)
    items = F.array_join(_without_repeats(F.transform(F.split(whole, ";"), collapse), 14), "; ")
    return F.when(F.contains(whole, F.lit(";")), items).otherwise(whole)


def without_repeated_lines(x: Column | str) -> Column:
    """``without_repeated_items`` per line; consecutive lines that repeat, and others from 20 characters on, dropped."""
    return F.array_join(_without_repeats(F.transform(F.split(col(x), "\n"), lambda p: without_repeated_items(collapse(p))), 20), "\n")


def cell_text(x: Column | str) -> Column:
    """A table cell on one line, without repeated brackets and items."""
    return collapse(without_repeated_lines(without_redundant_brackets(without_repeated_brackets(collapse(x)))))
