"""Ordered arrays and table matrices, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.text import col, collapse, compatible, fingerprint, once, without_article


def _strings(x: Column) -> Column:
    return F.transform(F.coalesce(x, F.array().cast("array<string>")), lambda v: F.coalesce(v, F.lit("")))


def first_by(items: Column, key) -> Column:  # noqa: ANN001
    """The items in order, without those whose ``key`` an earlier one has; items and keys are evaluated once."""

    def kept(own: Column) -> Column:
        first = lambda keys: F.filter(own, lambda _, i: F.array_position(keys, F.get(keys, i)) == i + 1)
        return once(F.transform(own, key), first)

    return once(items, kept)


def _changes(items: Column, kind: str, value) -> Column:  # noqa: ANN001
    """The items, of type ``kind``, whose ``value`` differs (by fingerprint) from that of the item before."""
    start = F.struct(F.array().cast(f"array<{kind}>").alias("out"), F.lit(None).cast("string").alias("last"))

    def add(acc: Column, v: Column) -> Column:
        mark = fingerprint(value(v))
        return F.struct(F.when(acc["last"].eqNullSafe(mark), acc["out"]).otherwise(F.array_append(acc["out"], v)).alias("out"), mark.alias("last"))

    return F.aggregate(items, start, add, lambda acc: acc["out"])


def distinct_terms(x: Column | str) -> Column:
    """Terms on one line in compatible characters, without article and empty ones, each fingerprint once."""
    clean = F.transform(_strings(col(x)), lambda v: without_article(collapse(compatible(v))))
    return first_by(F.filter(clean, lambda v: v != ""), fingerprint)


def distinct_trimmed(x: Column | str) -> Column:
    return F.array_distinct(F.filter(F.transform(_strings(col(x)), lambda v: F.trim(v)), lambda v: v != ""))


def keyword_list(x: Column | str, most: int) -> Column:
    """Keywords on one line, regardless of case once, at most ``most``."""
    return F.slice(first_by(F.filter(F.transform(_strings(col(x)), collapse), lambda v: v != ""), F.lower), 1, most)


def without_consecutive(x: Column | str) -> Column:
    """Without the items that repeat the item before (compared by fingerprint), and without empty ones."""
    return _changes(F.filter(F.transform(_strings(col(x)), collapse), lambda v: v != ""), "string", lambda v: v)


def distinct_cells(x: Column | str) -> Column:
    """Cells once by fingerprint, without empty ones, as they are written."""
    return first_by(F.filter(_strings(col(x)), lambda v: fingerprint(v) != ""), fingerprint)


def row_pairs(headers: Column | str, cells: Column | str) -> Column:
    """struct(header, value) of a row: 'column_i' without header; empty and consecutively repeated values dropped."""
    values, names = _strings(col(cells)), _strings(col(headers))
    pairs = F.transform(
        values,
        lambda v, i: F.struct(F.coalesce(F.nullif(F.trim(F.get(names, i)), F.lit("")), F.concat(F.lit("column_"), i + 1)).alias("header"), collapse(v).alias("value")),
    )
    return _changes(F.filter(pairs, lambda p: p["value"] != ""), "struct<header:string,value:string>", lambda p: p["value"])


def row_header(cells: Column | str) -> Column:
    """The first cell of a row that has more than one distinct cell, else empty."""
    return F.when(F.size(distinct_cells(cells)) > 1, collapse(F.get(_strings(col(cells)), 0))).otherwise("")


def row_text(headers: Column | str, cells: Column | str) -> Column:
    return F.array_join(F.transform(row_pairs(headers, cells), lambda p: F.concat(p["header"], F.lit(": "), p["value"])), "; ")


def table_text(title: Column | str, rows: Column | str) -> Column:
    """A table in lines: its title, then each row below the header as 'row i: header: value; ...'."""
    matrix = col(rows)
    head = F.get(matrix, 0)
    body = F.filter(
        F.transform(F.slice(matrix, F.lit(2), F.greatest(F.size(matrix), F.lit(1))), lambda r, i: F.struct((i + 1).alias("i"), row_text(head, r).alias("t"))), lambda s: s["t"] != ""
    )
    lines = F.transform(body, lambda s: F.concat(F.lit("row "), s["i"], F.lit(": "), s["t"]))
    only_head = F.when(F.size(matrix) == 1, F.array(F.array_join(F.filter(F.transform(_strings(head), collapse), lambda v: v != ""), "; "))).otherwise(F.array())
    name = F.when(F.coalesce(col(title), F.lit("")) != "", F.array(F.concat(F.lit("Table "), col(title)))).otherwise(F.array())
    return F.array_join(F.concat(name, only_head, lines), "\n")


def table_markdown(rows: Column | str) -> Column:
    """A Markdown table, rows padded to the widest."""
    matrix = F.transform(col(rows), _strings)
    width = F.array_max(F.transform(matrix, F.size))
    line = lambda cells, w: F.concat(F.lit("| "), F.array_join(F.concat(cells, F.array_repeat(F.lit(""), w - F.size(cells))), " | "), F.lit(" |"))
    # The width goes along with each row, so that it is found once.
    lines = F.zip_with(matrix, F.array_repeat(width, F.size(matrix)), line)
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.when(width > 0, F.array_join(F.array_insert(lines, 2, rule), "\n")).otherwise("")


def joined(parts: list[Column], sep: str) -> Column:
    """The parts that are not null or empty, joined."""
    return F.concat_ws(sep, *[F.nullif(p, F.lit("")) for p in parts])


def embedding_text(kind: Column | str) -> Column:
    """The text that stands for a record of this kind in an embedding."""
    c = F.col
    words = lambda a, sep: F.array_join(F.coalesce(a, F.array().cast("array<string>")), sep)
    head = [c("spec_no"), c("spec_title"), c("clause_id"), c("clause_title")]
    return (
        F.when(col(kind) == "entity_doc", joined([c("spec_no"), c("spec_title"), c("entity_type"), c("entity_name"), c("clause_id"), c("clause_title"), c("row_header"), c("text")], "\n"))
        .when(col(kind) == "table_row_doc", joined([*head, c("table_title"), words(c("table_headers"), " | "), c("row_header"), words(c("row_cells"), " | "), c("text")], "\n"))
        .when(col(kind) == "table_doc", joined([*head, c("table_title"), words(c("table_headers"), " | "), c("text")], "\n"))
        .otherwise(joined([*head, words(c("ie_names"), " "), words(c("message_names"), " "), words(c("procedure_names"), " "), c("text")], "\n"))
    )
