"""Navigation of clause hierarchies: subtrees, children, missing ancestors, natural order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import col


def natural_key(x: Column | str) -> Column:
    """A clause number as a string that sorts naturally: numbers zero-padded to ten digits, then their letters."""
    part = lambda t: F.concat(F.lpad(F.regexp_extract(t, r"^(\d*)", 1), 10, "0"), F.regexp_extract(t, r"^\d*(.*)$", 1))
    letters = lambda t: F.when(t.rlike(r"^\d"), part(t)).otherwise(F.concat(F.lit("~"), t))
    return F.array_join(F.transform(F.split(col(x), r"\."), letters), ".")


def subtree(tree: DataFrame, root: str) -> DataFrame:
    """The rows of a hierarchy at or below ``root`` in any document, by their paths."""
    return tree.filter(F.array_contains("path", root))


def children(tree: DataFrame, scope: list[str], order: str = "order_in_source") -> DataFrame:
    """Per parent its children in order, joined; a parent's children are gathered as names only."""
    rows = tree.filter("parent is not null").groupBy(*scope, "parent")
    named = rows.agg(F.count(F.lit(1)).alias("children"), F.array_sort(F.collect_list(F.struct(F.coalesce(order, F.lit(0)), "clause"))).alias("c"))
    return named.select(*scope, "parent", "children", F.array_join(F.transform("c", lambda s: s["clause"]), "|").alias("names"))


def missing_ancestors(clauses: DataFrame, scope: list[str]) -> DataFrame:
    """Rows for the prefixes of ``clause_path`` that have no row: clause, parent, depth, order_in_source, found_in.

    The first descendant in order stands for a prefix; the new row precedes it by their distance.
    """
    size = F.size("clause_path")
    paths = clauses.filter(size > 1).select(*scope, "clause", F.coalesce("order_in_source", F.lit(0)).alias("o"), size.alias("n"), "clause_path", F.posexplode(F.slice("clause_path", 1, size - 1)).alias("at", "ancestor"))
    known = clauses.select(*scope, F.col("clause").alias("ancestor"))
    lost = paths.filter(F.col("ancestor").isNotNull() & (F.col("ancestor") != "")).join(known, [*scope, "ancestor"], "left_anti")
    first = F.struct("o", "clause")
    return (
        lost.groupBy(*scope, "ancestor")
        .agg(
            F.min_by(F.when(F.col("at") > 0, F.get("clause_path", F.col("at") - 1)), first).alias("parent"),
            F.min_by("at", first).alias("depth"),
            F.min_by(F.greatest(F.lit(0), F.col("o") - (F.col("n") - F.col("at") - 1)), first).alias("order_in_source"),
            F.min_by("clause", first).alias("found_in"),
        )
        .withColumnRenamed("ancestor", "clause")
    )


def branches_matching(tree: DataFrame, scope: list[str], condition: Column) -> DataFrame:
    """The rows that match, and all of their ancestors: what stays visible when a tree is filtered."""
    hit = tree.filter(condition).select(*scope, F.explode("path").alias("clause")).distinct()
    return tree.join(hit, [*scope, "clause"], "left_semi")


def in_document(clauses: DataFrame, spec: str, release: str | None = None, release_data: str | None = None) -> DataFrame:
    """The clauses of one document of ``spec``: the given release, or else the smallest that there is."""
    rows = clauses.filter(F.col("spec") == spec)
    if release is not None:
        rows = rows.filter(F.col("release") == release)
    if release_data is not None:
        rows = rows.filter(F.col("release_data") == release_data)
    first = rows.agg(F.min(F.struct("release_data", "release")).alias("d"))  # one row
    return rows.join(F.broadcast(first), F.struct("release_data", "release") == F.col("d"), "left_semi")
