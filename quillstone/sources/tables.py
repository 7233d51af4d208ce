"""The input tables and the row versions that count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.text import filled, strip_white

#: Columns that name one document: one version of a specification.
DOCUMENT = ["release_data", "release", "spec"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def newest(rows: DataFrame, keys: list[str], order: list[str], keep: dict[str, Column]) -> DataFrame:
    """One row per key: the values of ``keep`` in the row that is greatest by ``order``.

    The maximum of a struct is aggregated before the shuffle, so a key with many versions sends one row per task.
    Nulls in ``order`` are lowest. Only ``keys`` and ``keep`` come out.
    """
    packed = F.struct(*[F.col(c) for c in order], F.struct(*[v.alias(k) for k, v in keep.items()]).alias("kept"))
    best = rows.groupBy(*keys).agg(F.max(packed).alias("best"))
    return best.select(*keys, *[F.col(f"best.kept.{k}").alias(k) for k in keep])


def counted_clauses(clauses: DataFrame) -> DataFrame:
    """Clause rows that count, with trimmed ``spec``, ``clause`` and ``parent`` (null for a root)."""
    return (
        clauses.withColumns({"spec": filled("spec_no"), "clause": filled("clause_id"), "parent": filled("parent_clause_id")})
        .filter(F.col("spec").isNotNull() & F.col("clause").isNotNull())
        .withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("release_data", "release")})
    )


def current_clauses(clauses: DataFrame, keep: dict[str, Column]) -> DataFrame:
    """The current row of each clause of each document: (release_data, release, spec, clause) and ``keep``."""
    return newest(counted_clauses(clauses), [*DOCUMENT, "clause"], ["ingested_at", "row_id"], keep)


def current_records(records: DataFrame, keep: dict[str, Column]) -> DataFrame:
    """The current row of each record: doc_id and ``keep``. Rows without doc_id name no record and are left out."""
    return newest(records.filter(F.col("doc_id").isNotNull()), ["doc_id"], ["indexed_at", "row_id"], keep)


__all__ = ["DOCUMENT", "counted_clauses", "current_clauses", "current_records", "newest", "strip_white", "table"]
