"""The corpus of index records: one current row per record, without nulls in its text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.text import strip_white
from quillstone.sources.tables import current_records, table

TEXTS = ["release", "release_data", "stage_hint", "clause_title", "row_header", "text"]
ARRAYS = ["row_cells", "referenced_specs", "referenced_clauses"]


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """row_id, doc_id, doc_type, content_kind, spec_no, clause_id (trimmed) and ``TEXTS`` and ``ARRAYS``; nulls as '' and []."""
    empty = F.array().cast("array<string>")
    keep = {
        "row_id": F.col("row_id"),
        "doc_type": F.coalesce("doc_type", F.lit("clause_doc")),
        "content_kind": F.coalesce("content_kind", F.lit("clause")),
        "spec_no": F.coalesce(strip_white("spec_no"), F.lit("")),
        "clause_id": F.coalesce(strip_white("clause_id"), F.lit("")),
        **{c: F.coalesce(F.col(c), F.lit("")) for c in TEXTS},
        **{c: F.array_compact(F.coalesce(F.col(c), empty)) for c in ARRAYS},
    }
    return current_records(table(spark, folder, "records"), keep)
