"""The canonical record: its columns, defaults and kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, IntegerType, StringType, StructField, StructType

# The columns of a record by type.
STRINGS = [
    "doc_id", "doc_type", "content_kind", "spec_no", "spec_title", "release", "release_data", "series", "ts_or_tr", "stage_hint", "clause_id",
    "clause_title", "parent_clause_id", "text", "summary", "source_file", "table_title", "version_tag", "embedding_text", "embedding_model",
    "table_id", "row_header", "table_markdown", "passage_id", "entity_type", "entity_name", "source_doc_id",
]
STRING_ARRAYS = [
    "clause_path", "keywords", "anchor_terms", "ie_names", "message_names", "procedure_names", "table_headers", "acronyms", "camel_case_identifiers",
    "referenced_specs", "referenced_clauses", "domain_hint", "row_cells",
]
ZEROS = ["order_in_source", "embedding_dim"]
UNSET = ["row_index", "passage_index", "paragraph_start_index", "paragraph_end_index"]

RECORD = StructType(
    [StructField(c, StringType()) for c in STRINGS]
    + [StructField(c, ArrayType(StringType())) for c in STRING_ARRAYS]
    + [StructField("table_raw", ArrayType(ArrayType(StringType()))), StructField("dense_vector", ArrayType(FloatType())), StructField("retrieval_weight", DoubleType())]
    + [StructField(c, IntegerType()) for c in ZEROS + UNSET]
)


def default(field: StructField) -> object:
    """The value of a column that a record leaves out: '', [], 1.0, 0 or -1."""
    if isinstance(field.dataType, ArrayType):
        return []
    if isinstance(field.dataType, StringType):
        return "clause_doc" if field.name == "doc_type" else "clause" if field.name == "content_kind" else ""
    return 1.0 if isinstance(field.dataType, DoubleType) else -1 if field.name in UNSET else 0


def with_defaults(rows: DataFrame) -> DataFrame:
    """``rows`` with all columns of a record and no nulls; other columns are dropped."""

    def column(field: StructField):  # noqa: ANN202
        kind: DataType = field.dataType
        value = F.array().cast(kind) if isinstance(kind, ArrayType) else F.lit(default(field)).cast(kind)
        return (F.coalesce(F.col(field.name).cast(kind), value) if field.name in rows.columns else value).alias(field.name)

    return rows.select(*map(column, RECORD))
