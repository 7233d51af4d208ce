"""Records in JSON lines: reading, slicing, feeding, partitioned writing; registries as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.schema import RECORD, with_defaults


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records of JSON lines: blank lines skipped, absent keys filled with defaults, unknown keys dropped."""
    return with_defaults(spark.read.schema(RECORD).json(path))


def read_clauses(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Only clauses that name a specification and a clause."""
    return read_records(spark, path).filter("doc_type = 'clause_doc' and spec_no <> '' and clause_id <> ''")


def read_judgements(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("query string, relevant_doc_ids array<string>, relevant_specs array<string>, notes string").json(path).filter("query is not null")


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """Keywords of a text file, without blank lines and '#' comments, on one line and in lower case."""
    lines = spark.read.text(path).select(F.lower(F.trim(F.regexp_replace("value", r"(?U)\s+", " "))).alias("keyword"))
    return lines.filter("keyword <> '' and keyword not like '#%'").distinct()


def sliced(rows: DataFrame, key: list[str], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*key).offset(offset).limit(limit)


def write_records(rows: DataFrame, path: str, by_release: bool = False, append: bool = False) -> None:
    writer = rows.write.mode("append" if append else "overwrite")
    (writer.partitionBy("release_data", "release") if by_release else writer).json(path)


def feed(records: DataFrame, namespace: str, kind: str, fields: list[str], searchable: Column) -> DataFrame:
    """One JSON document per record in the column ``value``: a put with the record's id and its fields, nulls left out."""
    body = F.struct(*[F.col(c) for c in fields if c != "text"], searchable.alias("text"))
    return records.select(F.to_json(F.struct(F.concat(F.lit(f"id:{namespace}:{kind}::"), "doc_id").alias("put"), body.alias("fields"))).alias("value"))


def registry_json(registry: DataFrame) -> DataFrame:
    """spec_no and the JSON object of its terms and scores; a registry holds a bounded number of terms per specification."""
    terms = F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "score"))))
    return registry.groupBy("spec_no").agg(F.to_json(terms).alias("terms"))
