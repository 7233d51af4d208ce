"""References to records that do not exist.

Index records refer to specifications and to clauses of their own document. A reference is a *direct* orphan when its
target is missing, deleted, or came after the record. Orphanhood then cascades: a record that refers to a clause whose
own records are orphaned inherits it, and so on to a fixpoint, one semi-join down the reference graph per round.

Null, empty and unparsable references are no references. Repeated rows and repeated references count once. Records
without doc_id are left out; those without spec_no have no clause references. A null time is never late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import clause_number, filled, spec_number
from quillstone.lineage import cut, discard
from quillstone.sources.tables import DOCUMENT, counted_clauses, current_records

KEY = [*DOCUMENT, "clause"]


def references(records: DataFrame) -> DataFrame:
    """Distinct references of the current records: doc_id, release_data, release, spec, clause (the record's own),
    indexed_at, ref_table, ref_value."""
    current = current_records(
        records,
        {
            "release_data": F.coalesce(F.col("release_data"), F.lit("")),
            "release": F.coalesce(F.col("release"), F.lit("")),
            "spec": filled("spec_no"),
            "clause": filled("clause_id"),
            "indexed_at": F.col("indexed_at"),
            "to_specs": F.array_compact(F.array_distinct(F.transform("referenced_specs", spec_number))),
            "to_clauses": F.array_compact(F.array_distinct(F.transform("referenced_clauses", clause_number))),
        },
    )
    own_clauses = F.when(F.col("spec").isNotNull(), F.col("to_clauses"))
    both = F.concat(
        F.coalesce(F.transform("to_specs", lambda v: F.struct(F.lit("specs").alias("ref_table"), v.alias("ref_value"))), F.array()),
        F.coalesce(F.transform(own_clauses, lambda v: F.struct(F.lit("clauses").alias("ref_table"), v.alias("ref_value"))), F.array()),
    )
    return current.select("doc_id", *KEY, "indexed_at", F.inline(both))


def spec_targets(specs: DataFrame) -> DataFrame:
    """Per five-digit number: when it first appeared, and whether its latest registration is withdrawn."""
    latest = F.max(F.struct("registered_at", "row_id", F.col("withdrawn_at").isNotNull().alias("gone")))
    return (
        specs.withColumn("ref_value", spec_number("spec_no"))
        .filter(F.col("ref_value").isNotNull())
        .groupBy("ref_value")
        .agg(F.min("registered_at").alias("since"), latest.alias("latest"))
        .select("ref_value", "since", F.col("latest.gone").alias("gone"))
    )


def clause_targets(clauses: DataFrame) -> DataFrame:
    """Per clause of a document: when it first appeared, and whether its current row is deleted."""
    latest = F.max(F.struct("ingested_at", "row_id", F.col("deleted_at").isNotNull().alias("gone")))
    return (
        counted_clauses(clauses)
        .groupBy(*KEY)
        .agg(F.min("ingested_at").alias("since"), latest.alias("latest"))
        .select(*DOCUMENT, F.col("clause").alias("ref_value"), "since", F.col("latest.gone").alias("gone"))
    )


def judged(refs: DataFrame, specs: DataFrame, clauses: DataFrame) -> DataFrame:
    """Every reference with its ``reason``: missing, deleted, late, or null for a sound one."""
    reason = (
        F.when(F.col("gone").isNull(), "missing")
        .when(F.col("gone"), "deleted")
        .when(F.col("since") > F.col("indexed_at"), "late")
    )
    to_specs = refs.filter("ref_table = 'specs'").join(spec_targets(specs), "ref_value", "left")
    to_clauses = refs.filter("ref_table = 'clauses'").join(clause_targets(clauses), [*DOCUMENT, "ref_value"], "left")
    out = ["doc_id", *KEY, "ref_table", "ref_value", reason.alias("reason")]
    return to_specs.select(*out).unionByName(to_clauses.select(*out))


def direct_orphans(refs: DataFrame) -> DataFrame:
    """The references of ``judged`` whose own target is missing, deleted or late: where the cascade starts, at level 0."""
    return refs.filter(F.col("reason").isNotNull()).withColumn("level", F.lit(0))


#: Rounds of the cascade after which what they reached is written as one.
MERGED = 8


def inherited_orphans(refs: DataFrame) -> DataFrame:
    """The sound references of ``judged`` to clauses whose records are orphaned, by a fixpoint of semi-joins down the graph.

    The graph's edges are partitioned by the clause they point to, once; a round reads only those of the clauses that
    the round before reached. Targets are keys of many, so a document with a third of all rows is spread.
    """
    tasks = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sound = refs.filter(F.col("reason").isNull() & (F.col("ref_table") == "clauses"))
    edges = cut(sound.filter(F.col("clause").isNotNull()).select(*KEY, "ref_value").distinct().repartition(tasks, *DOCUMENT, "ref_value"))
    start = refs.filter(F.col("reason").isNotNull() & F.col("spec").isNotNull() & F.col("clause").isNotNull())
    frontier = cut(start.select(*KEY).distinct().withColumn("level", F.lit(0)))
    reached, written, level = frontier, [frontier], 0
    while True:
        level += 1
        parents = frontier.select(*DOCUMENT, F.col("clause").alias("ref_value"))
        hit = edges.join(parents, [*DOCUMENT, "ref_value"], "left_semi").select(*KEY).distinct()
        frontier = cut(hit.join(reached, KEY, "left_anti").withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            discard(frontier)
            break
        reached = reached.unionByName(frontier)
        written.append(frontier)
        if level % MERGED == 0:
            reached = cut(reached)
            discard(*written[:-1])
            written = [frontier, reached]
    by_target = reached.select(*DOCUMENT, F.col("clause").alias("ref_value"), (F.col("level") + 1).alias("level"))
    return sound.join(by_target, [*DOCUMENT, "ref_value"]).withColumn("reason", F.lit("inherited"))


def orphan_references(records: DataFrame, specs: DataFrame, clauses: DataFrame) -> DataFrame:
    """All orphan references, direct and inherited.

    Returns doc_id, release_data, ref_table, ref_value, reason (missing, deleted, late; ``inherited`` for references to
    a clause that exists but whose records are orphaned) and level: 0 for direct ones, else the number of references
    between the record and the nearest directly orphaned record.
    """
    refs = cut(judged(references(records), specs, clauses))
    out = ["doc_id", "release_data", "ref_table", "ref_value", "reason", "level"]
    return direct_orphans(refs).select(*out).unionByName(inherited_orphans(refs).select(*out))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per target table, period and reason: references, and records that hold them."""
    return orphans.groupBy("ref_table", "release_data", "reason").agg(
        F.count(F.lit(1)).alias("refs"), F.countDistinct("doc_id").alias("records")
    )
