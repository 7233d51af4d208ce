"""Queries of the two core data-quality problems, with independent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.text import WHITE, filled
from quillstone.operators.hierarchy import descendants, hierarchy
from quillstone.operators.references import direct_orphans, judged, orphan_references, orphan_report, references
from quillstone.sources.tables import DOCUMENT, current_clauses, table


def _tables(spark: SparkSession, folder: str) -> list[DataFrame]:
    return [table(spark, folder, t) for t in ("records", "specs", "clauses")]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Level 0 of the cascade, as the rows asked for are the direct orphans; ``p1_orphans`` and ``p1_report`` have all levels."""
    records, specs, clauses = _tables(spark, folder)
    return direct_orphans(judged(references(records), specs, clauses)).select("doc_id", "ref_table", "ref_value", "reason")


def p1_orphans(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_references(*_tables(spark, folder)).select("doc_id", "ref_table", "ref_value", "reason", "level")


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(orphan_references(*_tables(spark, folder)))


def _tree(spark: SparkSession, folder: str, sizes: bool = False) -> DataFrame:
    keep = {"doc_id": F.col("doc_id"), "parent": F.col("parent"), "clause_path": F.col("clause_path")}
    return hierarchy(current_clauses(table(spark, folder, "clauses"), keep), DOCUMENT, sizes=sizes)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    fault = F.when(F.col("state") != "ok", F.col("state")).when(~F.col("clause_path").eqNullSafe(F.col("path")), "path")
    return _tree(spark, folder).select("doc_id", fault.alias("fault")).filter("fault is not null")


def p3_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    return _tree(spark, folder, sizes=True).select(*DOCUMENT, "clause", "state", "root", "depth", F.array_join("path", "/").alias("path"), "descendants")


def p3_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return descendants(_tree(spark, folder), DOCUMENT)


QUERIES = {f.__name__: f for f in (p1_found, p1_orphans, p1_report, p3_found, p3_hierarchy, p3_descendants)}

_WHITE = "||".join(f"chr({ord(c)})" for c in WHITE)
_CLAUSES = f"""
white as materialized (select {_WHITE} as w),
cl as materialized (
  select row_id, doc_id, coalesce(release_data, '') as release_data, coalesce(release, '') as release, trim(spec_no, w) as spec,
         trim(clause_id, w) as clause, nullif(trim(parent_clause_id, w), '') as parent, clause_path, ingested_at, deleted_at
  from clauses, white where coalesce(trim(spec_no, w), '') <> '' and coalesce(trim(clause_id, w), '') <> ''),
cur as materialized (
  select * from cl qualify row_number() over (partition by release_data, release, spec, clause order by ingested_at desc nulls last, row_id desc) = 1)
"""
_REFS = f"""
{_CLAUSES},
since as materialized (select release_data, release, spec, clause, min(ingested_at) as since from cl group by all),
rec as materialized (
  select doc_id, coalesce(release_data, '') as release_data, coalesce(release, '') as release, nullif(trim(spec_no, w), '') as spec,
         nullif(trim(clause_id, w), '') as clause, indexed_at, referenced_specs, referenced_clauses
  from records, white where doc_id is not null
  qualify row_number() over (partition by doc_id order by indexed_at desc nulls last, row_id desc) = 1),
sp as (select nullif(replace(regexp_extract(spec_no, '(?:^|[^0-9])([0-9]{{2}}[.]?[0-9]{{3}})(?:$|[^0-9])', 1), '.', '') , '') as v, row_id, registered_at, withdrawn_at from specs),
spt as materialized (select v, min(registered_at) as since, arg_max(withdrawn_at is not null, (registered_at, row_id)) as gone from sp where v is not null group by v),
rs as (
  select distinct doc_id, release_data, release, spec, clause, indexed_at, nullif(replace(regexp_extract(e, '(?:^|[^0-9])([0-9]{{2}}[.]?[0-9]{{3}})(?:$|[^0-9])', 1), '.', ''), '') as v
  from (select *, unnest(referenced_specs) as e from rec)),
rc as (
  select distinct doc_id, release_data, release, spec, clause, indexed_at,
         nullif(regexp_extract(e, '(?:^|[^A-Za-z0-9.])((?:[0-9]+|[A-Z])(?:[.][0-9]+[A-Za-z]?)+)(?:$|[^A-Za-z0-9])', 1), '') as v
  from (select *, unnest(referenced_clauses) as e from rec where spec is not null)),
refs as materialized (
  select rs.doc_id, release_data, release, spec, clause, 'specs' as ref_table, v as ref_value,
         case when spt.v is null then 'missing' when gone then 'deleted' when spt.since > indexed_at then 'late' end as reason
  from rs left join spt using (v) where v is not null
  union all
  select rc.doc_id, rc.release_data, rc.release, rc.spec, rc.clause, 'clauses', rc.v,
         case when cur.clause is null then 'missing' when cur.deleted_at is not null then 'deleted' when s.since > rc.indexed_at then 'late' end
  from rc left join cur on (rc.release_data, rc.release, rc.spec, rc.v) = (cur.release_data, cur.release, cur.spec, cur.clause)
  left join since s on (rc.release_data, rc.release, rc.spec, rc.v) = (s.release_data, s.release, s.spec, s.clause) where rc.v is not null)
"""
_TREE = f"""
{_CLAUSES},
walk as (
  select release_data, release, spec, clause, parent as up, [clause] as path, false as ring from cur
  union all
  select w.release_data, w.release, w.spec, w.clause, c.parent, list_prepend(c.clause, w.path), list_contains(w.path, c.clause)
  from walk w join cur c on (w.release_data, w.release, w.spec, w.up) = (c.release_data, c.release, c.spec, c.clause) where not w.ring),
ends as (select * from walk qualify row_number() over (partition by release_data, release, spec, clause order by len(path) desc) = 1),
tree as materialized (
  select c.*, case when not e.ring and e.up is null then 'ok' when not e.ring then 'broken' when e.path[1] = c.clause then 'cycle' else 'below_cycle' end as state, e.path
  from cur c join ends e using (release_data, release, spec, clause))
"""
_DESCENDANTS = """select release_data, release, spec, path[i] as ancestor, clause as descendant, cast(len(path) - i as integer) as distance
from (select *, unnest(range(1, len(path))) as i from tree where state in ('ok', 'broken'))"""

ORACLES = {
    "p1_found": f"with {_REFS} select doc_id, ref_table, ref_value, reason from refs where reason is not null",
    "p1_orphans": f"""with recursive {_REFS},
        e as materialized (select distinct release_data, release, spec, clause, ref_value from refs where reason is null and ref_table = 'clauses' and clause is not null),
        reach as (
          select distinct release_data, release, spec, clause, 0 as level from refs where reason is not null and spec is not null and clause is not null
          union
          select e.release_data, e.release, e.spec, e.clause, r.level + 1 from e
          join reach r on (e.release_data, e.release, e.spec, e.ref_value) = (r.release_data, r.release, r.spec, r.clause) where r.level < 60),
        least as materialized (select release_data, release, spec, clause, min(level) as level from reach group by all)
        select doc_id, ref_table, ref_value, reason, 0 as level from refs where reason is not null
        union all
        select r.doc_id, r.ref_table, r.ref_value, 'inherited', l.level + 1 from refs r
        join least l on (r.release_data, r.release, r.spec, r.ref_value) = (l.release_data, l.release, l.spec, l.clause)
        where r.reason is null and r.ref_table = 'clauses'""",
    "p1_report": f"""with recursive {_REFS},
        hit as (select distinct release_data, release, spec, clause from refs where reason is not null and spec is not null and clause is not null),
        reach as (
          select * from hit
          union
          select e.release_data, e.release, e.spec, e.clause from refs e
          join reach r on (e.release_data, e.release, e.spec, e.ref_value) = (r.release_data, r.release, r.spec, r.clause)
          where e.reason is null and e.ref_table = 'clauses' and e.clause is not null)
        select ref_table, release_data, reason, count(*) as refs, count(distinct doc_id) as records from (
          select doc_id, release_data, ref_table, reason from refs where reason is not null
          union all
          select e.doc_id, e.release_data, e.ref_table, 'inherited' from refs e
          join reach r on (e.release_data, e.release, e.spec, e.ref_value) = (r.release_data, r.release, r.spec, r.clause)
          where e.reason is null and e.ref_table = 'clauses') group by all""",
    "p3_found": f"""with recursive {_TREE}
        select doc_id, case when state <> 'ok' then state else 'path' end as fault from tree
        where state <> 'ok' or clause_path is distinct from path""",
    "p3_hierarchy": f"""with recursive {_TREE}, d as ({_DESCENDANTS}), n as (select release_data, release, spec, ancestor as clause, count(*) as n from d group by all)
        select release_data, release, spec, clause, state, case when state in ('ok', 'broken') then path[1] end as root,
               cast(case when state in ('ok', 'broken') then len(path) - 1 end as integer) as depth,
               case when state in ('ok', 'broken') then array_to_string(path, '/') end as path, coalesce(n, 0) as descendants
        from tree left join n using (release_data, release, spec, clause)""",
    "p3_descendants": f"with recursive {_TREE} {_DESCENDANTS}",
}
__all__ = ["ORACLES", "QUERIES", "filled"]
