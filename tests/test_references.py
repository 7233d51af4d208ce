from datetime import datetime

from quillstone.operators.references import orphan_references, orphan_report

SPECS = "row_id long, spec_no string, registered_at timestamp, withdrawn_at timestamp"
CLAUSES = "row_id long, spec_no string, release string, release_data string, clause_id string, parent_clause_id string, ingested_at timestamp, deleted_at timestamp"
RECORDS = (
    "row_id long, doc_id string, spec_no string, release string, release_data string, clause_id string, referenced_specs array<string>, "
    "referenced_clauses array<string>, indexed_at timestamp, ref_table string, reason string, level int"
)
T = [datetime(2020, 1, d) for d in range(1, 10)]


def run(spark, records, specs=(), clauses=()):
    tables = spark.createDataFrame(list(records), RECORDS), spark.createDataFrame(list(specs), SPECS), spark.createDataFrame(list(clauses), CLAUSES)
    return orphan_references(*tables)


def record(i, doc, clause, specs=None, clauses=None, at=T[5], spec="23501"):
    return (i, doc, spec, "Rel-1", "2020-01", clause, specs, clauses, at, "clash", "clash", 7)


def clause(i, name, at=T[1], gone=None, spec="23501"):
    return (i, spec, "Rel-1", "2020-01", name, None, at, gone)


def test_reasons_and_versions(spark):
    specs = [(1, "TS 23.501", T[0], T[1]), (2, "23501 ", T[2], None), (3, "23502", T[7], None), (4, "23503", T[0], T[1]), (5, None, None, None)]
    clauses = [clause(1, " 1.1 "), clause(2, "1.2", T[1]), clause(3, "1.2", T[2], T[3]), clause(4, "1.3", T[7]), clause(5, None), clause(6, "1.4", None)]
    records = [
        record(1, "a", "1.1", ["ts 23.501", "23.502,", "23503", "99999", "n/a", None, "", "99999"], ["clause 1.1", "§1.2", "(1.3)", "9.9.", "x", "1.4"]),
        record(2, "a", "1.1", [], [], T[4]),  # an older version
        record(3, None, "1.1", ["99998"], ["9.9"]),
        record(4, "b", "1.1", None, ["9.9"], spec=" "),
        record(5, "c", None, None, None, None),
    ]
    found = {tuple(r)[:3] for r in run(spark, records, specs, clauses).filter("level = 0").select("doc_id", "ref_value", "reason").collect()}
    assert found == {
        ("a", "23502", "late"), ("a", "23503", "deleted"), ("a", "99999", "missing"), ("a", "1.2", "deleted"), ("a", "1.3", "late"), ("a", "9.9", "missing"),
    }


def test_cascade_and_report(spark):
    clauses = [clause(i, f"1.{i}") for i in range(1, 7)]
    records = [
        record(1, "a", "1.1", None, ["9.9"]), record(2, "b", "1.2", None, ["1.1"]), record(3, "c", "1.3", None, ["1.2"]), record(4, "d", "1.4", None, ["1.5"]),
        record(5, "e", "1.5", None, ["1.4"]), record(6, "f", "1.6", None, ["1.6", "1.3"]),
    ]
    rows = run(spark, records, (), clauses)
    assert {(r.doc_id, r.ref_value, r.level) for r in rows.collect()} == {("a", "9.9", 0), ("b", "1.1", 1), ("c", "1.2", 2), ("f", "1.3", 3), ("f", "1.6", 4)}
    report = {(r.ref_table, r.reason): (r.refs, r.records) for r in orphan_report(rows).collect()}
    assert report == {("clauses", "missing"): (1, 1), ("clauses", "inherited"): (4, 3)}


def test_empty_tables(spark):
    assert run(spark, []).count() == 0
    assert {r.reason for r in run(spark, [record(1, "a", "1", ["23501"], ["1.1"])]).collect()} == {"missing"}
