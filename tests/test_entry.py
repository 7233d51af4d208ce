import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
#: Queries whose SQL is compared here; tools/compare.py does so for all of them.
SAMPLE = ["p1_found", "p1_report", "p3_found", "e1_keywords", "p1_enriched_records", "g1_anchor_candidates", "r10_o1_bm25", "t5_missing_ancestors"]


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("specs", "clauses", "records", "lineitem"):
        db.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    df = entry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    db.execute(entry.oracle_sql()[name])
    at = [d[0] for d in db.description]
    assert sorted(at) == columns
    theirs = sorted((tuple(plain(r[at.index(c)]) for c in columns) for r in db.fetchall()), key=repr)
    assert sorted((tuple(plain(v) for v in r) for r in df.select(columns).collect()), key=repr) == theirs


def test_sweep_has_every_profile_and_weight(spark):
    got = {r.profile for r in entry.queries()["y4_g15_profile_sweep"](spark, SMALL).collect()}
    assert got == {f"{p}:{w}" for p in ("bm25", "table_focus", "anchor_boost", "hybrid") for w in ("1.0:0.0", "0.0:1.0", "0.45:1.0")}
