from quillstone.functions import text
from quillstone.operators import enrich, queries, select


def asked(spark, *texts):
    return queries.normalised(spark.createDataFrame(list(enumerate(texts)), "query_id long, query string"))


def test_analysis(spark):
    rows = {r.query_id: r for r in asked(spark, "What is  the N1N2 message transfer in TS 23.501 stage 2 or else?", "", None, "x" * 100_000).collect()}
    r = rows[0]
    assert (r.specs, r.stages, r.stage_filters) == (["23501"], ["Stage 2"], ["Stage 2", "else"])
    assert r.normal.startswith("What is the N1N2") and {"N1N2Message", "N1N2MessageTransfer", "N1N2"} <= set(r.aliases)
    assert rows[1].tokens == [] and rows[1].specs == [] and not rows[2].normal and rows[3].tokens == ["x" * 100_000]
    assert asked(spark).count() == 0


def test_inferred_specs(spark):
    registry = spark.createDataFrame([("23501", "paging window", 1.5), ("23501", "n1 n2", 0.6), ("23502", "paging", 1.9), ("23503", None, 9.0)], "spec_no string, term string, score double")
    got = {(r.query_id, r.spec_no): r.score for r in queries.inferred_specs(asked(spark, "Paging Window of N1N2", "paging of TS 23.999", "", "nothing"), registry).collect()}
    assert got == {(0, "23501"): 2.1}
    assert queries.inferred_specs(asked(spark), registry).count() == 0 == queries.inferred_specs(asked(spark, "paging window"), registry.limit(0)).count()


def test_alias_closure(spark):
    aliases = spark.createDataFrame([("PSF", "Policy Serving Function"), ("PSF", "policy server"), ("AMF", "mobility"), ("NRF", None), (None, "x")], "canonical string, alias string")
    got = {(r.query_id, r.alias) for r in queries.known_aliases(asked(spark, "the policy server", "amf", "none"), aliases).collect()}
    assert got == {(0, "PSF"), (0, "Policy Serving Function"), (0, "policy server"), (1, "AMF"), (1, "mobility")}


def test_predicate(spark):
    shape = "doc_id string, spec_no string, stage_hint string, release string, release_data string, clause_id string, clause_title string, row_header string, text string, anchor_terms array<string>, ie_names array<string>, message_names array<string>, procedure_names array<string>"
    row = lambda i, spec="1", stage="Stage 3", title="", body="", anchors=(): (i, spec, stage, "Rel-17", "2020-01", "1", title, "", body, list(anchors), [], [], [])
    rows = spark.createDataFrame([row("a", title="Paging Window"), row("b"), row("c", spec="48491"), row("d", body="the WINDOW"), row("e", anchors=["PSF"]), row("f", stage="Stage 2")], shape)
    find = lambda q, inferred=(), scope=None: {r.doc_id for r in rows.filter(queries.Asked.of(rows, q, inferred).condition(scope)).collect()}
    assert find("Paging Window PSF") == {"a", "d", "e"}
    assert find("Paging Window PSF", ["48491"]) == {"a", "c", "d", "e"}
    assert find("Paging TS 48491") == set() | {"c"}
    assert find("Paging stage 2") == {"f"} and find("Window", scope=select.Scope(excluded_specs=["1"])) == set()


def test_containing(spark):
    texts = spark.createDataFrame([("abcdefghij",), ("abc",), (None,), ("",), ("abc",)], "text string")
    terms = spark.createDataFrame([("bcdefghi",), ("c",), ("zz",), ("",), (None,), ("c",)], "term string")
    assert {tuple(r) for r in select.containing(texts, terms).collect()} == {("abcdefghij", "bcdefghi"), ("abcdefghij", "c"), ("abc", "c")}
    assert select.containing(texts.limit(0), terms).count() == 0


def test_normal_terms(spark):
    rows = spark.createDataFrame([("Ｐａｇｉｎｇ​ Window ",), ("Paging\xa0Window",), ("ﬁt é",), (None,), ("",)], "t string")
    assert [r[0] for r in rows.select(text.normal_space("t")).collect()] == ["Paging Window", "Paging Window", "fit é", None, ""]
    assert len({r[0] for r in rows.limit(2).select(text.term_mark("t")).collect()}) == 1
    assert [r[0] for r in rows.limit(2).select(text.compatible("t")).collect()] == ["Paging Window ", "Paging Window"]


def test_views_and_metadata(spark):
    hits = spark.createDataFrame([(1, "1", "2", " long text ", True), (2, "1", "2 ", "later", True), (3, "1", None, "x", True), (4, "2", "1", None, True), (5, "3", "1", "y", None)], "i int, spec_no string, clause_id string, text string, relevant boolean")
    assert {tuple(r) for r in select.hit_views(hits, ["i"], 4).collect()} == {("1", "2", "long"), ("2", "1", "")}
    files = spark.createDataFrame([("/d/2020-01/Rel-17/23501-h10.docx",), ("/x/23502.docx",), ("/x/none.docx",)], "p string")
    given = spark.createDataFrame([("/x/23502.docx", "R", None), ("23501-h10.docx", "N", "9"), ("/d/2020-01/Rel-17/23501-h10.docx", None, "7")], "source string, release string, spec string")
    got = {r.p: (r.release, r.spec) for r in enrich.with_metadata(files, "p", given, ["release", "spec"]).collect()}
    assert got == {"/d/2020-01/Rel-17/23501-h10.docx": ("Rel-17", "7"), "/x/23502.docx": ("R", "23502"), "/x/none.docx": ("", "")}
    texts = spark.createDataFrame([("23501:4.2, 23502\r\n:x,a:,",), ("",), (None,)], "t string")
    assert [(r[0], [tuple(x) for x in r[1]]) if r[0] is not None else None for r in texts.select(select.excluded_specs("t"), select.excluded_clauses("t")).collect()][:2] == [(["23501:4.2", "23502", ":x", "a:"], [("23501", "4.2")]), ([], [])]
