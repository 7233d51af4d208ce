import pytest
from pyspark.sql import functions as F

from quillstone.operators import aggregate, enrich, evaluate, hops, search, select

RECORD = (
    "row_id long, doc_id string, doc_type string, content_kind string, spec_no string, clause_id string, release string, release_data string, stage_hint string, "
    "clause_title string, row_header string, text string, row_cells array<string>, referenced_specs array<string>, referenced_clauses array<string>"
)


def record(i, spec="23501", clause="1", title="", text="", header="", cells=(), specs=(), kind="clause_doc", stage="Stage 2"):
    return (i, f"d{i}", kind, "clause", spec, clause, "Rel-1", "2020-01", stage, title, header, text, list(cells), list(specs), [])


@pytest.fixture(scope="module")
def enriched(spark):
    rows = [
        record(1, title="Paging Window handling", text="The Paging Window Function (PWF) sends Tunnel Setup Request message towards n31MeshStorage."),
        record(2, "23502", "2", "Tunnel Setup Request", "Paging is described in clause 5.2.1 of TS 23.501.", specs=["23501"]),
        record(3, "23503", "3", "General", "", cells=["Paging Window", "Paging Window"], kind="table_row_doc"),
        record(4, "", "", "", "", ),
    ]
    return enrich.enriched(spark.createDataFrame(rows, RECORD)).cache()


def test_enrichment(enriched):
    row = enriched.filter("row_id = 1").first()
    assert "PWF" in row.acronyms and "Tunnel Setup Request" in row.message_names and "Paging Window handling" not in row.acronyms
    assert row.keywords[:2] == ["the", "paging"]
    assert enriched.filter("row_id = 4").first().anchor_terms == []
    assert enrich.entities(enriched).filter("source_doc_id = 'd1'").count() == len(row.ie_names) + len(row.message_names)


def test_registry_and_candidates(enriched):
    names = {r.term for r in aggregate.term_registry(enriched, [], least=0.0).collect()}
    assert "paging window handling" in names and "general" not in names
    scores = {r.term: r for r in aggregate.anchor_candidates(enriched).collect()}
    assert scores["Paging Window handling"].classification == "normal" and scores["General"].classification == "reject"
    assert aggregate.anchor_candidates(enriched.limit(0)).count() == 0


def test_rank_specs(spark):
    hits = [("23502", "a", 2.0, "direct_hit"), ("23502", "b", 1.0, "anchor_hit"), ("23501", "c", 1.5, "table_row_hit"), (None, "d", 0.5, "odd"), (" ", "e", 0.5, None)]
    rows = {r.spec_no: r for r in aggregate.ranked_specs(spark.createDataFrame(hits, "spec_no string, doc_id string, score double, reason_type string")).collect()}
    assert max(rows.values(), key=lambda r: r.score).spec_no == "23502" and rows["unknown"].doc_count == 2


def test_scores(enriched):
    scored = {r.doc_id: r.s for r in enriched.select("doc_id", search.tiered_score(["tunnel setup request", "paging window"]).alias("s")).collect()}
    assert scored["d2"] == 14.0 and scored["d1"] == 5.5 + 8.0 and scored["d4"] == 0.0
    assert enriched.filter(select.contains_any(["text"], [])).count() == 0


def test_hops(enriched):
    assert hops.two_phase(enriched, ["paging window"]).count() >= 2
    rounds = hops.iterative(enriched, ["paging window"], rounds=2, most=1).collect()
    assert len(rounds) == len({r.doc_id for r in rounds}) >= 2 and {r["round"] for r in rounds} >= {0, 1}
    assert hops.iterative(enriched, ["nothing of the kind"]).count() == 0
    assert hops.multi_hop(enriched, "Paging Window", ["paging window"]).count() >= 1
    assert hops.centred(enriched, "Paging Window", ["paging window"], ["Stage 2"]).count() >= 1


def test_judged(spark):
    hits = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    said = spark.createDataFrame([("a", True), ("x", True)], "doc_id string, relevant boolean")
    words = spark.createDataFrame([("a", "k2"), ("a", "k1")], "doc_id string, keyword string")
    assert {tuple(map(str, r)) for r in hops.judged(hits, said, words).collect()} == {("a", "True", "['k1', 'k2']"), ("b", "False", "[]")}


def test_metrics(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id int, doc_id string, place int")
    wanted = spark.createDataFrame([(1, "b"), (2, "z")], "query_id int, doc_id string")
    rows = {r.query_id: r for r in evaluate.ranking_metrics(hits, wanted, (3,)).collect()}
    assert rows[1].rr == 0.5 and rows[1].recall_3 == 1.0 and rows[2].rr == 0.0
    both = evaluate.ranking_metrics(hits, spark.createDataFrame([(1, "a"), (1, "c")], "query_id int, doc_id string"), (3,)).first()
    assert 0.9 < both.ndcg_3 <= 1.0


def test_exclusions_and_overlay(spark):
    hits = spark.createDataFrame([("1", "23502", "4.2"), ("2", "23501", "4.2"), ("3", "23501", "")], "doc_id string, spec_no string, clause_id string")
    none = spark.createDataFrame([], "spec_no string")
    pairs = spark.createDataFrame([("23502", "4.2")], "spec_no string, clause_id string")
    assert [r.doc_id for r in select.without_excluded(hits, none, pairs).collect()] == ["2"]
    parts = [spark.createDataFrame([("a", "base"), ("b", "base")], "doc_id string, t string"), spark.createDataFrame([("a", "overlay")], "doc_id string, t string")]
    assert {tuple(r) for r in select.overlaid(parts, ["doc_id"]).collect()} == {("a", "overlay"), ("b", "base")}
    assert select.unseen(hits, hits.filter("doc_id = '1'"), ["doc_id"]).count() == 2


def test_bm25_prefers_rare_words(spark):
    rows = spark.createDataFrame([("a", "common common rare"), ("b", "common common"), ("c", None), ("d", "")], "doc_id string, text string")
    asked = spark.createDataFrame([(1, "Rare, common!"), (2, "absent")], "query_id int, query string")
    found = search.bm25(rows, asked, {"text": 1.0}, 5).orderBy("place").collect()
    assert [(r.query_id, r.doc_id) for r in found] == [(1, "a"), (1, "b")]


def test_nearest(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None)], "id int, v array<float>")
    assert [r.id for r in search.nearest(rows, "v", [1.0, 0.1], 3, "id").collect()] == [1, 2]
    assert rows.select(F.round(search.closeness(search.cosine("v", [1.0, 0.0])), 6).alias("c")).first()["c"] == 1.0


def test_labels_ranges_and_posts(spark):
    rows = spark.createDataFrame([("a", "The Paging Window"), ("b", None), ("c", "tunnel and paging")], "doc_id string, text string")
    taxonomy = spark.createDataFrame([("radio", "Paging"), ("core", "tunnel"), ("radio", "window")], "label string, term string")
    assert {tuple(r) for r in select.labelled_by(rows, F.col("text"), "doc_id", taxonomy).collect()} == {("a", "radio"), ("c", "core|radio")}
    text = spark.createDataFrame([("one two three two", ["two three", " two ", "", None, "one", "absent"])], "t string, q array<string>")
    found = text.select(select.quoted_ranges(F.col("t"), F.col("q")).alias("r")).first()["r"]
    assert [tuple(r) for r in found] == [(0, 3, "one"), (4, 13, "two three")]
    posts = spark.createDataFrame([(1, "Paging", None, 1, 1), (2, None, "on paging", 2, 1), (3, "x", "y", 3, 1)], "post_id int, title string, body string, updated_at int, created_at int")
    assert [r.post_id for r in select.found_posts(posts, " PAGING ").collect()] == [2, 1]
    assert [r.post_id for r in select.found_posts(posts, " ").collect()] == [3, 2, 1]


def test_entry_specs(spark):
    registry = spark.createDataFrame([("1", "create sm context", 5.0), ("2", "sm", 9.0)], "spec_no string, term string, score double")
    titles = spark.createDataFrame([("1", "Create SM Context service", 1), ("3", "Create SM Context service", 17)], "spec_no string, clause_title string, place int")
    names = spark.createDataFrame([("2", "Create SM Context service operations"), ("4", None)], "spec_no string, title string")
    stages = spark.createDataFrame([("2", "Stage 3")], "spec_no string, stages string")
    found = search.entry_specs(registry, titles, names, stages, "Create SM Context service", ["context"], ["Create SM Context"], ["Stage 3"], 5).collect()
    assert [r.spec_no for r in found] == ["1", "2"]


def test_profiles_weigh_extracted_fields(spark, enriched):
    asked = spark.createDataFrame([(0, "PWF"), (1, "paging")], "query_id int, query string")
    scores = search.profile_scores(enriched, asked, search.ENRICHED_PROFILES)
    got = {(r.profile, r.query_id, r.doc_id): r.score for r in scores.collect()}
    plain = {(r.query_id, r.doc_id): r.score for r in search.bm25(enriched, asked, search.PROFILES["bm25"], 10).collect()}
    weight = {r.doc_id: r.retrieval_weight for r in enriched.collect()}
    assert set(search.ENRICHED_PROFILES) == {p for p, *_ in got}
    assert got["bm25", 0, "d1"] > plain[0, "d1"] * weight["d1"]  # the anchor term counts beside the text
    halved = search.profile_scores(enriched.withColumn("retrieval_weight", F.col("retrieval_weight") / 2), asked, search.ENRICHED_PROFILES)
    assert {(r.profile, r.query_id, r.doc_id): r.score for r in halved.collect()} == pytest.approx({k: v / 2 for k, v in got.items()}, abs=1e-5)


def test_hybrid_ranks_all_lexical_matches(spark):
    rows = [(q, f"d{i:03}", 100.0 - i / 10 if q else 10.0 - i / 100) for q in (0, 1) for i in range(120)]
    sparse = spark.createDataFrame(rows, "query_id int, doc_id string, score double").withColumns({"sparse": F.lit(0.45), "vector": F.lit(1.0)})
    axis = lambda i: [1.0, 0.0] if i in (99, 119) else [0.0, 1.0]
    raw = spark.createDataFrame([(f"d{i:03}", axis(i)) for i in range(120) if i != 5] + [("d005", None)], "doc_id string, v array<double>")
    vectors = raw.select("doc_id", search.unit("v", 2).alias("unit"))
    asked = spark.createDataFrame([(0, [2.0, 0.0]), (1, [2.0, 0.0])], "query_id int, v array<double>").select("query_id", search.unit("v", 2).alias("unit"))
    got = search.hybrid(sparse, vectors, asked, ["query_id"], 10).collect()
    best = {(r.query_id, r.place): r.doc_id for r in got}
    assert len(got) == 20 and best[0, 1] == "d099" and best[0, 2] == "d119"  # far beyond the 50th lexical place
    close = lambda i: 0 if i == 5 else 1.0 if i in (99, 119) else 1 / (1 + 1.5707963267948966)
    for q in (0, 1):
        want = sorted((-round(0.45 * s + 9 * close(int(d[1:])), 4), d) for p, d, s in rows if p == q)[:10]
        assert [best[q, k + 1] for k in range(10)] == [d for _, d in want]


def test_boosts_reach_the_profile():
    weights = search.Ranking(title=2.0, stage=3.0).weights()
    plain = search.Ranking(title=1.0, stage=1.0).weights()
    assert weights["clause_title"] == 2 * plain["clause_title"] and weights["stage_hint"] == 3 * plain["stage_hint"] and weights["text"] == plain["text"]
    assert (search.SINGLE.sparse, search.SINGLE.vector, search.ITERATIVE.sparse, search.ITERATIVE.vector) == (1.25, 0.45, 0.0, 1.0)


def test_labels_of_terms_of_any_length(spark):
    from __spark_entry__ import oracle_sql, queries

    assert "length(term)" not in oracle_sql()["e13_s17_all_labels"] and "e13_s17_all_labels" in queries()
    texts = {"a": "Paging window of the PSF", "b": "x", "c": "", "d": None, "e": "Tunnel setup requests", "f": "Paging window of the PSF", "g": "naïve 窓 text"}
    terms = [("normal", "psf"), ("reject", "x"), ("strong", "Tunnel Setup Request"), ("normal", "窓"), ("strong", "paging windows"), ("reject", "paging w"), ("strong", "NAÏVE")]
    rows = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    got = {r.doc_id: r.labels for r in select.labelled_by(rows, F.col("text"), "doc_id", spark.createDataFrame(terms, "label string, term string")).collect()}
    want = {d: "|".join(sorted({n for n, t in terms if t.lower() in text.lower()})) for d, text in texts.items() if text}
    assert got == {d: n for d, n in want.items() if n} and got["a"] == "normal|reject"


def test_nearest_to_each_of_many(spark):
    import numpy as np

    x = np.random.default_rng(3).normal(size=(300, 8))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(300, [0.0] * 8), (301, None)], "vec_id long, v array<double>")
    asked = vectors.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    got = {(r.query_id, r.place): r.vec_id for r in search.nearest_to_each(vectors, asked, "v", 4, "vec_id", rows=64).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got == {(q, k + 1): int(i) for q in (0, 100, 200) for k, i in enumerate(np.argsort(-(u @ u[q]))[:4])}


def test_distinct_texts_are_rows(spark):
    rows = [(i, "", "late" if i else "first", f"t{i % 3}") for i in range(600)] + [(600, "k", "only", "")]
    hits = spark.createDataFrame(rows, "row_id long, k string, clause_title string, text string")
    got = aggregate.distinct_texts(hits, ["k"], ["row_id"]).orderBy("place").collect()
    assert [(r.k, r.place, r.text) for r in got] == [("", 1, "t0"), ("", 2, "t1"), ("", 3, "t2")]
    merged = {r.k: (r.title, r.texts) for r in aggregate.merged_texts(hits, ["k"], ["row_id"]).collect()}
    assert merged == {"": ("first", 3), "k": ("only", 0)}
