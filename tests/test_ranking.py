import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillstone.operators import evaluate, ranking, search

#: Of these, a record in 100 asks for the title that all have.
ALIKE = 4000


@pytest.fixture(scope="module")
def alike(spark, tmp_path_factory):
    """A folder of records of one title: every query matches every record."""
    folder = tmp_path_factory.mktemp("alike")
    rows = spark.range(ALIKE).select(
        F.col("id").alias("row_id"), F.format_string("d%05d", "id").alias("doc_id"), F.lit("clause_doc").alias("doc_type"), F.lit("clause").alias("content_kind"), F.lit("23501").alias("spec_no"),
        F.lit("Rel-17").alias("release"), F.lit("2020-01").alias("release_data"), F.lit("Stage 2").alias("stage_hint"), F.lit("1").alias("clause_id"), F.lit("General").alias("clause_title"),
        F.lit(None).cast("string").alias("row_header"), F.array().cast("array<string>").alias("row_cells"), F.concat(F.lit("word "), F.col("id") % 7).alias("text"),
        F.array().cast("array<string>").alias("referenced_specs"), F.array().cast("array<string>").alias("referenced_clauses"),
        F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: ((F.col("id") * k) % 11 - 5).cast("float")).alias("dense_vector"), F.lit(None).cast("timestamp").alias("indexed_at"),
    )
    rows.write.parquet(f"{folder}/records.parquet")
    return str(folder)


def written(spark, made) -> int:
    """Rows that all shuffles of ``made`` write."""
    sc = spark.sparkContext
    none = sc._jvm.java.util.ArrayList()

    def total() -> tuple[int, int]:
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
        every = [stages.apply(i) for i in range(stages.size())]
        return max([s.stageId() for s in every], default=-1), every

    last, _ = total()
    made().write.format("noop").mode("overwrite").save()
    return sum(s.shuffleWriteRecords() for s in total()[1] if s.stageId() > last)


def no_pair_is_shuffled(spark, folder, name):
    assert written(spark, lambda: entry.queries()[name](spark, folder)) < ALIKE * ALIKE // 100 // 3


def test_bm25_shuffles_no_pairs(spark, alike):
    no_pair_is_shuffled(spark, alike, "r10_o1_bm25")


def test_metrics_shuffle_no_pairs(spark, alike):
    no_pair_is_shuffled(spark, alike, "y1_y2_y3_j13_metrics")


def test_enriched_bm25_shuffles_no_pairs(spark, alike):
    no_pair_is_shuffled(spark, alike, "r10_r11_enriched_bm25")


def test_hybrid_shuffles_no_pairs(spark, alike):
    no_pair_is_shuffled(spark, alike, "r11_r12_r13_hybrid")


def test_sweep_shuffles_no_pairs(spark, alike):
    no_pair_is_shuffled(spark, alike, "y4_g15_profile_sweep")


def test_blocks_rank_as_all_pairs_do(spark, monkeypatch):
    monkeypatch.setattr(ranking, "RECORDS", 60)
    monkeypatch.setattr(ranking, "QUERIES", 5)
    draw = random.Random(5)
    words = lambda n: " ".join(draw.choice("abcdefgh") * 2 for _ in range(draw.randint(0, n)))
    vector = lambda: draw.choice([None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], *[[draw.gauss(0, 1), draw.gauss(0, 1)] for _ in range(7)]])
    rows = spark.createDataFrame([(f"d{i}é", words(6), words(2).split(), draw.choice([0.5, 1.0]), vector()) for i in range(300)], "doc_id string, text string, names array<string>, weight double, v array<float>")
    asked = spark.createDataFrame([(i, draw.choice([words(3), "AA, bb", "none", ""]), vector()) for i in range(25)], "query_id int, query string, v array<float>")
    profiles = {"both": {"text": 1.0, "names": 1.7}, "names": {"names": 2.0}}
    scores = {"l": ranking.Score("both"), "m": ranking.Score("both", 0.45, 1.0), "v": ranking.Score("names", 0.0, 1.0), "z": ranking.Score("names", 1.25, 0.0)}
    got = ranking.best(rows, asked.select("query_id", "query"), profiles, scores, 4, "weight", vectors=rows, asked_vectors=asked, size=2)
    assert dict(got.dtypes) == {"ranking": "string", "query_id": "int", "doc_id": "string", "score": "double", "place": "int"}
    pairs = search.profile_scores(rows, asked, profiles, "weight")
    unit = lambda frame, key: frame.select(key, search.unit("v", 2).alias("unit"))
    for name, s in scores.items():
        mine = pairs.filter(F.col("profile") == s.profile)
        if s.vector is None:
            want = search.placed(mine, ["query_id"], 4)
        else:
            want = search.hybrid(mine.withColumns({"sparse": F.lit(s.sparse), "vector": F.lit(s.vector)}), unit(rows, "doc_id"), unit(asked, "query_id"), ["query_id"], 4)
        columns = ["query_id", "place", "doc_id", "score"]
        assert sorted(map(tuple, got.filter(F.col("ranking") == name).select(columns).collect())) == sorted(map(tuple, want.select(columns).collect())) != []


def test_nothing_to_rank(spark):
    rows = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    asked = spark.createDataFrame([(1, "x")], "query_id bigint, query string")
    assert search.bm25(rows.limit(0), asked, {"text": 1.0}, 5).count() == 0 == search.bm25(rows, asked.limit(0), {"text": 1.0}, 5).count()


def test_metrics_by_title_are_those_of_pairs(spark):
    rows = spark.createDataFrame([(i * 50, f"d{i}", t) for i, t in enumerate(["A", "a", "b", "", "B", "c", "a"])], "row_id bigint, doc_id string, clause_title string")
    hits = spark.createDataFrame([(0, "d1", 1), (0, "d2", 2), (0, "d6", 3), (100, "d0", 1), (200, "d4", 7), (300, "d5", 1)], "query_id bigint, doc_id string, place int")
    pairs = spark.createDataFrame([(0, "d0"), (0, "d1"), (0, "d6"), (100, "d2"), (100, "d4"), (200, "d2"), (200, "d4"), (300, "d0"), (300, "d1"), (300, "d6")], "query_id bigint, doc_id string")
    assert sorted(map(tuple, evaluate.metrics_of(*evaluate.titled(hits, rows)).collect())) == sorted(map(tuple, evaluate.ranking_metrics(hits, pairs).collect()))
