import pytest
from pyspark.sql import functions as F

from quillstone.llm.mixing import draw_mix, mix_plan, mix_report, mix_sources, source_name

SIZED = "doc_id long, source string, tokens long"
TARGETS = "source string, target_weight double, max_repeats int"


def fill(tokens, weights, repeats):
    """Capped water-filling by repeated clamping."""
    total, left = sum(tokens.values()), set(weights)
    grant = {}
    while left:
        room = total - sum(grant.values())
        share = {s: weights[s] / sum(weights[x] for x in left) * room for s in left}
        over = [s for s in left if tokens.get(s, 0) * repeats[s] < share[s]]
        if not over:
            return grant | share
        for s in over:
            grant[s] = tokens.get(s, 0) * repeats[s]
            left.discard(s)
    return grant


def test_plan_and_mix(spark):
    docs = [(i, s, 1 + i % 17) for s, n in (("a", 900), ("b", 40), ("c", 300), ("d", 5), ("z", 50)) for i in range(n)]
    docs = [(j, s, t) for j, (_, s, t) in enumerate(docs)]
    targets = [("A", 1.0, 2), ("b ", 3.0, 4), ("C", 2.0, 3), ("d", 5.0, 10), ("none", 1.0, 5), (None, 1.0, 1), ("nullish", None, None)]
    sized, plan_of = spark.createDataFrame(docs, SIZED), {}
    plan = mix_plan(sized, spark.createDataFrame(targets, TARGETS)).cache()
    plan_of = {r.source: r for r in plan.collect()}
    tokens = {s: sum(t for _, x, t in docs if x == s) for s in "abcd"}
    wanted = fill(tokens, {"a": 1, "b": 3, "c": 2, "d": 5, "none": 1}, {"a": 2, "b": 4, "c": 3, "d": 10, "none": 5})
    assert all(plan_of[s].granted == pytest.approx(g) for s, g in wanted.items()) and plan_of["nullish"].granted == 0
    total = sum(tokens.values())
    assert {s for s, r in plan_of.items() if r.short} == {s for s, w in (("b", 3), ("c", 2), ("d", 5), ("none", 1), ("a", 1)) if tokens.get(s, 0) * plan_of[s].max_repeats < w / 12 * total}
    mix = draw_mix(sized, plan).cache()
    for r in mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("n"), F.max("copies").alias("m")).collect():
        assert 0 <= plan_of[r.source].granted - r.n < 17 and r.m <= plan_of[r.source].max_repeats
    report = mix_report(plan, mix).collect()
    assert sum(r.actual_share for r in report) == pytest.approx(1)
    assert sorted(mix.collect()) == sorted(draw_mix(sized.repartition(7), plan).collect())


def test_names_and_documents(spark):
    rows = spark.createDataFrame([(" Trace - Logs ",), ("trace__logs",), ("-",), (" ",), (None,)], "s string")
    assert [r[0] for r in rows.select(source_name("s")).collect()] == ["trace_logs", "trace_logs", "_", None, None]
    documents = spark.createDataFrame([(1, "some words here", "A", 3), (2, None, "a", 3), (3, "", "a", 3), (4, "more words", None, 3), (5, "text text", "b", 3)], "doc_id long, text string, source string, tokens int")
    plan, mix = mix_sources(documents, spark.createDataFrame([("a", 1.0, 5), ("b", 1.0, 5)], TARGETS))
    assert {r.source: r.documents for r in plan.collect()} == {"a": 3, "b": 1}
    assert {r.doc_id for r in mix.collect()} <= {1, 2, 3, 5}
    empty, none = mix_sources(documents.limit(0), spark.createDataFrame([("a", 1.0, 5)], TARGETS))
    assert none.count() == 0 and [r.short for r in empty.collect()] in ([None], [False])
