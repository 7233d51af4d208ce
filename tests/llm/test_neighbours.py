import numpy as np
import pytest

from quillstone.llm import neighbours
from quillstone.llm.neighbours import most_similar, similar_pairs

RECORDS = "row_id long, doc_id string, dense_vector array<float>, indexed_at timestamp, embedding_dim int, unit string, rank int"


def frame(spark, vectors, start=0):
    rows = [(start + i, f"d{i:05d}", None if v is None else [None if x is None else float(x) for x in v], None, 3, "clash", 1) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, RECORDS)


def clustered(n, rng, centres=12):
    c = rng.normal(size=(centres, 64))
    return c[rng.integers(centres, size=n)] + 0.6 * rng.normal(size=(n, 64))


def test_recall_and_heap(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 700)
    monkeypatch.setattr(neighbours, "QUERIES", 500)
    vectors = clustered(3000, np.random.default_rng(1))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    exact = unit @ unit.T
    np.fill_diagonal(exact, -2)
    best = np.argsort(-exact, axis=1)[:, :5]
    found = {}
    for r in most_similar(frame(spark, vectors * np.random.default_rng(2).uniform(0.01, 50, size=(3000, 1)))).collect():
        found.setdefault(int(r.doc_id[1:]), set()).add(int(r.other_id[1:]))
        assert r.cosine == pytest.approx(exact[int(r.doc_id[1:]), int(r.other_id[1:])], abs=1e-6)
    assert all(len(x) == 5 for x in found.values())
    assert sum(len(found[i] & set(b)) for i, b in enumerate(best.tolist())) / (5 * len(best)) >= 0.94


def test_visits_are_the_nearest_cells():
    rng = np.random.default_rng(3)
    index = neighbours.MultiIndex(rng.normal(size=(7, 32)).astype(np.float32), rng.normal(size=(5, 32)).astype(np.float32))
    index.sizes = rng.integers(0, 9, size=35).tolist()
    query = rng.normal(size=(1, 64)).astype(np.float32)
    sums = (neighbours._distances(query[:, :32], index.first).T + neighbours._distances(query[:, 32:], index.second)).ravel()
    wanted, held = [], 0
    for cell in sums.argsort():
        if held >= 40:
            break
        if index.sizes[cell]:
            wanted.append(int(cell))
            held += index.sizes[cell]
    assert next(index.visits(query, 40))[1] == wanted


def test_unusable_and_equal_vectors(spark):
    one = np.eye(64)
    bad = [None, [], [1.0] * 63, [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63]
    same = [one[0] * s for s in (1, 2, 1e-20, 1e20, 1, 1, 1, 1)]
    rows = frame(spark, [*bad, *same, one[0] + 0.2 * one[1], one[2]])
    got = {}
    for r in most_similar(rows).collect():
        got.setdefault(r.doc_id, []).append((r["rank"], r.other_id))
    members = [f"d{i:05d}" for i in range(7, 15)]
    for m in members:
        assert [o for _, o in sorted(got[m])] == [x for x in members if x != m][:5]
    assert not set(got) & {f"d{i:05d}" for i in range(7)}
    pairs = {tuple(r) for r in similar_pairs(rows).collect()}
    assert ("d00007", "d00008") in pairs and ("d00007", "d00015") in pairs and all(a < b for a, b in pairs)
    assert most_similar(rows.limit(0)).count() == 0 and similar_pairs(rows.limit(7)).count() == 0


def test_dense_region_is_quantised_again(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 200)
    monkeypatch.setattr(neighbours, "HOT", 4)
    rng = np.random.default_rng(4)
    tight = rng.normal(size=64) + 1e-2 * rng.normal(size=(900, 64))
    vectors = np.concatenate([clustered(900, rng), tight])
    got = most_similar(frame(spark, vectors)).groupBy("doc_id").count().collect()
    assert len(got) == 1800 and all(r["count"] == 5 for r in got)


def test_exact_check_near_the_minimum(spark):
    one = np.eye(64)
    at = lambda c: c * one[0] + (1 - c * c) ** 0.5 * one[1]
    rows = frame(spark, [one[0], at(0.9001), one[5], 0.8999 * one[5] + (1 - 0.8999**2) ** 0.5 * one[6]])
    assert {tuple(r) for r in similar_pairs(rows).collect()} == {("d00000", "d00001")}


def test_exact_mode_and_recall(spark):
    vectors = clustered(1500, np.random.default_rng(6))
    rows = frame(spark, vectors)
    exact = {}
    for r in neighbours.exact_similar(rows, neighbours.F.col("row_id") % 10 == 0).collect():
        exact.setdefault(r.query_id, set()).add(r.doc_id)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for q, got in exact.items():
        order = np.argsort(-(unit @ unit[int(q[1:])]))
        assert got == {f"d{i:05d}" for i in order[1:6].tolist()}
    met = [(r.doc_id, r.other_id) for r in most_similar(rows).collect() if r.doc_id in exact]
    assert len(exact) == 150 and sum(o in exact[d] for d, o in met) / 750 >= 0.94


def test_a_cell_larger_than_a_block_is_cut(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    monkeypatch.setattr(neighbours, "HOT", 10**9)
    monkeypatch.setattr(neighbours, "QUERIES", 40)
    vectors = clustered(600, np.random.default_rng(8), centres=1)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    exact = unit @ unit.T
    np.fill_diagonal(exact, -2)
    best = np.argsort(-exact, axis=1)[:, :5]
    met = sum(int(r.other_id[1:]) in best[int(r.doc_id[1:])] for r in most_similar(frame(spark, vectors)).collect())
    assert met / 3000 >= 0.94
