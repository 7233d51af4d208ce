import random

import pytest

from quillstone.operators import hierarchy as contraction
from quillstone.operators import trees
from quillstone.operators.hierarchy import descendants, hierarchy

SHAPE = "doc string, clause string, parent string, path string, depth int, node long, fate string"


def tree(spark, edges, doc="d", sizes=False):
    rows = [(doc, c, p, "clash", 9, 1, "clash") for c, p in edges]
    return hierarchy(spark.createDataFrame(rows, SHAPE), ["doc"], sizes=sizes)


def brute(edges):
    up = dict(edges)
    out = {}
    for c in up:
        path, seen = [c], {c}
        while (p := up[path[0]]) is not None:
            if p not in up:
                out[c] = ("broken", path)
                break
            if p in seen:
                out[c] = ("cycle" if p == c else "below_cycle", None)
                break
            path, seen = [p, *path], seen | {p}
        else:
            out[c] = ("ok", path)
    # An ancestor ring that does not contain c.
    for c in up:
        if out[c][0] == "below_cycle":
            walk, at = set(), up[c]
            while at is not None and at in up and at not in walk:
                walk.add(at)
                at = up[at]
            out[c] = ("cycle", None) if c in walk else ("below_cycle", None)
    return out


@pytest.fixture(params=[0, 40])
def finish(request, monkeypatch):
    """The rounds alone, or some rounds and then one task: the same result. The other tests take one round and one task."""
    monkeypatch.setattr(contraction, "FINISH", request.param)


def check(spark, edges):
    rows = tree(spark, edges, sizes=True).collect()
    wanted = brute(edges)
    assert {r.clause: (r.state, r.path) for r in rows} == wanted
    below = dict.fromkeys(wanted, 0)
    for _, path in wanted.values():
        for above in (path or [])[:-1]:
            below[above] += 1
    assert {r.clause: r.descendants for r in rows} == below


def test_rounds_are_deleted(spark, monkeypatch):
    monkeypatch.setattr(contraction, "FINISH", 0)
    from pathlib import Path

    from quillstone.lineage import use_checkpoint_dir

    use_checkpoint_dir(spark)
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = {p for p in folder.rglob("rdd-*")}
    assert tree(spark, [("n0", None), *[(f"n{i}", f"n{i // 2}") for i in range(1, 60)]]).count() == 60
    # The numbered rows, and the nodes with their paths, which the result is read from.
    assert len({p for p in folder.rglob("rdd-*")} - before) <= 2


def test_long_chain_and_rings(spark, finish):
    chain = [("n0", None), *[(f"n{i}", f"n{i - 1}") for i in range(1, 70)]]
    rings = [("a", "c"), ("b", "a"), ("c", "b"), ("self", "self"), ("x", "b"), ("y", "x"), ("z", "self"), ("p", "q"), ("q", "p")]
    lost = [("l1", "absent"), ("l2", "l1"), ("l3", "l2")]
    check(spark, chain + rings + lost)


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, seed, finish):
    rng = random.Random(seed)
    names = [f"c{i}" for i in range(150)]
    check(spark, [(n, rng.choice([None, "absent", *names, *names[: i or 1], *names[: i or 1]])) for i, n in enumerate(names)])


def test_star_and_counts(spark):
    rows = tree(spark, [("r", None), *[(f"k{i}", "r") for i in range(300)], ("g", "k0")], sizes=True)
    counts = {r.clause: r.descendants for r in rows.collect()}
    assert counts["r"] == 301 and counts["k0"] == 1 and counts["g"] == 0
    pairs = {(r.ancestor, r.descendant, r.distance) for r in descendants(rows, ["doc"]).filter("descendant = 'g'").collect()}
    assert pairs == {("r", "g", 2), ("k0", "g", 1)}


def test_scopes_and_empty(spark):
    rows = spark.createDataFrame([("d", "1", None), ("d", "1.1", "1"), ("e", "1.1", "1"), (None, "1", None), (None, "1.1", "1")], "doc string, clause string, parent string")
    got = {(r.doc, r.clause): (r.state, r.depth) for r in hierarchy(rows, ["doc"]).collect()}
    assert got == {("d", "1"): ("ok", 0), ("d", "1.1"): ("ok", 1), ("e", "1.1"): ("broken", 0), (None, "1"): ("ok", 0), (None, "1.1"): ("ok", 1)}
    assert hierarchy(rows.limit(0), ["doc"]).count() == 0


def test_navigation(spark):
    shape = "doc string, clause string, parent string, clause_path array<string>, order_in_source int, clause_title string"
    rows = spark.createDataFrame(
        [("d", "1", None, ["1"], 1, "Alpha"), ("d", "1.10", "1", ["1", "1.10"], 3, "x"), ("d", "1.2", "1", ["1", "1.2"], 2, "Beta"), ("d", "2.1.1", "2.1", ["2", "2.1", "2.1.1"], 9, "y")], shape
    )
    lost = {r.clause: (r.parent, r.depth, r.order_in_source) for r in trees.missing_ancestors(rows, ["doc"]).collect()}
    assert lost == {"2": (None, 0, 7), "2.1": ("2", 1, 8)}
    assert [r.clause for r in rows.filter("parent = '1'").orderBy(trees.natural_key("clause")).collect()] == ["1.2", "1.10"]
    full = hierarchy(rows, ["doc"])
    assert {r.clause for r in trees.subtree(full, "1").collect()} == {"1", "1.2", "1.10"}
    assert {r.clause for r in trees.branches_matching(full, ["doc"], full.clause_title == "Beta").collect()} == {"1", "1.2"}
    assert trees.children(rows, ["doc"]).filter("parent = '1'").first()["names"] == "1.2|1.10"
