import random
from collections import defaultdict

from quillstone.llm import terms as module
from quillstone.llm.terms import BurstTrie, marked_terms, normal_term, term_counts

HITS = "hit_id long, doc_id string, spec_no string, term string, mark string, occurrences long"


def brute(rows):
    n, docs, specs = defaultdict(int), defaultdict(set), defaultdict(set)
    for _, doc, spec, term, *_ in rows:
        if term is None or len(normal_term(term)) < 3:
            continue
        t = normal_term(term)
        n[t] += 1
        if doc is not None:
            docs[t].add(doc)
        if spec is not None and spec.strip():
            specs[t].add(spec.strip())
    return {t: (n[t], len(docs[t]), len(specs[t])) for t in n}


def got(frame):
    return {r.term: (r.occurrences, r.doc_count, r.spec_count) for r in term_counts(frame).collect()}


def test_trie():
    rng = random.Random(1)
    trie, wanted = BurstTrie(4), defaultdict(lambda: [0, 0])
    for _ in range(3000):
        key = "".join(rng.choice("ab\x00") for _ in range(rng.randint(0, 9)))
        trie.add(key, 1, 2)
        wanted[key][0] += 1
        wanted[key][1] += 2
    found = {p + s: [n, d] for p, ss, ns, ds in trie.containers() for s, n, d in zip(ss, ns, ds, strict=True)}
    assert found == dict(wanted) and trie.entries == len(wanted)


def test_tries_merge_container_by_container():
    rng = random.Random(2)
    whole, wanted = BurstTrie(6), defaultdict(lambda: [0, 0])
    for _ in range(20):
        part = BurstTrie(3)
        for _ in range(300):
            key = "".join(rng.choice("abc\x00") for _ in range(rng.randint(0, 8)))
            part.add(key, 1, 3)
            wanted[key][0] += 1
            wanted[key][1] += 3
        for container in part.containers():
            whole.merge(*container)
    found = [(p + s, [n, d]) for p, ss, ns, ds in whole.containers() for s, n, d in zip(ss, ns, ds, strict=True)]
    assert dict(found) == dict(wanted) and whole.entries == len(wanted) and [k for k, _ in found] == sorted(wanted)


def test_no_subtree_gets_more_than_its_bound(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(module, "ENTRIES", 60)
    monkeypatch.setattr(module, "CONTAINER", 16)
    seen = module._route
    # A skewed vocabulary: most terms share a long prefix.
    rows = [(i, f"d{i % 50}", f"s{i % 3}", ("common prefix " if i % 4 else "x") + str(i % 400), "", 1) for i in range(2000)]
    frame = spark.createDataFrame(rows, HITS)
    assert got(frame) == brute(rows)
    crowded = frozenset({"", "c", "co"})
    assert seen("comm", crowded) == "com" and seen("x", crowded) == "x" and not sizes


def test_counts(spark, monkeypatch):
    monkeypatch.setattr(module, "CONTAINER", 8)
    rng = random.Random(2)
    names = [f"term {i % 97} {'x' * (i % 5)}" for i in range(300)] + ["Ｆｕｌｌ ｗｉｄｔｈ", "full  width", "FULL​ width ", "ab", "", " ", None, "hot term"]
    rows = [(i, rng.choice([None, *[f"d{j}" for j in range(60)]]), rng.choice([None, " ", "1 ", "1", "2"]), rng.choice(names), "clash", 5) for i in range(4000)]
    rows += [(9000 + i, f"h{i % 900}", str(i % 40), "hot term", "clash", 5) for i in range(2000)]
    rows += [(1, "d1", "1", "y" * 20000, "clash", 5)] * 3
    frame = spark.createDataFrame(rows, HITS)
    assert got(frame) == brute(rows)
    assert got(frame.limit(0)) == {}


def test_marks(spark):
    rows = [(i, f"d{i}", "1", "one spec", None, 0) for i in range(3)] + [(i, f"d{i}", str(i), "seldom", None, 0) for i in range(2)]
    rows += [(i, f"d{i}", str(i % 2), "often", None, 0) for i in range(60)] + [(i, f"d{i}", str(i % 2), "useful", None, 0) for i in range(2, 5)] + [(0, f"e{i}", "1", None, None, 0) for i in range(40)]
    marks = {r.term: r.mark for r in marked_terms(spark.createDataFrame(rows, HITS)).collect()}
    assert marks == {"one spec": "local", "seldom": "rare", "often": "common", "useful": None}
