import random
import time

import pytest

from quillstone.llm.split import cuts, oversized, pieces, split_oversized

CLAUSES = (
    "row_id long, doc_id string, spec_no string, release string, release_data string, clause_id string, parent_clause_id string, text string, "
    "blocks array<struct<block_kind:string,block_text:string,table_rows:array<array<string>>>>, ingested_at timestamp, item_no int, piece string"
)


@pytest.mark.parametrize("seed", range(5))
def test_pieces_keep_limits_and_join(seed):
    rng = random.Random(seed)
    for _ in range(40):
        parts = ["word ", "Sentence. ", "\n", "\n\n", "x" * rng.randint(1, 300), "é。"]
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 900)))
        spans = cuts(text, 400, 40)
        assert all(e - s <= 400 for s, e in spans)
        assert "".join(text[s + (40 if i else 0) : e] for i, (s, e) in enumerate(spans)) == text
        assert all(a[1] - b[0] == 40 for a, b in zip(spans, spans[1:], strict=False))


def test_boundaries():
    text = ("A" * 90 + ". ") * 40
    assert all(text[:e].endswith(". ") for _, e in cuts(text, 1000, 100)[:-1])
    paragraphs = "\n\n".join("word " * 60 for _ in range(20))
    assert all(paragraphs[:e].endswith("\n\n") for _, e in cuts(paragraphs, 1000, 100)[:-1])
    assert cuts("", 10, 2) == [] and cuts("x" * 10, 10, 2) == [(0, 10)] and len(cuts("x" * 11, 10, 2)) == 2
    assert len(cuts("y" * 10_000_0, 4000, 200)) == 27
    with pytest.raises(ValueError):
        cuts("x" * 50, 10, 5)


def test_few_pieces_in_linear_time():
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoin") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    text = " ".join(rng.choice(words) + rng.choice([",", "", "", "", "", ".", ".\n", ""]) for _ in range(340_000))
    took = {}
    for size in (500_000, 2_000_000):
        began = time.perf_counter()
        spans = cuts(text[:size])
        took[size] = time.perf_counter() - began
        # Where the least number leaves no room for a boundary, a piece is added.
        assert len(spans) <= 1.02 * (1 + -(-(size - 4000) // 3800))
        assert all(text[e - 1] in " \n" for _, e in spans[:-1])
    assert took[2_000_000] < 12 * took[500_000] + 0.2


def clause(i, name, text, blocks=None, spec="23501"):
    return (i, f"d{name}", spec, "Rel-1", "2020-01", name, None, text, blocks, None, 3, "clash")


def test_items(spark):
    table = ("table", None, [["a" * 2500, None], None, ["b" * 1600, "c"]])
    rows = [
        clause(1, "1", "x" * 4000, [("paragraph", "y" * 4001, None), None, table, ("image", "z" * 9000, None), ("table", None, None)]),
        clause(2, "2", "é" * 4001), clause(3, "2 ", "short"),  # the newer row of clause 2
        clause(4, "3", None, []), clause(5, "4", ""), clause(6, None, "x" * 9000), clause(7, "5", "x" * 9000, spec=" "), clause(8, "6", "x" * 4001),
    ]
    frame = spark.createDataFrame(rows, CLAUSES)
    assert {(r.doc_id, r.item_no) for r in oversized(frame).collect()} == {("d1", 0), ("d1", 2), ("d6", -1)}
    got = split_oversized(frame).collect()
    assert {(r.doc_id, r.item_no) for r in got if r.piece_no == 0} == {("d1", 0), ("d1", 2), ("d6", -1)}
    assert all(len(r.piece) <= 4000 for r in got)
    assert split_oversized(frame.limit(0)).count() == 0


def test_pieces_of_null_items(spark):
    assert pieces(spark.createDataFrame([(1, None), (2, "")], "k int, item string")).count() == 0
