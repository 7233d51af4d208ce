import os

import pytest

from quillstone.llm.tokens import VOCABULARY, PrefixEncoder, token_counts, token_ids

tokenizers = pytest.importorskip("tokenizers")
JSON = VOCABULARY.replace(".tiktoken", ".json")
TEXTS = [
    "", " ", "hello world", "<|endoftext|> is text", "I'll don't we've", "日本語と中文", "a" * 5000, " " * 300 + "x", "\n\n \t\n a", "naïve café\r\n", "abab" * 700, "é́🎉‍", "x1234567890" * 50,
]


@pytest.fixture(scope="module")
def library():
    made = tokenizers.Tokenizer.from_file(JSON)
    made.encode_special_tokens = True
    return made


def test_encoder_equals_the_library(library):
    with open(VOCABULARY, "rb") as f:
        encoder = PrefixEncoder(f.read())
    assert [list(encoder.encode(t)) for t in TEXTS] == [e.ids for e in library.encode_batch(TEXTS, add_special_tokens=False)]
    assert list(encoder.encode(None)) == []


def test_frames(spark, library):
    rows = spark.createDataFrame([(i, t, "keep", [1]) for i, t in enumerate([*TEXTS, None])], "doc_id long, text string, _text string, ids array<int>")
    got = {r.doc_id: (r.ids, r["_text"]) for r in token_ids(rows).collect()}
    assert got == {i: (library.encode(t, add_special_tokens=False).ids if t else [], "keep") for i, t in enumerate([*TEXTS, None])}
    counts = {r.doc_id: r.tokens for r in token_counts(rows.select("doc_id", "text")).collect()}
    assert counts == {i: len(ids) for i, (ids, _) in got.items()}
    assert token_ids(rows.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no test tables")
def test_documents(spark, library):
    rows = token_ids(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")).collect()
    assert all(r.ids == (library.encode(r.text, add_special_tokens=False).ids if r.text else []) for r in rows)
