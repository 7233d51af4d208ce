import pytest
from pyspark.sql import functions as F

from quillstone.functions import arrays, extract, text
from quillstone.functions.embeddings import hash_embedding


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("f", "given", "wanted"),
    [
        (text.collapse, " a \n b ", "a b"),
        (text.strip_white, " \t x  ", "x"),
        (text.fingerprint, "A b\tC", "abc"),
        (text.anchor_term, "pduSession_setup/Request", "pdu Session setup Request"),
        (text.hint_term, " (N1N2 Transfer). ", "n1n2 transfer"),
        (text.preview, "x" * 200, "x" * 179 + "..."),
        (text.file_stem, 'a<b>: "c".', "ab_c"),
        (text.file_stem, "...", "clause-export"),
        (text.spec_number, "3GPP TS 49.628", "49628"),
        (text.spec_number, "123456", None),
        (text.clause_number, "subclause 4.2a.1.", "4.2a.1"),
        (text.clause_number, "(B.1.3)", "B.1.3"),
        (text.clause_number, "12", None),
        (text.without_repeated_brackets, "a [PDU Session request] b [PDU Session request]", "a [PDU Session request] b"),
        (text.without_repeated_brackets, "[] []", "[]"),
        (text.cell_text, "PDU Session Establishment Request [PDU Session Establishment Request]", "PDU Session Establishment Request"),
        (text.cell_text, "Note A; Note A; Note B", "Note A; Note B"),
        (text.stage_bucket, "Stage 2", "stage2"),
        (text.stage_bucket, None, "else"),
        (text.content_kind, "table_row_doc", "table_row"),
        (text.url_quoted, "a b:c", "a%20b%3Ac"),
    ],
)
def test_text(spark, f, given, wanted):
    assert one(spark, f("x"), x=given) == wanted


def test_null_stays_null(spark):
    for f in (text.collapse, text.strip_white, text.filled, text.spec_number, text.clause_number, text.anchor_term, text.preview, text.cell_text):
        assert one(spark, f("x"), x=None) is None


def test_packing(spark):
    assert len(one(spark, text.packed_paragraphs("x"), x="A" * 7000 + "\n\n" + "B" * 6990)) == 2
    assert one(spark, text.packed_paragraphs("x", 10), x="aaa\n\n\nbbb\n\ncccccccccccc") == ["aaa\n\nbbb", "cccccccccccc"]
    assert one(spark, text.chunks("x", 4, 2), x=" abcdefghij ") == ["abcd", "efgh"]


def test_stage_filter(spark):
    assert one(spark, text.stage_filter("x"), x="stage2") == "Stage 2"
    with pytest.raises(Exception, match="unknown stage"):
        one(spark, text.stage_filter("x"), x="stage9")


def test_arrays(spark):
    assert one(spark, arrays.distinct_cells("x"), x=["A", "A", "B", "B", "B"]) == ["A", "B"]
    assert one(spark, arrays.distinct_cells("x"), x=["A", "B", "A", None, " "]) == ["A", "B"]
    assert one(spark, arrays.distinct_terms("x"), x=["the Foo", "foo", None, "Bar"]) == ["Foo", "Bar"]
    assert one(spark, arrays.distinct_terms("x"), x=[]) == []
    pairs = one(spark, arrays.row_pairs("h", "c"), h=["Message", "Message", "Direction"], c=["Foo request", "Foo request", "UE to CN"])
    assert [tuple(p) for p in pairs] == [("Message", "Foo request"), ("Direction", "UE to CN")]
    assert one(spark, arrays.row_header("c"), c=["A", "A"]) == ""
    assert one(spark, arrays.row_header("c"), c=["A", "B"]) == "A"


def test_table_markdown(spark):
    row = spark.createDataFrame([([["a", "b"], ["c"]],)], "m array<array<string>>").select(arrays.table_markdown("m").alias("v")).first()
    assert row["v"] == "| a | b |\n| --- | --- |\n| c |  |"


def test_extraction(spark):
    assert one(spark, extract.message_names("x"), x="The PDU Session Setup Request message") == ["The PDU Session Setup Request", "The PDU Session Setup Request message"]
    assert one(spark, extract.query_aliases("x"), x="N1N2 message transfer") == ["N1N2", "N1N2Message", "N1N2MessageTransfer"]
    anchors = one(spark, extract.query_anchors("x"), x="End to End Redundant Paths")
    assert anchors[0] == "End to End Redundant Paths"
    assert one(spark, extract.query_tokens("x"), x="End to End Redundant Paths") == ["Redundant"]
    assert one(spark, extract.spec_spellings("x"), x="23501") == ["23501", "23.501", "TS 23.501"]
    assert one(spark, extract.query_variants("x"), x="N1N2 message transfer") == ["n1 n2 message transfer", "n1n2 message transfer"]
    assert one(spark, extract.clause_references("x"), x="see 5.2.1 and 5.2.1, 7") == ["5.2.1"]
    assert one(spark, extract.heading("x")["clause"], x="Annex A (normative) Codes") == "Annex A"
    assert one(spark, extract.relative_heading("x")["clause"], x=".3 Title") == "3"
    assert one(spark, extract.style_level("x"), x="heading 2") == 2
    assert one(spark, extract.clause_target("x", F.lit(""))["spec"], x="5.2.1 of TS 23.501") == "23501"
    assert one(spark, extract.is_caption("x"), x="Table 5.1-2: Values")


def test_hash_embedding():
    v = hash_embedding("alpha beta")
    assert len(v) == 16 and abs(sum(x * x for x in v) - 1) < 1e-4
    assert hash_embedding("alpha beta") == v and hash_embedding("") == [0.0] * 16 == hash_embedding(None)


def test_chunks_leave_nothing_out(spark):
    long = "".join(chr(97 + i % 26) for i in range(9001))
    got = spark.createDataFrame([(long,)], "t string").select(text.chunks("t").alias("all"), text.chunks("t", most=3).alias("few")).first()
    assert "".join(got["all"]) == long and len(got["all"]) == 5 and got["few"] == got["all"][:3]
