import io
import json
import zipfile

from quillstone.schema import RECORD
from quillstone.sources import docx, records
from quillstone.streaming.overlay import upsert_stream

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def paragraph(text, style=""):
    props = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{props}<w:r><w:t>{text}</w:t></w:r></w:p>"


def test_record_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"doc_id": "x", "spec_no": "23501", "clause_id": "1", "odd": 1}\n\n{"doc_id": "y", "doc_type": "table_doc", "row_cells": ["a"]}\n')
    rows = records.read_records(spark, str(tmp_path / "a.jsonl"))
    assert rows.columns == RECORD.names and rows.count() == 2
    x = rows.filter("doc_id = 'x'").first()
    assert (x.doc_type, x.text, x.keywords, x.row_index, x.retrieval_weight) == ("clause_doc", "", [], -1, 1.0)
    assert records.read_clauses(spark, str(tmp_path / "a.jsonl")).count() == 1
    records.write_records(rows, str(tmp_path / "out"), by_release=False)
    assert records.read_records(spark, str(tmp_path / "out")).exceptAll(rows).count() == 0
    (tmp_path / "stop.txt").write_text("# note\n\n General  Terms \ngeneral terms\n")
    assert [r.keyword for r in records.read_exclusions(spark, str(tmp_path / "stop.txt")).collect()] == ["general terms"]


def test_word_documents(spark, tmp_path):
    cell = lambda t: f"<w:tc>{paragraph(t)}</w:tc>"
    body = "".join(
        [
            paragraph("Cover"), paragraph("1 Scope", "Heading1"), paragraph("Text."), paragraph("Text."), paragraph("1.1 Parts", "Heading2"),
            f"<w:tbl><w:tr>{cell('A')}{cell('B')}</w:tr><w:tr>{cell('')}{cell('')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>",
            paragraph("More", "Heading2"), paragraph("Body"), paragraph("2 End", "Heading1"), paragraph("Annex A (normative) Change history", "Heading1"), paragraph("gone"),
        ]
    )
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "23501-h10.docx").write_bytes(data.getvalue())
    (tmp_path / "old.doc").write_bytes(bytes.fromhex("D0CF11E0A1B11AE1") + b"x")
    (tmp_path / "bad.docx").write_bytes(b"PK\x03\x04 broken")
    files = docx.word_files(spark, str(tmp_path))
    assert {r.kind for r in files.collect()} == {"doc", "docx"}
    blocks = docx.read_blocks(files)
    assert blocks.filter("kind = 'error'").count() == 1
    rows = {r.clause_id: r for r in docx.clauses_of(blocks).collect()}
    assert set(rows) == {"1", "1.1", "1.2", "2"}
    assert rows["1"].text == "Text." and rows["1.2"].clause_title == "More" and rows["1.2"].parent_clause_id == "1"
    assert rows["1.1"].clause_path == ["1", "1.1"] and rows["1.1"].tables == [[["A", "B"], ["1", "2"]]]


def document(body, core=""):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        if core:
            z.writestr("docProps/core.xml", f'<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/">{core}</cp:coreProperties>')
    return data.getvalue()


def test_headings_without_number_and_archives(spark, tmp_path):
    body = "".join(paragraph(*x) for x in [
        ("4 Procedures 9", "TOC1"), ("4.1 Setup 10", "TOC2"), ("4.3 Special 12", "TOC2"), ("Lost before", "Heading2"), ("4 Procedures", "Heading1"), ("Setup", "Heading2"), (".1 Deep", "Heading3"),
        ("After setup", "Heading2"), ("Special", "Heading2"), ("Text of special",), ("Unknown", "Heading1"), ("Annex B (informative) More", "Heading1"), ("5 Last", "Heading1"),
    ])
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        z.writestr("in/23502-h00.docx", document(body))
        z.writestr("../evil.docx", document(body))
        z.writestr("note.txt", "x")
    (tmp_path / "broken.zip").write_bytes(b"PK no archive")
    files = docx.archived_files(spark, str(tmp_path))
    assert [r.path.rpartition("!")[2] for r in files.collect()] == ["/in/23502-h00.docx"]
    rows = [(r.clause_id, r.clause_title, r.parent_clause_id) for r in docx.clauses_of(docx.read_blocks(files)).orderBy("order_in_source").collect()]
    assert rows == [("4", "Procedures", ""), ("4.1", "Setup", "4"), ("4.1.1", "Deep", "4.1"), ("4.2", "After setup", "4"), ("4.3", "Special", "4"), ("heading_6", "Unknown", ""), ("5", "Last", "")]


def test_tables_of_uneven_rows():
    cell = lambda t, span=1, below="": f'<w:tc><w:tcPr><w:gridSpan w:val="{span}"/>{below}</w:tcPr>{paragraph(t)}</w:tc>'
    rows = [cell("A") + cell("B") + cell("C"), cell("wide", 2) + cell("x") + cell(""), cell("only"), cell("1") + cell("2") + cell("3")]
    table = f"<w:tbl><w:tblGrid><w:gridCol/><w:gridCol/><w:gridCol/></w:tblGrid>{''.join(f'<w:tr>{r}</w:tr>' for r in rows)}</w:tbl>"
    [(_, _, _, _, matrix)] = docx.blocks_of(document(table))
    assert matrix == [["A", "B", "C"], ["wide", "x", ""], ["only", "", ""], ["1", "2", "3"]]


def test_spec_titles(spark, tmp_path):
    cell = lambda t: f"<w:tc>{paragraph(t)}</w:tc>"
    cover = f"<w:tbl><w:tr>{cell('')}</w:tr><w:tr>{cell('3rd Generation Partnership Project; Technical Specification Group Services and System Aspects; Mesh broker; Stage 2')}</w:tr></w:tbl>"
    subject = lambda t: f"<dc:subject>{t}</dc:subject>"
    made = {
        "a": document(paragraph("x"), subject("Routing tokens")), "b": document(paragraph("x") + cover, subject("Title 1 here")), "c": document(paragraph("Contents") + paragraph("First line")),
        "d": document(paragraph("x"), "<dc:title>3GPP TS 23.501</dc:title>"), "e": document("", "<dc:title>A title</dc:title>"), "f": document(paragraph("Foreword")),
    }
    for name, data in made.items():
        (tmp_path / f"{name}.docx").write_bytes(data)
    got = {r.path[-6]: r.spec_title for r in docx.spec_titles(docx.read_blocks(docx.word_files(spark, str(tmp_path)))).collect()}
    assert got == {"a": "Routing tokens", "b": "Mesh broker; Stage 2", "c": "First line", "d": "x", "e": "A title", "f": ""}


def test_stream_overlay(spark, tmp_path):
    files = tmp_path / "in"
    files.mkdir()
    shape = spark.createDataFrame([], "doc_id string, version int, text string").schema
    run = lambda: upsert_stream(str(files), shape, str(tmp_path / "t"), str(tmp_path / "c"), ["doc_id"], ["version"], 4).awaitTermination()
    (files / "1.json").write_text("\n".join(json.dumps({"doc_id": f"d{i}", "version": 1, "text": "old"}) for i in range(20)))
    run()
    (files / "2.json").write_text(json.dumps({"doc_id": "d3", "version": 2, "text": "new"}) + "\n" + json.dumps({"doc_id": "d4", "version": 0, "text": "late"}))
    run()
    rows = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    assert len(rows) == 20 and rows["d3"] == "new" and rows["d4"] == "old"
