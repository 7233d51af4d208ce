"""Word documents as ordered blocks, and blocks as clauses.

A file is one row of the binaryFile source; its blocks are parsed within the task that reads it. Clauses are then cut
per document: a document is one file, so its blocks are bounded by what the reader took in.
"""

from __future__ import annotations

import io
import zipfile
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions.extract import heading, is_excluded_clause, is_heading, relative_heading, style_level
from quillstone.functions.text import collapse

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BLOCKS = "path string, pos int, kind string, style string, level int, text string, matrix array<array<string>>"


def word_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content and kind (docx, doc or other by their first bytes) of the Word files below a folder, each path once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{doc,docx}").load(path)
    head = F.hex(F.substring("content", 1, 8))
    kind = F.when(head == "D0CF11E0A1B11AE1", "doc").when(F.startswith(head, F.lit("504B0304")), "docx").otherwise("other")
    return files.select("path", "content", kind.alias("kind")).dropDuplicates(["path"])


def archived_files(spark: SparkSession, path: str) -> DataFrame:
    """``word_files`` of the Word documents within the zip archives below a folder, with paths 'archive!/member'.

    Members whose paths lead out of the archive are left out; a broken archive has none. An archive is unpacked in the
    task that reads it, a member at a time.
    """
    archives = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(path)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as archive:
                        for member in archive.namelist():
                            if member.lower().endswith(".docx") and not member.startswith("/") and ".." not in member:
                                yield pd.DataFrame({"path": [f"{name}!/{member}"], "content": [archive.read(member)], "kind": ["docx"]})
                except zipfile.BadZipFile:
                    continue

    return archives.select("path", "content").mapInPandas(unpack, "path string, content binary, kind string")


def _text(node: ElementTree.Element) -> str:
    parts = {f"{_W}t": lambda n: n.text or "", f"{_W}tab": lambda n: "\t", f"{_W}br": lambda n: "\n"}
    return "".join(parts[n.tag](n) for n in node.iter() if n.tag in parts)


def _matrix(table: ElementTree.Element) -> list[list[str]]:
    """Cells by row, without empty rows.

    Where all rows are as wide as the table's grid, a merged cell stands once, at its start, followed by '' for what it
    spans. Otherwise rows are brought to the width that most rows have: repeats of the cell before are dropped, as merged
    cells give them, then empty cells at the end, and short rows are filled up.
    """
    rows: list[list[tuple[str, int, bool]]] = []
    for row in table.iter(f"{_W}tr"):
        cells = []
        for cell in row.findall(f"{_W}tc"):
            props = cell.find(f"{_W}tcPr")
            span = props.find(f"{_W}gridSpan") if props is not None else None
            merge = props.find(f"{_W}vMerge") if props is not None else None
            below = merge is not None and merge.get(f"{_W}val", "continue") == "continue"
            text = " ".join(" ".join(_text(p) for p in cell.findall(f"{_W}p")).split())
            cells.append((text, max(1, int(span.get(f"{_W}val", "1"))) if span is not None else 1, below))
        if cells:
            rows.append(cells)
    widths = Counter(sum(n for _, n, _ in cells) for cells in rows)
    grid = table.find(f"{_W}tblGrid")
    columns = len(grid.findall(f"{_W}gridCol")) if grid is not None else None
    if len(widths) <= 1 and columns in (None, *widths):
        out = [[x for text, n, below in cells for x in ("" if below else text, *[""] * (n - 1))] for cells in rows]
        return [cells for cells in out if any(cells)]
    width, out, above = widths.most_common(1)[0][0], [], []
    for cells in rows:
        slots = [x for text, n, below in cells for x in [(text, below)] * n]
        whole = [above[i] if below and i < len(above) else text for i, (text, below) in enumerate(slots)]
        above = whole
        mark = lambda v: "".join(v.lower().split())
        kept = [v for i, v in enumerate(whole) if not i or mark(v) != mark(whole[i - 1])]
        while len(kept) > width and not kept[-1]:
            kept.pop()
        if any(kept):
            out.append([*kept, *[""] * (width - len(kept))][:width])
    return out


def blocks_of(content: bytes) -> list[tuple[str, str, int | None, str, list[list[str]]]]:
    """(kind, style, level, text, matrix) of the subject and title of a document, and of the paragraphs and tables of its body, in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as docx:
        body = ElementTree.fromstring(docx.read("word/document.xml")).find(f"{_W}body")
        core = ElementTree.fromstring(docx.read("docProps/core.xml")) if "docProps/core.xml" in docx.namelist() else None
    out = []
    for kind in ("subject", "title"):
        node = core.find(f"{{http://purl.org/dc/elements/1.1/}}{kind}") if core is not None else None
        if node is not None and (node.text or "").strip():
            out.append((kind, "", None, node.text, []))
    for node in body if body is not None else []:
        if node.tag == f"{_W}tbl":
            out.append(("table", "", None, "", _matrix(node)))
        elif node.tag == f"{_W}p":
            style, outline = node.find(f"{_W}pPr/{_W}pStyle"), node.find(f"{_W}pPr/{_W}outlineLvl")
            level = int(outline.get(f"{_W}val")) + 1 if outline is not None else None
            out.append(("paragraph", style.get(f"{_W}val", "") if style is not None else "", level, _text(node), []))
    return out


def read_blocks(files: DataFrame) -> DataFrame:
    """The blocks of every readable document; a broken file has one block of kind 'error' that says why."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [(path, i, *b) for i, b in enumerate(blocks_of(bytes(content)))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError) as e:
                    rows.append((path, 0, "error", "", None, f"{type(e).__name__}: {e}", []))
            frame = pd.DataFrame(rows, columns=["path", "pos", "kind", "style", "level", "text", "matrix"])
            yield frame.astype({"level": "Int32"})

    return files.filter("kind = 'docx'").select("path", "content").mapInPandas(parse, BLOCKS)


_CLAUSES = "path string, clause_id string, clause_title string, parent_clause_id string, clause_path array<string>, order_in_source int, level int, text string, tables array<array<array<string>>>"


class _Outline:
    """The open clauses of a document, and the numbers of headings that lack one."""

    def __init__(self, contents: list[tuple[str, str]]) -> None:
        self.open: list[tuple[int, str, str]] = []  # level, number, number of the clause above
        self.contents = [(1 if n.startswith("Annex ") else n.count(".") + 1, n, n.rpartition(".")[0], title) for n, title in contents]
        self.headings = 0

    def _above(self, level: int) -> str | None:
        return next((number for at, number, _ in reversed(self.open) if at < level), None)

    def number(self, title: str, level: int, relative: str | None, relative_title: str | None) -> tuple[str, str] | None:
        """The number and title of a heading without number: relative to the clause above, as the contents table has it, or the one after its sibling."""
        above = self._above(level)
        if relative is not None and level > 1 and above is not None:
            return f"{above}.{relative}", relative_title or ""
        listed = [(n, up) for at, n, up, name in self.contents if at == level and name == title]
        below = [x for x in listed if above and x[1] == above] or listed
        if len(below) == 1:
            return below[0][0], title
        sibling = next(((number, up) for at, number, up in reversed(self.open) if at == level), None)
        if level > 1 and above is not None and sibling and sibling[1] == above and sibling[0].rpartition(".")[2].isdigit():
            return f"{above}.{int(sibling[0].rpartition('.')[2]) + 1}", title
        return None

    def enter(self, number: str, level: int) -> list[str]:
        """Open a clause; the numbers of those above it."""
        while self.open and (self.open[-1][0] >= level or (number[:1].isdigit() and self.open[-1][1].startswith("Annex "))):
            self.open.pop()
        path = [n for _, n, _ in self.open]
        self.open.append((level, number, path[-1] if path else ""))
        return path


def _segment(blocks: pd.DataFrame) -> pd.DataFrame:
    """The clauses of one document: a heading opens a clause below the nearest open one of a lower level.

    Text before the first numbered heading is left out. A heading whose number cannot be told is named by its place among
    the headings.
    """
    rows: list[dict] = []
    blocks = blocks.sort_values("pos")
    outline = _Outline([(b.number, b.title) for b in blocks[blocks["contents"]].itertuples() if b.number is not None])
    for b in blocks[~blocks["contents"]].itertuples():
        if b.is_heading:
            level = int(b.heading_level) if not pd.isna(b.heading_level) else 1
            found = (b.number, b.title) if b.number is not None else outline.number(b.text, level, b.relative, b.relative_title)
            if found is None and not rows:
                continue
            outline.headings += 1
            if found is not None:
                level = 1 if found[0].startswith("Annex ") else found[0].count(".") + 1
            number, title = found or (f"heading_{outline.headings}", b.text)
            path = outline.enter(number, level)
            rows.append({"path": b.path, "clause_id": number, "clause_title": title, "parent_clause_id": path[-1] if path else "", "clause_path": [*path, number],
                         "order_in_source": len(rows), "level": level, "text": [], "tables": []})
        elif rows and b.kind == "table":
            rows[-1]["tables"].append([list(r) for r in b.matrix])
        elif rows and b.text and (not rows[-1]["text"] or rows[-1]["text"][-1] != b.text):
            rows[-1]["text"].append(b.text)
    for r in rows:
        r["text"] = "\n".join(r["text"])
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _CLAUSES.split(", ")])


def clauses_of(blocks: DataFrame) -> DataFrame:
    """Clauses with path, parent, order, text and tables, in the order of each document; text before the first heading and excluded clauses are left out.

    Headings without number take it from the clause above them (.2 Title), from the contents table, or from their sibling.
    """
    line = collapse("text")
    contents = F.startswith(F.lower("style"), F.lit("toc"))
    # In a contents table the page follows the title.
    told = F.when(contents, F.regexp_replace(line, r"^(.*\S)\s+\d+$", "$1")).otherwise(line)
    found, relative = heading(told), relative_heading(line)
    # A style tells a heading before the outline level does.
    level = F.coalesce(style_level("style"), "level")
    marked = blocks.filter("kind in ('paragraph', 'table')").select(
        "path", "pos", "kind", "matrix", line.alias("text"), contents.alias("contents"),
        ((F.col("kind") == "paragraph") & (line != "") & F.coalesce(is_heading("text", "style", F.col("level")) | style_level("style").isNotNull(), F.lit(False))).alias("is_heading"),
        level.alias("heading_level"), found["clause"].alias("number"), F.coalesce(found["title"], line).alias("title"), relative["clause"].alias("relative"), relative["title"].alias("relative_title"),
    )
    return marked.groupBy("path").applyInPandas(_segment, _CLAUSES).filter(~is_excluded_clause("clause_id", "clause_title"))


# What is no title of a specification, and what a cover puts before one.
NO_TITLES = [
    "this technical specification has been produced by the 3rd generation partnership project",
    "the present document has been developed within the 3rd generation partnership project",
    "the contents of the present document are subject to continuing work within the tsg",
]
PLACEHOLDERS = ["<title", "title 1", "title 2"]
COVER_MARK = "3rd generation partnership project"
COVER_PREFIXES = ["3rd Generation Partnership Project;", "Technical Specification Group Services and System Aspects;"]
FRONT_LINES = ["contents", "table of contents", "foreword"]


def _cover_title(text: Column) -> Column:
    """The title in a cover row: without prefixes, its parts after semicolons; the last two where the last names a stage or release."""
    rest = text
    for prefix in COVER_PREFIXES:
        rest = F.when(F.startswith(rest, F.lit(prefix)), F.trim(F.substring(rest, F.lit(len(prefix) + 1), F.length(rest)))).otherwise(rest)
    parts = F.filter(F.transform(F.split(rest, ";"), lambda v: F.trim(v)), lambda v: v != "")
    last = F.lower(F.coalesce(F.get(parts, F.size(parts) - 1), F.lit("")))
    short = F.contains(last, F.lit("stage")) | F.contains(last, F.lit("release"))
    kept = F.when(short, F.slice(parts, F.size(parts) - 1, F.lit(2))).otherwise(parts)
    return F.when(F.size(parts) >= 2, F.array_join(kept, "; ")).otherwise(F.coalesce(F.nullif(rest, F.lit("")), text))


def spec_titles(blocks: DataFrame) -> DataFrame:
    """path and title of each document: its subject, its cover, its title, or its first line that may be one; '' if there is none."""
    line = collapse("text")
    holds = lambda x, words: reduce(Column.__or__, [F.contains(F.lower(x), F.lit(w)) for w in words])
    first_table = F.min(F.when(F.col("kind") == "table", F.col("pos"))).over(Window.partitionBy("path"))
    cells = F.transform("matrix", lambda r: F.coalesce(F.get(F.filter(F.transform(r, collapse), lambda v: v != ""), F.lit(0)), F.lit("")))
    cover = F.get(F.filter(cells, lambda v: F.contains(F.lower(v), F.lit(COVER_MARK)) & ~holds(v, NO_TITLES)), F.lit(0))
    rows = blocks.filter("kind <> 'error'").withColumn("line", line).withColumn("first_table", first_table)
    ranked = rows.select(
        "path", "pos",
        F.when((F.col("kind") == "subject") & ~holds("line", NO_TITLES + PLACEHOLDERS), F.struct(F.lit(0).alias("rank"), "pos", F.col("line").alias("title")))
        .when((F.col("pos") == F.col("first_table")) & cover.isNotNull(), F.struct(F.lit(1).alias("rank"), "pos", _cover_title(cover).alias("title")))
        .when((F.col("kind") == "title") & ~F.col("line").rlike(r"^3GPP\s+(?:TS|TR)\s+\d{2}\.\d{3}$"), F.struct(F.lit(2).alias("rank"), "pos", F.col("line").alias("title")))
        .when(
            (F.col("kind") == "paragraph") & (F.col("line") != "") & ~F.startswith(F.lower("style"), F.lit("toc")) & (F.col("style") != "TT")
            & ~F.lower("line").isin(FRONT_LINES) & ~holds("line", NO_TITLES),
            F.struct(F.lit(3).alias("rank"), "pos", F.col("line").alias("title")),
        ).alias("t"),
    )
    return ranked.groupBy("path").agg(F.coalesce(F.min("t")["title"], F.lit("")).alias("spec_title"))
