"""Splitting oversized items at natural boundaries, with overlap.

Balanced targets: from where a piece starts, the smallest possible number of pieces for the rest is taken, their ends are
placed at equal distances, and the first of them is moved to the strongest boundary near it that still leaves the rest
within that number. Where no natural boundary does, but one lies nearer, a piece is added. Every piece keeps to the
limit, consecutive pieces share exactly ``overlap`` characters, and the pieces without their overlaps give the item back.
Boundaries are looked for around each target only, so the time is linear in the item.

Null and empty items have no pieces to split and do not come out; an item within the limit is not oversized.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.sources.tables import DOCUMENT, current_clauses

LIMIT, OVERLAP = 4000, 200
#: Boundaries from the strongest to the weakest. A cut comes after the match.
BOUNDARIES = [re.compile(p) for p in (r"\n[^\S\n]*\n\s*", r"\n", r"[.!?;:][)\"'”’]*\s+|[。！？]", r"\s+")]
#: As many of the boundaries as count as natural; the last, a blank between words, only beats a cut within a word.
NATURAL = 3


#: Characters of pieces that are handed on together.
HANDED = 4_000_000


def _nearest(boundary: re.Pattern, text: str, target: float, low: float, high: float) -> int | None:
    """The end of a match nearest to ``target``, from ``low`` to ``high``."""
    low, high = max(1, int(low + 0.999)), min(len(text), int(high))
    if low > high:
        return None
    # A match may begin before the window and, if it is to end in it, reach its end only when seen whole.
    ends = (m.end() for m in boundary.finditer(text, max(0, low - 64), min(len(text), high + 64)))
    return min((e for e in ends if low <= e <= high), key=lambda e: abs(e - target), default=None)


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans of the pieces of ``text``."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half of the limit")
    size, start, step = len(text), 0, limit - overlap
    spans: list[tuple[int, int]] = []
    while size - start > limit:
        left = -(-(size - start - limit) // step)  # pieces after this one, at least
        length = (size - start + left * overlap) / (left + 1)
        target = start + length
        # An end before ``least`` needs a piece more.
        least = size + overlap - (limit + (left - 1) * step)
        first, last = start + overlap + 1, start + limit
        near, far = (target - length / 4, target + length / 4), (target - length / 2, target + length / 2)
        tries = [
            *((b, (max(w[0], least, first), min(w[1], last))) for w in (near, far) for b in BOUNDARIES[:NATURAL]),
            *((b, (max(far[0], first), least)) for b in BOUNDARIES[:NATURAL]),
            *((b, (max(w[0], least, first), min(w[1], last))) for w in (near, far) for b in BOUNDARIES[NATURAL:]),
        ]
        found = (_nearest(b, text, target, *window) for b, window in tries)
        end = next((p for p in found if p is not None), int(target))
        spans.append((start, end))
        start = end - overlap
    return [*spans, (start, size)] if size else []


def _table_size(rows: Column) -> Column:
    cells = F.flatten(F.transform(rows, lambda r: F.coalesce(r, F.array())))
    return F.aggregate(cells, F.lit(0), lambda n, c: n + F.coalesce(F.length(c), F.lit(0)))


def _table_text(rows: Column) -> Column:
    """A row per line, cells parted by tabs."""
    row = lambda r: F.array_join(F.coalesce(r, F.array()), "\t", "")
    return F.array_join(F.transform(rows, row), "\n")


def oversized(clauses: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Items above ``limit`` of the current clause rows: key columns, doc_id, item_no and the whole item as ``item``.

    item_no is -1 for the text, else the position of the block. A paragraph's size is that of its text, a table's the
    sum of its cells; other blocks have none. Only oversized items are shuffled.
    """
    rows = lambda b: F.coalesce(b["table_rows"], F.array())
    block_size = lambda b: F.when(b["block_kind"] == "paragraph", F.length(b["block_text"])).when(b["block_kind"] == "table", _table_size(rows(b)))
    numbered = F.transform(
        F.coalesce("blocks", F.array()),
        lambda b, i: F.when(
            block_size(b) > limit,
            F.struct(i.alias("item_no"), F.when(b["block_kind"] == "table", _table_text(rows(b))).otherwise(b["block_text"]).alias("item")),
        ),
    )
    text = F.when(F.length("text") > limit, F.struct(F.lit(-1).alias("item_no"), F.col("text").alias("item")))
    items = F.array_compact(F.concat(F.array(text), numbered))
    current = current_clauses(clauses, {"doc_id": F.col("doc_id"), "items": items})
    return current.filter(F.size("items") > 0).select(*DOCUMENT, "clause", "doc_id", F.inline("items"))


def pieces(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``items`` with the column ``item`` replaced by piece_no, start and piece, a row for each piece."""
    import pyarrow as pa

    kept = [c for c in items.columns if c != "item"]
    schema = ", ".join([*(f"`{c}` {items.schema[c].dataType.simpleString()}" for c in kept), "piece_no int, start int, piece string"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, starts, texts, held = [], [], [], [], 0

            def handed() -> pa.RecordBatch:
                same = batch.select(kept).take(pa.array(rows, pa.int64()))  # noqa: B023
                return pa.RecordBatch.from_arrays(
                    [*same.columns, pa.array(numbers, pa.int32()), pa.array(starts, pa.int32()), pa.array(texts, pa.string())], [*kept, "piece_no", "start", "piece"]  # noqa: B023
                )

            for row, item in enumerate(batch.column("item")):
                text = item.as_py() or ""
                for number, (start, end) in enumerate(cuts(text, limit, overlap)):
                    rows.append(row)
                    numbers.append(number)
                    starts.append(start)
                    texts.append(text[start:end])
                    held += end - start
                    if held > HANDED:
                        yield handed()
                        rows, numbers, starts, texts, held = [], [], [], [], 0
            yield handed()

    return items.select(*kept, "item").mapInArrow(split, schema)


def split_oversized(clauses: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every oversized item of the current clause rows."""
    return pieces(oversized(clauses, limit), limit, overlap)
