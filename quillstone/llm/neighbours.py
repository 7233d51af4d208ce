"""The most similar vectors of every vector, by an inverted multi-index.

Each half of a vector is quantised by its own codebook; a pair of centroids is a cell. A query visits the cells in the
order of their summed distances, from a heap, until they hold enough entries, and ranks these by cosine. How many are
enough is measured: for ``ASKED`` vectors of the sample the true neighbours are found by one scan, and the number is the
least with which the share ``TARGET`` of them would have been met. So recall does not fall as the collection grows; the
number of entries ranked does, as far as the data make it.

So that a visited cell is scored by one matrix product, neighbouring cells form blocks, and a query is sent once to each
block in which it visits cells, with its ``reach``: the summed distance of the last pair it took from the heap, by which
the block knows its cells again. A block has at most 1.5 ``BLOCK`` entries: cells above ``HOT`` times the mean are
quantised once more by codebooks of their own, and what is still larger than a block is cut into several by a hash, all
of which a visiting query gets. The queries of a block are cut into parts of about ``QUERIES`` by a hash, and each part
is one task with a copy of the block's entries; so the largest task is the same at any size.

What is held on the driver and broadcast: codebooks of at most ``MOST_CENTROIDS`` rows per half, their square as sizes of
cells, and the parts of overfull cells, at most ``SAMPLE`` / 4. Codebooks are fitted on a sample of ``SAMPLE`` vectors;
every vector is indexed. Equal vectors (after scaling, to half precision) are indexed once, with the first members of
their group, so a vector in a third of all rows is no hot key.

Vectors that are null, of another length, with non-finite elements or all zero take no part. Ties are broken by doc_id.
The index works in half precision, which moves a cosine by about 1e-4: it hands on ``SPARE`` entries more than wanted,
and these are ranked once more by the stored vectors in double precision; ``similar_pairs`` does so only where it can
change the result. ``exact_similar`` needs no index.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush, heapreplace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.lineage import cut
from quillstone.llm.sampling import bounded_sample
from quillstone.operators.search import nearest_to_each
from quillstone.sources.tables import current_records

DIM = 64
SAMPLE, SEED = 20_000, 11
#: Vectors whose true neighbours are looked up, and the share of these that the index must meet.
ASKED, TARGET = 500, 0.965
#: Vectors by whose visits the queries of each block are estimated.
ROUTED = 4_000
MOST_CENTROIDS = 512
#: Entries of a block, queries of a part of it, and how far above the mean a cell is quantised once more.
BLOCK, QUERIES, HOT = 50_000, 100_000, 16
#: What half precision may move a cosine by, and how many entries more than wanted are ranked by the stored vectors.
MARGIN, SPARE = 0.002, 3


def usable_vectors(records: DataFrame, dim: int = DIM) -> DataFrame:
    """doc_id and unit (half-precision bytes) of the current records whose vector is usable."""
    import pyarrow as pa

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat = pa.compute.fill_null(lists.flatten(), np.float32("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
            sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
            whole = np.flatnonzero(sizes == dim)
            starts = (np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0))[whole]
            vectors = flat[starts[:, None] + np.arange(dim)] if len(whole) else np.empty((0, dim))
            good = np.isfinite(vectors).all(1) & (vectors != 0).any(1)
            vectors, whole = vectors[good], whole[good]
            vectors /= np.abs(vectors).max(1, keepdims=True)
            vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
            units = np.full(batch.num_rows, None, object)
            units[whole] = [v.tobytes() for v in vectors.astype(np.float16) + np.float16(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(units, pa.binary())], ["doc_id", "indexed_at", "row_id", "unit"])

    rows = records.select("dense_vector", "doc_id", "indexed_at", "row_id")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    scaled = rows.mapInArrow(unit, f"doc_id {kinds['doc_id']}, indexed_at {kinds['indexed_at']}, row_id {kinds['row_id']}, unit binary")
    return current_records(scaled, {"unit": F.col("unit")}).filter("unit is not null")


def _distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, less the vectors' own squares."""
    return (centroids**2).sum(1) - 2 * vectors @ centroids.T


def codebook(sample: np.ndarray, size: int, seed: int = SEED, rounds: int = 8) -> np.ndarray:
    """Centroids by Lloyd's algorithm."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), size, replace=False)]
    for _ in range(rounds):
        own = _distances(sample, centroids).argmin(1)
        members = np.bincount(own, minlength=size)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        centroids = np.where(members[:, None] > 0, sums / np.maximum(members, 1)[:, None], centroids).astype(np.float32)
    return centroids


class MultiIndex:
    """Codebooks and cell sizes; cells of the two codebooks come first, parts of overfull cells after them."""

    def __init__(self, first: np.ndarray, second: np.ndarray) -> None:
        self.first, self.second = first, second
        self.parts: dict[int, tuple[int, np.ndarray]] = {}
        self.cells = len(first) * len(second)
        self.sizes: list[int] = []
        #: Per cell its first block and the number of blocks over which it is cut; per block the parts of its queries, and the first of these.
        self.block: np.ndarray | None = None
        self.pieces: np.ndarray | None = None
        self.queries: np.ndarray | None = None
        self.unit: np.ndarray | None = None
        self.whole = True

    def quantise_again(self, cell: int, centroids: np.ndarray) -> None:
        self.parts[cell] = (self.cells, centroids)
        self.cells += len(centroids)

    def cell(self, vectors: np.ndarray) -> np.ndarray:
        half = vectors.shape[1] // 2
        cells = _distances(vectors[:, :half], self.first).argmin(1) * len(self.second) + _distances(vectors[:, half:], self.second).argmin(1)
        held = np.unique(cells)
        for whole in held[np.isin(held, list(self.parts))].tolist():
            start, centroids = self.parts[whole]
            inside = np.flatnonzero(cells == whole)
            cells[inside] = start + _distances(vectors[inside], centroids).argmin(1)
        return cells

    def walks(self, vectors: np.ndarray) -> Iterator[Iterator[tuple[float, int]]]:
        """Per vector its cells that are not empty with their summed distance, nearest first, from a heap of pairs of centroids."""
        half, width, sizes = vectors.shape[1] // 2, len(self.second), self.sizes
        near_a, near_b = _distances(vectors[:, :half], self.first), _distances(vectors[:, half:], self.second)
        orders_a, orders_b = near_a.argsort(1), near_b.argsort(1)
        near_a, near_b = np.take_along_axis(near_a, orders_a, 1).tolist(), np.take_along_axis(near_b, orders_b, 1).tolist()

        def walk(vector: np.ndarray, da: list[float], db: list[float], oa: list[int], ob: list[int]) -> Iterator[tuple[float, int]]:
            heap, rows = [(da[0] + db[0], 0, 0)], len(da)
            while heap:
                reach, a, b = heap[0]
                # Every pair is pushed once: along the second half, and at its start along the first.
                if b + 1 < width:
                    heapreplace(heap, (da[a] + db[b + 1], a, b + 1))
                else:
                    heappop(heap)
                if not b and a + 1 < rows:
                    heappush(heap, (da[a + 1] + db[0], a + 1, 0))
                cell = oa[a] * width + ob[b]
                if sizes[cell]:
                    yield reach, cell
                elif cell in self.parts:
                    start, centroids = self.parts[cell]
                    for part in _distances(vector, centroids).argsort().tolist():
                        if sizes[start + part]:
                            yield reach, start + part

        for row in zip(vectors, near_a, near_b, orders_a.tolist(), orders_b.tolist(), strict=True):
            yield walk(*row)

    def visits(self, vectors: np.ndarray, enough: int) -> Iterator[tuple[float, list[int]]]:
        """Per vector its reach and the cells to visit, nearest first, until they hold ``enough`` entries."""
        sizes = self.sizes
        for walk in self.walks(vectors):
            held, found, reach = 0, [], 0.0
            for reach, cell in walk:  # noqa: B007
                found.append(cell)
                held += sizes[cell]
                if held >= enough:
                    break
            yield reach, found

    def needed(self, vectors: np.ndarray, wanted: list[set[int]]) -> list[dict[int, int]]:
        """How many entries must be enough for each vector to visit each of its ``wanted`` cells."""
        out = []
        for walk, cells in zip(self.walks(vectors), wanted, strict=True):
            held, left = 0, dict.fromkeys(cells)
            for _, cell in walk:
                if cell in left:
                    left[cell] = held + 1
                    if None not in left.values():
                        break
                held += self.sizes[cell]
            out.append(left)
        return out

    def group(self, block: int | None = None) -> None:
        """Put neighbouring cells into blocks: a grid of clusters of each codebook's centroids."""
        block = block or BLOCK
        runs = max(1, round((sum(self.sizes) / block) ** 0.5))

        def run(centroids: np.ndarray) -> np.ndarray:
            return _distances(centroids, codebook(centroids, min(runs, len(centroids)))).argmin(1)

        grid = (run(self.first)[:, None] * runs + run(self.second)[None, :]).ravel()
        # The parts of an overfull cell stand in its place.
        of = np.concatenate([grid, *(np.full(len(centroids), grid[cell]) for cell, (_, centroids) in sorted(self.parts.items(), key=lambda x: x[1][0]))])
        order = of.argsort(kind="stable").tolist()
        self.block, self.pieces = np.zeros(self.cells, np.int64), np.ones(self.cells, np.int64)
        at, held, before = -1, 0, None
        for cell in order:
            size = self.sizes[cell]
            if size > 1.5 * block:
                # No block holds this cell: a hash spreads its entries over several.
                self.pieces[cell] = -(-size // block)
                self.block[cell] = at + 1
                at, before = at + int(self.pieces[cell]), None
                continue
            # A new block at each run of the grid, and where the cells of one hold too much.
            if before is None or of[cell] != before or held + size > 1.5 * block:
                at, held, before = at + 1, 0, of[cell]
            self.block[cell] = at
            held += size
        self.whole = bool((self.pieces == 1).all())
        self.part_queries(np.zeros(at + 1))

    def part_queries(self, queries: np.ndarray) -> None:
        """Cut the queries of each block, given their estimated numbers, into parts; a part is a unit of work."""
        self.queries = np.maximum(1, np.ceil(queries / QUERIES)).astype(np.int64)
        self.unit = np.r_[0, np.cumsum(self.queries)]

    def blocks_of(self, cells: list[int]) -> list[int]:
        """The blocks that hold entries of the cells."""
        first = self.block[cells]
        if self.whole:
            return np.unique(first).tolist()
        return sorted({b for f, n in zip(first.tolist(), self.pieces[cells].tolist(), strict=True) for b in range(f, f + n)})

    def pairs(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the two codebooks that cells belong to; those of the overfull cell for its parts."""
        of = np.arange(self.cells)
        for cell, (start, centroids) in self.parts.items():
            of[start : start + len(centroids)] = cell
        return of[cells] // len(self.second), of[cells] % len(self.second)


def _vectors(column) -> np.ndarray:  # noqa: ANN001
    """The half-precision vectors of a binary column."""
    if not len(column):
        return np.empty((0, DIM), np.float32)
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(len(column), -1).astype(np.float32)


def _cells(units: DataFrame, index) -> DataFrame:  # noqa: ANN001
    import pyarrow as pa

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(index.value.cell(_vectors(batch.column(0))), pa.int64())], ["cell"])

    return units.select("unit").mapInArrow(assigned, "cell bigint")


def _true_cells(units: DataFrame, index, ids: np.ndarray, asked: np.ndarray, k: int) -> DataFrame:  # noqa: ANN001
    """asked (the row of a query), cosine and cell of the k most similar others of each query, by one scan."""
    import pyarrow as pa

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, cells = np.full((len(asked), k), -2.0, np.float32), np.full((len(asked), k), -1, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, own = _vectors(batch.column(1)), batch.column(0).to_numpy()
            new = asked @ vectors.T
            new[ids[:, None] == own[None, :]] = -2.0
            every = np.concatenate([scores, new], 1)
            where = np.concatenate([cells, np.broadcast_to(index.value.cell(vectors), new.shape)], 1)
            top = np.argpartition(-every, k - 1, axis=1)[:, :k]
            scores, cells = np.take_along_axis(every, top, 1), np.take_along_axis(where, top, 1)
        rows, columns = np.nonzero(cells >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(scores[rows, columns]), pa.array(cells[rows, columns], pa.int64())], ["asked", "cosine", "cell"])

    found = units.select("id", "unit").mapInArrow(best, "asked bigint, cosine float, cell bigint")
    first = Window.partitionBy("asked").orderBy(F.desc("cosine"), "cell")
    return found.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k).drop("_n")


def _sampled(units: DataFrame, total: int, size: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors of a seeded sample, drawn by the vectors themselves."""
    rows = bounded_sample(units.select("id", "unit"), F.xxhash64("unit", F.lit(seed)), total, size)
    vectors = np.frombuffer(b"".join(bytes(r["unit"]) for r in rows), np.float16).reshape(len(rows), -1).astype(np.float32)
    return np.array([r["id"] for r in rows], np.int64), vectors


def build_index(units: DataFrame, total: int, k: int) -> tuple[MultiIndex, int]:
    """An index of all of ``units``, fitted on a sample of them, and the number of entries that are enough for a query."""
    sc = units.sparkSession.sparkContext
    ids, sample = _sampled(units, total, SAMPLE)
    size = min(len(sample), MOST_CENTROIDS, max(1, round(total**0.5 / 20)))
    half = sample.shape[1] // 2
    index = MultiIndex(codebook(sample[:, :half], size), codebook(sample[:, half:], size))

    def count() -> None:
        index.sizes = [0] * index.cells
        # At most one row per cell: MOST_CENTROIDS squared and the parts.
        for cell, n in _cells(units, sc.broadcast(index)).groupBy("cell").count().collect():
            index.sizes[cell] = n

    count()
    mean = max(1, total // index.cells)
    overfull = {c: n for c, n in enumerate(index.sizes) if n > HOT * mean and n > BLOCK // 32}
    if overfull:
        whole = sum(overfull.values())
        members = _members(units, sc.broadcast(index), list(overfull))
        inside = _sampled(members, whole, SAMPLE)[1] if whole > len(sample) else sample
        own = index.cell(inside)
        for c, n in overfull.items():
            mine = inside[own == c]
            parts = min(len(mine) // 4, -(-n // (4 * mean)))
            if parts > 1:
                index.quantise_again(c, codebook(mine, parts))
        count()
    index.group()

    # How many entries are enough, from the true neighbours of some vectors.
    asked, vectors = ids[:ASKED], sample[:ASKED]
    wanted: list[list[int]] = [[] for _ in asked]
    for r in _true_cells(units, sc.broadcast(index), asked, vectors, k).collect():  # at most k rows per vector asked
        wanted[r["asked"]].append(r["cell"])
    met = index.needed(vectors, [set(w) for w in wanted])
    needed = sorted(by[c] for by, cells in zip(met, wanted, strict=True) for c in cells)
    enough = max([20 * k, *needed[: int(TARGET * len(needed)) + 1][-1:]])

    # How many queries each block gets, from the visits of some vectors.
    some = units.filter(F.pmod(F.xxhash64("unit", F.lit(SEED + 1)), F.lit(1 << 30)) < int(min(1.0, ROUTED / total) * (1 << 30)))
    routed = _visited(some, sc.broadcast(index), enough).groupBy("block").count().collect()  # a row per block
    share = min(1.0, ROUTED / total)
    queries = np.zeros(len(index.queries))
    for block, n in routed:
        queries[block] = n / share
    index.part_queries(queries)
    return index, enough


def _members(units: DataFrame, index, cells: list[int]) -> DataFrame:  # noqa: ANN001
    """The rows of ``units`` that lie in one of ``cells``."""
    import pyarrow as pa

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(np.isin(index.value.cell(_vectors(batch.column(1))), cells)))

    return units.select("id", "unit").mapInArrow(inside, "id bigint, unit binary")


def _visited(units: DataFrame, index, enough: int) -> DataFrame:  # noqa: ANN001
    """A row for each block that a vector of ``units`` visits."""
    import pyarrow as pa

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [b for _, cells in index.value.visits(_vectors(batch.column(0)), enough) for b in index.value.blocks_of(cells)]
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64())], ["block"])

    return units.select("unit").mapInArrow(visit, "block bigint")


_ROWS = "work int, entry boolean, id bigint, unit binary, reach float"


def _sent(units: DataFrame, index, enough: int) -> DataFrame:  # noqa: ANN001
    """Every vector as an entry to all units of work of the block of its cell, and as a query to one unit of each block in which it visits cells."""
    import pyarrow as pa

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multi = index.value
        first, parts = multi.unit.tolist(), multi.queries.tolist()
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                ids, units = batch.column(0).to_pylist(), batch.column(1)
                vectors = _vectors(units)
                to, rows, reaches = [], [], []
                for row, (cell, own) in enumerate(zip(multi.cell(vectors).tolist(), ids, strict=True)):
                    block = int(multi.block[cell]) + own % int(multi.pieces[cell])
                    to += range(first[block], first[block + 1])
                    rows += [row] * parts[block]
                entries = len(to)
                for row, ((reach, visited), own) in enumerate(zip(multi.visits(vectors, enough), ids, strict=True)):
                    blocks = multi.blocks_of(visited)
                    to += [first[b] + own % parts[b] for b in blocks]
                    reaches += [reach] * len(blocks)
                    rows += [row] * len(blocks)
                entry = np.arange(len(to)) < entries
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to, pa.int32()), pa.array(entry), batch.column(0).take(take), units.take(take), pa.array([0.0] * entries + reaches, pa.float32())],
                    ["work", "entry", "id", "unit", "reach"],
                )

    return units.select("id", "unit").mapInArrow(send, _ROWS)


def _ranker(index, k: int, least: float):  # noqa: ANN001, ANN202
    def rank(batches):  # noqa: ANN001, ANN202
        """The k best entries of a unit of work for each of its queries, cell by cell."""
        import pyarrow as pa

        held = [b for b in batches if b.num_rows]
        every = pa.Table.from_batches(held).sort_by("work") if held else None
        works = every.column("work").to_numpy() if held else np.empty(0, np.int32)
        for start, end in zip(np.flatnonzero(np.r_[True, works[1:] != works[:-1]]) if held else (), [*np.flatnonzero(works[1:] != works[:-1]) + 1, len(works)], strict=False):
            yield ranked(every.slice(start, end - start).combine_chunks())

    def ranked(block):  # noqa: ANN001, ANN202
        import pyarrow as pa

        multi = index.value
        entry = block.column("entry").to_numpy(zero_copy_only=False)
        every = _vectors(block.column("unit"))
        ids = block.column("id").to_numpy()
        # Distances are summed anew in other batches, hence the allowance.
        reach = block.column("reach").to_numpy() + np.float32(1e-5)
        half = every.shape[1] // 2
        best = np.full((len(ids), k), -2.0, np.float32)
        whom = np.full((len(ids), k), -1, np.int64)
        asks, e_rows = np.flatnonzero(~entry), np.flatnonzero(entry)
        near_a, near_b = _distances(every[asks, :half], multi.first).T.copy(), _distances(every[asks, half:], multi.second).T.copy()
        e_cells = multi.cell(every[e_rows])
        order = e_cells.argsort(kind="stable")
        e_rows, e_cells = e_rows[order], e_cells[order]
        held_cells = np.unique(e_cells)
        for c, a, b in zip(held_cells, *multi.pairs(held_cells), strict=True):
            entries = e_rows[slice(*np.searchsorted(e_cells, [c, c + 1]))]
            queries = asks[near_a[a] + near_b[b] <= reach[asks]]
            for at in range(0, len(queries), 2048):
                asking = queries[at : at + 2048]
                for part in range(0, len(entries), 4096):
                    held = entries[part : part + 4096]
                    scores = every[asking] @ every[held].T
                    floor = np.maximum(best[asking].min(1), least)
                    passing = scores > floor[:, None]
                    if len(held) > k + 1 and np.count_nonzero(passing) > 4 * k * len(asking):
                        # Before a query has seen its neighbourhood nearly all entries pass: only the k best can stay, and itself.
                        passing &= scores >= np.partition(scores, -(k + 1), axis=1)[:, -(k + 1), None]
                    rows, columns = np.nonzero(passing)
                    found = scores[rows, columns]
                    other = ids[asking[rows]] != ids[held[columns]]
                    rows, columns, found = rows[other], columns[other], found[other]
                    if not len(rows):
                        continue
                    # Within a query by falling score; the first k of them meet the k best so far.
                    order = np.lexsort((-found, rows))
                    rows, columns, found = rows[order], columns[order], found[order]
                    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                    place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
                    top = place < k
                    new = np.full((len(asking), k), -2.0, np.float32)
                    names = np.full((len(asking), k), -1, np.int64)
                    new[rows[top], place[top]] = found[top]
                    names[rows[top], place[top]] = ids[held[columns[top]]]
                    both = np.concatenate([best[asking], new], 1)
                    which = np.concatenate([whom[asking], names], 1)
                    order = (-both).argsort(1, kind="stable")[:, :k]
                    best[asking] = np.take_along_axis(both, order, 1)
                    whom[asking] = np.take_along_axis(which, order, 1)
        rows, columns = np.nonzero(whom >= 0)
        return pa.RecordBatch.from_pydict({"id": ids[rows], "other": whom[rows, columns], "cosine": best[rows, columns]})

    return rank


def similar_ids(units: DataFrame, k: int, least: float = -1.0) -> DataFrame:
    """id, other and cosine: the k most similar others of each id among (id, unit), of at least about ``least``."""
    total = units.count()
    if not total:
        return units.select("id", F.col("id").alias("other"), F.lit(0.0).cast("float").alias("cosine"))
    index, enough = build_index(units, total, k)
    shared = units.sparkSession.sparkContext.broadcast(index)
    # One unit of work is one partition, so none holds more than one block and one part of its queries.
    sent = _sent(units, shared, enough).repartitionById(int(index.unit[-1]), "work")
    scored = sent.mapInArrow(_ranker(shared, k, np.float32(least - MARGIN)), "id bigint, other bigint, cosine float")
    # Of one block at most k rows per id.
    best = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    return scored.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= k).drop("_rank")


def _candidates(records: DataFrame, k: int, least: float, dim: int) -> DataFrame:
    """doc_id, other_id and about their cosine (null for equal vectors): the k most similar others and ``SPARE`` more, of about ``least`` and more."""
    usable = cut(usable_vectors(records, dim).withColumn("key", F.unhex(F.md5("unit"))))
    most = k + SPARE
    first = Window.partitionBy("key").orderBy("doc_id")
    # Of each group of equal vectors the first members; the limit applies before the shuffle.
    heads = usable.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= most + 1)
    units = heads.groupBy("key").agg(F.first("unit").alias("unit"), F.sort_array(F.collect_list("doc_id")).alias("docs"))
    units = cut(units.withColumn("id", F.monotonically_increasing_id()))
    near = similar_ids(units, most, least)
    named = near.join(units.select(F.col("id").alias("other"), "docs"), "other").select("id", "cosine", F.explode("docs").alias("other_id"))
    best: Column = F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("less"), "other_id")))
    outside = named.groupBy("id").agg(F.slice(best, 1, most).alias("outside"))
    none = F.array().cast("array<struct<less:float,other_id:string>>")
    same = F.transform("docs", lambda d: F.struct(F.lit(None).cast("float").alias("less"), d.alias("other_id")))
    asked = units.join(outside, "id", "left").select("key", F.concat(same, F.coalesce("outside", none)).alias("all"))
    lone = asked.filter(F.size("all") > 1)
    own = usable.select("doc_id", "key").join(lone, "key")
    others = F.slice(F.filter("all", lambda x: x["other_id"] != F.col("doc_id")), 1, most)
    return own.select("doc_id", F.size(others).alias("n"), F.explode(others).alias("x")).select("doc_id", "n", "x.other_id", (-F.col("x.less")).alias("cosine"))


def _ranked(exact: DataFrame, k: int, least: float) -> DataFrame:
    place = Window.partitionBy("doc_id").orderBy(F.desc(F.round("cosine", 12)), "other_id")
    return exact.filter(F.col("cosine") >= least).withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)


def most_similar(records: DataFrame, k: int = 5, least: float = -1.0, dim: int = DIM) -> DataFrame:
    """doc_id, other_id, cosine and rank of the k most similar other records of each record, of cosine at least ``least``."""
    return _ranked(exact_cosines(cut(_candidates(records, k, least, dim).select("doc_id", "other_id")), records, dim), k, least)


def exact_cosines(pairs: DataFrame, records: DataFrame, dim: int = DIM) -> DataFrame:
    """``pairs`` (doc_id, other_id) with the ``cosine`` of the stored vectors in double precision."""
    wanted = pairs.select(F.explode(F.array("doc_id", "other_id")).alias("doc_id")).distinct()
    vector = F.transform("dense_vector", lambda x: x.cast("double"))
    current = current_records(records.join(wanted, "doc_id", "left_semi"), {"v": vector})

    def dot(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    longest = F.array_repeat(F.array_max(F.transform("v", F.abs)), dim)  # once per vector
    current = current.withColumn("v", F.zip_with("v", longest, lambda x, most: x / most))
    both = pairs.join(current.select("doc_id", F.col("v").alias("_a")), "doc_id").join(current.select(F.col("doc_id").alias("other_id"), F.col("v").alias("_b")), "other_id")
    return both.select("doc_id", "other_id", (dot("_a", "_b") / F.sqrt(dot("_a", "_a")) / F.sqrt(dot("_b", "_b"))).alias("cosine"))


def similar_pairs(records: DataFrame, k: int = 5, least: float = 0.9) -> DataFrame:
    """doc_id_a < doc_id_b of every pair of which one is among the other's k most similar, with cosine at least ``least``."""
    near = cut(_candidates(records, k, least, DIM))
    # Where a record has at most k candidates, and none near the minimum, half precision cannot err.
    sure = (F.col("n") <= k) & F.coalesce(F.col("cosine") >= least + MARGIN, F.lit(True))
    clear = near.filter(sure).select("doc_id", "other_id")
    close = near.filter(~sure).select("doc_id", "other_id")
    every = clear.unionByName(_ranked(exact_cosines(close, records), k, least).select("doc_id", "other_id"))
    return every.select(F.least("doc_id", "other_id").alias("doc_id_a"), F.greatest("doc_id", "other_id").alias("doc_id_b")).distinct()


def exact_similar(records: DataFrame, asked: Column, k: int = 5, dim: int = DIM) -> DataFrame:
    """query_id (a doc_id), doc_id, score (closeness) and place of the k most similar others of the current records that meet ``asked``, without index.

    The queries are a stated part of the rows; they meet all rows in blocks.
    """
    vector = F.transform("dense_vector", lambda x: x.cast("double"))
    current = current_records(records, {"v": vector, "asked": asked})
    fit = F.coalesce((F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    usable = current.filter(fit)
    found = nearest_to_each(usable, usable.filter("asked").select(F.col("doc_id").alias("query_id"), "v"), "v", k + 1, "doc_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    others = found.filter(F.col("query_id") != F.col("doc_id")).withColumn("place", F.row_number().over(best))
    return others.filter(F.col("place") <= k)
