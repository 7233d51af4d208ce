"""The best records for each of many queries by BM25 per field, or by BM25 and closeness together, over all matches.

Records and queries are cut into blocks, and every block of queries meets every block of records in one task, where all
matches are scored and the best of each query are kept. So no pair of query and record is shuffled: what goes on is the
best of each query and block, and the result is that of scoring and ranking all pairs. Queries of the same tokens match
the same records, and are matched once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.lineage import cut
from quillstone.operators.search import K1, B, placed, tokens

#: Records and queries of a block, rows scored at once, and queries of the same tokens compared with vectors at once.
RECORDS, QUERIES, CHUNK, TOGETHER = 65_536, 16_384, 16_384, 64
_WORD, _QUERY, _VECTOR, _RECORD = range(4)


@dataclass(frozen=True)
class Score:
    """BM25 by a profile, to six places; with ``vector``, ``sparse`` times that and ``vector`` times 9 times the closeness, to four."""

    profile: str
    sparse: float = 1.0
    vector: float | None = None

    @property
    def lexical(self) -> bool:
        """Whether queries of the same tokens have the same scores."""
        return not self.vector


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    return np.floor(x * 10.0**digits + 0.5) / 10.0**digits


def _units(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1, and which rows have one."""
    has = (pc.fill_null(pc.list_value_length(column), -1)).to_numpy(zero_copy_only=False) == size
    v = np.zeros((len(column), size))
    if has.any():
        v[has] = column.filter(pa.array(has)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    with np.errstate(all="ignore"):
        norm = np.sqrt((v * v).sum(1))
        has &= np.isfinite(norm) & (norm > 0)
        return np.where(has[:, None], v / norm[:, None], 0.0), has


class _Best:
    """The best ``most`` of each query of one ranking: scores, and places of the records in the block; of equal scores the first."""

    def __init__(self, queries: int, most: int) -> None:
        self.most, self.scores, self.at = most, np.full((queries, most), -np.inf), np.zeros((queries, most), np.int64)

    def least(self, queries: np.ndarray) -> np.ndarray:
        return self.scores[queries, -1]

    def add(self, query: int, scores: np.ndarray, at: np.ndarray) -> None:
        """``at`` is in order, and after all that was added."""
        if len(scores) > self.most:
            kept = np.flatnonzero(scores >= np.partition(scores, -self.most)[-self.most])
            scores, at = scores[kept], at[kept]
        scores, at = np.concatenate([self.scores[query], scores]), np.concatenate([self.at[query], at])
        order = np.argsort(-scores, kind="stable")[: self.most]
        self.scores[query], self.at[query] = scores[order], at[order]


class _Block:
    """One block of queries against one block of records, which come in the order of their key."""

    def __init__(self, spec: dict) -> None:
        self.spec, self.parts, self.waiting, self.n, self.keys = spec, {t: [] for t in (_WORD, _QUERY, _VECTOR)}, [], 0, []
        self.ready = False

    def take(self, tag: int, rows: pa.RecordBatch) -> None:
        if tag != _RECORD:
            self.parts[tag].append(rows)
            return
        self.waiting.append(rows)
        if sum(map(len, self.waiting)) >= CHUNK:
            self._score()

    def _prepare(self) -> None:
        spec, fields = self.spec, len(self.spec["fields"])
        rows = lambda tag: pa.Table.from_batches(self.parts[tag]).combine_chunks() if self.parts[tag] else None
        one = lambda table, c: table.column(c).combine_chunks() if table.num_rows else None
        words, asked, vectors = rows(_WORD), rows(_QUERY), rows(_VECTOR)
        self.ready, self.lists, self.words = True, [], None
        if words is None or asked is None:
            return
        self.words = one(words, "tokens").flatten().flatten()
        numbers = one(words, "numbers").flatten().to_numpy(zero_copy_only=False).reshape(-1, 1 + 2 * fields)
        total, df, self.average = numbers[0, 0], numbers[:, 1 : 1 + fields], numbers[0, 1 + fields :]
        self.idf = np.log(1 + (total - df + 0.5) / (df + 0.5))
        self.ids = one(asked, "id").to_numpy()
        held = one(asked, "tokens").flatten()  # a list of tokens per query
        of, ends = pc.fill_null(pc.index_in(held.flatten(), value_set=self.words), -1).to_numpy(), np.cumsum(pc.list_value_length(held).to_numpy())
        by_list: dict[int, list[int]] = {}
        for query, name in enumerate(one(asked, "list").to_pylist()):
            by_list.setdefault(name, []).append(query)
        for name, members in by_list.items():
            first = members[0]
            known = of[(ends[first - 1] if first else 0) : ends[first]]
            if (known >= 0).any():
                self.lists.append((len(self.lists), name, known[known >= 0], np.array(members)))
        most = spec["most"]
        self.best = {r: _Best(len(self.lists) if s.lexical else len(self.ids), most) for r, s in spec["rankings"].items()}
        if spec["size"]:
            self.asked, self.has_asked = _units(one(asked, "v"), spec["size"])
            self.vector_keys = one(vectors, "key") if vectors is not None else None
            if vectors is not None:
                self.vectors, self.has_vector = _units(one(vectors, "v"), spec["size"])

    def _postings(self, rows: pa.Table, n: int) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per profile: where the postings of each word begin, their records, and their parts of the score."""
        fields = len(self.spec["fields"])
        inner = rows.column("tokens").combine_chunks().flatten()
        lengths = pc.list_value_length(inner).to_numpy()
        ids = pc.fill_null(pc.index_in(inner.flatten(), value_set=self.words), -1).to_numpy()
        cell = np.repeat(np.arange(n * fields), lengths)[ids >= 0]
        codes, tf = np.unique((ids[ids >= 0].astype(np.int64) * fields + cell % fields) * n + cell // fields, return_counts=True)
        record, word, field = codes % n, codes // n // fields, codes // n % fields
        length = lengths[record * fields + field]
        weight = rows.column("counts").to_numpy()[record]
        part = weight * self.idf[word, field] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.average[field]))
        found = {}
        for name, weights in self.spec["profiles"].items():
            mine = np.array([f in weights for f in self.spec["fields"]])[field]
            pair, back = np.unique(word[mine] * n + record[mine], return_inverse=True)
            of = np.array([weights.get(f, 0.0) for f in self.spec["fields"]])[field[mine]]
            found[name] = (np.searchsorted(pair // n, np.arange(len(self.words) + 1)), pair % n, np.bincount(back, of * part[mine], len(pair)))
        return found

    def _score(self) -> None:
        """Scores the waiting records."""
        if not self.ready:
            self._prepare()
        if not self.waiting:
            return
        rows = pa.Table.from_batches(self.waiting).combine_chunks()
        self.waiting, n, base = [], len(rows), self.n
        self.n += n
        self.keys.append(rows.column("key").combine_chunks())
        if not self.lists:
            return
        postings, rankings = self._postings(rows, n), self.spec["rankings"]
        close = any(not s.lexical for s in rankings.values())
        if close:
            units, has = np.zeros((n, self.spec["size"])), np.zeros(n, bool)
            if self.vector_keys is not None:
                at = pc.fill_null(pc.index_in(self.keys[-1], value_set=self.vector_keys), -1).to_numpy()
                units[at >= 0], has[at >= 0] = self.vectors[at[at >= 0]], self.has_vector[at[at >= 0]]
        sums, seen, wanted, row_of = np.zeros(n), np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, np.int64)
        for which, _, words, members in self.lists:
            matched = {}
            for name, (begins, records, parts) in postings.items():
                for w in words:
                    own = slice(begins[w], begins[w + 1])
                    sums[records[own]] += parts[own]
                    seen[records[own]] = True
                at = np.flatnonzero(seen)
                matched[name] = (at, _rounded(sums[at], 6))
                sums[at], seen[at] = 0.0, False
            near = []
            for r, s in rankings.items():
                at, lexical = matched[s.profile]
                if not len(at):
                    continue
                if s.vector is not None:
                    lexical = lexical * s.sparse
                if not s.lexical:
                    # Closeness is at most 1.
                    can = lexical + 9 * s.vector >= self.best[r].least(members).min()
                    if can.any():
                        near.append((r, s, at[can], lexical[can]))
                        wanted[at[can]] = True
                    continue
                total = lexical if s.vector is None else _rounded(lexical, 4)
                more = total > self.best[r].scores[which, -1]
                if more.any():
                    self.best[r].add(which, total[more], base + at[more])
            if near:
                at = np.flatnonzero(wanted)
                wanted[at], row_of[at] = False, np.arange(len(at))
                sub, has_sub = units[at], has[at]
                for k in range(0, len(members), TOGETHER):
                    some = members[k : k + TOGETHER]
                    cosines = np.clip(self.asked[some] @ sub.T, -1.0, 1.0)
                    cosines[:, ~has_sub] = -2.0  # without a vector there is no closeness
                    cosines[~self.has_asked[some]] = -2.0
                    for r, s, records, lexical in near:
                        self._closest(r, s, some, base + records, lexical, cosines if len(records) == len(at) else cosines[:, row_of[records]])

    def _closest(self, r: str, s: Score, queries: np.ndarray, at: np.ndarray, lexical: np.ndarray, cosines: np.ndarray) -> None:
        best = self.best[r]
        least = best.least(queries)
        needed = (least - lexical.max()) / (9 * s.vector) - 1e-9  # the closeness that any record needs to be among the best
        with np.errstate(all="ignore"):
            bound = np.where(needed >= 1 / (1 + np.pi), np.cos(np.maximum(1 / needed - 1, 0)) - 1e-9, np.where(needed > 0, -1.0, -3.0))
        bound[needed > 1] = 2.0
        q, k = np.nonzero(cosines >= bound[:, None])
        cos = cosines[q, k]
        total = _rounded(lexical[k] + np.where(cos < -1, 0.0, 1 / (1 + np.arccos(np.maximum(cos, -1)))) * 9 * s.vector, 4)
        more = total > least[q]
        q, k, total = q[more], k[more], total[more]
        starts = np.flatnonzero(np.diff(q, prepend=-1))
        for b, e in zip(starts, [*starts[1:], len(q)]):
            best.add(queries[q[b]], total[b:e], at[k[b:e]])

    def found(self) -> Iterator[pa.RecordBatch]:
        self._score()
        if not self.lists or not self.n:
            return
        keys = pa.chunked_array(self.keys).combine_chunks()
        names = np.array([name for _, name, _, _ in self.lists], np.int64)
        for r, s in self.spec["rankings"].items():
            ids, best = names if s.lexical else self.ids, self.best[r]
            for k in range(0, len(ids), 4096):
                q, j = np.nonzero(best.scores[k : k + 4096] > -np.inf)
                if len(q):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r] * len(q), pa.string()), pa.array(ids[k + q]), keys.take(pa.array(best.at[k + q, j])), pa.array(best.scores[k + q, j])], ["ranking", "id", "key", "score"]
                    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int, pa.RecordBatch]]:
    """The rows of a batch by block and tag, as they come."""
    i, j, tag = (batch.column(c).to_numpy() for c in ("i", "j", "tag"))
    ends = [*(np.flatnonzero((np.diff(i) != 0) | (np.diff(j) != 0) | (np.diff(tag) != 0)) + 1), len(batch)]
    begin = 0
    for end in ends:
        if end > begin:
            yield (int(i[begin]), int(j[begin])), int(tag[begin]), batch.slice(begin, end - begin)
        begin = end


def best(
    records: DataFrame, queries: DataFrame, profiles: dict[str, dict[str, float]], rankings: dict[str, Score], most: int, weight: str | None = None, key: str = "doc_id",
    vectors: DataFrame | None = None, asked_vectors: DataFrame | None = None, size: int = 64,
) -> DataFrame:
    """ranking, query_id, key, score and place of the ``most`` best records for each query (query_id, query).

    A record matches where a field of the ranking's profile, a text or an array of terms, holds a token of the query; BM25
    is summed over the profile's fields and multiplied by the record's ``weight``. ``vectors`` (key, v) and ``asked_vectors``
    (query_id, v) have vectors of ``size`` elements; without one, closeness is 0. Equal scores are ordered by key.
    """
    arrays = {f for f, kind in records.dtypes if kind.startswith("array")}
    fields = list(dict.fromkeys(f for p in profiles.values() for f in p))
    kinds, id_kind = dict(records.dtypes), dict(queries.dtypes)["query_id"]
    none = F.array().cast("array<string>")
    of = lambda f: tokens(F.array_join(f, " ") if f in arrays else f)
    held = records.select(F.col(key).alias("key"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("counts"), F.array(*[F.coalesce(of(f), none) for f in fields]).alias("tokens"))

    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.explode(F.array_distinct(tokens("query"))).alias("token"))
    lists = cut(asked.groupBy("query_id").agg(F.sort_array(F.collect_list("token")).alias("words")))
    asked = cut(lists.join(lists.groupBy("words").agg(F.min("query_id").alias("list")), "words"))

    # Beside the tokens, which are never empty, '' counts the records, as field -1, and per field those with a value and their lengths.
    one = lambda token, field, length: F.struct(token.alias("token"), field.alias("field"), length.alias("length"))
    empty, zero = F.lit(""), F.lit(0)
    terms = lambda ts, f: F.concat(F.array(one(empty, f, F.size(ts))), F.transform(F.array_distinct(ts), lambda t: one(t, f, zero)))
    each = F.transform(F.array(*map(of, fields)), lambda ts, f: F.when(ts.isNotNull(), terms(ts, f)).otherwise(F.array().cast("array<struct<token:string,field:int,length:int>>")))
    counted = records.select(F.explode(F.concat(F.array(one(empty, F.lit(-1), zero)), F.flatten(each))).alias("t")).groupBy("t.token", "t.field")
    counted = counted.agg(F.count(F.lit(1)).cast("double").alias("df"), F.sum("t.length").alias("length"))
    words = lists.select(F.explode("words").alias("token")).unionByName(records.sparkSession.createDataFrame([("",)], "token string")).distinct()
    counted = cut(counted.join(words, "token", "left_semi"))
    whole = {r.field: (r.df, r.length) for r in counted.filter("token = ''").collect()}  # a row per field
    n = whole.get(-1, (0.0, 0))[0]
    average = [length / df for df, length in (whole.get(k, (1.0, 0)) for k in range(len(fields)))]

    blocks = max(1, -(-int(n) // RECORDS))
    close = any(not s.lexical for s in rankings.values())
    rows = asked if close else asked.filter("query_id = list")
    parts = max(1, -(-rows.count() // QUERIES))
    rows = rows.withColumn("j", F.pmod(F.xxhash64("list"), F.lit(parts)).cast("int"))

    def row(frame: DataFrame, tag: int, **values) -> DataFrame:  # noqa: ANN003
        kinds_of = {"key": kinds[key], "id": "bigint", "list": "bigint", "counts": "double", "tokens": "array<array<string>>", "numbers": "array<double>", "v": "array<float>"}
        return frame.select("i", "j", F.lit(tag).alias("tag"), *[values.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds_of.items()])

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    known = rows.select("j", F.explode("words").alias("token")).distinct().join(counted.drop("length"), "token").groupBy("j", "token")
    known = known.agg(*[F.coalesce(F.sum(F.when(F.col("field") == k, F.col("df"))), F.lit(0.0)).alias(f"d{k}") for k in range(len(fields))])
    numbers = F.array(F.lit(n), *[f"d{k}" for k in range(len(fields))], *map(F.lit, average))
    placed_in = lambda frame: frame.select("*", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("i"), every(parts).alias("j"))
    frames = [
        row(known.withColumn("i", every(blocks)), _WORD, tokens=F.array(F.array("token")), numbers=numbers),
        row(placed_in(held), _RECORD, key=F.col("key"), counts=F.col("counts"), tokens=F.col("tokens")),
    ]
    queried = {"id": F.col("query_id"), "list": F.col("list"), "tokens": F.array("words")}
    if close:
        fit = F.when((F.size("v") == size) & ~F.exists("v", lambda x: x.isNull()), F.col("v"))
        rows = rows.join(asked_vectors.select(F.col("query_id").cast("bigint").alias("query_id"), fit.alias("v")), "query_id", "left")
        queried["v"] = F.col("v")
        given = vectors.select(F.col(key).alias("key"), fit.alias("v")).filter("v is not null")
        frames.append(row(placed_in(given), _VECTOR, key=F.col("key"), v=F.col("v")))
    frames.append(row(rows.withColumn("i", every(blocks)), _QUERY, **queried))
    spec = {"fields": fields, "profiles": profiles, "rankings": rankings, "most": most, "size": size if close else 0}

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None
        for batch in batches:
            for where, tag, run in _runs(batch):
                if where != at:
                    if block:
                        yield from block.found()
                    at, block = where, _Block(spec)
                block.take(tag, run)
        if block:
            yield from block.found()

    together = reduce(DataFrame.unionByName, frames).repartition("i", "j").sortWithinPartitions("i", "j", "tag", "key")
    found = placed(together.mapInArrow(ranked, f"ranking string, id bigint, key {kinds[key]}, score double"), ["ranking", "id"], most, "key")
    alike = [r for r, s in rankings.items() if s.lexical]
    each = found.filter(F.col("ranking").isin(alike)).join(asked.select("query_id", F.col("list").alias("id")), "id").select("ranking", "query_id", "key", "score", "place")
    if close:
        own = found.filter(~F.col("ranking").isin(alike)).select("ranking", F.col("id").alias("query_id"), "key", "score", "place")
        each = each.unionByName(own) if alike else own
    return each.select("ranking", F.col("query_id").cast(id_kind).alias("query_id"), F.col("key").alias(key), "score", "place")
