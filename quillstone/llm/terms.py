"""Occurrences, records and specifications of every distinct term, by burst tries.

Each task counts its terms in a burst trie: inner nodes branch by character, leaf containers hold the remaining suffixes
with their counters, and a container that grows too large bursts into a node. Tries travel as compact containers (prefix,
suffixes, counters). How far the prefixes branch globally is found from the containers' sizes: a prefix under which more
than ``ENTRIES`` entries lie is split further, so no worker gets more for a subtree, however many terms there are and
however unevenly they are spread. Workers merge the containers of a subtree into one trie, container by container:
where both tries have a container they are merged by adding counters, where one branches further the other follows.

A key of the trie is the term and, below it, the specification. Counters of a key are its occurrences and the records
counted under it; each record of a term counts under one of its specifications only. So both counters add up, and the
specifications of a term are the keys below it.

Terms compare after NFKC, without zero-width characters, with white-space runs made one blank, trimmed, in lower case;
null, blank and shorter terms do not count. Null doc_ids add occurrences, but no record. Repeated rows count as
occurrences. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from unicodedata import normalize

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillstone.functions.text import filled
from quillstone.lineage import cut

SHORTEST = 3
RARE_DOCS, LOCAL_SPECS, COMMON_SHARE = 2, 1, 0.05
#: Entries of a container before it bursts, and of a task's trie before it is handed on.
CONTAINER, TRIE = 512, 250_000
#: Entries of all tasks that are routed to one subtree at most; the prefixes that are split, a set that is broadcast, are
#: fewer than all entries over this, times their length.
ENTRIES = 100_000
#: Characters of no width that are removed.
ZERO_WIDTH = dict.fromkeys([0x200B, 0x200C, 0x200D, 0xFEFF])
SEP = "\x00"


def normal_term(term: str) -> str:
    return " ".join(normalize("NFKC", term).translate(ZERO_WIDTH).split()).lower()


@F.pandas_udf(StringType())
def normal_terms(terms: pd.Series) -> pd.Series:
    codes, distinct = pd.factorize(terms)
    normal = [normal_term(t) for t in distinct]
    return pd.Series([normal[c] if c >= 0 else None for c in codes], dtype=object)


class BurstTrie:
    """Counters by key. A node is a dict by character; a container is a list [dict suffix -> counters]."""

    def __init__(self, container: int = CONTAINER) -> None:
        self.container, self.root, self.entries = container, [{}], 0

    def add(self, key: str, n: int, d: int) -> None:
        holder, slot, at, depth = None, "", self.root, 0
        while type(at) is dict:
            holder, slot = at, key[depth : depth + 1]
            at = at.get(slot)
            if at is None:
                at = holder[slot] = [{}]
            depth += 1
        held, suffix = at[0], key[depth:]
        old = held.get(suffix)
        if old:
            held[suffix] = (old[0] + n, old[1] + d)
        else:
            self._fill(at, holder, slot, [(suffix, n, d)])

    def merge(self, prefix: str, suffixes: list[str], occurrences: list[int], docs: list[int]) -> None:
        """Add the entries of another trie's container."""
        holder, slot, at, depth = None, "", self.root, 0
        while isinstance(at, dict) and depth < len(prefix):
            holder, slot = at, prefix[depth]
            at = at.setdefault(slot, [{}])
            depth += 1
        rest = prefix[depth:]
        if isinstance(at, dict):
            # This trie branches further here: the container is parted by the next character.
            for c, group in groupby(zip(suffixes, occurrences, docs, strict=True), key=lambda x: x[0][:1]):
                own = list(group)
                child = at.setdefault(c, [{}])
                if isinstance(child, dict):
                    self.merge(prefix + c, *map(list, zip(*((s[1:], n, d) for s, n, d in own), strict=True)))
                else:
                    self._fill(child, at, c, [(s[1:], n, d) for s, n, d in own])
        else:
            self._fill(at, holder, slot, [(rest + s, n, d) for s, n, d in zip(suffixes, occurrences, docs, strict=True)])

    def _fill(self, container: list, holder: dict | None, slot: str, entries: list[tuple[str, int, int]]) -> None:
        """Add entries to a container, which stands at ``slot`` of ``holder``, and burst it if it grows too large."""
        held = container[0]
        before = len(held)
        for suffix, n, d in entries:
            old = held.get(suffix)
            held[suffix] = (old[0] + n, old[1] + d) if old else (n, d)
        self.entries += len(held) - before
        if len(held) > self.container:
            node: dict = {}
            for s, c in held.items():
                node.setdefault(s[:1], [{}])[0][s[1:]] = c
            if holder is None:
                self.root = node
            else:
                holder[slot] = node

    def containers(self) -> Iterator[tuple[str, list[str], list[int], list[int]]]:
        """Containers in order, with their entries in order: all keys are sorted."""
        stack = [("", self.root)]
        while stack:
            prefix, at = stack.pop()
            if isinstance(at, dict):
                stack += sorted(((prefix + c, x) for c, x in at.items()), key=lambda x: x[0], reverse=True)
            elif at[0]:
                suffixes = sorted(at[0])
                yield prefix, suffixes, [at[0][s][0] for s in suffixes], [at[0][s][1] for s in suffixes]


_BLOCKS = "prefix string, suffixes array<string>, occurrences array<bigint>, docs array<bigint>"
_NAMES = ["prefix", "suffixes", "occurrences", "docs"]


def _blocks(rows: list[tuple[str, list[str], list[int], list[int]]], names: list[str] = _NAMES):  # noqa: ANN202
    import pyarrow as pa

    kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _count(batches: Iterator) -> Iterator:
    """Rows (key, occurrences, docs) of a task to the containers of its tries."""
    trie = BurstTrie()

    def handed() -> Iterator:
        rows = list(trie.containers())
        for at in range(0, len(rows), 256):
            yield _blocks(rows[at : at + 256])

    for batch in batches:
        for key, n, d in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            trie.add(key, n, d)
        if trie.entries > TRIE:
            yield from handed()
            trie = BurstTrie()
    yield from handed()


def _route(key: str, split: frozenset[str]) -> str:
    depth = 0
    while depth < len(key) and key[:depth] in split:
        depth += 1
    return key[:depth]


def _merge(blocks):  # noqa: ANN001, ANN202
    """The containers of one subtree, merged as a trie, to its terms."""
    import pyarrow as pa

    trie = BurstTrie()
    for block in blocks.to_batches():
        for container in zip(*(block.column(n).to_pylist() for n in _NAMES), strict=True):
            trie.merge(*container)
    keys = ((prefix + s, n, d) for prefix, suffixes, ns, ds in trie.containers() for s, n, d in zip(suffixes, ns, ds, strict=True))
    out = []
    # The separator comes before any other character, so the keys of a term stand together.
    for term, own in groupby(keys, key=lambda k: k[0].partition(SEP)[0]):
        below = list(own)
        out.append((term, sum(n for _, n, _ in below), sum(d for _, _, d in below), sum(not k.endswith(SEP) for k, _, _ in below)))
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["term", "occurrences", "docs", "specs"])


def term_counts(hits: DataFrame, term: Column | str = "term", doc: str = "doc_id", spec: str = "spec_no") -> DataFrame:
    """term, occurrences, doc_count and spec_count of every distinct term."""
    named = hits.select(normal_terms(F.col(term) if isinstance(term, str) else term).alias("term"), F.col(doc).alias("doc"), filled(spec).alias("spec"))
    named = named.filter(F.length("term") >= SHORTEST)
    # A pair of term and record is spread by both, so a term in a third of all rows is no hot key; equal rows meet before the shuffle.
    pairs = named.groupBy("term", "doc").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("spec")).alias("specs"))
    first = F.col("at") <= 0
    keys = pairs.select("term", "doc", "n", F.posexplode(F.when(F.size("specs") > 0, F.col("specs")).otherwise(F.array(F.lit("")))).alias("at", "spec"))
    keys = keys.select(
        F.concat("term", F.lit(SEP), "spec").alias("key"),
        F.when(first, F.col("n")).otherwise(0).cast("bigint").alias("n"),
        (first & F.col("doc").isNotNull()).cast("bigint").alias("d"),
    )
    blocks = cut(keys.mapInArrow(_count, _BLOCKS))

    sizes = blocks.select("prefix", F.size("suffixes").cast("bigint").alias("entries"))
    under = sizes.select("entries", F.explode(F.transform(F.sequence(F.lit(0), F.length("prefix")), lambda n: F.substring("prefix", F.lit(1), n))).alias("at"))
    crowded = under.groupBy("at").agg(F.sum("entries").alias("entries")).filter(F.col("entries") > ENTRIES).select("at").collect()
    split = hits.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in crowded))

    def routed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for prefix, *columns in zip(*(batch.column(n).to_pylist() for n in _NAMES), strict=True):
                entries = sorted((_route(prefix + s, split.value), prefix + s, n, d) for s, n, d in zip(*columns, strict=True))
                for route, own in groupby(entries, key=lambda x: x[0]):
                    _, keys, ns, ds = zip(*own, strict=True)
                    rows.append((route, [k[len(route) :] for k in keys], ns, ds))
            if rows:
                yield pa.RecordBatch.from_arrays(_blocks(rows).columns, _NAMES)

    merged = blocks.mapInArrow(routed, _BLOCKS).groupBy("prefix").applyInArrow(_merge, "term string, occurrences bigint, docs bigint, specs bigint")
    # A term with very many specifications may lie in several subtrees.
    return merged.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("docs").alias("doc_count"), F.sum("specs").alias("spec_count"))


def marked_terms(hits: DataFrame) -> DataFrame:
    """``term_counts`` with ``mark``: rare, local, common or null, the first that holds."""
    docs = hits.select("doc_id").filter("doc_id is not null").distinct().count()
    mark = (
        F.when(F.col("doc_count") <= RARE_DOCS, "rare")
        .when(F.col("spec_count") <= LOCAL_SPECS, "local")
        .when(F.col("doc_count") >= COMMON_SHARE * docs, "common")
    )
    return term_counts(hits).withColumn("mark", mark)
