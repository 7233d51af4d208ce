"""Exact byte-level BPE ids of a whole corpus with a public tokenizer.

The vocabulary is a file of base64 tokens and ranks; its path is a parameter and its bytes travel as a broadcast of
fixed size. A text is cut into pieces by the tokenizer's pattern. Each piece is encoded by dynamic programming over its
prefixes: an automaton with suffix links yields the vocabulary's tokens that end at each position, and among them
exactly one is the last token of that prefix's encoding - the one compatible with the last token of the prefix before
it. Back-pointers from the end give the ids. The time is linear in the piece, also for pieces of many thousand bytes.

Null and empty texts give an empty list. Strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern by which the public byte-level BPE tokenizer cuts texts into pieces.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces up to this length are remembered per worker, so many of them at once.
REMEMBERED_LENGTH, REMEMBERED = 40, 300_000
#: Rows of a batch that are encoded and handed on together, so that long texts do not pile up.
ROWS = 512


class PrefixEncoder:
    """Encodes pieces; a token's id is its rank, and ranks are the order of merging."""

    def __init__(self, vocabulary: bytes) -> None:
        import ahocorasick
        import regex

        pairs = (line.split() for line in vocabulary.splitlines() if line)
        ranks = {base64.b64decode(token).decode("latin-1"): int(rank) for token, rank in pairs}
        self.pieces = regex.compile(PIECES).findall
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, list[int]] = {}
        self.lengths = {rank: len(token) for token, rank in ranks.items()}
        self.matches = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self.matches.add_word(token, rank)
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut], rank), ranks.get(token[cut:], rank)
                if left < rank and right < rank and self._untouched(left, right):
                    self.merged[left, right], self.halves[rank] = rank, (left, right)
                    break
        self.matches.make_automaton()
        self.fits.clear()

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The parts of a token at one edge, outermost first, each with the rank at which it is merged further."""
        out, until = [], float("inf")
        while True:
            out.append((token, until))
            if token not in self.halves:
                return out
            token, until = self.halves[token][side], token

    def _untouched(self, left: int, right: int) -> bool:
        """Whether no merge joins a part of ``left`` with a part of ``right`` while both parts exist.

        Of equal ranks the leftmost merge comes first, hence the two kinds of comparison.
        """
        for a, a_until in self._spine(left, 1):
            for b, b_until in self._spine(right, 0):
                rank = self.merged.get((a, b))
                if rank is not None and rank < a_until and rank <= b_until:
                    return False
        return True

    def compatible(self, left: int, right: int) -> bool:
        fits = self.fits.get((left, right))
        if fits is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            fits = self.fits[left, right] = self._untouched(left, right)
        return fits

    def piece(self, piece: str) -> list[int]:
        text = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        last, lengths = [-1] * (len(text) + 1), self.lengths
        for end, token in self.matches.iter(text):
            if last[end + 1] < 0:
                start = end + 1 - lengths[token]
                if not start or self.compatible(last[start], token):
                    last[end + 1] = token
        ids, end = [], len(text)
        while end:
            ids.append(last[end])
            end -= lengths[last[end]]
        ids.reverse()
        return ids

    def encode(self, text: str | None) -> array:
        out, known = array("i"), self.known
        for piece in self.pieces(text) if text else ():
            ids = known.get(piece)
            if ids is None:
                ids = self.piece(piece)
                if len(piece) <= REMEMBERED_LENGTH:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            out.extend(ids)
        return out


@lru_cache(2)
def _encoder(vocabulary: bytes) -> PrefixEncoder:
    """One per worker and vocabulary."""
    return PrefixEncoder(vocabulary)


def _encoded(df: DataFrame, text: str, out: str, counts: bool, vocabulary: str) -> DataFrame:
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

    ranks = df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                ends, ids = array("i", [0]), array("i")
                for value in batch.column(0):
                    found = encoder.encode(value.as_py())
                    ends.append(len(found) if counts else ends[-1] + len(found))
                    if not counts:
                        ids.extend(found)
                column = pa.array(ends[1:], pa.int64()) if counts else pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                rest = batch.columns[1:]
                yield pa.RecordBatch.from_arrays([*rest, column], [*batch.schema.names[1:], out])

    df = df.drop(out) if out != text else df
    kind = LongType() if counts else ArrayType(IntegerType(), False)
    schema = StructType([*(f for f in df.schema.fields if f.name != out), StructField(out, kind)])
    named = max(["_text", *df.columns], key=len) + "_"  # a name that no column has
    return df.select(F.col(text).alias(named), *[c for c in df.columns if c != out]).mapInArrow(encode, schema)


def token_ids(df: DataFrame, text: str = "text", out: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with the ids of ``text`` in the column ``out``, which is replaced if there is one; select the columns wanted
    first, as all of them pass through Python."""
    return _encoded(df, text, out, False, vocabulary)


def token_counts(df: DataFrame, text: str = "text", out: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with the number of ids of ``text``."""
    return _encoded(df, text, out, True, vocabulary)
