"""Text that was decoded with a wrong character encoding.

A multinomial classifier on hashed byte bigrams tells clean from garbled stretches of non-ASCII text, and which chain of
encodings garbled them. Its garbled examples are made from the corpus itself: lines of a bounded, seeded sample are
encoded in one encoding and decoded in another. As the sample holds a few garbled lines of its own, it is cleaned by the
first fit and the classifier fitted once more; garbling and counting run in tasks, one for each chain and part of the
sample, and the driver gets their counters. Every text is then classified whole, stretch by stretch and line by line:
a predicted chain is inverted, and accepted if the inverse is strictly decodable to assigned characters. Of several such
chains one whose characters are such as clean texts have goes first; characters that they lack reject none. Where bytes were lost to replacement characters the text is found, but cannot be restored.

Null, empty and pure ASCII texts are clean. The result does not depend on the order or number of rows, but for the
sample. Several chains in one text are found and inverted each.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.sampling import bounded_sample

#: Lines of non-ASCII text that the classifier is fitted on; longer lines are drawn in parts of ``LINE`` characters, all of them.
SAMPLE, LINE, SEED = 12_000, 400, 5
#: Parts of the sample that are counted apart.
PARTS = 4
BUCKETS = 1 << 15
#: Log-odds against clean that a stretch, and all stretches of a line together, must exceed.
STRETCH_ODDS, LINE_ODDS = 8.0, 16.0
#: Log-odds beyond which a stretch is garbled although no chain can be inverted: bytes were dropped on the way.
CERTAIN_ODDS = 40.0
#: Log-odds below the likeliest chain within which a chain is tried that has a character for almost any bytes.
UNPROVEN_GAP = 6.0
LOST = "�"
#: Share of the characters beyond ASCII from which on a page of 64 characters is a familiar one.
FAMILIAR = 5e-5

#: Chains of (true encoding, encoding it was read with), the first step first.
CHAINS: list[tuple[tuple[str, str], ...]] = [
    *[(("utf-8", wrong),) for wrong in ("latin-1", "cp1252", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "koi8-r", "gbk", "shift_jis")],
    *[(("utf-8", wrong), ("utf-8", wrong)) for wrong in ("latin-1", "cp1252")],
    (("utf-8", "latin-1 stripped"),),
    *[(("cp1251", wrong),) for wrong in ("latin-1", "koi8-r")],
    *[(("koi8-r", wrong),) for wrong in ("latin-1", "cp1251")],
    *[(("cp866", wrong),) for wrong in ("cp437", "cp1252", "cp1251")],
    *[(("gbk", wrong),) for wrong in ("latin-1", "cp1252", "utf-8")],
    *[(("euc_jp", wrong),) for wrong in ("latin-1", "utf-8")],
    *[(("shift_jis", wrong),) for wrong in ("latin-1", "cp1252", "utf-8")],
    *[((true, "latin-1"),) for true in ("iso8859-7", "iso8859-2", "cp1250")],
    *[(("cp1252", wrong),) for wrong in ("utf-8", "mac_roman", "cp850", "cp437", "cp1251", "cp1250")],
    *[(("mac_roman", wrong),) for wrong in ("cp1252", "latin-1", "utf-8")],
    *[((true, "cp1252"),) for true in ("cp850", "cp1250")],
    *[(("cp852", wrong),) for wrong in ("cp437", "cp850", "cp1250", "cp1252")],
    *[((true, "utf-8"),) for true in ("cp1251", "iso8859-7", "cp1250")],
]
#: Latin-1 from which the control characters were then removed, as many tools do.
STRIPPED = "latin-1 stripped"
WIDE = {"utf-8", "gbk", "shift_jis", "euc_jp"}

#: UTF-8 that may lack bytes from 0x80 to 0x9f.
HOLED = re.compile(rb"(?:[\x00-\x7f]|[\xc2-\xdf][\xa0-\xbf]?|[\xe0-\xef][\xa0-\xbf]{0,2}|[\xf0-\xf4][\xa0-\xbf]{0,3})+")
#: A stretch: characters beyond ASCII with at most two visible ASCII characters between them.
STRETCH = re.compile(r"[^\x00-\x7f](?:[\x21-\x7e]{0,2}[^\x00-\x7f])*")


@lru_cache(None)
def _table(encoding: str) -> tuple[dict[int, str], dict[str, int]]:
    """Bytes to characters and back; a byte without character stands for the control character of its number."""
    to = {}
    for b in range(256):
        try:
            to[b] = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            to[b] = chr(b)
    return to, {c: b for b, c in to.items()}


def garble(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """``text`` after the chain; null where the true encoding does not have its characters."""
    for true, wrong in chain:
        try:
            raw = text.encode(true)
        except UnicodeEncodeError:
            return None
        if wrong == STRIPPED:
            text = re.sub("[\x80-\x9f]", "", raw.decode("latin-1"))
            continue
        text = raw.decode(wrong, "replace") if wrong in WIDE else raw.decode("latin-1").translate(_table(wrong)[0])
    return text


def restore(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The text before the chain; null unless each step decodes strictly."""
    for true, wrong in reversed(chain):
        if wrong == STRIPPED:
            return None
        try:
            if wrong in WIDE:
                raw = text.encode(wrong)
            else:
                back = _table(wrong)[1]
                raw = bytes([back[c] for c in text])
            text = raw.decode(true) if true in WIDE else raw.decode("latin-1").translate(_table(true)[0])
        except (UnicodeError, KeyError):
            return None
    return text


def _lost(text: str, chain: tuple[tuple[str, str], ...]) -> bool:
    """Whether ``text`` can be what the chain left when bytes were lost."""
    if chain[-1][1] != STRIPPED:
        return LOST in text and any(wrong in WIDE for _, wrong in chain)
    try:
        raw = text.encode("latin-1")
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return bool(HOLED.fullmatch(raw))
    except UnicodeEncodeError:
        pass
    return False


def bigrams(text: str) -> np.ndarray:
    """Hashed byte bigrams."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    return ((raw[:-1] * 257 + raw[1:]) * np.uint32(2654435761)) >> np.uint32(17)


def stretches(line: str) -> Iterator[tuple[int, int]]:
    """Spans of the stretches of a line; long ones in parts, so that a garbled part does not hide in a clean one."""
    for m in STRETCH.finditer(line):
        for at in range(m.start(), m.end(), 24):
            yield at, min(at + 24, m.end())


def _assigned(text: str) -> bool:
    """Whether all characters beyond ASCII are assigned ones of text: no controls, surrogates or private ones."""
    return all(c < "\x80" or unicodedata.category(c) not in ("Cc", "Cn", "Co", "Cs") for c in text)


def _around(line: str, start: int, end: int) -> str:
    return (line[start - 1] if start else " ") + line[start:end] + (line[end] if end < len(line) else " ")


def class_counts(lines: list[str], k: int) -> tuple[np.ndarray, Counter]:
    """How often each bigram occurs in the stretches of ``lines`` after the k-th chain (0: as they are), and pages of characters."""
    chain = CHAINS[k - 1] if k else ()
    texts = []
    for line in lines:
        text = garble(line, chain) if chain else line
        if text is not None and (not chain or text != line):
            texts += [_around(text, s, e) for s, e in stretches(text)]
    # A line end keeps the bigrams of neighbouring stretches apart.
    counts = np.bincount(bigrams("\n".join(texts)), minlength=BUCKETS) if texts else np.zeros(BUCKETS, np.int64)
    return counts, Counter(ord(c) >> 6 for t in texts for c in t) if not k else Counter()


class EncodingClassifier:
    """Log-odds of each chain against clean, per bigram; and the character pages that clean text has."""

    def __init__(self, counts: np.ndarray, pages: Counter) -> None:
        """From the counts of each class (clean first) by bigram, and the pages of the clean texts."""
        self.known: dict[str, tuple] = {}
        self.pages = {p for p, n in pages.items() if n > FAMILIAR * pages.total()}
        # All classes are counted over the same lines, so their rates compare although few lines fit some encodings.
        rates = np.log((counts + 0.5) / (counts[0] + 0.5).sum())
        self.odds = (rates[1:] - rates[0]).T.astype(np.float32)

    def _familiar(self, text: str) -> bool:
        return all(ord(c) < 128 or ord(c) >> 6 in self.pages for c in text)

    def scores(self, text: str) -> np.ndarray:
        return self.odds[bigrams(text)].sum(0)

    def _inverse(self, line: str, start: int, end: int, chain: tuple) -> tuple[int, int, str] | None:
        """The inverse of a stretch, which may begin or end within a character of its bytes; a familiar one if there is one."""
        other = None
        if LOST in line[start:end] and chain[-1][1] == "utf-8":
            return None
        for s, e in ((start, end), (start, end + 1), (start - 1, end), (start - 1, end + 1), *((start + i, end - j) for i in range(3) for j in range(3) if i + j)):
            if 0 <= s < e <= len(line) and LOST not in line[s:e]:
                before = restore(line[s:e], chain)
                if before is not None and before != line[s:e] and _assigned(before):
                    if self._familiar(before):
                        return s, e, before
                    other = other or (s, e, before)
        return other

    def _judge(self, line: str, start: int, end: int, odds: np.ndarray, least: float) -> tuple | None:
        """(chain, start, end, original or null) if a chain is likelier than clean by ``least`` and holds."""
        other, proven = None, False
        order = odds.argsort()[::-1]
        for k in order:
            if odds[k] < least:
                break
            if odds[k] < odds[order[0]] - UNPROVEN_GAP and CHAINS[k][0][0] != "utf-8":
                continue
            found = self._inverse(line, start, end, CHAINS[k])
            if found and self._familiar(found[2]):
                return (int(k), *found)
            # Where the inverse cannot tell, every bigram must speak for the chain, or all together clearly.
            clear = odds[k] > 2 * STRETCH_ODDS or self.odds[bigrams(_around(line, start, end)), k].min() > 0.05
            if found:
                # Only UTF-8 proves itself: the other encodings have a character for almost any bytes.
                proof = CHAINS[k][0][0] == "utf-8"
                if proof > proven if other else proof or odds[k] > CERTAIN_ODDS:
                    other, proven = (int(k), *found), proof
            elif other is None and _lost(line[start:end], CHAINS[k]) and (LOST in line[start:end] or clear):
                return int(k), start, end, None
        best = int(order[0])
        if not proven and odds[best] > CERTAIN_ODDS:
            # Characters that the sample lacks say little for their own chain, but whatever is garbled may prove itself.
            for k in order:
                if odds[k] < least and CHAINS[k][0][0] == "utf-8" and (found := self._inverse(line, start, end, CHAINS[k])):
                    return (int(k), *found)
        if other:
            return other
        return (best, start, end, None) if odds[best] > CERTAIN_ODDS else None

    def _widened(self, line: str, first: int, last: int, verdicts: list[tuple | None]) -> list[tuple | None]:
        """Verdicts without inverse once more over all neighbouring characters that the wrong encoding has.

        A part may begin or end within the bytes of a character, or stand beside clean text in one stretch.
        """
        out: list[tuple | None] = []
        done = first
        for v in verdicts:
            if v is None or v[1] < done:
                out.append(v if v is None else None)
                continue
            k, s, e, original = v
            wrong = CHAINS[k][-1][1]
            if original is None and wrong not in WIDE and wrong != STRIPPED:
                has = _table(wrong)[1]
                while s > done and line[s - 1] in has:
                    s -= 1
                while e < last and line[e] in has:
                    e += 1
                found = self._inverse(line, s, e, CHAINS[k])
                v = (k, *found) if found else v
            out.append(v)
            done = v[2]
        return out

    def faults(self, line: str) -> list[tuple]:
        """(chain, start, end, original or null) of the garbled places of a line."""
        if line.isascii():
            return []
        found, rest, total = [], [], np.zeros(len(CHAINS), np.float32)
        for m in STRETCH.finditer(line):
            whole = self._known(_around(line, m.start(), m.end()))
            if whole is None:
                parts = [(at, min(at + 24, m.end())) for at in range(m.start(), m.end(), 24)]
                odds = [self.scores(_around(line, *p)) for p in parts]
                verdicts = [self._judge(line, *p, o, STRETCH_ODDS) for p, o in zip(parts, odds, strict=True)]
                verdicts = self._widened(line, m.start(), m.end(), verdicts)
                own = sum(odds)
                if len(parts) > 1 and (one := self._judge(line, m.start(), m.end(), own, STRETCH_ODDS)) and one[3] is not None:
                    verdicts = [one]
                # Kept relative to the stretch, as it may come again elsewhere.
                whole = own, [(k, s - m.start(), e - m.start(), t) for k, s, e, t in filter(None, verdicts)]
                if m.end() - m.start() <= 40:
                    if len(self.known) > 200_000:
                        self.known.clear()
                    self.known[_around(line, m.start(), m.end())] = whole
            own, verdicts = whole
            if verdicts:
                found += [(k, m.start() + s, m.start() + e, t) for k, s, e, t in verdicts]
            else:
                rest.append((m.start(), m.end()))
                total += own
        if rest:
            best = int(total.argmax())
            if total[best] > LINE_ODDS:
                inverses = [self._inverse(line, s, e, CHAINS[best]) for s, e in rest]
                if CHAINS[best][0][0] != "utf-8" and total[best] <= CERTAIN_ODDS:
                    inverses = [x if x and self._familiar(x[2]) else None for x in inverses]
                if sum(x is not None for x in inverses) * 2 > len(rest):
                    found += [(best, *x) for x in inverses if x]
        return found

    def _known(self, key: str) -> tuple | None:
        return self.known.get(key)

    def repair(self, text: str | None) -> tuple[list[str], str | None]:
        """The chains found in a text, and the text restored; no chains for a clean text, null where bytes are lost."""
        if not text or text.isascii():
            return [], None
        chains, lines, lost = [], text.split("\n"), False
        for n, line in enumerate(lines):
            end = len(line) + 1
            for k, s, e, original in sorted(self.faults(line), key=lambda f: -f[1]):
                chains.append(" ".join(f"{t}>{w}" for t, w in CHAINS[k]))
                if original is None:
                    lost = True
                elif e <= end:
                    lines[n] = lines[n][:s] + original + lines[n][e:]
                    end = s
        return sorted(set(chains)), None if lost or not chains else "\n".join(lines)


def fitted(spark: SparkSession, lines: list[str]) -> EncodingClassifier:
    """A classifier of ``lines``, whose garbled examples are made and counted in tasks."""
    import pyarrow as pa

    sc = spark.sparkContext
    shared = sc.broadcast(lines)  # at most SAMPLE lines of LINE characters

    def model(kept: list[int] | None) -> EncodingClassifier:
        chosen = sc.broadcast(kept)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            every = shared.value if chosen.value is None else [shared.value[i] for i in chosen.value]
            for batch in batches:
                for at in batch.column(0).to_pylist():
                    counts, pages = class_counts(every[at % PARTS :: PARTS], at // PARTS)
                    held = np.flatnonzero(counts)
                    sums = [np.array(list(x), np.int64).tobytes() for x in (held, counts[held], pages.keys(), pages.values())]
                    yield pa.RecordBatch.from_arrays([pa.array([at // PARTS]), *(pa.array([x], pa.binary()) for x in sums)], ["k", "bigrams", "counts", "pages", "uses"])

        units = (len(CHAINS) + 1) * PARTS
        counts, pages = np.zeros((len(CHAINS) + 1, BUCKETS)), Counter()
        rows = spark.range(0, units, 1, units).mapInArrow(count, "k bigint, bigrams binary, counts binary, pages binary, uses binary")
        for k, *sums in rows.collect():  # a row per chain and part, of at most BUCKETS entries
            bigram, n, page, uses = (np.frombuffer(x, np.int64) for x in sums)
            counts[k, bigram] += n
            pages.update(dict(zip(page.tolist(), uses.tolist(), strict=True)))
        return EncodingClassifier(counts, pages)

    first = sc.broadcast(model(None))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not first.value.faults(shared.value[i]) for i in batch.column(0).to_pylist()], pa.bool_()))

    tasks = 2 * sc.defaultParallelism
    kept = [r[0] for r in spark.range(0, len(lines), 1, tasks).mapInArrow(clean, "id bigint").collect()]
    return model(sorted(kept)) if kept else first.value


def fit_classifier(documents: DataFrame, key: str = "doc_id", text: str = "text") -> EncodingClassifier:
    """A classifier of the texts' own languages, from a seeded sample of at most ``SAMPLE`` lines beyond ASCII.

    Lines are drawn by their place, not by their content, so frequent lines have their share of the sample.
    """
    lines = documents.select(F.col(key).alias("key"), F.posexplode(F.split(text, "\n")).alias("at", "whole")).filter(r"whole rlike '[^\\x00-\\x7f]'")
    starts = F.sequence(F.lit(1), F.greatest(F.length("whole"), F.lit(1)), F.lit(LINE))
    parts = lines.select("key", "at", F.explode(F.transform(starts, lambda i: F.struct(i.alias("start"), F.substring("whole", i, F.lit(LINE)).alias("line")))).alias("p"))
    parts = parts.select("key", "at", "p.start", "p.line").filter(r"line rlike '[^\\x00-\\x7f]'")
    sample = bounded_sample(parts, F.xxhash64("key", "at", "start", F.lit(SEED)), parts.count(), SAMPLE)
    return fitted(documents.sparkSession, [r["line"] for r in sample])


def repaired(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, chains and restored of every garbled text of ``documents``."""
    import pyarrow as pa

    model = documents.sparkSession.sparkContext.broadcast(fit_classifier(documents, key, text))

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, chains, texts = [], [], []
            for row, value in enumerate(batch.column(1)):
                found, restored = model.value.repair(value.as_py())
                if found:
                    rows.append(row)
                    chains.append(found)
                    texts.append(restored)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(chains, pa.list_(pa.string())), pa.array(texts, pa.string())], [key, "chains", "restored"]
            )

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(repair, f"`{key}` {kind}, chains array<string>, restored string")
