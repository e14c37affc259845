"""Benchmark decontamination: q-gram counts in overlapping diagonal bands, verified by banded alignment."""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Characters to a q-gram, and edits for each hundred characters of an item that a region may have.
Q, EDITS = 8, 10
#: Characters of benchmark text that are searched for in one pass over the documents.
BLOCK_CHARS = 2_000_000
#: Alignments that are worked out side by side, and the most cells of text that they hold; hits that are counted at a time.
ALIGNED, ALIGNED_CELLS, HITS = 128, 1 << 22, 1 << 20
#: Characters of documents that are searched together, or a longer one alone.
ROUND_CHARS = 1 << 20

_ORIGIN = 1 << 20
_FAR = 1 << 50


def normal(text: str | None) -> str:
    """Lower case, one space for each run of white space."""
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def qgrams(chars: np.ndarray) -> np.ndarray:
    """A 32-bit hash of each eight characters. Equal hashes of unequal q-grams only add candidates."""
    if len(chars) < Q:
        return np.empty(0, np.uint32)
    h = chars * np.uint32(0x9E3779B1)
    h = h[:-1] * np.uint32(0x85EBCA6B) + h[1:]
    h = h[:-2] * np.uint32(0xC2B2AE35) + h[2:]
    return h[:-4] * np.uint32(0x27D4EB2F) + h[4:]


def edit_budget(length: int) -> int:
    """Edits that an item may have: EDITS in a hundred, but no more than leave one q-gram whole."""
    return max(0, min(length * EDITS // 100, (length - Q) // Q))


@dataclass
class Block:
    """Items of the benchmark and their q-grams."""

    ids: list[int]
    texts: list[str]

    def __post_init__(self):
        self.chars = [codes(t) for t in self.texts]
        lengths = np.array([len(c) for c in self.chars], np.int64)
        self.lengths = lengths
        self.budget = np.array([edit_budget(n) for n in lengths], np.int64)
        #: The q-gram lemma: so many q-grams outlast the edits.
        self.least = lengths - Q + 1 - Q * self.budget
        #: A bin of diagonals is wider than the budget, so two neighbouring bins hold any alignment's q-grams.
        self.shift = np.array([int(k).bit_length() for k in self.budget], np.int64)
        grams = [qgrams(c) for c in self.chars]
        flat = np.concatenate([np.empty(0, np.uint32), *grams])
        order = np.argsort(flat, kind="stable")
        self.hashes, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.place = np.concatenate([np.empty(0, np.int64), *(np.arange(len(g)) for g in grams)])[order]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.hashes >> 10] = True
        self.short = [n for n, size in enumerate(lengths) if size < Q]

    def candidates(self, chars: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Rows (doc, item, first diagonal, shared q-grams) of bands that meet the lemma; ``starts`` are the documents' first characters."""
        grams = qgrams(chars)
        at = np.flatnonzero(self.bits[grams >> 10])
        found = np.searchsorted(self.hashes, grams[at])
        found[found == len(self.hashes)] = 0
        same = self.hashes[found] == grams[at] if len(self.hashes) else np.zeros(0, bool)
        at, found = at[same], found[same]
        # Hits (a place of the text and one of an item) are counted HITS at a time: text and item may repeat one q-gram throughout.
        count = self.count[found]
        ends = np.cumsum(count)
        parts = []
        first = 0
        while first < len(at):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] - count[first] + HITS, "right")))
            some, n = found[first:last], count[first:last]
            index = np.repeat(self.first[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            where = np.repeat(at[first:last], n)
            item = self.item[index]
            doc = np.searchsorted(starts, where, "right") - 1
            diagonal = where - starts[doc] - self.place[index] + self.lengths[item]  # never negative
            parts.append(np.unique(((doc * len(self.ids) + item) << 32) | (diagonal >> self.shift[item]), return_counts=True))
            first = last
        if not parts:
            return np.empty((0, 4), np.int64)
        keys, shared = parts[0]
        if len(parts) > 1:
            keys, of = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            shared = np.bincount(of, weights=np.concatenate([n for _, n in parts])).astype(np.int64)
        after = np.zeros_like(shared)
        after[:-1] = np.where(keys[1:] == keys[:-1] + 1, shared[1:], 0)
        before = np.zeros_like(shared)
        before[1:] = np.where(keys[1:] == keys[:-1] + 1, shared[:-1], 0)
        item = (keys >> 32) % len(self.ids)
        # The band of this bin and the next; a bin that has neither neighbour is such a band, too. The second test
        # leaves out a band that adds nothing to the one before it.
        good = (shared + after >= self.least[item]) & ((after > 0) | (before == 0))
        keys, item, shared = keys[good], item[good], (shared + after)[good]
        low = ((keys & 0xFFFFFFFF) << self.shift[item]) - self.lengths[item]
        return np.stack([(keys >> 32) // len(self.ids), item, low, shared], 1)

    def align(self, docs: list[np.ndarray], found: np.ndarray) -> np.ndarray:
        """(edits, start, end) of the best alignment inside each candidate's band; edits is large if none is within budget."""
        doc, item, low = found[:, 0], found[:, 1], found[:, 2]
        budget = self.budget[item]
        low = low - budget
        width = int((2 * (1 << self.shift[item]) + 2 * budget).max())
        longest = int(self.lengths[item].max())
        lengths = np.array([len(docs[d]) for d in doc])
        text = np.full((len(found), longest + width + 1), 0xFFFFFFFF, np.uint32)
        pattern = np.full((len(found), longest), 0xFFFFFFFE, np.uint32)
        for n, (d, i, at) in enumerate(zip(doc, item, low, strict=True)):
            a, b = max(0, at), min(lengths[n], at + text.shape[1])
            if b > a:
                text[n, a - at : b - at] = docs[d][a:b]
            pattern[n, : self.lengths[i]] = self.chars[i]
        steps = np.arange(width)
        ramp = steps * _ORIGIN
        # cost: edits in the high bits, the diagonal on which the alignment starts in the low ones. column: characters
        # of the text used so far on each diagonal.
        column = low[:, None] + steps
        cost = np.where((column >= 0) & (column <= lengths[:, None]), steps[None, :], _FAR)
        best = np.full((len(found), 3), _FAR)
        for row in range(1, longest + 1):
            column = column + 1
            inside = (column >= 0) & (column <= lengths[:, None])
            # A character of the item without one of the text comes from the next diagonal of the row before.
            skipped = np.full_like(cost, _FAR)
            skipped[:, :-1] = cost[:, 1:] + _ORIGIN
            met = cost + np.where(text[:, row - 1 : row - 1 + width] == pattern[:, row - 1 : row], 0, _ORIGIN)
            cost = np.where(inside, np.minimum(met, skipped), _FAR)
            cost = np.where(inside, np.minimum.accumulate(cost - ramp, axis=1) + ramp, _FAR)
            for n in np.flatnonzero(self.lengths[item] == row):
                at = int(np.argmin(cost[n]))
                edits, origin = int(cost[n, at]) // _ORIGIN, int(cost[n, at]) % _ORIGIN
                best[n] = (edits, low[n] + origin, low[n] + row + at)
        return best

    def regions(self, texts: list[str]) -> list[tuple[int, int, int, int, int, int]]:
        """(text number, item id, start, end, edits, shared q-grams) of all regions, without overlap for each item."""
        docs = [codes(t) for t in texts]
        sizes = np.array([len(d) + 1 for d in docs], np.int64)
        starts = np.cumsum(sizes) - sizes
        gap = np.array([0x110000], np.uint32)
        chars = np.concatenate([x for d in docs for x in (d, gap)]) if docs else np.empty(0, np.uint32)
        found = self.candidates(chars, starts)
        rows = []
        order = np.argsort(self.lengths[found[:, 1]], kind="stable")  # items of like lengths side by side
        found = found[order]
        k = 0
        while k < len(found):
            longest = self.lengths[found[min(k + ALIGNED, len(found)) - 1, 1]]
            some = found[k : k + max(1, min(ALIGNED, ALIGNED_CELLS // (2 * int(longest))))]
            k += len(some)
            for (d, i, _, shared), (edits, a, b) in zip(some.tolist(), self.align(docs, some).tolist(), strict=True):
                if edits <= self.budget[i]:
                    rows.append((d, i, edits, a, b, shared))
        for i in self.short:
            for d, t in enumerate(texts):
                at = t.find(self.texts[i])
                while at >= 0:
                    rows.append((d, i, 0, at, at + len(self.texts[i]), 0))
                    at = t.find(self.texts[i], at + len(self.texts[i]))
        kept: dict[tuple[int, int], list[tuple[int, int]]] = {}
        out = []
        for d, i, edits, a, b, shared in sorted(rows):
            spans = kept.setdefault((d, i), [])  # in order, without overlap
            n = bisect.bisect(spans, (a, b))
            if (n == 0 or spans[n - 1][1] <= a) and (n == len(spans) or b <= spans[n][0]):
                spans.insert(n, (a, b))
                out.append((d, self.ids[i], a, b, edits, shared))
        return out


def grouped(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts, made normal, of ROUND_CHARS characters or a longer one alone, each group with its first one's number."""
    held, first, size = [], 0, 0
    for n, t in enumerate(texts):
        made = normal(t)
        if held and size + len(made) > ROUND_CHARS:
            yield first, held
            held, first, size = [], n, 0
        held.append(made)
        size += len(made)
    if held:
        yield first, held


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Block]:
    """The benchmark in blocks of BLOCK_CHARS characters, whatever its size; null and blank items are left out."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).toLocalIterator()
    ids, texts, size = [], [], 0
    for r in rows:
        text = normal(r["t"])
        if not text:
            continue
        ids.append(r["i"])
        texts.append(text)
        size += len(text)
        if size >= BLOCK_CHARS:
            yield Block(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Block(ids, texts)


OUT = "doc_id long, item_id long, start int, end int, edits int, shared_qgrams int"


def regions(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each region of a document that is an item of the benchmark but for a few edits.

    Both sides are lower-cased and runs of white space made one space; start and end count characters of that
    text. A region has at most EDITS edits for each hundred characters of its item. By the q-gram lemma such a region shares
    at least length - Q + 1 - Q * edits q-grams with the item, on diagonals no further apart than the edits:
    they are counted in overlapping bands of diagonals, and the bands that meet the bound are verified by
    alignment inside the band. Items shorter than Q characters are found only unchanged. Of overlapping
    regions of one item the one with fewest edits stays. The benchmark is searched for in blocks of bounded
    size, one pass each. Memory follows ROUND_CHARS, HITS and the longest text and item, also where a text repeats a
    q-gram of an item throughout; the time of an alignment grows with the square of an item's length. Null and empty texts have no regions; repeated documents and items give repeated
    rows. Only the named columns are read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = spark.createDataFrame([], OUT)
    for block in blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            for batch in batches:
                found = [(first + d, *rest) for first, some in grouped(batch.column("text").to_pylist()) for d, *rest in shared.value.regions(some)]
                ids = batch.column("doc_id").take(pa.array([r[0] for r in found], pa.int64()))
                rest = [pa.array([r[c] for r in found], pa.int64() if c == 1 else pa.int32()) for c in range(1, 6)]
                yield pa.RecordBatch.from_arrays([ids, *rest], ["doc_id", "item_id", "start", "end", "edits", "shared_qgrams"])

        out = out.unionByName(rows.mapInArrow(run, OUT))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows in which ``regions`` finds anything; nothing is shuffled."""
    spark = docs.sparkSession
    small_batches(spark)
    for block in blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for first, some in grouped(batch.column(text_col).to_pylist()):
                    keep[[first + r[0] for r in shared.value.regions(some)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
