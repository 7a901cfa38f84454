"""Periodic runs of words, found by internal pattern matching.

A run is a stretch of words with smallest period q that is at least
``exponent`` (4 or more) times q long and that no neighbouring word extends. For
2**k <= q < 2**(k+1), one of the first 2**k words of a run starts a dyadic
block of 2**k words, and the block occurs again q words later. So, for each
block that its document holds three times or more, its occurrences in the
neighbouring window (2**k to 2**(k+1) words on) are asked for; two that follow
closely make a progression with the block's own period, and then the ends of
the two stretches with that period give the only further candidate. Each
candidate period is held against the words and extended both ways.

Occurrences: the suffixes of a batch of documents are sorted by prefix doubling
(the words of each document are symbols of its own, so no match crosses a
document), which gives every block its interval of the suffix array; a wavelet
tree over the suffix array answers range successor: the first suffix of the
interval at or after a word. The ranks of the blocks of each size give the
extensions. All documents of a batch advance together, level by level.

Every document is one row and is handled in one task, with the words of its
batch: at most 1 MB of text, or one longer document. Memory is about 4 bytes a
word for each level, the logarithm of a quarter of the longest document.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text; null and
empty texts have no words and no runs; null, repeated and equal rows are handled
row by row; runs come by start, then period; a word that follows the first
period of any run is dropped from ``collapsed``, whose words are joined by one
space; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_BYTES, batches_of, ship_package, text_or_empty

_ROWS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class WaveletTree:
    """Range successor over an array of numbers below ``2**bits`` (level by level, zeros before ones)."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for bit in range(bits - 1, -1, -1):
            one = (values >> bit & 1).astype(bool)
            ones = np.zeros(len(values) + 1, np.int32)
            np.cumsum(one, out=ones[1:])
            self.levels.append((bit, ones, len(values) - int(ones[-1])))
            values = np.concatenate([values[~one], values[one]])

    def below(self, left: np.ndarray, right: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many numbers of ``[left, right)`` are smaller than ``bound``."""
        found = np.zeros(len(left), np.int64)
        for bit, ones, zeros in self.levels:
            one = (bound >> bit & 1).astype(bool)
            a, b = ones[left], ones[right]
            found += np.where(one, (right - b) - (left - a), 0)
            left, right = np.where(one, zeros + a, left - a), np.where(one, zeros + b, right - b)
        return found

    def smallest(self, left: np.ndarray, right: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The ``nth`` smallest number of ``[left, right)``, from 0."""
        value = np.zeros(len(left), np.int64)
        for bit, ones, zeros in self.levels:
            a, b = ones[left], ones[right]
            low = (right - b) - (left - a)
            one = nth >= low
            nth = nth - np.where(one, low, 0)
            value += one.astype(np.int64) << bit
            left, right = np.where(one, zeros + a, left - a), np.where(one, zeros + b, right - b)
        return value

    def successor(self, left: np.ndarray, right: np.ndarray, bound: np.ndarray, none: int) -> np.ndarray:
        """The smallest number of ``[left, right)`` that is at least ``bound`` (itself a possible number), or ``none``."""
        nth = self.below(left, right, bound)
        out = np.full(len(left), none, np.int64)
        hit = np.flatnonzero(nth < right - left)
        out[hit] = self.smallest(left[hit], right[hit], nth[hit])
        return out


class Factors:
    """The suffixes of ``symbols`` sorted by their first 2**k symbols, and the ranks of the blocks of each size."""

    def __init__(self, symbols: np.ndarray, levels: int):
        n = self.n = len(symbols)
        self.order = np.argsort(symbols).astype(np.int32)
        ahead = symbols[self.order]
        fresh = np.ones(n, bool)  # suffixes that differ from the one before
        fresh[1:] = ahead[1:] != ahead[:-1]
        self.ranks: list[np.ndarray] = []
        self.intervals: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        slots = np.arange(n)  # whose suffixes may still change places
        rank = np.full(n + 1, -1, np.int32)
        for k in range(levels + 1):
            if k:
                at = self.order[slots]
                key = rank[at].astype(np.int64) * (n + 1) + rank[np.minimum(at + (1 << k - 1), n)] + 1
                by = np.argsort(key)
                self.order[slots], key = at[by], key[by]
                fresh[slots[1:]] |= key[1:] != key[:-1]
                rank = rank.copy()
            first = np.flatnonzero(fresh)
            size = np.diff(np.append(first, n))
            rank[self.order[slots]] = np.repeat(first, size)[slots]
            self.ranks.append(rank)
            often = np.flatnonzero(np.repeat(size > 2, size))  # a run holds its block three times
            starts = self.order[often]
            left = rank[starts]
            self.intervals.append((starts, left, left + np.repeat(size, size)[often]))
            slots = np.flatnonzero(np.repeat(size > 1, size))
            if not len(often):
                break

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from ``a`` on are those from ``b`` on (a < b)."""
        far = np.zeros(len(a), np.int64)

        def same(k, i):
            return self.ranks[k][np.minimum(a[i] + far[i], self.n)] == self.ranks[k][np.minimum(b[i] + far[i], self.n)]

        return self._extend(far, same)

    def back(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols before ``a`` are those before ``b`` (a < b)."""
        far = np.zeros(len(a), np.int64)

        def same(k, i):
            left = a[i] - far[i] - (1 << k)
            return (left >= 0) & (self.ranks[k][np.maximum(left, 0)] == self.ranks[k][np.maximum(b[i] - far[i] - (1 << k), 0)])

        return self._extend(far, same)

    def _extend(self, far: np.ndarray, same) -> np.ndarray:
        i = np.arange(len(far))
        top = len(self.ranks) - 1
        while len(i):  # blocks of the largest size, as many as match
            i = i[same(top, i)]
            far[i] += 1 << top
        i = np.arange(len(far))
        for k in range(top - 1, -1, -1):
            hit = i[same(k, i)]
            far[hit] += 1 << k
        return far


def find_runs(symbols: np.ndarray, ends: np.ndarray, exponent: int = 4, shortest: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs in documents laid end to end, by start, then period.

    ``symbols`` of different documents must differ; ``ends[i]`` is where the
    document of word ``i`` ends.
    """
    if exponent < 4:
        raise ValueError("blocks find runs of four periods or more")
    empty = np.zeros(0, np.int64)
    n = len(symbols)
    if not n:
        return empty, empty, empty
    starts = np.flatnonzero(np.diff(ends, prepend=-1))  # of documents
    longest = int((ends[starts] - starts).max())
    made = Factors(symbols, max(0, (longest // 4).bit_length() - 1))
    tree = None
    found = []
    for k, (block, left, right) in enumerate(made.intervals):
        size = 1 << k
        if k == 0:  # the window of one word is the next word
            first = np.flatnonzero(symbols[1:] == symbols[:-1])
            found.append((first, np.ones(len(first), np.int64)))
            continue
        fits = (block % size == 0) & (block + 3 * size <= ends[block])
        block, left, right = (x[fits].astype(np.int64) for x in (block, left, right))
        if not len(block):
            continue
        tree = tree or WaveletTree(made.order, max(1, n.bit_length()))
        one = tree.successor(left, right, block + size, n)
        hit = one < block + 2 * size
        block, left, right, one = block[hit], left[hit], right[hit], one[hit]
        found.append((block, one - block))
        two = tree.successor(left, right, one + 1, n)
        hit = two < block + 2 * size
        block, one, two = block[hit], one[hit], two[hit]
        found.append((block, two - block))
        step = two - one  # of the progression: both stretches with this period end the same way one period apart
        period = (one + made.ahead(one, two)) - (block + made.ahead(block, block + step))
        hit = (period >= size) & (period < 2 * size)
        found.append((block[hit], period[hit]))
    at, period = (np.concatenate(x) for x in zip(*found, strict=True))
    end = at + period + made.ahead(at, at + period)
    start = at - made.back(at, at + period)
    long = end - start >= np.maximum(shortest, exponent * period)
    runs = np.unique(np.stack([start[long], end[long], period[long]], 1), axis=0)
    smallest = np.ones(len(runs), bool)  # a multiple of a run's period gives the same stretch
    smallest[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[smallest]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return runs[:, 0], runs[:, 1], runs[:, 2]


def _run(exponent: int, shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, TEXT_BYTES):
            cut = [t.split() for t in batch.column("text").cast(pa.binary()).to_pylist()]  # of bytes: at 0x20 and 0x09-0x0D only
            sizes = np.fromiter(map(len, cut), np.int64, len(cut))
            ends = np.cumsum(sizes)
            firsts = ends - sizes
            number: dict[bytes, int] = defaultdict(count().__next__)
            words = np.fromiter(map(number.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
            doc = np.repeat(np.arange(len(cut)), sizes)
            start, end, period = find_runs(doc * (len(number) + 1) + words, ends[doc], exponent, shortest)
            drops = np.zeros(len(words) + 1, np.int64)
            np.add.at(drops, start + period, 1)
            np.add.at(drops, end, -1)
            kept = np.cumsum(drops)[:-1] == 0
            owner = doc[start] if len(start) else start
            collapsed = [b" ".join(w) for w in cut]
            for d in np.unique(owner).tolist():
                collapsed[d] = b" ".join(compress(cut[d], kept[firsts[d]:ends[d]].tolist()))
            runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - firsts[owner], end - start, period)], ["start", "length", "period"])
            offsets = np.searchsorted(owner, np.arange(len(cut) + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs),
                 pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, exponent: int = 4, shortest: int = 6) -> DataFrame:
    """The runs of each text of ``docs`` (doc_id, text) and the text with repeats of a period taken out."""
    ship_package(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return texts.mapInArrow(_run(exponent, shortest), _ROWS)
