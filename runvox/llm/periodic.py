"""Periodic runs of words by internal pattern matching.

The texts of a slice are put behind each other, with a separator that occurs once between them. Ranks of all word blocks
of doubled length (a dictionary of basic factors) give the suffix array; a wavelet matrix over it answers which
occurrence of a block comes next before and behind a place.

Blocks start at multiples of their length ``L``, a power of two. A run with period ``q`` and at least ``4 * q`` words
holds, for the ``L`` with ``q <= L < 2 * q``, a whole block whose next occurrence on one of its sides is ``q`` words
away: occurrences of a block inside a run are a progression with difference ``q``, as the block is not shorter than the
period. So the nearest neighbours within ``L`` words give every period, and as they are nearest, no smaller one is
hidden in it. Each candidate is extended to both sides by comparing blocks from the longest down.

Work and memory are ``n log n`` in the words of a slice (about one MB of text, or one longer text); nothing depends on
how often anything repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runvox.llm.words import SPACE, Words, binary, slices

LEAST_LENGTH, LEAST_EXPONENT = 6, 4


class Wavelet:
    """Order statistics of ranges of a sequence of numbers from 0 to ``len - 1``, for many ranges at once."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.ones = []
        for b in range(self.bits - 1, -1, -1):
            bit = ((values >> b) & 1).astype(bool)
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            values = np.concatenate((values[~bit], values[bit]))

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of each range are smaller than ``x``."""
        count = np.zeros(len(lo), np.int64)
        for b, ones in zip(range(self.bits - 1, -1, -1), self.ones, strict=True):
            one_lo, one_hi = ones[lo], ones[hi]
            up = ((x >> b) & 1).astype(bool)
            count += np.where(up, (hi - lo) - (one_hi - one_lo), 0)
            zeros = len(ones) - 1 - ones[-1]
            lo, hi = np.where(up, zeros + one_lo, lo - one_lo), np.where(up, zeros + one_hi, hi - one_hi)
        return count

    def nth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value with ``k`` smaller ones in each range."""
        value = np.zeros(len(lo), np.int64)
        for b, ones in zip(range(self.bits - 1, -1, -1), self.ones, strict=True):
            one_lo, one_hi = ones[lo], ones[hi]
            below = (hi - lo) - (one_hi - one_lo)
            up = k >= below
            value += np.where(up, 1 << b, 0)
            k = np.where(up, k - below, k)
            zeros = len(ones) - 1 - ones[-1]
            lo, hi = np.where(up, zeros + one_lo, lo - one_lo), np.where(up, zeros + one_hi, hi - one_hi)
        return value


def _ranks(words: np.ndarray) -> tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
    """(ranks, repeated) by level: how many blocks of ``2 ** level`` words are smaller than that of each place, and the
    places (with their number) whose block occurs elsewhere. Blocks that reach beyond the end occur once. The last
    ranks are all different: they are the inverse of the suffix array."""
    n = len(words)
    counts = np.bincount(words)
    rank = (np.cumsum(counts) - counts)[words].astype(np.int32)
    held = counts[words]
    active = np.flatnonzero(held > 1)
    ranks, repeated, size = [rank], [(active, held[active])], 1
    while len(active):
        behind = np.zeros(len(active), np.int64)
        inside = active + size < n
        behind[inside] = rank[active[inside] + size] + 1
        key = rank[active].astype(np.int64) * (n + 1) + behind
        order = np.argsort(key, kind="stable")
        key, active = key[order], active[order]
        old = rank[active]
        at = np.arange(len(key))
        block = np.concatenate(([True], key[1:] != key[:-1]))
        whole = np.concatenate(([True], old[1:] != old[:-1]))
        first = np.maximum.accumulate(np.where(block, at, 0))
        rank = rank.copy()
        rank[active] = old + (first - np.maximum.accumulate(np.where(whole, at, 0)))
        number = np.diff(np.append(np.flatnonzero(block), len(key)))
        held = np.repeat(number, number)
        active, held = active[held > 1], held[held > 1]
        size *= 2
        ranks.append(rank)
        repeated.append((active, held))
    return ranks, repeated


def _extended(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
    """How many words from ``i`` and ``j`` on (or before them) are equal."""
    n, off = len(ranks[0]), np.zeros(len(i), np.int64)
    for level in range(len(ranks) - 2, -1, -1):
        size, rank = 1 << level, ranks[level]
        if forward:
            a, b, inside = i + off, j + off, j + off + size <= n
        else:
            a, b, inside = i - off - size, j - off - size, i - off - size >= 0
        inside[inside] = rank[a[inside]] == rank[b[inside]]
        off += np.where(inside, size, 0)
    return off


def runs_of(words: np.ndarray, exponent: int = LEAST_EXPONENT, least: int = LEAST_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of a sequence of small numbers, by start, then period."""
    if exponent < LEAST_EXPONENT or least < LEAST_LENGTH:
        raise ValueError(f"blocks surely meet in runs of {LEAST_EXPONENT} periods and {LEAST_LENGTH} words or more")
    ranks, repeated = _ranks(words)
    asked = []
    for level in range(1, len(ranks)):
        active, held = repeated[level]
        here = (active & ((1 << level) - 1)) == 0
        p = active[here]
        lo = ranks[level][p].astype(np.int64)
        asked.append((p, lo, lo + held[here], np.full(len(p), 1 << level)))
    none = np.zeros(0, np.int64)
    if not asked or not sum(len(a[0]) for a in asked):
        return none, none, none
    p, lo, hi, size = (np.concatenate(x) for x in zip(*asked, strict=True))
    suffixes = np.empty(len(words), np.int32)
    suffixes[ranks[-1]] = np.arange(len(words), dtype=np.int32)
    tree = Wavelet(suffixes)
    before = tree.below(lo, hi, p)
    left, right = [], []
    for has, k in ((before > 0, before - 1), (before + 1 < hi - lo, before + 1)):
        q = p[has]
        other = tree.nth(lo[has], hi[has], k[has])
        d = np.abs(other - q)
        fits = (d <= size[has]) & ((2 * d > size[has]) | (size[has] == 2))
        left.append(np.minimum(q, other)[fits])
        right.append(np.maximum(q, other)[fits])
    i, j = np.concatenate(left), np.concatenate(right)
    start = i - _extended(ranks, i, j, forward=False)
    period = j - i
    length = j + _extended(ranks, i, j, forward=True) - start
    long = length >= np.maximum(least, exponent * period)
    found = np.unique(np.stack((start[long], period[long], length[long]), axis=1), axis=0)
    return found[:, 0], found[:, 2], found[:, 1]


def _numbered(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, first): equal words of the texts have equal numbers, every text ends with a number of its own."""
    size = words.ends - words.starts
    data = np.frombuffer(words.blob, np.uint8)
    data = data[~SPACE[data]]
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    coded = column.dictionary_encode()
    own = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(words.counts)
    first = words.first + np.arange(n + 1)
    out = np.empty(len(own) + n, np.int64)
    out[first[1:] - 1] = len(coded.dictionary) + np.arange(n)
    out[np.arange(len(own)) + words.owner()] = own
    return out, first


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", exponent: int = LEAST_EXPONENT,
                  least: int = LEAST_LENGTH) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of ``docs``.

    ``runs``: (start, length, period) of every stretch of words with smallest period ``period`` and at least
    ``max(least, exponent * period)`` words that can't be extended, by start, then period; empty if there is none.
    ``collapsed``: the words joined by one space without those that repeat a run's first period. A null or empty text
    has no words, no runs and an empty ``collapsed``. Rows are judged by themselves, so ids may be null or repeat; other
    columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary(batch, "text")
            for a, b in slices(texts):
                words = Words(texts[a:b])
                numbers, first = _numbered(words)
                start, length, period = runs_of(numbers, exponent, least)
                owner = np.searchsorted(first, start, "right") - 1
                held = np.bincount(owner, minlength=b - a)
                shown = [b" ".join((t or b"").split()) for t in texts[a:b]]
                for i in np.flatnonzero(held).tolist():
                    change = np.zeros(words.counts[i] + 1, np.int64)
                    mine = owner == i
                    np.add.at(change, start[mine] + period[mine] - first[i], 1)
                    np.add.at(change, start[mine] + length[mine] - first[i], -1)
                    keep = (np.cumsum(change)[:-1] == 0).tolist()
                    shown[i] = b" ".join([w for w, k in zip(shown[i].split(), keep, strict=True) if k])
                parts = pa.StructArray.from_arrays(
                    [pa.array(start - first[owner]), pa.array(length), pa.array(period)], ["start", "length", "period"])
                offsets = pa.array(np.concatenate(([0], np.cumsum(held))).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(words.counts.astype(np.int64)),
                     pa.ListArray.from_arrays(offsets, parts), pa.array(shown, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
