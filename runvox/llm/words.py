"""Words, word hashes and shingles of whole texts, vectorised over Arrow batches.

A word is a maximal run of bytes other than space and 0x09-0x0D; UTF-8 never uses those bytes inside a character, so
bytes and code points split alike. Hashes have 64 bits and depend on the bytes of a word only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"
#: A batch is worked off in slices of about this many text bytes, so temporary arrays stay small.
SLICE_BYTES = 1 << 20

#: Which bytes separate words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 output bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * _A
    h = h ^ (h >> np.uint64(29))
    h = h * _B
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of several texts: byte spans in one buffer and the word range of each text."""

    def __init__(self, texts: list[bytes | None]) -> None:
        self.blob = b"\n".join(t or b"" for t in texts)
        sizes = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts))
        space = SPACE[np.frombuffer(self.blob, np.uint8)]
        edges = np.flatnonzero(np.diff(space, prepend=True, append=True))
        self.starts, self.ends = edges[0::2], edges[1::2]
        begins = np.concatenate(([0], np.cumsum(sizes + 1)))
        #: text i has the words first[i] .. first[i + 1]
        self.first = np.searchsorted(self.starts, begins)
        self.counts = np.diff(self.first)

    def head(self) -> np.ndarray:
        """The first 8 bytes of every word as a little-endian number (shorter words: zero bytes behind)."""
        return self._bytes_at(self.starts, np.minimum(self.ends - self.starts, 8))

    def _bytes_at(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        padded = np.frombuffer(self.blob + bytes(8), np.uint8)
        rows = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
        return rows[at].view("<u8").reshape(-1) & _MASK[length]

    def hashes(self, seed: int = 0) -> np.ndarray:
        """One 64-bit hash per word, of all its bytes."""
        length = self.ends - self.starts
        h = mixed(length.astype(np.uint64) + np.uint64(seed << 32))
        left, at, rows = length, self.starts, np.arange(len(length))
        while len(rows):
            h[rows] = mixed(h[rows] ^ (self._bytes_at(at, np.minimum(left, 8)) * _A))
            more = left > 8
            rows, at, left = rows[more], at[more] + 8, left[more] - 8
        return h

    def text(self, i: int) -> list[bytes]:
        """The words of one text as bytes."""
        a, b = self.first[i], self.first[i + 1]
        return [self.blob[s:e] for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist(), strict=True)]

    def owner(self) -> np.ndarray:
        """The text each word is in."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive values (``len(h) - width + 1`` of them, none if shorter).

    Runs are put together from runs of doubled width, so the work is ``log2(width)`` passes.
    """
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, size = None, 0, h, 1
    while True:
        if width & size:
            out = power[:n] if out is None else mixed(out * _B + power[done:done + n])
            done += size
        if done == width:
            return mixed(out + np.uint64(width))
        power = mixed(power[:len(power) - size] * _A + power[size:] + np.uint64(size))
        size *= 2


def shingles(words: Words, i: int, h: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct ``width``-word shingle hashes of text ``i``; the whole sequence if it has fewer words."""
    own = h[words.first[i]:words.first[i + 1]]
    if not len(own):
        return np.zeros(0, np.uint64)
    return np.unique(windows(own, min(width, len(own))))


def slices(texts: list[bytes | None], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes; a longer text makes a range of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or b"")
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def binary(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def longs(values) -> pa.Array:
    """Unsigned 64-bit values kept bit by bit in a signed column."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from one array per row."""
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat, kind))


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], most: int = 1 << 14) -> Iterator[pa.Table]:
    """Whole key groups of sorted batches, a few thousand rows at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < most:
            continue
        table = pa.Table.from_batches(held)
        last = [table.column(k)[-1].as_py() for k in keys]
        same = np.ones(table.num_rows, bool)
        for k, v in zip(keys, last, strict=True):
            same &= table.column(k).to_numpy() == v
        cut = table.num_rows - int(same.sum())
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        if table.num_rows:
            yield table


def packed(text: bytes | None) -> bytes:
    """A text in compressed form (null as empty)."""
    text = text or b""
    return len(text).to_bytes(8, "little") + (pa.compress(text, "zstd", asbytes=True) if text else b"")


def unpacked(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.decompress(pa.py_buffer(data).slice(8), size, "zstd", asbytes=True) if size else b""
