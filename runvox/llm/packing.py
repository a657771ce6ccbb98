"""Best-two-fit packing of tokenised documents into sequences of a fixed capacity.

A bin is filled greedily with the largest document that fits; then its smallest document gives way to two unpacked
ones as long as they fill the widened gap more tightly. Bins depend on lengths alone, and there are at most
``capacity`` lengths, so the plan is made on the histogram of lengths: a pattern of lengths is repeated as often as the
counts allow. The documents, ranked by length over the cluster, then take the places of the plan.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from runvox.llm.words import binary
from runvox.scale import materialise, ranked

CAPACITY = 4096
END_ID = 1
#: Words whose ids a Python worker remembers; beyond that it starts over.
REMEMBERED = 600_000
#: Letters without marks of their own, then ASCII signs other than the apostrophe: this tokenizer folds case and ends a
#: token between the two, so such a word has the ids of its lower-cased letters and those of its signs.
#: Each of the two is one word of the model, whose last token alone has the mark of a word's end.
#: Found in words joined by spaces: letters and signs, or what else a word is.
_LETTERS_SIGNS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]++)([!-&(-/:-@\[-`{-~]*+)(?= |\Z)|([^ ]+)")


WORD_END = "</w>"
#: So many plain words are encoded as one text, which is cheaper than a text for each.
JOINED = 256


class _Ids(dict):
    """Token ids (little-endian unsigned 32 bit) of words. Words are split at ASCII white space, where this tokenizer
    always ends a token, so a text's ids are those of its words in turn."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        self.parts: dict[str, bytes] = {"": b""}
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, words: list[str]) -> None:
        """Ids of plain words, encoded many at a time and cut behind each token that ends a word."""
        chunks = [words[a:a + JOINED] for a in range(0, len(words), JOINED)]
        for chunk, found in zip(chunks, self._encoded([" ".join(c) for c in chunks]), strict=True):
            ids = np.array(found, "<u4")
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(ends) == len(chunk):
                data = ids.tobytes()
                self.parts.update(zip(chunk, map(data.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
            else:  # a word without tokens, or without such an end
                self._single(chunk)

    def _single(self, texts: list[str]) -> None:
        for a in range(0, len(texts), 4096):
            some = texts[a:a + 4096]
            self.parts.update((p, array("I", ids).tobytes()) for p, ids in zip(some, self._encoded(some), strict=True))

    def learn(self, words: set[bytes]) -> None:
        if len(self) > REMEMBERED:
            self.clear()
        if len(self.parts) > REMEMBERED:
            self.parts = {"": b""}
        new = [w for w in words if w not in self]
        if not new:
            return
        found = _LETTERS_SIGNS.findall(b" ".join(new).decode())
        letters = " ".join([f[0] for f in found]).lower().split(" ")  # one letter for one letter
        signs, other = [f[1] for f in found], [f[2] for f in found]
        parts = self.parts
        self._plain([p for p in {*letters, *signs} if p not in parts])
        self._single([p for p in set(other) if p not in parts])
        self.update(zip(new, [parts[a] + parts[b] + parts[c] for a, b, c in zip(letters, signs, other, strict=True)]))


_IDS: dict[str, _Ids] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and the end id, cut only where they are longer
    than ``capacity``. ``tokenizer`` is the path of a file that all executors have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids = _IDS.get(tokenizer) or _IDS.setdefault(tokenizer, _Ids(tokenizer))
        end = array("I", [END_ID]).tobytes()
        for batch in batches:
            docs, texts = batch.column("doc").to_pylist(), binary(batch, "text")
            out: list[list] = [[], [], [], [], []]
            for lo in range(0, len(texts), 64):
                split = [(t or b"").split() for t in texts[lo:lo + 64]]
                ids.learn(set().union(*split))
                for doc, words in zip(docs[lo:lo + 64], split, strict=True):
                    all_ids = b"".join(map(ids.__getitem__, words)) + end
                    for k, at in enumerate(range(0, len(all_ids), 4 * capacity)):
                        part = all_ids[at:at + 4 * capacity]
                        for column, v in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            column.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, copies), ...]) per pattern; together they use every length exactly ``counts`` times."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []
    places = np.arange(capacity + 1)
    while left.any():
        have = left.copy()
        largest = np.maximum.accumulate(np.where(have > 0, places, 0))
        gap, use = capacity, {}
        while gap and largest[gap]:
            length = int(largest[gap])
            n = min(int(have[length]), gap // length)
            use[length] = n
            have[length] -= n
            gap -= n * length
            if not have[length]:
                largest = np.maximum.accumulate(np.where(have > 0, places, 0))
        while gap and use:
            small = min(use)
            room = gap + small
            a = np.flatnonzero(have[:room + 1])
            b = largest[np.minimum(room - a, a)]
            alone = (b == a) & (have[a] < 2)
            b = np.where(alone, largest[np.maximum(np.minimum(room - a, a) - 1, 0)], b)
            both = np.where(b > 0, a + b, 0)
            if not len(a) or both.max() <= small:
                break
            k = int(both.argmax())
            use[small] -= 1
            have[small] += 1
            if not use[small]:
                del use[small]
            for length in (int(a[k]), int(b[k])):
                use[length] = use.get(length, 0) + 1
                have[length] -= 1
            gap = room - int(both[k])
            largest = np.maximum.accumulate(np.where(have > 0, places, 0))
        times = min(int(left[length]) // n for length, n in use.items())
        for length, n in use.items():
            left[length] -= n * times
        out.append((times, sorted(use.items(), reverse=True)))
    return out


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (with ``doc_id``, ``piece`` and a ``length`` of 1 to ``capacity``) and the place of each row:
    ``sequence_id`` and ``offset``. Offsets of a sequence follow each other without gaps from 0. Rows that repeat each
    other get places of their own; null ids are packed like others; an empty table gives no rows."""
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per length
    first: dict[int, int] = {}
    before = 0
    for length in sorted(counts):
        first[length] = before
        before += counts[length]
    slots, sequence = [], 0
    for times, pattern in plan(counts, capacity):
        offset = 0
        for length, copies in pattern:
            slots.append((first[length], copies, sequence, offset, length))
            first[length] += copies * times
            offset += copies * length
        sequence += times
    table = np.array(sorted(slots) or np.zeros((0, 5)), np.int64).reshape(-1, 5)
    names = parts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("_at").to_numpy()
            row = table[np.searchsorted(table[:, 0], at, "right") - 1]
            nth = at - row[:, 0]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(row[:, 2] + nth // row[:, 1]),
                 pa.array(row[:, 3] + nth % row[:, 1] * row[:, 4])], [*names, "sequence_id", "offset"])

    order = ["length", *[c for c in ("doc_id", "piece", "ids_crc32") if c in names]]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    return ranked(parts, order, into="_at").select(*names, "_at").mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its place. A null or empty text is the end id alone."""
    return pack(materialise(pieces(docs, tokenizer, capacity)), capacity)
