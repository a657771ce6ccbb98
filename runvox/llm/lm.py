"""Language-model scores from a log-frequency Bloom filter.

Counts of word sequences of 1 to ``order`` words are quantised: a sequence counted ``c`` times has the level ``q`` whose
range of counts, growing by ``GROWTH`` per level, holds ``c``, and is entered into the filter once for each of the levels
1 to ``q``. Probing the levels upwards until one is absent gives the quantised count back; a false positive, with a
probability of ``2 ** -PROBES``, raises it by a level. Probabilities are smoothed by handing ``MASS`` counts of every
history to the next shorter one.

The filter grows with the corpus, so it is kept in shards of the sequences' hash range, as many as ``SHARD_BYTES`` of text
each ask for; an entry is a sequence's 32 bits behind the shard, whose collisions are much rarer than false positives. As
long as all shards together have at most ``MOST_BROADCAST`` bytes they are broadcast, and workers probe them where the
texts are. Beyond that size each shard is sent to the worker that answers for it, and probes travel to it and levels back;
both ways give the same scores.

Texts are packed into slices first. A slice sends each of its distinct sequences once to its shard, so no frequent word
makes a large group, and messages are packed arrays of byte planes, which compress well. Exact counts of words, for the
base score, come back the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runvox.llm.words import Words, binary, mixed, slices
from runvox.scale import materialise

ORDER = 2
MASS = 64.0
PROBES = 8
GROWTH = 1.5
SLICE_BYTES = 4 << 20
SHARD_BYTES = 16 << 20
MOST_BROADCAST = 10 << 20

#: Least count of every level, from level 1 on.
LEAST_COUNT = np.unique(np.ceil(GROWTH ** np.arange(105)).astype(np.int64))
#: What a level stands for: the middle of its counts (level 0: none).
COUNT_OF = np.concatenate(([0.0], (LEAST_COUNT[:-1] + LEAST_COUNT[1:] - 1) / 2, [float(LEAST_COUNT[-1])]))
_START, _END = mixed(np.array([0x5354415254, 0x454E44], np.uint64))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)


class Sequences:
    """Hashes of the word sequences of several texts. Each text is ``order - 1`` starts, its words, and an end."""

    def __init__(self, texts: list[bytes | None], order: int) -> None:
        words = Words([t and t.lower() for t in texts])
        pad = order - 1
        #: tokens of each text: its words and the end
        self.tokens = words.counts + 1
        first = np.concatenate(([0], np.cumsum(self.tokens + pad)))
        own = np.full(first[-1], _START, np.uint64)
        own[np.arange(len(words.starts)) + np.repeat(first[:-1] + pad - words.first[:-1], words.counts)] = words.hashes()
        own[first[1:] - 1] = _END
        owner = np.repeat(np.arange(len(texts)), self.tokens + pad)
        place = np.arange(first[-1]) - first[owner]
        #: where tokens are, and the last start of each text, which is a history but no token
        self.at = np.flatnonzero(place >= pad)
        self.starts = first[:-1] + pad - 1 if pad else np.zeros(0, np.int64)
        self.owner = owner
        #: by_order[k - 1][i]: hash of the k values up to place i
        self.by_order = [own]
        for k in range(2, order + 1):
            longer = mixed(self.by_order[-1][:-1] * _STEP + own[1:] + np.uint64(k))
            self.by_order.append(np.concatenate((own[:1], longer)))

    def asked(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """(distinct, per order the index of each place's sequence): all sequences whose counts the scores need."""
        parts = []
        for k, h in enumerate(self.by_order):
            parts.append(h[self.at])
            if k < len(self.by_order) - 1:
                parts.append(h[self.starts])
        distinct, index = np.unique(np.concatenate(parts), return_inverse=True)
        out, done = [], 0
        for k, h in enumerate(self.by_order):
            spread = np.zeros(len(h), np.int64)
            for places in (self.at, self.starts) if k < len(self.by_order) - 1 else (self.at,):
                spread[places] = index[done:done + len(places)]
                done += len(places)
            out.append(spread)
        return distinct, out


def _placed(h: np.ndarray, shards: int) -> np.ndarray:
    """32 bits of shard and 32 bits of key: equal parts of the hash range, so sorted hashes are sorted by both."""
    return (h >> np.uint64(32)) * np.uint64(shards) + ((h & _LOW) * np.uint64(shards) >> np.uint64(32))


def _cuts(placed: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of sorted places."""
    own = (placed >> np.uint64(32)).astype(np.int64)
    edges = np.concatenate(([0], np.flatnonzero(np.diff(own)) + 1, [len(own)])) if len(own) else np.zeros(1, int)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(own[a]), a, b


def _planes(values: np.ndarray, kind: str) -> bytes:
    """Numbers as bytes, all first bytes before all second ones."""
    return np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(len(values), np.dtype(kind).itemsize).T.tobytes()


def _unplaned(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def _steps(keys: np.ndarray) -> bytes:
    """Ascending 32-bit keys as differences."""
    return _planes(np.diff(keys & _LOW, prepend=np.uint64(0)), "<u4")


def _keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unplaned(data, "<u4").astype(np.uint64), dtype=np.uint64)


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEAST_COUNT, counts, "right")


def _hashed(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    h = mixed(keys + np.uint64(level * int(_STEP) % (1 << 64)))
    return h, h >> np.uint64(32) | np.uint64(1)


def _place(first: np.ndarray, step: np.ndarray, probe: int, bits: int) -> np.ndarray:
    return (first + np.uint64(probe) * step & _LOW) * np.uint64(bits) >> np.uint64(32)


def filled(keys: np.ndarray, levels: np.ndarray, probes: int) -> bytes:
    """The bits of a shard that holds the levels 1 to ``levels`` of distinct keys, about half of them set."""
    bits = max(64, int(np.ceil(int(levels.sum()) * probes / np.log(2) / 8)) * 8)
    field = np.zeros(bits, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        keys, levels = keys[levels >= level], levels[levels >= level]
        first, step = _hashed(keys, level)
        for probe in range(probes):
            field[_place(first, step, probe, bits)] = True
    return np.packbits(field, bitorder="little").tobytes()


def probed(keys: np.ndarray, field: bytes | None, probes: int) -> np.ndarray:
    """The levels of keys: probes go upwards until a level is absent."""
    out = np.zeros(len(keys), np.uint8)
    if field is None:
        return out
    field = np.frombuffer(field, np.uint8)
    left, level = np.arange(len(keys)), 0
    while len(left) and level < len(LEAST_COUNT):
        level += 1
        first, step = _hashed(keys[left], level)
        for probe in range(probes):
            at = _place(first, step, probe, 8 * len(field))
            there = (field[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            left, first, step = left[there], first[there], step[there]
        out[left] = level
    return out


def _packed(docs: DataFrame, text: str, key: str, held: Column) -> DataFrame:
    """(slice, docs, held, sizes, texts, bytes, train): compressed texts of about ``SLICE_BYTES`` per row, with the number of
    training tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts, held = binary(batch, "text"), batch.column("held").to_pylist()
            for a, b in slices(texts, SLICE_BYTES):
                counts = Words(texts[a:b]).counts + 1
                train = int(counts[~np.array(held[a:b], bool)].sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([batch.column("doc").slice(a, b - a).to_pylist()], pa.list_(pa.int64())),
                     pa.array([held[a:b]]), pa.array([[len(t or b"") for t in texts[a:b]]], pa.list_(pa.int32())),
                     pa.array([pa.compress(b"".join(t or b"" for t in texts[a:b]), "zstd", asbytes=True)]),
                     pa.array([sum(len(t or b"") for t in texts[a:b])]), pa.array([train])],
                    ["slice", "docs", "held", "sizes", "texts", "bytes", "train"])
                number += 1

    rows = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(held, F.lit(False)).alias("held"), F.col(text).alias("text"))
    return materialise(rows.mapInArrow(run, "slice long, docs array<long>, held array<boolean>, sizes array<int>, texts binary, bytes long, train long"))


def _slices(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[tuple[dict, Sequences]]:
    """One row of packed texts after the other."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            ends = np.cumsum(row["sizes"]).tolist()
            blob = pa.decompress(row.pop("texts"), ends[-1], "zstd", asbytes=True) if ends[-1] else b""
            yield row, Sequences([blob[e - n:e] for n, e in zip(row["sizes"], ends, strict=True)], order)


def _shards(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of one shard after the other, from batches sorted by shard."""
    held: list[dict] = []
    for batch in rows:
        for row in batch.to_pylist():
            if held and held[0]["shard"] != row["shard"]:
                yield held[0]["shard"], held
                held = []
            held.append(row)
    if held:
        yield held[0]["shard"], held


def _learned(packed: DataFrame, order: int, shards: int, probes: int) -> DataFrame:
    """(shard, slice, payload, known): rows with a slice answer it with the counts of its words; the others hold the bits
    of each shard and the number of its training words."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, s in _slices(batches, order):
            train = ~np.array(row["held"], bool)[s.owner]
            words, index = np.unique(s.by_order[0][s.at], return_inverse=True)
            times = np.bincount(index[train[s.at]], minlength=len(words))
            events = []
            for k, h in enumerate(s.by_order):
                events += [h[s.at[train[s.at]]]] if k else []
                events += [h[s.starts[train[s.starts]]]] if k < order - 1 else []
            grams, held = np.unique(np.concatenate(events), return_counts=True) if events else (words[:0], times[:0])
            out: dict[int, dict] = {}
            for shard, a, b in _cuts(_placed(words, shards)):
                out[shard] = {"words": _planes(words[a:b], "<u8"), "times": _planes(times[a:b], "<u4")}
            grams = _placed(grams, shards)
            for shard, a, b in _cuts(grams):
                once = held[a:b] == 1
                out.setdefault(shard, {"words": b"", "times": b""}).update(
                    once=_steps(grams[a:b][once]), more=_steps(grams[a:b][~once]), held=_planes(held[a:b][~once], "<u4"))
            yield pa.RecordBatch.from_pylist(
                [{"shard": k, "slice": row["slice"], "once": b"", "more": b"", "held": b"", **v} for k, v in out.items()],
                pa.schema([("shard", pa.int32()), ("slice", pa.int64()), *[(c, pa.binary()) for c in ("words", "times", "once", "more", "held")]]))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("shard", pa.int32()), ("slice", pa.int64()), ("payload", pa.binary()), ("known", pa.int64())])
        for shard, rows in _shards(batches):
            words, times = (np.concatenate([_unplaned(r[c], t) for r in rows]) for c, t in (("words", "<u8"), ("times", "<u4")))
            distinct, index = np.unique(words, return_inverse=True)
            total = np.bincount(index, times, len(distinct)).astype(np.int64)
            once, more = (np.concatenate([_keys(r[c]) for r in rows]) for c in ("once", "more"))
            held = np.concatenate([_unplaned(r["held"], "<u4") for r in rows])
            known = total > 0
            weights = np.concatenate((np.ones(len(once), np.int64), held, total[known]))
            keys, place = np.unique(np.concatenate((once, more, _placed(distinct[known], shards) & _LOW)), return_inverse=True)
            field = filled(keys, level_of(np.bincount(place, weights, len(keys)).astype(np.int64)), probes)
            out, done = [{"shard": shard, "payload": field, "known": int(known.sum())}], 0
            for r in rows:
                n = len(r["words"]) // 8
                out.append({"shard": shard, "slice": r["slice"], "payload": _planes(total[index[done:done + n]], "<u8")})
                done += n
            for a in range(0, len(out), 64):
                yield pa.RecordBatch.from_pylist(out[a:a + 64], kind)

    sent = packed.select("slice", "held", "sizes", "texts").mapInArrow(send, "shard int, slice long, words binary, times binary, once binary, more binary, held binary")
    return materialise(sent.repartition("shard").sortWithinPartitions("shard").mapInArrow(
        learn, "shard int, slice long, payload binary, known long"))


def _answered(packed: DataFrame, fields: DataFrame, order: int, shards: int, probes: int) -> DataFrame:
    """(shard, slice, payload): the levels of the sequences that each slice asks for; probes travel to their shard."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, s in _slices(batches, order):
            asked = _placed(s.asked()[0], shards)
            parts = [(k, _steps(asked[a:b])) for k, a, b in _cuts(asked)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in parts], pa.int32()), pa.array([row["slice"]] * len(parts), pa.int64()),
                 pa.array([p for _, p in parts], pa.binary())], ["shard", "slice", "payload"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, field = None, None
        for batch in batches:
            shard, number, answers = batch.column("shard").to_pylist(), batch.column("slice").to_pylist(), []
            for i, k in enumerate(shard):
                payload = batch.column("payload")[i].as_py()
                if number[i] is None:
                    at, field = k, payload
                else:
                    answers.append((k, number[i], probed(_keys(payload), field if k == at else None, probes).tobytes()))
            if answers:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*answers, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)],
                    ["shard", "slice", "payload"])

    kind = "shard int, slice long, payload binary"
    asked = packed.select("slice", "sizes", "texts").mapInArrow(send, kind)
    both = asked.unionByName(fields.select("shard", F.lit(None).cast("long").alias("slice"), "payload"))
    # a shard's bits have no slice, so they come before its probes
    return both.repartition("shard").sortWithinPartitions("shard", F.col("slice").asc_nulls_first()).mapInArrow(answer, kind)


def scored(docs: DataFrame, held: Column, text: str = "text", key: str = "doc_id", order: int = ORDER, mass: float = MASS,
           probes: int = PROBES, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Words are lower-cased in A-Z only; every text has one more token, its end, so a null or empty text has one. Rows for
    which ``held`` is not true are learned from. ``n_known``: tokens that training texts have; ``train_tokens``: tokens of
    training texts; ``base_score``: sum of log10((c + 1) / (train_tokens + v + 1)) with exact counts ``c`` of the tokens and
    ``v`` distinct training tokens; ``score``: log10 probability of the text by the model. Each row is scored by itself, so
    ids may repeat or be null; other columns are not read; an empty table gives no rows. Words are compared by 64-bit
    hashes.
    """
    packed = _packed(docs, text, key, held)
    size = packed.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("train"), F.lit(0))).first()
    shards, train = 1 + size[0] // SHARD_BYTES, size[1]
    learned = _learned(packed, order, shards, probes)
    fields = learned.where("slice IS NULL")
    known, field_bytes = fields.agg(F.coalesce(F.sum("known"), F.lit(0)), F.coalesce(F.sum(F.length("payload")), F.lit(0))).first()
    words = learned.where("slice IS NOT NULL").select("slice", F.lit(0).alias("kind"), "shard", "payload")
    sent = None
    if field_bytes <= most_broadcast:
        sent = docs.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["payload"]) for r in fields.select("shard", "payload").toLocalIterator()})
    else:
        answers = _answered(packed, fields, order, shards, probes)
        words = words.unionByName(answers.select("slice", F.lit(1).alias("kind"), "shard", "payload"))
    replies = words.groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("kind", "shard", "payload"))).alias("replies"))
    total = train + known + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, s in _slices(batches, order):
            n, owner = len(row["docs"]), s.owner[s.at]
            _, index = np.unique(s.by_order[0][s.at], return_inverse=True)
            counts = np.concatenate([_unplaned(r["payload"], "<u8") for r in row["replies"] if r["kind"] == 0]).astype(np.int64)
            base = np.bincount(owner, np.log10((counts + 1) / total)[index], n)
            asked, places = s.asked()
            if sent is None:
                levels = np.frombuffer(b"".join([r["payload"] for r in row["replies"] if r["kind"] == 1]), np.uint8)
            else:
                asked = _placed(asked, shards)
                levels = np.concatenate([probed(asked[a:b] & _LOW, sent.value.get(k), probes) for k, a, b in _cuts(asked)])
            held = COUNT_OF[levels]
            p = (held[places[0][s.at]] + 1) / total
            for k in range(1, order):
                history = held[places[k - 1][s.at - 1]]
                p = (np.minimum(held[places[k][s.at]], history) + mass * p) / (history + mass)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["docs"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(s.tokens.astype(np.int64)),
                 pa.array(np.bincount(owner[counts[index] > 0], minlength=n)), pa.array([train] * n, pa.int64()),
                 pa.array(base), pa.array(np.bincount(owner, np.log10(np.minimum(p, 1.0)), n))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return packed.select("slice", "docs", "held", "sizes", "texts").join(replies, "slice").drop("slice").mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
