"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all documents that may be learnt from, labelled or not, are the unlabelled
text. A linear classifier on hashed words and word beginnings that positives have more often minimises the class-prior-corrected risk
``prior * R(positive, 1) + max(0, R(unlabelled, 0) - prior * R(positive, 0))``: the second term can't fall below zero,
so the positives hidden in the unlabelled text aren't learnt as clean. The prior is the share of toxic documents among
the labelled training rows.

Nothing is sampled. Features are chosen by their counts over all texts, and every text becomes the set of its chosen
features, counted once per distinct set. Few sets are fitted on the driver; more are kept on the cluster, which adds up
the gradient of each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from runvox.llm.words import Words, binary, lists, mixed, slices
from runvox.scale import materialise

BITS = 18
#: Word beginnings of so many bytes are features beside the whole word.
BEGINNINGS = (3, 4, 5)
#: So many distinct sets at most are fitted on the driver.
LOCAL_SETS = 50_000
THRESHOLD = 0.7
#: A feature takes part if so many positives have it, and more of them than chance gives (in standard deviations of its
#: share of the unlabelled text): with few positives, the many words of long texts would else drown the telling ones.
LEAST_HELD, LEAST_DEVIATION = 3, 5.0
#: And so many times the share that unlabelled text has: with very many positives, chance alone rules out too little.
LEAST_LIFT = 3.0


def _features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) pairs: for each distinct lower-cased word of a text, the word and its beginnings."""
    lower = [(t or b"").decode("utf-8", "replace").lower().encode() for t in texts]
    words = Words(lower)
    blob = np.frombuffer(words.blob, np.uint8)
    starts, ends = words.starts, words.ends
    # marks around a word don't make another word of it
    letter = ((blob >= 97) & (blob <= 122)) | (blob >= 128) | ((blob >= 48) & (blob <= 57))
    for _ in range(3):
        if len(ends):
            ends = ends - ((ends - starts > 1) & ~letter[ends - 1])
            starts = starts + ((ends - starts > 1) & ~letter[np.minimum(starts, len(letter) - 1)])
    words.starts, words.ends = starts, ends
    h, head, owner = words.hashes(), words.head(), words.owner()
    order = np.lexsort((h, owner))
    h, head, owner = h[order], head[order], owner[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))) if len(h) else np.zeros(0, bool)
    h, head, owner = h[new], head[new], owner[new]
    columns = [h] + [mixed((head & np.uint64((1 << 8 * n) - 1)) + np.uint64(n << 60)) for n in BEGINNINGS]
    found = np.stack(columns, axis=1) >> np.uint64(64 - BITS) if len(h) else np.zeros((0, len(columns)), np.uint64)
    return np.repeat(owner, len(columns)), found.reshape(-1).astype(np.int64)


def _distinct(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The (text number, feature) pairs of ``_features``, each once, by text."""
    owner, found = _features(texts)
    pairs = np.unique(owner << BITS | found)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _counts(docs: DataFrame, name: str) -> DataFrame:
    """(f, name): how many texts have each feature, added up in every task before it is sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            texts = binary(batch, "text")
            for a, b in slices(texts):
                total += np.bincount(_distinct(texts[a:b])[1], minlength=len(total))
        f = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), pa.array(total[f])], ["f", name])

    return docs.select("text").mapInArrow(run, f"f int, {name} long").groupBy("f").agg(F.sum(name).alias(name))


def _sets(docs: DataFrame, chosen: np.ndarray, name: str) -> DataFrame:
    """(f, name): the distinct sets of chosen features (as places in ``chosen``) and how many texts have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        for batch in batches:
            texts = binary(batch, "text")
            for a, b in slices(texts):
                owner, found = _distinct(texts[a:b])
                found = place[found]
                owner, found = owner[found >= 0], found[found >= 0]
                cuts = np.searchsorted(owner, np.arange(1, b - a))
                yield pa.RecordBatch.from_arrays([lists(np.split(found, cuts), pa.int32())], ["f"])

    return docs.select("text").mapInArrow(run, "f array<int>").groupBy("f").agg(F.count(F.lit(1)).alias(name))


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(set number, feature) of all sets."""
    n = np.array([len(x) for x in sets], np.int64)
    return np.repeat(np.arange(len(sets)), n), np.concatenate([*sets, np.zeros(0, np.int64)]).astype(np.int64)


def _parts(row: np.ndarray, f: np.ndarray, p: np.ndarray, u: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    """Sums over sets (held by ``p`` positive and ``u`` unlabelled texts) that losses and gradients consist of: unlabelled
    and positive log(1 - s), then p * (s - 1), p * s and u * s, each in all and by feature."""
    s = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[f], len(p)) + bias, -30, 30)))
    rest = np.log(1 - s)
    weights = (p * (s - 1), p * s, u * s)
    return np.concatenate([[(u * rest).sum(), (p * rest).sum()], *[x for g in weights for x in ([g.sum()], np.bincount(f, g[row], len(w)))]])


def _descended(parts, features: int, positives: int, unlabelled: int, prior: float, rounds: int, rate: float, shrink: float) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the non-negative risk (full-batch Adam)."""
    w, bias = np.zeros(features), np.log(prior / (1 - prior)) if 0 < prior < 1 else 0.0
    m, v, mb, vb = np.zeros(features), np.zeros(features), 0.0, 0.0
    for t in range(1, rounds + 1):
        sums = parts(w, bias)
        loss_u, loss_p = sums[:2]
        (p_one, p_zero, u_zero) = sums[2:].reshape(3, 1 + features)
        g = p_one * (prior / positives)
        if prior * loss_p / positives - loss_u / unlabelled >= 0:
            g = g + u_zero / unlabelled - p_zero * (prior / positives)
        gb, g = g[0], g[1:] + shrink * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w = w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-5)
        bias -= rate * (mb / (1 - 0.9 ** t)) / (np.sqrt(vb / (1 - 0.999 ** t)) + 1e-5)
    return w, bias


ROUNDS, RATE, SHRINK = 120, 0.05, 2e-4


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[np.ndarray, float]:
    """Weights and intercept from feature sets in memory."""
    size = 1 << BITS
    if not positive or not unlabelled:
        return np.zeros(size), np.log(prior / (1 - prior)) if 0 < prior < 1 else 0.0
    row, f = _flat([*positive, *unlabelled])
    p = np.array([1] * len(positive) + [0] * len(unlabelled))
    return _descended(lambda w, bias: _parts(row, f, p, 1 - p, w, bias), size, len(positive), len(unlabelled), prior, ROUNDS, RATE, SHRINK)


def _on_cluster(rows: DataFrame, w: np.ndarray, bias: float) -> np.ndarray:
    """The sums of ``_parts`` over all stored sets (f, p, u): one partial vector per task, of three numbers a chosen feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            sets = batch.column("f")
            row = np.repeat(np.arange(len(sets)), np.diff(sets.offsets.to_numpy()))
            f = sets.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            part = _parts(row, f, batch.column("p").to_numpy(), batch.column("u").to_numpy(), w, bias)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["v"])

    return np.sum([np.frombuffer(r["v"]) for r in rows.mapInArrow(run, "v binary").collect()], axis=0)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


#: Ids are first looked up in a bitmap of so many bits (2 MB), however many they are.
FILTER_BITS = 24


def _with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids``. A bitmap of hashed ids, of fixed size, lets only likely texts into the
    join; what it lets through wrongly, the join drops."""
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << FILTER_BITS))
    part, bit = F.shiftright(place, 15).alias("_part"), place.bitwiseAND((1 << 15) - 1)
    field = ids.select(part, bit.alias("_bit")).groupBy("_part").agg(F.bitmap_construct_agg("_bit").alias("_field"))
    byte = F.conv(F.hex(F.substring("_field", F.shiftright("_bit", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = byte.bitwiseAND(F.expr("shiftleft(1, CAST(_bit % 8 AS INT))")) != 0
    likely = docs.withColumns({"_part": part, "_bit": bit}).join(F.broadcast(field), "_part").where(held).drop("_part", "_bit", "_field")
    return likely.join(ids.distinct(), "doc_id")  # a semi join would be moved below the lookup, to all texts


def train(docs: DataFrame, labels: DataFrame, local_sets: int = LOCAL_SETS) -> tuple[np.ndarray, float]:
    """Fits the classifier to all rows with an id that are not held out. Rows that repeat an id count one by one."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    share = known.agg(F.avg((F.col("toxic") == 1).cast("double")).alias("p")).first()["p"]
    weights = np.zeros(1 << BITS)
    if not share:
        return weights, -4.0
    prior = min(0.9, share)
    every = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text")
    toxic = materialise(_with_ids(every, known.where("toxic = 1").select("doc_id")))
    positives, unlabelled = toxic.count(), every.count()
    if not positives:
        return weights, float(np.log(prior / (1 - prior)))
    chosen = _telling(_counts(toxic, "p"), _counts(every, "u"), positives, unlabelled)
    rows = materialise(_sets(toxic, chosen, "p").join(_sets(every, chosen, "u"), "f", "full_outer")
                       .select("f", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("u", F.lit(0)).alias("u")))
    if rows.count() <= local_sets:
        held = rows.toPandas()
        (row, f), p, u = _flat([np.asarray(x, np.int64) for x in held["f"]]), held["p"].to_numpy(), held["u"].to_numpy()

        def parts(w, bias):
            return _parts(row, f, p, u, w, bias)
    else:
        def parts(w, bias):
            return _on_cluster(rows, w, bias)
    weights[chosen], bias = _descended(parts, len(chosen), positives, unlabelled, prior, ROUNDS, RATE, SHRINK)
    return weights, bias


def _telling(p: DataFrame, u: DataFrame, positives: int, unlabelled: int) -> np.ndarray:
    """The features (of ``2 ** BITS`` at most) that positives have more often than chance gives."""
    share = (F.coalesce("u", F.lit(0)) + 1) / (unlabelled + 2)
    held = F.col("p") / positives
    more = (held - share >= LEAST_DEVIATION * F.sqrt(share * (1 - share) / positives)) & (held >= LEAST_LIFT * share)
    return np.array(sorted(r["f"] for r in p.join(u, "f", "left").where(more & (F.col("p") >= LEAST_HELD)).select("f").collect()), np.int64)


def _scores(texts: list[bytes | None], weights: np.ndarray, bias: float) -> np.ndarray:
    margins = [np.zeros(0)]
    for a, b in slices(texts):
        owner, found = _features(texts[a:b])
        margins.append(np.bincount(owner, weights[found], b - a) + bias)
    return 1 / (1 + np.exp(-np.clip(np.concatenate(margins), -30, 30)))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Null and empty texts have no features and get the score of the intercept. Rows that repeat an id are scored one by
    one; a null id is not held out and never used for training. Without a toxic training label all scores are low.
    Labels, language, source and id are no inputs of a score.
    """
    w, bias = train(docs, labels)
    weights = w.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _scores(binary(batch, "text"), weights, bias)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, that are not predicted toxic. Every row is judged by its own text, whatever
    its id."""
    w, bias = train(docs, labels)
    weights = w.astype(np.float32)
    names = [f"c{k}" for k in range(len(docs.columns))]
    text = names[docs.columns.index("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(binary(batch, text), weights, bias) < THRESHOLD))

    schema = StructType([StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields, strict=True)])
    return docs.toDF(*names).mapInArrow(run, schema).toDF(*docs.columns)
