"""Mixing sources to target weights.

The words of a source, document after document, are cut into blocks of a fixed length. A source needs as many slots as
its target asks for. Each output shard has a fixed number of slots and draws how many of them each source fills: a
multinomial draw by what the sources need, under the condition that over all shards every source gets just that. Shards are
halved again and again, and each half draws its counts, so any shard is drawn without the others. A keyed pseudorandom
permutation of a source's block numbers says which block a slot holds: no block comes twice before all others came once.
Blocks and documents meet by source and block number, so a hot source is spread like any other. The report counts the words
of the mix that comes out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from runvox.llm.words import Words, binary, mixed, slices
from runvox.scale import materialise, ranked

BLOCK = 256
#: Slots per output shard.
SHARD = 4096
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0


def sized(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, *keep): number of words per row (null: 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary(batch, "text")
            counts = [Words(texts[a:b]).counts for a, b in slices(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(np.concatenate(counts or [np.zeros(0, int)])),
                                              *[batch.column(c) for c in keep]], ["doc_id", "source", "size", *keep])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col(text).alias("text"), *keep)
    return own.mapInArrow(run, StructType([*own.select("doc_id", "source").schema.fields, StructField("size", LongType()), *own.select(*keep).schema.fields]))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sources`` (source, source_size, first: one row per source) with ``sid``, ``target``.

    Sources by code point, null last, take the weights in turn. With ``level`` words per unit of weight, a source gets
    ``min(most * size, level * weight)``; the level is the one at which the targets add up to ``share`` of all sizes.
    That is where resharing the excess by weight ends. The windows order one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("sid"), F.lit(len(weights))) + 1).cast("int"))
    cap = most * F.col("source_size")
    s = (sources.withColumn("sid", (F.row_number().over(by_name) - 1).cast("long")).withColumn("w", weight)
         .withColumn("cap", cap).withColumn("fills", F.col("cap") / F.col("w")))
    order = Window.orderBy("fills", "sid")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy()) * share
    s = s.withColumn("level", (total - before) / open_weight)
    level = F.max(F.when(F.col("level") <= F.col("fills"), F.col("level"))).over(Window.partitionBy())
    target = F.coalesce(F.least("cap", level * F.col("w")), F.col("cap"))
    return s.select("source", "source_size", "first", "sid", F.round(target, 6).alias("target"))


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0 .. n-1 applied to ``index``: a Feistel network on enough bits, walked until inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        left, right = x >> h, x & m
        for turn in range(4):
            left, right = right, left ^ (mixed(right + k + np.uint64(turn << 40)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


#: Up to so many slots counts are drawn; halves of more, whose draws would differ by less than 1 in 10,000, get their shares.
_MOST_DRAWN = 10 ** 9 - 1


def drawn(need: np.ndarray, shard: int, seed: int, begin: int, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard number, slots before by source, slots in it by source) of the shards ``begin`` to ``end``, without the others."""
    total = int(need.sum())

    def halved(lo: int, hi: int, counts: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if hi <= begin or lo >= end:
            return
        if hi - lo == 1:
            yield lo, before, counts
            return
        middle = (lo + hi) // 2
        wanted = (middle - lo) * shard
        if counts.sum() <= _MOST_DRAWN:
            left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(counts, wanted, method="marginals")
        else:
            share = counts * (wanted / counts.sum())
            left = np.floor(share).astype(np.int64)
            left[np.argsort(left - share, kind="stable")[:wanted - int(left.sum())]] += 1
        yield from halved(lo, middle, left, before)
        yield from halved(middle, hi, counts - left, before + left)

    if total:
        yield from halved(0, -(-total // shard), need, np.zeros_like(need))


def slots(sources: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = 0) -> DataFrame:
    """(sid, shard, slot, epoch, block, take): which block a slot holds and how many of its words it takes.

    ``sources``: sid, source_size, target; one row per source is sent to every task. All but the last epoch of a source take
    every block once; the last one takes permuted blocks up to the target, the last slot a part of its block. A source's
    short last block ends each epoch.
    """
    size, words = F.col("source_size"), F.round("target").cast("long")
    s = (sources.where("source_size > 0").withColumn("words", words)
         .withColumn("epochs", F.floor(F.col("words") / size)).withColumn("rest", F.col("words") - F.col("epochs") * size)
         .withColumn("blocks", F.ceil(size / block))
         .withColumn("slots", F.col("epochs") * F.col("blocks") + F.ceil(F.col("rest") / block)))
    each = s.select("sid", "slots", "source_size", "blocks", "epochs", "rest").orderBy("sid").toPandas()
    sids, need, *others = (each[c].to_numpy(np.int64) for c in each.columns)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("id").to_numpy()
            for number, before, counts in drawn(need, shard, seed, int(numbers[0]), int(numbers[-1]) + 1):
                u = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (sids[u], np.full(len(u), number), before[u], counts[u], *[x[u] for x in others])],
                    ["sid", "shard", "first", "number", "size", "blocks", "epochs", "rest"])

    drawn_slots = sources.sparkSession.range(max(1, -(-int(need.sum()) // shard))).mapInArrow(
        draw, "sid long, shard long, first long, number long, size long, blocks long, epochs long, rest long")
    each = drawn_slots.repartition("sid", "shard").withColumn("slot", F.explode(F.expr("sequence(first, first + number - 1)"))).drop("first", "number")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid, shard, size, blocks, epochs, rest, slot = (batch.column(c).to_numpy() for c in ("sid", "shard", "size", "blocks", "epochs", "rest", "slot"))
            epoch, at = slot // blocks, slot % blocks
            full = size // block
            key = mixed(mixed(sid.astype(np.uint64) + np.uint64(seed << 32)) + epoch.astype(np.uint64))
            where = at.copy()
            inner = at < full
            where[inner] = permuted(at[inner], full[inner], key[inner])
            length = np.where(inner, block, size - full * block)
            take = np.where(epoch < epochs, length, np.minimum(length, rest - at * block))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (sid, shard, slot, epoch, where, take)],
                                             ["sid", "shard", "slot", "epoch", "block", "take"])

    return each.mapInArrow(place, "sid long, shard long, slot long, epoch long, block long, take long")


def _placed(docs: DataFrame, keep: tuple[str, ...] = (), ties: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows with their ``place`` in the words of all sources (stored), and the sources with targets (stored)."""
    rows = materialise(ranked(materialise(sized(docs, keep=keep)), ["source", "doc_id", "size", *ties], weight="size", into="place"))
    return rows, materialise(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("place").alias("first"))))


def spans(rows: DataFrame, sources: DataFrame, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """(place, doc_id, shard, slot, epoch, start, words): the words of a document (from ``start``) that a slot takes."""
    s = sources.select(F.col("source").alias("_source"), "sid", "first")
    own = (rows.where("size > 0").join(s, F.col("source").eqNullSafe(F.col("_source")))
           .withColumn("at", F.col("place") - F.col("first")).select("place", "doc_id", "sid", "at", "size"))
    cut = own.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))))
    met = cut.join(slots(sources, block, SHARD, seed), ["sid", "block"])
    low = F.greatest(F.col("at"), F.col("block") * block)
    high = F.least(F.col("at") + F.col("size"), F.col("block") * block + F.col("take"))
    return met.where(high > low).select("place", "doc_id", "shard", "slot", "epoch", (low - F.col("at")).alias("start"), (high - low).alias("words"))


def _mix(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, sources, mix): ``docs`` must have doc_id, source, text and a stored ``_row``; mix: (_row, copies), for every row
    that gives words a list of copies, each a list of (start, words)."""
    digest = docs.withColumn("_digest", F.xxhash64("text"))
    rows, sources = _placed(digest, ("_row", "_digest"), ("_digest",))
    # rows with words have places of their own
    mix = (spans(rows, sources).groupBy("place", "epoch").agg(F.collect_list(F.struct("start", "words")).alias("spans"))
           .groupBy("place").agg(F.collect_list("spans").alias("copies"))
           .join(rows.where("size > 0").select("place", "_row"), "place").select("_row", "copies"))
    return rows, sources, mix


def _taken(text: bytes | None, copies: list[list[dict]]) -> Iterator[bytes | None]:
    """The texts that a document gives to the mix; one taken whole stays as it is."""
    own = (text or b"").split()
    for found in copies:
        ordered = sorted((s["start"], s["words"]) for s in found)
        whole = sum(n for _, n in ordered) >= len(own)
        yield text if whole else b" ".join([w for a, n in ordered for w in own[a:a + n]])


def mix_report(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs``; ``taken`` counts the words of the mix.

    Sources may be null (a source of its own, last); null and empty texts have size 0 and nothing taken; rows that
    repeat an id are rows of their own. Equal tables give equal mixes. An empty table gives no rows.
    """
    numbered = materialise(docs.select("doc_id", "source", "text").withColumn("_row", F.monotonically_increasing_id()))
    rows, sources, mix = _mix(numbered)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = []
            for text, copies in zip(binary(batch, "text"), batch.column("copies").to_pylist(), strict=True):
                counts.append(int(Words(list(_taken(text, copies))).counts.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(counts, pa.int64())], ["_row", "taken"])

    taken = numbered.join(mix, "_row").select("_row", "text", "copies").mapInArrow(run, "_row long, taken long")
    s = sources.select(F.col("source").alias("_source"), "source_size", "target")
    out = rows.join(s, F.col("source").eqNullSafe(F.col("_source")))
    return out.join(taken, "_row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as rows like those of ``docs``: one per document and epoch in which words of it are taken.

    A document taken whole keeps its text; of others, the taken words are joined by spaces in order. ``n_chars``, where
    there is such a column, is counted anew. Rows without an id and rows that repeat one are rows of their own, with
    the words that the mix takes from them. Equal tables give equal mixes: rows equal in source, id and size are ordered
    by their texts. Columns may have any names.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    numbered = materialise(docs.toDF(*names).withColumn("_row", F.monotonically_increasing_id()))
    needed = [F.col(names[docs.columns.index(c)]).alias(c) for c in ("doc_id", "source", "text")]
    _, _, parts = _mix(numbered.select(*needed, "_row"))
    both = numbered.join(parts, "_row").select(*names, "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = [], []
            for r, (t, copies) in enumerate(zip(binary(batch, text), batch.column("copies").to_pylist(), strict=True)):
                for taken in _taken(t, copies):
                    texts.append(taken)
                    rows.append(r)
            out = pa.Table.from_batches([batch]).select(names).take(pa.array(rows, pa.int64()))
            out = out.set_column(names.index(text), text, pa.array(texts, pa.binary()).cast(pa.string()))
            yield from out.to_batches()

    schema = StructType([StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields, strict=True)])
    out = both.mapInArrow(run, schema).toDF(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
