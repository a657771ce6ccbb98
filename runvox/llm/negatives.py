"""Hard negatives by threshold joins over an inverted index with norm bounds.

Rows are ordered by label and falling norm and cut into parts of about ``CELLS`` components. An anchor goes to the parts that may hold
what it looks for: those of its own label for positives, all others for negatives, and only where the product of norms
reaches its threshold. A part meets ``BLOCK`` anchors at a time:

* Dimensions are taken from the one with most weight on. Of each row, the index leaves out the dimensions from the place
  on where the norm of the rest times the largest anchor is below the threshold: who shares only these can't reach it.
* Partial scores are accumulated ``STEP`` dimensions at a time. A pair is given up once its partial score and the product
  of both remaining norms stay below the anchor's threshold.
* What survives gets its left-out dimensions, so scores are exact: with squared norms below 2^52 every sum is a whole
  number that a double holds.

A window (the positives of an anchor, or the negatives of one of its positives) wants its first few rows of a range of
scores. Thresholds begin high; windows that stay short come back with a lower one, down to the end of their range. A part
gives at most as many rows as a window wants, so a range that very many rows fall into costs no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runvox.scale import materialise, ranked

CELLS, BLOCK, STEP = 1 << 20, 64, 8
#: Rows with a larger squared norm take no part.
MOST_NORM = 2.0 ** 52
#: Thresholds for positives as shares of the largest possible score, before the last one that keeps everything.
SHARES = (0.8, 0.4, 0.2)
_LEAST = -(1 << 60)


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """The vectors of a list column as rows; shorter ones end with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))), np.float64)
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _rests(vectors: np.ndarray) -> np.ndarray:
    """Norm of what is left of each row from every dimension on, a little more than exact."""
    squares = np.cumsum(vectors[:, ::-1] ** 2, axis=1)[:, ::-1]
    return np.sqrt(np.concatenate((squares, np.zeros((len(vectors), 1))), axis=1)) * (1 + 1e-9)


class Part:
    """The rows of one part, with dimensions from most to least weight."""

    def __init__(self, row: np.ndarray, key: np.ndarray, label: np.ndarray, vectors: np.ndarray) -> None:
        self.row, self.key, self.label = row, key, label
        self.order = np.argsort(-(vectors ** 2).sum(axis=0), kind="stable")
        self.vectors = np.ascontiguousarray(vectors[:, self.order])
        self.rests = _rests(self.vectors)

    def join(self, anchors: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores): the rows that reach ``least`` with some anchor, and their exact scores with all of them."""
        width = len(self.order)
        wide = np.zeros((len(anchors), max(width, anchors.shape[1])))
        wide[:, :anchors.shape[1]] = anchors
        anchors = wide[:, self.order]
        rests = _rests(anchors)
        # how many dimensions of each row are in the index, in whole steps
        bound = least.min() / rests[:, 0].max() if rests[:, 0].max() > 0 and least.min() > 0 else 0.0
        indexed = np.minimum(-(-(self.rests >= bound).sum(axis=1) // STEP) * STEP, width) if bound > 0 else np.full(len(self.row), width)
        rows = np.argsort(-indexed, kind="stable")
        if bound > 0:
            rows = rows[self.rests[rows, 0] >= bound]
        scores = np.zeros((len(anchors), len(rows)))
        for a in range(0, width, STEP):
            b = min(a + STEP, width)
            listed = int(np.searchsorted(-indexed[rows], -a))  # rows whose index goes beyond dimension a come first
            scores[:, :listed] += anchors[:, a:b] @ self.vectors[rows[:listed], a:b].T
            done = np.minimum(indexed[rows], b)
            may = (scores + rests[:, done] * self.rests[rows, done] >= least[:, None]).any(axis=0)
            if not may.all():
                rows, scores = rows[may], scores[:, may]
        for a in np.unique(indexed[rows]).tolist():
            if a < width:
                own = indexed[rows] == a
                scores[:, own] += anchors[:, a:] @ self.vectors[rows[own], a:].T
        return rows, scores


_OUT = "row long, q int, score long, id long, other long"


def _searched(rows: DataFrame, targets: DataFrame, same: bool, wanted: int) -> DataFrame:
    """(row, q, score, id, other): of every window the first ``wanted`` rows in each part it goes to.

    ``rows``: (part, row, vec_id, code, vector); ``targets``: (part, row, code, vector, windows of (q, low, high)).
    """
    wide = rows.select("part", F.lit(0).alias("kind"), "row", "vec_id", "code", "vector",
                       F.expr("CAST(NULL AS array<struct<q: int, low: bigint, high: bigint>>)").alias("windows"))
    both = wide.unionByName(targets.select("part", F.lit(1).alias("kind"), "row", F.lit(None).cast("long").alias("vec_id"), "code", "vector", "windows"))

    def flush(part: Part, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        for a in range(0, table.num_rows, BLOCK):
            block = table.slice(a, BLOCK).combine_chunks()
            windows = block.column("windows").to_pylist()
            least = np.array([min(w["low"] for w in ws) for ws in windows], np.float64)
            code, own = block.column("code").to_numpy(), block.column("row").to_numpy()
            at, scores = part.join(_matrix(block.column("vector").chunk(0), 0), least)
            out = []
            for i, ws in enumerate(windows):
                fits = ((part.label[at] == code[i]) == same) & (part.row[at] != own[i]) & (scores[i] >= least[i])
                near, s = at[fits], scores[i][fits].astype(np.int64)
                for w in ws:
                    inside = (s >= w["low"]) & (s <= w["high"])
                    r, v = near[inside], s[inside]
                    if len(r) > 4 * wanted:
                        keep = v >= np.partition(v, len(v) - wanted)[len(v) - wanted]
                        r, v = r[keep], v[keep]
                    first = np.lexsort((part.row[r], part.key[r], -v))[:wanted]
                    out += [(own[i], w["q"], v[k], part.key[r[k]], part.row[r[k]]) for k in first]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(c), t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), *[pa.int64()] * 3), strict=True)],
                    ["row", "q", "score", "id", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        number, part = None, None
        for batch in batches:
            numbers, kinds = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if kinds[a] == 0:
                    if number != numbers[a]:
                        held, number = [], numbers[a]
                    part = None
                    held.append(batch.slice(a, b - a))
                    continue
                if number != numbers[a]:
                    continue  # a part without rows
                if part is None:
                    table = pa.Table.from_batches(held).combine_chunks()
                    part = Part(*(table.column(c).to_numpy() for c in ("row", "vec_id", "code")), _matrix(table.column("vector").chunk(0), 0))
                    held = []
                yield from flush(part, [batch.slice(a, b - a)])

    found = both.repartition("part").sortWithinPartitions("part", "kind", "row").mapInArrow(run, _OUT)
    order = Window.partitionBy("row", "q").orderBy(F.desc("score"), "id", "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted)


def _until_full(rows: DataFrame, windows: DataFrame, parts, same: bool, wanted: int, lows: list[Column]) -> DataFrame:
    """(row, q, score, id, other, rank): the first ``wanted`` rows of every window (row, q, high, code, vector, norm). Lower
    ends ``lows`` are tried one after the other for the windows that are not full yet."""
    found = None
    for k, low in enumerate(lows):
        anchors = windows.withColumn("low", low).groupBy("row").agg(
            F.first("code").alias("code"), F.first("vector").alias("vector"), F.first("norm").alias("norm"), F.min("low").alias("least"),
            F.collect_list(F.struct("q", "low", "high")).alias("windows"))
        got = materialise(_searched(rows, parts(anchors), same, wanted))
        full = got.where(F.col("rank") == wanted).select("row", "q")
        if k < len(lows) - 1:
            left = materialise(windows.join(full, ["row", "q"], "left_anti"))
            got = got.join(full, ["row", "q"], "left_semi")
        found = got if found is None else found.unionByName(got)
        if k < len(lows) - 1:
            if left.isEmpty():
                break
            windows = left
    return found


def mined(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors``: (vec_id, label, vector of whole numbers); scores are inner products, where a shorter vector ends with
    zeros. An anchor's positives are its first ``positives`` other rows of the same label, its negatives for one of them
    the first ``negatives`` rows of other labels with ``low * positive <= 100 * negative <= high * positive`` (``high`` is
    100 at most, both are whole): higher scores first, ties by smaller id. An anchor without positives, or a positive
    without negatives (as every one with a negative score), gives no rows. Rows without an id or a label, without a
    vector, with a null component, or with a squared norm of 2^52 or more take no part. Rows that repeat an id are rows
    of their own. Other columns are not read; an empty table gives no rows.
    """
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    valid = vectors.withColumn("anchor", F.coalesce(anchor, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("vector").cast("array<long>").alias("vector"), "anchor", norm.alias("norm")).where(
        f"vec_id IS NOT NULL AND label IS NOT NULL AND norm IS NOT NULL AND norm * norm < {MOST_NORM}")
    placed = ranked(valid.withColumn("_down", -F.col("norm")), ["label", "_down", "vec_id", "vector"], into="row")
    placed = materialise(placed)
    widest = placed.agg(F.max(F.size("vector"))).first()[0] or 1
    placed = placed.withColumn("part", F.expr(f"row DIV {max(1, CELLS // max(1, widest))}"))
    own = placed.groupBy("label").agg(F.min("row").alias("code"), F.min("part").alias("first"), F.max("part").alias("last"), F.max("norm").alias("most"))
    rows = placed.join(own.select("label", "code"), "label").select("part", "row", "vec_id", "code", "vector", "norm", "anchor")
    rows = materialise(rows)
    extent = materialise(rows.groupBy("part").agg(F.max("norm").alias("most"), F.min("code").alias("lo"), F.max("code").alias("hi")))
    anchors = materialise(rows.where("anchor").join(own.select("code", "first", "last", F.col("most").alias("strongest")), "code"))
    last = extent.agg(F.max("part")).first()[0]
    if last is None:
        return anchors.select(*[F.col("row").alias(c) for c in ("anchor_id", "positive_id")], F.lit(0).alias("rank"),
                              *[F.col("row").alias(c) for c in ("negative_id", "positive_score", "negative_score")])
    reach = F.col("norm") * F.col("most") * (1 + 1e-9) >= F.col("least")

    def near(asked: DataFrame) -> DataFrame:
        ranges = own.select("code", "first", "last")
        return (asked.join(ranges, "code").withColumn("part", F.explode(F.sequence("first", "last")))
                .join(extent, "part").where(reach).select("part", "row", "code", "vector", "windows"))

    def elsewhere(asked: DataFrame) -> DataFrame:
        other = (F.col("lo") != F.col("code")) | (F.col("hi") != F.col("code"))
        return (asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))))
                .join(extent, "part").where(reach & other).select("part", "row", "code", "vector", "windows"))

    asked = anchors.select("row", F.lit(0).alias("q"), F.lit(-_LEAST).alias("high"), "code", "vector", "norm", "strongest")
    shares = [F.ceil(F.col("norm") * F.col("strongest") * s).cast("long") for s in SHARES]
    best = materialise(_until_full(rows.drop("anchor"), asked, near, True, positives, [*shares, F.lit(_LEAST)]))
    asked = (best.select("row", F.col("rank").alias("q"), F.expr(f"score * {high} DIV 100").alias("high"), "score")
             .where("score >= 0").join(anchors.select("row", "code", "vector", "norm"), "row"))
    lows = [F.expr(f"(score * {p} + 99) DIV 100") for p in sorted({high - (high - low) // 4, high - (high - low) // 2, low}, reverse=True)]
    hard = _until_full(rows.drop("anchor"), materialise(asked), elsewhere, False, negatives, lows)
    names = anchors.select("row", F.col("vec_id").alias("anchor_id"))
    pairs = best.select("row", F.col("rank").alias("q"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (hard.select("row", "q", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
            .join(pairs, ["row", "q"]).join(names, "row")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
