"""Exact near-duplicate embeddings by dual traversal of cover trees.

On unit vectors, a cosine threshold is a distance threshold. A label's vectors are split at the top of the tree by the
nearest of a bounded set of centres, and cells that hold too many vectors are dealt into blocks; blocks carry their
covering radius. Below, each block is a cover tree: nets of halving radii, every point within the radius of its centre.
Pairs of blocks, then pairs of nodes, are pruned where the distance of their centres exceeds the threshold plus both
covering radii, and taken whole where even the farthest points link; the rest is measured point by point.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runvox.operators.components import connected
from runvox.scale import materialise

#: Vectors per block, on average; most centres per label; radius of a block's upper net (halved further down).
BLOCK, CENTRES, NET = 2048, 256, 0.4
_LEAF, _SLACK = 48, 1e-9


def units(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dim, unit, digest); unit is null for vectors that can't link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, out, digests = [], [], []
            for v in batch.column("embedding").to_pylist():
                x = np.array([np.nan if e is None else e for e in v], float) if v else np.zeros(0)
                norm = np.sqrt(x @ x) if len(x) and np.isfinite(x).all() else 0.0
                fine = bool(np.isfinite(norm) and norm > 0)
                dims.append(len(x))
                out.append((x / norm).tobytes() if fine else None)
                digests.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if fine else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(dims, pa.int32()),
                                              pa.array(out, pa.binary()), pa.array(digests, pa.binary())],
                                             ["vec_id", "label", "dim", "unit", "digest"])

    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                          F.col("embedding").cast("array<double>").alias("embedding"))
    return kept.mapInArrow(run, "vec_id long, label string, dim int, unit binary, digest binary")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), float).reshape(len(column), -1)


def _net(x: np.ndarray, radius: float) -> np.ndarray:
    """For every row, the row of its centre: greedy, each centre covers what is within ``radius`` of it."""
    centre = np.full(len(x), -1)
    left = np.arange(len(x))
    while len(left):
        c = left[0]
        near = x[left] @ x[c] >= 1 - radius * radius / 2
        near[0] = True
        centre[left[near]] = c
        left = left[~near]
    return centre


class _Node:
    """Points of one block below a centre, with the covering radius; children are made when they are asked for."""

    def __init__(self, x: np.ndarray, rows: np.ndarray, centre: int, radius: float) -> None:
        self.x, self.rows, self.centre, self.step = x, rows, centre, radius
        away = np.maximum(0, 2 - 2 * (x[rows] @ x[centre]))
        self.cover = float(np.sqrt(away.max())) + _SLACK
        self.below: list[_Node] | None = None

    def children(self) -> list[_Node]:
        if self.below is None:
            own = _net(self.x[self.rows], self.step / 2)
            self.below = [_Node(self.x, self.rows[own == c], int(self.rows[c]), self.step / 2) for c in np.unique(own)]
        return self.below


def _dual(a: list[_Node], b: list[_Node], same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (row of a's points, row of b's points) with at least the given cosine."""
    reach = np.sqrt(2 - 2 * cosine)
    left, right = [np.zeros(0, int)], [np.zeros(0, int)]
    todo = [(a, b, same)]
    while todo:
        us, vs, same = todo.pop()
        cu, cv = us[0].x[[u.centre for u in us]], vs[0].x[[v.centre for v in vs]]
        limit = reach + np.array([u.cover for u in us])[:, None] + np.array([v.cover for v in vs])[None, :] + _SLACK
        for i, j in zip(*np.nonzero(cu @ cv.T >= 1 - limit * limit / 2), strict=True):
            u, v = us[i], vs[j]
            if same and i > j:
                continue  # met the other way round
            far = np.sqrt(max(0.0, 2 - 2 * float(cu[i] @ cv[j]))) + u.cover + v.cover
            if far <= reach - 1e-6:
                m = np.ones((len(u.rows), len(v.rows)), bool)
            elif min(len(u.rows), len(v.rows)) <= _LEAF or u.step < reach / 8:
                m = u.x[u.rows] @ v.x[v.rows].T >= cosine
            else:
                todo.append((u.children(), v.children(), u is v))
                continue
            r, c = np.nonzero(m)
            r, c = u.rows[r], v.rows[c]
            if same and u is v:
                r, c = r[r < c], c[r < c]
            left.append(r)
            right.append(c)
    return np.concatenate(left), np.concatenate(right)


def _gathered(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that links within the block pair reach from each row."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _blocks(points: DataFrame) -> DataFrame:
    """``points`` (label, dim, vec_id, unit, copies) with ``cell``, ``block`` and the centre of their block's net."""
    keys = ["label", "dim"]
    sizes = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("held"))
    sizes = sizes.withColumn("want", F.least(F.lit(CENTRES), F.ceil(F.col("held") / BLOCK)))
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) / float(1 << 30)
    # about twice as many candidates as centres are wanted, so the gathered set is bounded
    drawn = points.join(sizes, keys).where(spread * F.col("held") < F.lit(2.0) * F.col("want") + 8)
    centres = drawn.groupBy(*keys, "want").agg(F.sort_array(F.collect_list(F.struct(spread.alias("at"), "unit"))).alias("c"))
    centres = centres.select(*keys, F.expr("transform(slice(c, 1, cast(want AS int)), x -> x.unit)").alias("centres"))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.zeros(batch.num_rows, np.int32)
            groups: dict[tuple, list[int]] = {}
            sets = batch.column("centres").to_pylist()
            for r, c in enumerate(sets):
                if c is not None and len(c) > 1:
                    groups.setdefault((len(c[0]), c[0], c[-1], len(c)), []).append(r)
            unit = batch.column("unit").to_pylist()
            for rows in groups.values():
                cells[rows] = (_matrix([unit[r] for r in rows]) @ _matrix(sets[rows[0]]).T).argmax(axis=1)
            names = ["label", "dim", "vec_id", "unit", "copies"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(cells)], [*names, "cell"])

    placed = points.join(centres, keys, "left").select(*keys, "vec_id", "unit", "copies", "centres").mapInArrow(
        nearest, "label string, dim int, vec_id long, unit binary, copies long, cell int")
    placed = materialise(placed)
    counts = placed.groupBy(*keys, "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    dealt = placed.join(counts, [*keys, "cell"]).withColumn("block", F.concat_ws("-", "cell", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col("parts"))))

    def net(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(list(pdf["unit"]))
        mean = x.mean(axis=0)
        own = _net(x, NET)
        return pdf.assign(net=own.astype(np.int32), place=np.arange(len(x), dtype=np.int32), middle=[mean.tobytes()] * len(x),
                          radius=float(np.sqrt(((x - mean) ** 2).sum(axis=1)).max()))

    return materialise(dealt.drop("parts", "cell").groupBy(*keys, "block").applyInPandas(
        net, "label string, dim int, vec_id long, unit binary, copies long, block string, net int, place int, middle binary, radius double"))


def links(points: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(vec_id, n): links of each point, counted with copies; (a, b): edges that connect what links connect."""
    keys = ["label", "dim"]
    blocks = _blocks(points)
    heads = blocks.groupBy(*keys, "block").agg(F.first("middle").alias("m"), F.max("radius").alias("r"))
    reach = float(np.sqrt(2 - 2 * cosine))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            apart = [np.linalg.norm(np.frombuffer(a) - np.frombuffer(b)) for a, b in zip(batch["m"], batch["m2"], strict=True)]
            ok = np.array(apart) <= reach + batch["r"].to_numpy() + batch["r2"].to_numpy() + _SLACK
            yield batch.loc[ok, [*keys, "block", "block2"]]

    other = heads.select(*keys, F.col("block").alias("block2"), F.col("m").alias("m2"), F.col("r").alias("r2"))
    pairs = heads.join(other, keys).where("block <= block2").mapInPandas(near, "label string, dim int, block string, block2 string")
    sides = pairs.select(*keys, F.col("block").alias("i"), F.col("block2").alias("j"),
                         F.explode(F.array_distinct(F.array("block", "block2"))).alias("block"))

    def traverse(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iat[0], pdf["j"].iat[0]
        pdf = pdf.sort_values(["block", "place"], kind="stable").reset_index(drop=True)
        x, ids, copies = _matrix(list(pdf["unit"])), pdf["vec_id"].to_numpy(), pdf["copies"].to_numpy()

        def tree(block: str) -> list[_Node]:
            rows = np.flatnonzero(pdf["block"].to_numpy() == block)
            own = rows[pdf["net"].to_numpy()[rows]]
            order = np.argsort(own, kind="stable")
            cuts = np.flatnonzero(np.diff(own[order])) + 1
            return [_Node(x, part, int(own[part[0] - rows[0]]), NET) for part in np.split(rows[order], cuts)]

        left = tree(i)
        a, b = _dual(left, left if i == j else tree(j), i == j, cosine)
        count = np.bincount(a, copies[b], len(x)) + np.bincount(b, copies[a], len(x))
        up = _gathered(len(x), a, b)
        on = np.flatnonzero(count)
        return pd.DataFrame({"vec_id": ids[on], "n": count[on].astype(np.int64), "up": ids[up[on]]})

    found = materialise(sides.join(blocks, [*keys, "block"]).groupBy(*keys, "i", "j").applyInPandas(traverse, "vec_id long, n long, up long"))
    return (found.groupBy("vec_id").agg(F.sum("n").alias("n")),
            found.where("vec_id <> up").select(F.col("vec_id").alias("a"), F.col("up").alias("b")))


def near_duplicates(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row (vec_id, embedding, label) of ``vectors``.

    Vectors link where labels and lengths are equal, labels not null, and the cosine reaches the threshold. Null, empty
    and zero vectors, and those with null or non-finite parts, link with nothing, as do rows without an id, which are
    kept. Copies are compared once and counted one by one; rows that repeat an id are copies with one id. An empty table
    gives no rows; other columns are not read.
    """
    stored = materialise(units(vectors))
    usable = stored.where("unit IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL")
    keys = ["label", "dim", "digest"]
    points = usable.groupBy(*keys).agg(F.min("vec_id").alias("first"), F.first("unit").alias("unit"), F.count(F.lit(1)).alias("copies"))
    points = materialise(points)
    counted, edges = links(points.select("label", "dim", F.col("first").alias("vec_id"), "unit", "copies"), cosine)
    member = materialise(usable.select("vec_id", *keys).join(points.drop("unit"), keys))
    same = member.where("vec_id <> first").select(F.col("first").alias("a"), F.col("vec_id").alias("b"))
    roots = materialise(connected(edges.unionByName(same), []))
    lowest = roots.groupBy("root").agg(F.min("node").alias("component"))
    component = roots.join(lowest, "root").select(F.col("node").alias("vec_id"), "component")
    direct = (member.join(counted.withColumnRenamed("vec_id", "first"), "first", "left")
              .groupBy("vec_id").agg(F.max(F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n")))
    out = stored.select("vec_id").join(direct, "vec_id", "left").join(component, "vec_id", "left")
    lowest_id = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), lowest_id.alias("component_id"),
                      F.coalesce(F.col("vec_id") == lowest_id, F.lit(True)).alias("kept"))
