"""26-connected components of run-length masks as a distributed graph problem."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runvox.operators.runs import length
from runvox.scale import materialise
from runvox.schemas import RUN_KEY

# Volume axes are 16-bit in the file format, so 15 bits per index hold any voxel.
_BITS = 15


def _node():
    """A run's id within its mask: array position in the low 45 bits, random bits above.

    The low bits make ids unique and keep array order; the random bits make hooking shrink the graph by a constant
    factor per round whatever the shape of the mask.
    """
    place = F.shiftleft(F.col("x").cast("long"), 2 * _BITS) + F.shiftleft(F.col("y").cast("long"), _BITS) \
        + F.col("z0").cast("long")
    return F.shiftleft(F.hash(place).bitwiseAND(0x3FFFF).cast("long"), 3 * _BITS) + place


def run_edges(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs of touching runs. Each run meets its four forward neighbour columns by equi-join; touching in z is the
    residual test."""
    ahead = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
                      for dx, dy in ((0, 1), (1, -1), (1, 0), (1, 1))])
    left = (nodes.withColumn("_d", F.explode(ahead))
            .select(*keys, (F.col("x") + F.col("_d.dx")).alias("x"), (F.col("y") + F.col("_d.dy")).alias("y"),
                    F.col("z0").alias("_z0"), F.col("z1").alias("_z1"), F.col("node").alias("a")))
    right = nodes.select(*keys, "x", "y", "z0", "z1", F.col("node").alias("b"))
    touch = (F.col("z0") <= F.col("_z1") + 1) & (F.col("_z0") <= F.col("z1") + 1)
    return left.join(right.hint("merge"), [*keys, "x", "y"]).where(touch).select(*keys, "a", "b")


def connected(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, node, root) for every node that has an edge; equal roots mean connected.

    Each round hooks every node to its smallest neighbour, follows the hooks two steps, and contracts the graph to
    the labels that remain. Any map that stays inside a component keeps contraction exact, so no round needs to
    converge by itself. The graph shrinks geometrically; each round's map is written to the shared folder, and the
    maps are composed from the smallest back, so no join meets a label that a whole component already shares.

    Joins with a map are merge joins: a stored map is many times smaller than its rows in memory, so the optimizer would
    send maps of millions of rows through the driver.
    """
    keys = list(keys)
    edges = materialise(edges)
    maps = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(*keys, F.col("a").alias("node")).agg(F.min("b").alias("_m")).select(
            *keys, "node", F.least("node", "_m").alias("up"))
        above = hook.select(*keys, F.col("node").alias("up"), F.col("up").alias("_up"))
        hook = materialise(hook.join(above.hint("merge"), [*keys, "up"]).select(*keys, "node", F.col("_up").alias("up")))
        maps.append(hook)
        ends = edges
        for end in ("a", "b"):
            ends = ends.join(hook.select(*keys, F.col("node").alias(end), F.col("up").alias(f"_{end}"))
                             .hint("merge"), [*keys, end]).drop(end).withColumnRenamed(f"_{end}", end)
        edges = materialise(ends.where("a <> b").select(
            *keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not maps:
        return edges.select(*keys, F.col("a").alias("node"), F.col("b").alias("root"))
    total = maps[-1]
    for earlier in reversed(maps[:-1]):
        later = total.select(*keys, F.col("node").alias("up"), F.col("up").alias("_up"))
        total = earlier.join(later.hint("merge"), [*keys, "up"], "left").select(
            *keys, "node", F.coalesce("_up", "up").alias("up"))
    return total.withColumnRenamed("up", "root")


def label_components(runs: DataFrame, keys: Sequence[str] = RUN_KEY) -> DataFrame:
    """The runs with ``component``: an id that is equal exactly for connected runs of one mask.

    Masks get a number first, so the graph tables that are shuffled in every round hold three integers per row.
    """
    keys = list(keys)
    masks = materialise(runs.select(*keys).distinct().withColumn("mask", F.monotonically_increasing_id()))
    nodes = materialise(runs.join(masks.hint("merge"), keys).withColumn("node", _node()))
    roots = connected(run_edges(nodes.select("mask", "x", "y", "z0", "z1", "node"), ["mask"]), ["mask"])
    return (nodes.join(roots.hint("merge"), ["mask", "node"], "left")
            .withColumn("component", F.coalesce("root", "node")).drop("mask", "node", "root"))


def component_sizes(labelled: DataFrame, keys: Sequence[str] = RUN_KEY) -> DataFrame:
    """(keys, component, voxels, first_x, first_y, first_z): size and first voxel in array order."""
    first = F.min(F.struct("x", "y", "z0"))
    return (labelled.groupBy(*keys, "component").agg(F.sum(length()).cast("long").alias("voxels"), first.alias("_f"))
            .select(*keys, "component", "voxels", F.col("_f.x").alias("first_x"), F.col("_f.y").alias("first_y"),
                    F.col("_f.z0").alias("first_z")))


def largest_components(sizes: DataFrame, keys: Sequence[str] = RUN_KEY) -> DataFrame:
    """The biggest component of each mask; of equal ones the first in array order. Partial maxima, no sort."""
    rank = F.struct(F.col("voxels"), -F.col("first_x"), -F.col("first_y"), -F.col("first_z"))
    return sizes.groupBy(*keys).agg(F.max_by("component", rank).alias("component"),
                                    F.max("voxels").alias("largest_voxels"), F.sum("voxels").alias("voxels"))


def keep_largest(labelled: DataFrame, keys: Sequence[str] = RUN_KEY) -> DataFrame:
    """The runs of each mask's largest component."""
    best = largest_components(component_sizes(labelled, keys), keys).select(*keys, "component")
    return labelled.join(best.hint("merge"), [*keys, "component"], "left_semi").drop("component")


def speckle_removed(sizes: DataFrame, header: DataFrame, keys: Sequence[str] = RUN_KEY) -> DataFrame:
    """Volume (mL, 4 dp) that keeping only the largest component removes."""
    return (largest_components(sizes, keys).join(header.select("source", "case_id", "voxel_ml"), ["source", "case_id"])
            .select(*keys, F.round((F.col("voxels") - F.col("largest_voxels")) * F.col("voxel_ml"), 4)
                    .alias("removed_ml")))
