"""Standard form of a scan: the body's bounding box in RAS order, its hash, and a small z-scored descriptor.

Scans are stored once, in buckets of their key. Cropping, hashing and resampling read the buckets where they lie: only
boxes, column hashes and weighted sums of the few grid columns are shuffled, never intensities (but for scans whose last
axis is not the body's, which are taken apart). The hash is built in levels (column, plane, scan), so no task ever holds
a whole volume.
"""

from __future__ import annotations

import uuid
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runvox.operators.components import component_sizes, label_components, largest_components
from runvox.operators.overlap import clip, zscored
from runvox.scale import checkpoint_root, materialise
from runvox.schemas import CASE_KEY

WINDOW = (-100, 100)
LIMITS = (-1000, 1000)
DESCRIPTOR_LIMITS = (-200.0, 300.0)


def stored_by_case(ct: DataFrame, buckets: int | None = None) -> DataFrame:
    """``ct`` as a table in the shared folder, bucketed and sorted by case: joins and groupings by case read it in place."""
    spark = ct.sparkSession
    name = f"scans_{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (ct.repartition(buckets, *CASE_KEY).write.bucketBy(buckets, *CASE_KEY).sortBy(*CASE_KEY)
     .option("path", f"{checkpoint_root(spark)}/runvox/{name}").saveAsTable(name))
    return spark.table(name)


def window_runs(ct: DataFrame, low: int = WINDOW[0], high: int = WINDOW[1]) -> DataFrame:
    """Runs of low < hu < high, found inside each column array."""
    inside = F.transform("hu", lambda v: (v > low) & (v < high))
    place = F.sequence(F.lit(0), F.size("_in") - 1)
    at = lambda i: F.coalesce(F.get("_in", i), F.lit(False))
    starts = F.filter(place, lambda i: at(i) & ~at(i - 1))
    stops = F.filter(place, lambda i: at(i) & ~at(i + 1))
    return (ct.where(F.size("hu") > 0).withColumn("_in", inside)
            .select(*CASE_KEY, "x", "y", F.inline(F.arrays_zip(starts.alias("z0"), stops.alias("z1")))))


def orientation(affine: Column) -> Column:
    """struct(axis, flip): for each world axis the array axis closest to it and whether it runs backwards."""
    norm = [F.sqrt(sum((affine[r][c] * affine[r][c] for r in (1, 2)), affine[0][c] * affine[0][c])) for c in range(3)]
    options = []
    for order in permutations(range(3)):  # order[w] = array axis of world axis w
        fit = sum((F.abs(affine[w][order[w]] / norm[order[w]]) for w in (1, 2)), F.abs(affine[0][order[0]] / norm[order[0]]))
        options.append(F.struct(F.round(fit, 9).alias("fit"), F.array(*[F.lit(-a) for a in order]).alias("neg"),
                                F.array(*[F.lit(a) for a in order]).alias("axis"),
                                F.array(*[affine[w][order[w]] < 0 for w in range(3)]).alias("flip")))
    best = F.array_max(F.array(*options))
    return F.struct(best["axis"].alias("axis"), best["flip"].alias("flip"))


def body_box(ct: DataFrame) -> DataFrame:
    """Bounding box of the largest connected region of the window, per case."""
    labelled = materialise(label_components(window_runs(ct), CASE_KEY))
    body = largest_components(component_sizes(labelled, CASE_KEY), CASE_KEY).select(*CASE_KEY, "component")
    return (labelled.join(body, [*CASE_KEY, "component"], "left_semi").groupBy(*CASE_KEY).agg(
        F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"),
        F.min("z0").alias("z_min"), F.max("z1").alias("z_max")))


def standard_columns(ct: DataFrame, header: DataFrame, box: DataFrame) -> DataFrame:
    """(source, case_id, nx, ny, nz, x, y, hu): the cropped, clipped scan in RAS order, one row per column."""
    frame = box.join(header.select(*CASE_KEY, orientation(F.col("affine")).alias("_o")), CASE_KEY)
    mins, spans = F.array("x_min", "y_min", "z_min"), F.array(*[F.col(f"{a}_max") - F.col(f"{a}_min") + 1 for a in "xyz"])
    cut = (ct.join(frame, CASE_KEY)
           .where(F.col("x").between(F.col("x_min"), F.col("x_max")) & F.col("y").between(F.col("y_min"), F.col("y_max")))
           .select(*CASE_KEY, "_o", spans.alias("_n"), (F.col("x") - F.col("x_min")).alias("x"),
                   (F.col("y") - F.col("y_min")).alias("y"),
                   F.slice("hu", F.col("z_min") + 1, F.col("z_max") - F.col("z_min") + 1).alias("hu")))
    low, high = (F.lit(v).cast("smallint") for v in LIMITS)
    cut = cut.withColumn("hu", F.transform("hu", lambda v: F.greatest(low, F.least(v.cast("smallint"), high))))
    axis, flip, n = F.col("_o.axis"), F.col("_o.flip"), F.col("_n")
    sized = [n[axis[w]].alias(f"n{c}") for w, c in enumerate("xyz")]

    def along(w: int, place: Column) -> Column:
        at = place[axis[w]]
        return F.when(flip[w], n[axis[w]] - 1 - at).otherwise(at).cast("int")

    here = F.array("x", "y", F.lit(0))
    straight = cut.where(axis[2] == 2).select(
        *CASE_KEY, *sized, along(0, here).alias("x"), along(1, here).alias("y"),
        F.when(flip[2], F.reverse("hu")).otherwise(F.col("hu")).alias("hu"))
    # stored with another axis last: columns run along that axis, so they are taken apart and built anew
    voxels = cut.where(axis[2] != 2).select(*CASE_KEY, "_o", "_n", "x", "y", F.posexplode("hu").alias("z", "v"))
    there = F.array("x", "y", "z")
    turned = (voxels.select(*CASE_KEY, *sized, *[along(w, there).alias(c) for w, c in enumerate("xyz")], "v")
              .groupBy(*CASE_KEY, "nx", "ny", "nz", "x", "y")
              .agg(F.sort_array(F.collect_list(F.struct("z", "v"))).alias("_zv"))
              .select(*CASE_KEY, "nx", "ny", "nz", "x", "y", F.transform("_zv", lambda s: s["v"]).alias("hu")))
    return straight.unionByName(turned)


def scan_hash(columns: DataFrame) -> DataFrame:
    """md5 over planes of md5 over columns, with the shape in front: equal exactly for equal standard scans."""
    joined = lambda at: F.md5(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct(at, "h"))),
                                                           lambda s: s["h"])))
    plane = (columns.select(*CASE_KEY, "nx", "ny", "nz", "x", "y", F.md5(F.array_join(
        F.transform("hu", lambda v: v.cast("string")), ",")).alias("h"))
        .groupBy(*CASE_KEY, "nx", "ny", "nz", "x").agg(joined("y").alias("h")))
    return (plane.groupBy(*CASE_KEY, "nx", "ny", "nz").agg(joined("x").alias("h"))
            .select(*CASE_KEY, F.array("nx", "ny", "nz").alias("shape"),
                    F.md5(F.concat_ws("x", "nx", "ny", "nz", "h")).alias("md5")))


def descriptor(columns: DataFrame, size: int = 32) -> DataFrame:
    """``v``: the scan linearly resampled to size³ (end points aligned), flattened in array order and z-scored.

    Interpolation is separable: along z inside the column array, across x and y as a weighted sum of the few columns
    next to each grid line. Columns between grid lines are dropped before anything is computed.
    """
    steps = F.sequence(F.lit(0), F.lit(size - 1))

    def weight(i: Column, at: str, n: str) -> Column:
        grid = i * (F.col(n) - 1) / F.lit(float(max(size - 1, 1)))
        return 1.0 - F.abs(grid - F.col(at))

    def lines(at: str, n: str) -> Column:
        return F.filter(F.transform(steps, lambda i: F.struct(i.alias("i"), weight(i, at, n).alias("w"))),
                        lambda s: s["w"] > 0)

    def sample(k: Column) -> Column:
        at = k * (F.col("nz") - 1) / F.lit(float(max(size - 1, 1)))
        f = F.floor(at).cast("int")
        low, high = F.get("_w", f), F.coalesce(F.get("_w", f + 1), F.lit(0.0))
        return low * (1 - (at - f)) + high * (at - f)

    near = (columns.withColumn("_i", lines("x", "nx")).withColumn("_j", lines("y", "ny"))
            .where((F.size("_i") > 0) & (F.size("_j") > 0))
            .withColumn("_w", F.transform("hu", lambda v: clip(v.cast("double"), *DESCRIPTOR_LIMITS)))
            .withColumn("_z", F.transform(steps, sample))
            .withColumn("_i", F.explode("_i")).withColumn("_j", F.explode("_j"))
            .select(*CASE_KEY, F.col("_i.i").alias("i"), F.col("_j.i").alias("j"),
                    (F.col("_i.w") * F.col("_j.w")).alias("w"), "_z"))
    cells = near.groupBy(*CASE_KEY, "i", "j").agg(
        F.array(*[F.sum(F.col("w") * F.col("_z")[k]) for k in range(size)]).alias("_z"))
    flat = cells.groupBy(*CASE_KEY).agg(F.sort_array(F.collect_list(F.struct("i", "j", "_z"))).alias("_c")).select(
        *CASE_KEY, F.flatten(F.transform("_c", lambda s: s["_z"])).alias("_raw"))
    return zscored(flat, "_raw", "v").drop("_raw")


def fingerprints(ct: DataFrame, header: DataFrame, size: int = 32) -> DataFrame:
    """(source, case_id, shape, md5, v) for every case of ``header``; null where there is no body to crop to."""
    ct = stored_by_case(ct)
    columns = standard_columns(ct, header, materialise(body_box(ct)))
    return (header.select(*CASE_KEY).join(scan_hash(columns), CASE_KEY, "left")
            .join(descriptor(columns, size), CASE_KEY, "left"))
