"""Grids, voxel volumes, edges, centres and left/right order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runvox.operators.runs import length
from runvox.schemas import CASE_KEY, RUN_KEY


def all_close(a: Column, b: Column, atol: float = 1e-3, rtol: float = 1e-5) -> Column:
    """Every element of ``a`` within ``atol + rtol * |b|`` of ``b``; the tolerance follows the second operand."""
    return F.forall(F.zip_with(a, b, lambda p, q: F.abs(p - q) <= F.lit(atol) + F.lit(rtol) * F.abs(q)), lambda ok: ok)


def grid_agreement(first: DataFrame, second: DataFrame, atol: float = 1e-3, rtol: float = 1e-5) -> DataFrame:
    """One row per case of ``first`` with ``same_shape``, ``same_affine`` and ``agrees``; an absent or null grid
    agrees with nothing."""
    b = second.select(*CASE_KEY, F.col("shape").alias("_shape"), F.flatten("affine").alias("_affine"))
    return (first.join(b, CASE_KEY, "left")
            .withColumn("same_shape", F.coalesce(F.col("shape") == F.col("_shape"), F.lit(False)))
            .withColumn("same_affine", F.coalesce(all_close(F.flatten("affine"), F.col("_affine"), atol, rtol), F.lit(False)))
            .withColumn("agrees", F.col("same_shape") & F.col("same_affine"))
            .select(*CASE_KEY, "same_shape", "same_affine", "agrees"))


def grid_mismatch(first: DataFrame, second: DataFrame, atol: float = 1e-3, rtol: float = 1e-5) -> DataFrame:
    return grid_agreement(first, second, atol, rtol).where(~F.col("agrees"))


def _cell(affine: Column, row: int, column: int) -> Column:
    return affine[row][column]


def zoom_voxel_ml(zooms: Column) -> Column:
    return zooms[0] * zooms[1] * zooms[2] / 1000


def column_norms(affine: Column) -> list[Column]:
    """Voxel size along each array axis: the norms of the first three affine columns."""
    return [F.sqrt(sum((_cell(affine, r, c) * _cell(affine, r, c) for r in (1, 2)),
                       _cell(affine, 0, c) * _cell(affine, 0, c))) for c in range(3)]


def norm_voxel_ml(affine: Column) -> Column:
    a, b, c = column_norms(affine)
    return a * b * c / 1000


def det_voxel_ml(affine: Column) -> Column:
    m = [[_cell(affine, r, c) for c in range(3)] for r in range(3)]
    det = (m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1])
           - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0])
           + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0]))
    return F.abs(det) / 1000


def slice_thickness(zooms: Column) -> Column:
    """The coarsest axis, to a micrometre."""
    return F.round(F.array_max(zooms), 3)


def extents(runs: DataFrame, keys: Sequence[str] = RUN_KEY) -> DataFrame:
    """Voxel count, bounding box and index sums of each mask: the single pass most measurements start from."""
    n = length().cast("long")
    return runs.groupBy(*keys).agg(
        F.sum(n).alias("voxels"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"),
        F.max("y").alias("y_max"), F.min("z0").alias("z_min"), F.max("z1").alias("z_max"),
        F.sum(n * F.col("x")).alias("x_sum"), F.sum(n * F.col("y")).alias("y_sum"),
        F.sum(n * (F.col("z0") + F.col("z1"))).alias("z_sum2"))


def edge_touch(measured: DataFrame, header: DataFrame) -> DataFrame:
    """A mask touches a face of the scan exactly if its bounding box does, so no run meets the header."""
    last = lambda i: F.col("shape")[i] - 1
    touches = ((F.col("x_min") == 0) | (F.col("y_min") == 0) | (F.col("z_min") == 0) | (F.col("x_max") == last(0))
               | (F.col("y_max") == last(1)) | (F.col("z_max") == last(2)))
    return (measured.join(header.select(*CASE_KEY, "shape"), CASE_KEY)
            .withColumn("touches_edge", touches).drop("shape"))


def world_x(measured: DataFrame, header: DataFrame) -> DataFrame:
    """Centre of mass of each mask along the world x axis (grows towards the patient's right)."""
    row = F.col("affine")[0]
    n = F.col("voxels")
    x = row[0] * (F.col("x_sum") / n) + row[1] * (F.col("y_sum") / n) + row[2] * (F.col("z_sum2") / (2 * n)) + row[3]
    return (measured.join(header.select(*CASE_KEY, "affine"), CASE_KEY)
            .select(*CASE_KEY, "organ", x.alias("world_x")))


def sides_check(measured: DataFrame, header: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``ok`` or which organs lie on the wrong side, one row per case of ``header``. Absent organs are skipped."""
    organs = sorted({o for pair in pairs for o in pair})
    at = world_x(measured.where(F.col("organ").isin(organs)), header)
    wide = at.groupBy(*CASE_KEY).agg(*[F.max(F.when(F.col("organ") == o, F.col("world_x"))).alias(f"_{o}")
                                       for o in organs])
    wrong = [F.when(F.col(f"_{left}") >= F.col(f"_{right}"), F.lit(f"{left} is not left of {right}"))
             for left, right in pairs]
    text = F.concat_ws("; ", *wrong)  # concat_ws skips the pairs that are in order
    return (header.select(*CASE_KEY).join(wide, CASE_KEY, "left")
            .select(*CASE_KEY, F.when(text == "", "ok").otherwise(text).alias("sides")))


def swap_gate(measured: DataFrame, header: DataFrame, left: str, right: str, keys: Sequence[str] = ("source",),
              one_in: int = 20) -> DataFrame:
    """Per collection: scans whose left organ lies right of the right one, and whether they are too many.

    Centres are compared along the world x axis, whichever array axis runs along it.
    """
    at = world_x(measured.where(F.col("organ").isin(left, right)), header)
    sides = at.groupBy(*CASE_KEY).agg(*[F.max(F.when(F.col("organ") == o, F.col("world_x"))).alias(n)
                                        for o, n in ((left, "_l"), (right, "_r"))])
    wrong = F.coalesce(F.col("_l") > F.col("_r"), F.lit(False))
    return (header.join(sides, CASE_KEY, "left").groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("scans"), F.count_if(wrong).alias("swapped"))
            .withColumn("looks_swapped", F.col("swapped") > F.floor(F.col("scans") / one_in)))
