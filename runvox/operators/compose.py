"""Composing one label volume out of many masks, and comparing label volumes, column by column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runvox.operators.runs import length, column_sweep, union_runs
from runvox.schemas import CASE_KEY


def with_priority(runs: DataFrame, write_order: Sequence[str]) -> DataFrame:
    """``priority`` = place in the write order; organs outside it are not written."""
    place = F.array_position(F.array(*map(F.lit, write_order)), F.col("organ"))
    return runs.withColumn("priority", place).where(F.col("priority") > 0)


def compose_labels(runs: DataFrame, whole: bool = True) -> DataFrame:
    """Label runs after writing the masks in order of ``priority`` (later wins). Input: organ runs with priority. Runs that
    touch are united if they are to be ``whole``; what counts voxels only needs no such runs."""
    swept = column_sweep(runs, CASE_KEY, ["priority", "organ"])
    top = F.array_max(F.transform("over", lambda r: F.struct(r["priority"].alias("p"), r["organ"].alias("o"))))
    pieces = swept.select(*CASE_KEY, "x", "y", "z0", "z1", top["o"].alias("organ"))
    return union_runs(pieces) if whole else pieces


def overlap_voxels(runs: DataFrame, header: DataFrame) -> DataFrame:
    """Voxels claimed by more than one mask, per case (0 where none)."""
    swept = column_sweep(runs, CASE_KEY, ["organ"])
    shared = swept.groupBy(*CASE_KEY).agg(F.sum(F.when(F.size("over") > 1, length()).otherwise(0)).alias("n"))
    return (header.select(*CASE_KEY).join(shared, CASE_KEY, "left")
            .select(*CASE_KEY, F.coalesce("n", F.lit(0)).cast("long").alias("overlap_voxels")))


def labels_present(composed: DataFrame, organ_ids: dict[str, int]) -> DataFrame:
    """Sorted distinct ids of the composed volume (at most one per class)."""
    ids = F.create_map(*[F.lit(v) for pair in organ_ids.items() for v in pair])
    return composed.groupBy(*CASE_KEY).agg(F.sort_array(F.collect_set(ids[F.col("organ")])).alias("labels_present"))


def merge_pseudo(pseudo: DataFrame, truth: DataFrame, authority: DataFrame, glands: Sequence[str],
                 organ_ids: dict[str, int]) -> DataFrame:
    """Pseudo-labels completed by the truth.

    A pseudo mask of any organ its source labels itself (``authority(source, organ)``) is dropped everywhere; the
    truth is written over the rest, by class id, glands last.
    """
    rest = pseudo.join(authority, ["source", "organ"], "left_anti").withColumn("priority", F.lit(0))
    ids = F.create_map(*[F.lit(v) for pair in organ_ids.items() for v in pair])
    last = F.when(F.col("organ").isin(list(glands)), len(organ_ids) + 1).otherwise(0)
    written = truth.withColumn("priority", (ids[F.col("organ")] + last).cast("int"))
    return compose_labels(rest.unionByName(written))


def label_disagreement(first: DataFrame, second: DataFrame, header: DataFrame, limit: float) -> DataFrame:
    """Voxels whose label differs between two volumes on one grid; background counts as a label.

    Inputs: label runs with an integer ``label``, one label per voxel.
    """
    both = first.withColumn("side", F.lit(0)).unionByName(second.withColumn("side", F.lit(1)))
    swept = column_sweep(both, CASE_KEY, ["side", "label"])
    at = lambda side: F.coalesce(F.array_max(F.transform(F.filter("over", lambda r: r["side"] == side),
                                                         lambda r: r["label"])), F.lit(0))
    pieces = swept.select(*CASE_KEY, length().alias("n"), F.abs(at(0) - at(1)).alias("delta"))
    changed = pieces.groupBy(*CASE_KEY).agg(F.sum(F.when(F.col("delta") > 0, F.col("n")).otherwise(0)).alias("c"),
                                            F.max("delta").alias("d"))
    shape = F.col("shape")
    return (header.select(*CASE_KEY, (shape[0].cast("long") * shape[1] * shape[2]).alias("voxels"))
            .join(changed, CASE_KEY, "left")
            .select(*CASE_KEY, "voxels", F.coalesce("c", F.lit(0)).cast("long").alias("labels_changed"),
                    F.coalesce("d", F.lit(0)).cast("int").alias("max_delta"))
            .withColumn("changed_fraction", F.col("labels_changed") / F.col("voxels"))
            .withColumn("passed", F.col("changed_fraction") <= limit))
