"""The end-to-end jobs: audit a cohort, build its dataset, score predictions behind a gate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runvox import vocabulary
from runvox.functions.text import case_name
from runvox.operators import cohort, components, compose, geometry, labels, provenance, score
from runvox.operators.gates import Gate
from runvox.scale import materialise
from runvox.schemas import CASE_KEY, RUN_KEY


@dataclass
class Audit:
    """Everything one pass over the masks of a cohort yields. ``labelled`` and ``sizes`` are stored tables."""

    header: DataFrame
    measured: DataFrame
    labelled: DataFrame
    sizes: DataFrame
    touch: DataFrame
    decisions: DataFrame
    sides: DataFrame
    cohort: DataFrame


def audit(runs: DataFrame, header: DataFrame, organs: Sequence[str],
          pairs: Sequence[tuple[str, str]] = tuple(vocabulary.SIDE_PAIRS),
          glands: Sequence[str] = tuple(vocabulary.GLANDS), speckle_ml: float = vocabulary.SPECKLE_ML,
          minimum_ml: float = vocabulary.MINIMUM_ML) -> Audit:
    """Measure every mask, judge the glands, check the sides, decide each case."""
    runs = runs.where(F.col("organ").isin(list(organs)))
    measured = geometry.extents(runs)
    labelled = materialise(components.label_components(runs))
    sizes = materialise(components.component_sizes(labelled))
    touch = geometry.edge_touch(measured, header)
    profile = cohort.component_profile(sizes.where(F.col("organ").isin(list(glands))))
    decisions = cohort.gland_decisions(profile, touch, header, glands, speckle_ml, minimum_ml)
    sides = geometry.sides_check(measured, header, pairs)
    return Audit(header, measured, labelled, sizes, touch, decisions, sides,
                 cohort.case_outcome(decisions, sides, header, glands))


def score_predictions(truth: DataFrame, prediction: DataFrame, header: DataFrame, organs: Sequence[str]) -> DataFrame:
    """Volume metrics of every case and organ, absent ones included."""
    return score.volume_metrics(score.confusion(truth, prediction, header, organs))


def score_scans(truth: DataFrame, prediction: DataFrame, header: DataFrame, organs: Sequence[str],
                tolerances: Sequence[float] = tuple(vocabulary.TOLERANCES_MM)) -> DataFrame:
    """Volume metrics and surface Dice of every case and organ: the full score row."""
    volumes = score_predictions(truth, prediction, header, organs)
    return volumes.join(score.surface_dice(truth, prediction, header, organs, tolerances), RUN_KEY)


def score_raw(structures: DataFrame, structure_map: DataFrame, prediction: DataFrame, header: DataFrame,
              organs: Sequence[str], membership: DataFrame) -> DataFrame:
    """Organs scored against raw, uncleaned masks that may overlap, tagged with the part of the split."""
    truth = labels.merge_structures(structures, structure_map)
    scored = score_predictions(truth, prediction, header, organs)
    named = scored.withColumn("name", case_name(F.col("source"), F.col("case_id")))
    return provenance.with_membership(named, membership)


def gated_scores(truth: DataFrame, prediction: DataFrame, header: DataFrame, organs: Sequence[str], gate: Gate) -> DataFrame:
    """Volume metrics of the cases that pass the gate; masks of the others are left out before anything is joined."""
    return score_predictions(gate.accepted(truth), gate.accepted(prediction), gate.accepted(header), organs)


def build_dataset(done: Audit, first: DataFrame, images: DataFrame, roles: DataFrame, organ_ids: dict[str, int],
                  write_order: Sequence[str], glands: Sequence[str] = tuple(vocabulary.GLANDS)) -> tuple[DataFrame, DataFrame]:
    """(rows, composed): one row per cohort case, and the label runs of the cases that were built.

    ``done``: an audit of the masks as they are now; ``first``: the cohort table written earlier (source, case_id, scan and a
    decision per gland); ``images``: (source, case_id, shape, affine) of the scans; ``roles``: (source, case_id, role). A case
    that is not kept is ``excluded``, with its outcome as ``error``. A kept case whose image lies on another grid, or whose
    glands are judged differently now, is ``failed`` and says why; no label is composed for it. For all others only the
    largest piece of each gland stays before masks are written over each other, and overlaps are counted after that.
    """
    kept = F.col("scan").startswith("kept")
    grid = geometry.grid_agreement(done.header, images).select(*CASE_KEY, F.col("agrees"))
    before = first.select(*CASE_KEY, "scan", F.expr(f"stack({len(glands)}, {', '.join(f"'{g}', {g}" for g in glands)}) AS (organ, decision)"))
    drift = cohort.decision_drift(before.where(kept), done.decisions)
    order = F.array_position(F.array(*map(F.lit, glands)), F.col("organ"))
    drift = drift.groupBy(*CASE_KEY).agg(F.min_by(
        F.concat("organ", F.lit(": was "), "decision", F.lit(", is "), "second_decision"), order).alias("_drift"))
    judged = (first.select(*CASE_KEY, "scan").join(grid, CASE_KEY, "left").join(drift, CASE_KEY, "left").join(roles, CASE_KEY, "left")
              .withColumn("error", F.when(~kept, F.col("scan")).when(~F.coalesce("agrees", F.lit(False)), "image grid differs from label grid")
                          .otherwise(F.coalesce("_drift", F.lit(""))))
              .withColumn("role", F.when(~kept, "excluded").when(F.col("error") != "", "failed").otherwise(F.col("role")))
              .select(*CASE_KEY, "role", "error"))
    judged = materialise(judged)
    built = judged.where("error = ''").select(*CASE_KEY)
    labelled = done.labelled.join(built, CASE_KEY, "left_semi")
    gland = F.col("organ").isin(list(glands))
    clean = materialise(components.keep_largest(labelled.where(gland)).select(*RUN_KEY, "x", "y", "z0", "z1")
                        .unionByName(labelled.where(~gland).select(*RUN_KEY, "x", "y", "z0", "z1")))
    composed = materialise(compose.compose_labels(compose.with_priority(clean, write_order)))
    removed = components.speckle_removed(done.sizes.where(gland).join(built, CASE_KEY, "left_semi"), done.header)
    removed = removed.groupBy(*CASE_KEY).agg(*[F.max(F.when(F.col("organ") == g, F.col("removed_ml"))).alias(f"{g}_removed_ml") for g in glands])
    head = done.header.join(built, CASE_KEY, "left_semi")
    rows = (judged.join(compose.overlap_voxels(clean, head), CASE_KEY, "left").join(compose.labels_present(composed, organ_ids), CASE_KEY, "left")
            .join(removed, CASE_KEY, "left"))
    whole = F.col("error") == ""
    return rows.select(
        *CASE_KEY, case_name(F.col("source"), F.col("case_id")).alias("name"), "role",
        *[F.when(whole, F.coalesce(f"{g}_removed_ml", F.lit(0.0))).alias(f"{g}_removed_ml") for g in glands], "overlap_voxels",
        F.when(whole, F.coalesce("labels_present", F.array().cast("array<int>"))).alias("labels_present"), "error"), composed
