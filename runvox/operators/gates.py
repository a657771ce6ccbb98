"""What must hold before a prediction is scored. Cases that fail are kept aside with their reasons; nothing of them is scored."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from runvox.operators.geometry import all_close
from runvox.scale import materialise
from runvox.schemas import CASE_KEY

REASONS = ("missing", "duplicate", "changed", "grid", "labels")


@dataclass
class Gate:
    """``judged``: (source, case_id, reasons) of every case, stored; ``counts``: cases in all and by reason, counted while
    it was stored."""

    judged: DataFrame
    counts: dict[str, int]

    @property
    def rejects(self) -> DataFrame:
        return self.judged.where(F.size("reasons") > 0)

    def accepted(self, rows: DataFrame) -> DataFrame:
        """The rows of cases with no reason against them."""
        return rows.join(self.judged.where(F.size("reasons") == 0).select(*CASE_KEY), CASE_KEY, "left_semi")


def prediction_gate(references: DataFrame, predictions: DataFrame, record: DataFrame, labels: DataFrame, classes: Sequence[int],
                    atol: float = 1e-3, rtol: float = 1e-5) -> Gate:
    """Judges the prediction of every reference case in one pass over small per-case tables.

    ``references``: (source, case_id, shape, affine), one grid per case; ``predictions``: (source, case_id, shape, affine,
    sha256), a row per file; ``record``: (source, case_id, sha256) as it was written down; ``labels``: (source, case_id,
    label, voxels) of the predictions. No file is ``missing``, several are ``duplicate``; of a single one, the hash must be
    the recorded one (``changed``, also without a record), the grid that of the reference (``grid``, tolerance relative to
    the prediction, also if either is unknown), and all labels within ``classes`` (``labels``).
    """
    files = predictions.groupBy(*CASE_KEY).agg(
        F.count(F.lit(1)).alias("_files"), F.first("shape").alias("_shape"), F.first(F.flatten("affine")).alias("_affine"),
        F.first("sha256").alias("_sha"))
    outside = (labels.where(~F.col("label").isin(list(classes)) & (F.col("voxels") > 0))
               .groupBy(*CASE_KEY).agg(F.count(F.lit(1)).alias("_outside")))
    wrote = record.groupBy(*CASE_KEY).agg(F.first("sha256").alias("_wrote"))
    same_grid = (F.col("shape") == F.col("_shape")) & all_close(F.flatten("affine"), F.col("_affine"), atol, rtol)
    one = F.col("_files") == 1
    tests = {"missing": F.col("_files").isNull(), "duplicate": F.col("_files") > 1,
             "changed": one & ~F.coalesce(F.col("_sha") == F.col("_wrote"), F.lit(False)),
             "grid": one & ~F.coalesce(same_grid, F.lit(False)), "labels": one & (F.col("_outside") > 0)}
    reasons = F.filter(F.array(*[F.when(tests[r], F.lit(r)) for r in REASONS]), lambda r: r.isNotNull())
    seen = Observation()
    rows = (references.select(*CASE_KEY, "shape", "affine").join(files, CASE_KEY, "left").join(wrote, CASE_KEY, "left")
            .join(outside, CASE_KEY, "left").select(*CASE_KEY, reasons.alias("reasons"))
            .observe(seen, F.count(F.lit(1)).alias("cases"), F.count_if(F.size("reasons") > 0).alias("rejected"),
                     *[F.count_if(F.array_contains("reasons", r)).alias(r) for r in REASONS]))
    return Gate(materialise(rows), seen.get)
