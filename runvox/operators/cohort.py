"""Per-case measurements and the rules that decide what is kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runvox import vocabulary
from runvox.schemas import CASE_KEY


def dense(header: DataFrame, organs: Sequence[str], *columns: str) -> DataFrame:
    """Case × organ domain: an organ without voxels is a row, not a gap."""
    return header.select(*CASE_KEY, *columns, F.explode(F.array(*map(F.lit, organs))).alias("organ"))


def organ_volumes(measured: DataFrame, header: DataFrame, organs: Sequence[str]) -> DataFrame:
    """Voxels and volume (mL, 2 dp) of every organ of every case, zero where absent."""
    n = F.coalesce("voxels", F.lit(0)).cast("long")
    return (dense(header, organs, "voxel_ml").join(measured.select(*CASE_KEY, "organ", "voxels"),
                                                   [*CASE_KEY, "organ"], "left")
            .select(*CASE_KEY, "organ", n.alias("voxels"), F.round(n * F.col("voxel_ml"), 2).alias("volume_ml")))


def component_profile(sizes: DataFrame) -> DataFrame:
    """Number of components, largest and second largest size of each mask.

    Equal sizes are counted first; the list that is then sorted holds distinct sizes only, and since distinct sizes
    add up to at most the voxels of one scan, it stays below the square root of twice that number.
    """
    key = [*CASE_KEY, "organ"]
    by_size = sizes.groupBy(*key, "voxels").agg(F.count(F.lit(1)).alias("_k"))
    listed = by_size.groupBy(*key).agg(F.sum("_k").alias("components"), F.max("voxels").alias("largest"),
                                       F.max_by("_k", "voxels").alias("_ties"),
                                       F.sort_array(F.collect_list("voxels"), asc=False).alias("_sizes"))
    second = F.when(F.col("_ties") > 1, F.col("largest")).otherwise(F.get("_sizes", F.lit(1)))
    return listed.select(*key, "components", "largest", F.coalesce(second, F.lit(0)).alias("second"))


def gland_decisions(profile: DataFrame, touch: DataFrame, header: DataFrame,
                    glands: Sequence[str] = vocabulary.GLANDS, speckle_ml: float = vocabulary.SPECKLE_ML,
                    minimum_ml: float = vocabulary.MINIMUM_ML) -> DataFrame:
    """The cleaning rule, one row per case and gland. The order of the tests is part of the rule."""
    key = [*CASE_KEY, "organ"]
    largest, second = F.col("largest") * F.col("voxel_ml"), F.col("second") * F.col("voxel_ml")
    decision = (F.when(F.col("components") == 0, "absent")
                .when((F.col("components") > 1) & (second >= speckle_ml), "exclude_fragmented")
                .when(largest <= minimum_ml, "exclude_small")
                .when(F.col("touches_edge"), "exclude_truncated")
                .when(F.col("components") > 1, "keep_despeckled").otherwise("keep"))
    known = (dense(header, glands, "voxel_ml").join(profile, key, "left")
             .join(touch.select(*key, "touches_edge"), key, "left")
             .fillna(0, ["components", "largest", "second"]).fillna(False, ["touches_edge"]))
    return known.select(*key, "components", F.round(largest, 4).alias("largest_ml"),
                        F.round(second, 4).alias("second_ml"), "touches_edge", decision.alias("decision"))


def wide_decisions(decisions: DataFrame, glands: Sequence[str] = vocabulary.GLANDS) -> DataFrame:
    columns = []
    for g in glands:
        mine = lambda c, g=g: F.max(F.when(F.col("organ") == g, F.col(c)))
        columns += [mine("decision").alias(g), mine("components").alias(f"{g}_components"),
                    mine("largest_ml").alias(f"{g}_largest_ml"), mine("second_ml").alias(f"{g}_second_ml")]
    return decisions.groupBy(*CASE_KEY).agg(*columns)


def case_outcome(decisions: DataFrame, sides: DataFrame, header: DataFrame,
                 glands: Sequence[str] = vocabulary.GLANDS, max_slice_mm: float = vocabulary.MAX_SLICE_MM) -> DataFrame:
    """The cohort row: gland columns, ``sides`` and ``scan``. A header that carries an ``error`` yields ``error``, and
    its gland columns are null: a case that could not be read was not judged."""
    any_of = lambda test: F.array_contains(F.array(*[test(F.col(g)) for g in glands]), True)
    thickness = F.round(F.array_max("zooms"), 3)
    error = F.coalesce("error", F.lit("")) if "error" in header.columns else F.lit("")
    head = header.select(*CASE_KEY, thickness.alias("slice_thickness_mm"), error.alias("error"))
    excluded = (F.col("slice_thickness_mm") > max_slice_mm) | (F.col("sides") != "ok") \
        | any_of(lambda d: d.startswith("exclude"))
    scan = (F.when(F.col("error") != "", "error").when(excluded, "excluded")
            .when(~any_of(lambda d: d != "absent"), "kept_no_adrenal").otherwise("kept_with_adrenal"))
    wide = wide_decisions(decisions, glands)
    judged = {c: F.when(F.col("error") == "", F.col(c)) for c in wide.columns if c not in CASE_KEY}
    return head.join(wide, CASE_KEY).join(sides, CASE_KEY).withColumn("scan", scan).withColumns(judged)


def training_exclusion(decisions: DataFrame, glands: Sequence[str] = vocabulary.GLANDS) -> DataFrame:
    """The revised rule: only a fragmented gland, or a small one wholly in view, excludes. Names the first offender."""
    offends = (F.col("decision") == "exclude_fragmented") \
        | ((F.col("decision") == "exclude_small") & ~F.col("touches_edge"))
    order = F.array_position(F.array(*map(F.lit, glands)), F.col("organ"))
    text = F.concat_ws(": ", "organ", "decision")
    return decisions.groupBy(*CASE_KEY).agg(
        F.coalesce(F.min_by(F.when(offends, text), F.when(offends, order)), F.lit("")).alias("reason"))


def kept_cases(cohort: DataFrame, sources: Sequence[str]) -> DataFrame:
    return cohort.where(F.col("scan").startswith("kept") & F.col("source").isin(list(sources)))


def candidates(cohort: DataFrame, max_slice_mm: float = vocabulary.MAX_SLICE_MM) -> DataFrame:
    """What the revised rule can know from the table alone, before any mask is read."""
    fragmented = F.array_contains(F.array(*map(F.col, vocabulary.GLANDS)), "exclude_fragmented")
    return cohort.where((F.col("error") == "") & (F.col("sides") == "ok")
                        & (F.col("slice_thickness_mm") <= max_slice_mm) & ~fragmented)


def decision_drift(first: DataFrame, second: DataFrame) -> DataFrame:
    """Glands the second step judges differently from the first: must be empty."""
    again = second.select(*CASE_KEY, "organ", F.col("decision").alias("second_decision"))
    return (first.select(*CASE_KEY, "organ", "decision").join(again, [*CASE_KEY, "organ"])
            .where(~F.col("decision").eqNullSafe(F.col("second_decision"))))
