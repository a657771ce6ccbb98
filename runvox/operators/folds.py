"""Stratified, order-independent splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runvox import vocabulary
from runvox.operators.report import with_levels
from runvox.scale import exact_quantiles, materialise, ranked

KEY = ["source", "case_id"]


def thickness_group(mm: Column) -> Column:
    return F.when(mm <= 2, "<=2 mm").when(mm <= 4, "2-4 mm").otherwise("4-5 mm")


def strata(cases: DataFrame, minimum: int = vocabulary.MINIMUM_GROUP) -> DataFrame:
    """``stratum`` per case: source | thickness | volume third, coarser where a level has too few cases.

    ``cases(source, case_id, slice_thickness_mm, volume)``. The two cut points are scalars; the level counts come
    from one grouping by the finest level, rolled up on that small result.
    """
    cut = materialise(exact_quantiles(cases.where(F.col("volume") > 0), [], "volume", {"low": 1 / 3, "high": 2 / 3}))
    low, high = cut.select("low").scalar(), cut.select("high").scalar()
    v = F.col("volume")
    size = F.when(v == 0, "none").when(v <= low, "small").when(v <= high, "medium").otherwise("large")
    sized = cases.withColumn("_thick", thickness_group(F.col("slice_thickness_mm"))).withColumn("_size", size)
    fine = sized.groupBy("source", "_thick", "_size").agg(F.count(F.lit(1)).alias("_n"))
    mid = fine.groupBy("source", "_size").agg(F.sum("_n").alias("_m"))
    label = (F.when(F.col("_n") >= minimum, F.concat_ws("|", "source", "_thick", "_size"))
             .when(F.col("_m") >= minimum, F.concat_ws("|", "source", "_size")).otherwise(F.col("source")))
    names = fine.join(mid, ["source", "_size"]).select("source", "_thick", "_size", label.alias("stratum"))
    return sized.join(names, ["source", "_thick", "_size"]).drop("_thick", "_size")


def fold_hash(seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *KEY))


def folds(labelled: DataFrame, k: int = vocabulary.FOLDS, seed: int = vocabulary.SPLIT_SEED) -> DataFrame:
    """``fold`` per case: strata in order of their first case, cases inside by a seeded hash, positions dealt out.

    Every stratum is spread evenly and input order plays no part. Dealing along one global order gives fold i the
    positions i, i+k, …, so fold sizes per stratum equal those of a stratified k-fold over classes numbered by first
    appearance. The order is a distributed rank; no stratum is sorted in one task.
    """
    first = labelled.groupBy("stratum").agg(F.min(F.struct(*KEY)).alias("_first"))
    ordered = (labelled.join(first, "stratum")
               .select(*labelled.columns, F.col("_first.source").alias("_s"), F.col("_first.case_id").alias("_c"),
                       fold_hash(seed).alias("_h")))
    return (ranked(ordered, ["_s", "_c", "_h", *KEY]).withColumn("fold", (F.col("position") % k).cast("int"))
            .drop("_s", "_c", "_h", "position"))


def five_folds(cases: DataFrame) -> DataFrame:
    return folds(strata(cases))


def split_roles(cases: DataFrame) -> DataFrame:
    """Fold 0 of all cases is the test set; the rest is stratified afresh and its fold 0 validates.

    ``role``: test / validation / train; ``fold``: the case's fold in the second division (null for test);
    ``stratum``: the one it was dealt by; ``overall_stratum``: its stratum among all cases, for reports over all parts.
    """
    outer = materialise(five_folds(cases)).withColumn("overall_stratum", F.col("stratum"))
    test = outer.where("fold = 0").select(*cases.columns, "stratum", "overall_stratum", F.lit("test").alias("role"),
                                          F.lit(None).cast("int").alias("fold"))
    inner = five_folds(outer.where("fold <> 0").select(*cases.columns, "overall_stratum"))
    role = F.when(F.col("fold") == 0, "validation").otherwise("train")
    return test.unionByName(inner.select(*cases.columns, "stratum", "overall_stratum", role.alias("role"), "fold"))


def balance(split: DataFrame) -> DataFrame:
    """Per part: cases, cases with glands, median of their volume, and counts per thickness group."""
    thick = thickness_group(F.col("slice_thickness_mm"))
    counts = split.groupBy("role").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(F.col("volume") > 0).alias("with_glands"),
        *[F.count_if(thick == g).alias(n) for g, n in (("<=2 mm", "thin"), ("2-4 mm", "middle"), ("4-5 mm", "thick"))])
    middle = exact_quantiles(split.where(F.col("volume") > 0), ["role"], "volume", {"median_volume": 0.5})
    return counts.join(middle, "role", "left").fillna(0.0, ["median_volume"])


def stratum_mix(split: DataFrame) -> DataFrame:
    """Cases per stratum in each part, and over all parts; strata are those of all cases at once."""
    split = split.withColumn("stratum", F.col("overall_stratum"))
    return with_levels(split, [["stratum"], ["role", "stratum"]]).groupBy("role", "stratum").agg(
        F.count(F.lit(1)).alias("cases"))


def split_table(split: DataFrame, name: Column, k: int = vocabulary.FOLDS) -> DataFrame:
    """(fold, part, name) for all k folds of the development cases."""
    every = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    dev = split.where(F.col("role") != "test").select(name.alias("name"), F.col("fold").alias("_own"),
                                                      every.alias("fold"))
    return dev.select("fold", F.when(F.col("_own") == F.col("fold"), "val").otherwise("train").alias("part"), "name")


def split_violations(split: DataFrame, build: DataFrame, k: int = vocabulary.FOLDS) -> DataFrame:
    """(fold, name, problem): names listed twice or in both parts, missing or unknown names, test names, absent folds.

    ``split(fold, part, name)``, ``build(name, role)`` with roles train / test. Empty means the split is sound.
    """
    seen = split.groupBy("fold", "name").agg(F.count_if(F.col("part") == "train").alias("t"),
                                             F.count_if(F.col("part") == "val").alias("v"))
    all_folds = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold")
    kept = build.where("role = 'train'").select(all_folds, "name", F.lit(True).alias("_kept"))
    test = build.where("role = 'test'").select("name", F.lit(True).alias("_test")).distinct()
    checked = seen.join(kept, ["fold", "name"], "full_outer").join(test, "name", "left")
    problem = F.array_compact(F.array(
        F.when((F.col("t") > 0) & (F.col("v") > 0), "in both parts"),
        F.when((F.col("t") > 1) | (F.col("v") > 1), "listed twice"),
        F.when(F.col("t").isNull(), "missing from fold"),
        F.when(F.col("_test").isNotNull() & F.col("t").isNotNull(), "test case in fold"),
        F.when(F.col("_test").isNotNull() & F.col("_kept").isNotNull(), "kept and test"),
        F.when(F.col("_kept").isNull() & F.col("_test").isNull(), "not a kept case")))
    return checked.select("fold", "name", F.explode(problem).alias("problem"))
