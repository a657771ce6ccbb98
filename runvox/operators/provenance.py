"""Which set each scan belongs to, for every model and comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runvox import vocabulary
from runvox.schemas import CASE_KEY


def roles(build: DataFrame, split: DataFrame) -> DataFrame:
    """(name, role): train / validation from fold 0, test from the build table."""
    part = F.when(F.col("part") == "val", "validation").otherwise(F.col("part"))
    return split.where("fold = 0").select("name", part.alias("role")).unionByName(
        build.where("role = 'test'").select("name", "role"))


def with_membership(rows: DataFrame, membership: DataFrame, default: str = vocabulary.OUTSIDE_SPLIT) -> DataFrame:
    """``split`` per row; scans in no part get the default."""
    part = membership.select("name", F.col("role").alias("_role"))
    return rows.join(part, "name", "left").withColumn("split", F.coalesce("_role", F.lit(default))).drop("_role")


def inherit_roles(candidates: DataFrame, old_build: DataFrame, old_split: DataFrame) -> DataFrame:
    """Old test stays test, old validation stays val, every other old case and every new one trains."""
    old = old_build.where(F.col("role").isin("train", "test")).select("name", F.col("role").alias("_old"))
    val = old_split.where("fold = 0 AND part = 'val'").select("name", F.lit(True).alias("_val")).distinct()
    role = (F.when(F.col("_old") == "test", "test")
            .when(F.col("_old").isNotNull() & F.col("_val").isNotNull(), "val").otherwise("train"))
    return (candidates.join(old, "name", "left").join(val, "name", "left").withColumn("role", role)
            .withColumn("is_new", F.col("_old").isNull()).drop("_old", "_val"))


def lost_cases(candidates: DataFrame, old_build: DataFrame) -> DataFrame:
    """Old train or test cases that are no longer candidates: must be empty."""
    return old_build.where(F.col("role").isin("train", "test")).join(candidates, "name", "left_anti")


def provenance(scanned: DataFrame, old_roles: DataFrame, new_build: DataFrame, unlabelled: str = "ts",
               external: tuple[str, ...] = ("amos", "btcv"), flare: str = "flare") -> DataFrame:
    """One row per scanned case with its role in each model and comparison set.

    ``scanned`` has ``name``; ``old_roles(name, role)``; ``new_build(name, role, reason)``.
    """
    old = old_roles.select("name", F.col("role").alias("_old"))
    new = new_build.select("name", F.col("role").alias("_new"), F.col("reason").alias("_reason"))
    labelled = F.col("source") != unlabelled
    test = F.coalesce(F.col("_old") == "test", F.lit(False))
    yes = lambda c: F.when(c, "yes").otherwise("")
    return (scanned.join(old, "name", "left").join(new, "name", "left").select(
        "name", *CASE_KEY, F.col("scan").alias("scan_decision"),
        F.when(labelled, "yes").otherwise(vocabulary.OWN_LABELS).alias("pseudo_label"),
        F.coalesce("_old", F.lit("excluded")).alias("first_finetune"),
        F.coalesce("_new", F.lit(vocabulary.OUTSIDE_BUILD)).alias("second_finetune"),
        F.coalesce("_reason", F.lit("")).alias("second_finetune_exclusion"),
        yes(test).alias("comparison_test"), yes(test & labelled).alias("comparison_matched"),
        yes(F.col("source").isin(*external)).alias("comparison_external"),
        yes(F.col("source") == flare).alias("comparison_flare")))
