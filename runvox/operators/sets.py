"""Comparing tables as sets and as sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_columns(*tables: DataFrame) -> DataFrame:
    """Union by name; columns a table lacks are null (written as empty fields)."""
    rows = tables[0]
    for more in tables[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    return rows


def membership_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): members of only one of the two sets."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    both = left.withColumn("_a", F.lit(True)).join(right.withColumn("_b", F.lit(True)), key, "full_outer")
    return both.where("_a IS NULL OR _b IS NULL").select(
        key, F.when(F.col("_b").isNull(), "only_a").otherwise("only_b").alias("side"))


def not_contained(part: DataFrame, whole: DataFrame) -> DataFrame:
    """Rows of ``part`` absent from ``whole`` (null-safe on every column): empty means contained."""
    return part.join(whole, [part[c].eqNullSafe(whole[c]) for c in part.columns], "left_anti")


def ordered_difference(a: DataFrame, b: DataFrame, position: str, value: str) -> DataFrame:
    """Positions where two ordered lists differ, longer tails included: empty means equal sequences."""
    left = a.select(position, F.col(value).alias("left_value"))
    right = b.select(position, F.col(value).alias("right_value"))
    return left.join(right, position, "full_outer").where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def missing_rows(wanted: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wanted rows without a counterpart."""
    return wanted.join(present.select(*keys).distinct(), list(keys), "left_anti")
