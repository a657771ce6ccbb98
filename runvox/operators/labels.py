"""Mapping of label ids and structure names onto the target organs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runvox import vocabulary
from runvox.operators.runs import union_runs
from runvox.scale import fixed_table


def organ_map(spark: SparkSession) -> DataFrame:
    """(source, label, organ): a fixed table of a few dozen rows."""
    rows = [(s, i, o) for s, ids in vocabulary.LABEL_IDS.items() for o, i in ids.items()]
    rows += [(f"raos{n}", i, o) for n in (1, 2, 3) for o, i in vocabulary.RAOS_LABEL_IDS.items()]
    return fixed_table(spark, rows, ["source", "label", "organ"])


def structure_map(spark: SparkSession) -> DataFrame:
    rows = [(s, o) for o, parts in vocabulary.STRUCTURES.items() for s in parts]
    return fixed_table(spark, rows, ["structure", "organ"])


def remap_labels(runs: DataFrame, label_map: DataFrame) -> DataFrame:
    """Ids without an entry are background and drop out. Works on any rows with ``source`` and ``label``."""
    return runs.join(label_map, ["source", "label"]).drop("label")


def merge_structures(runs: DataFrame, structures: DataFrame) -> DataFrame:
    """Several structures make one organ; their masks may overlap, so the runs are united."""
    return union_runs(runs.join(structures, "structure").drop("structure"))


def map_by_name(source_classes: DataFrame, target_names: DataFrame) -> DataFrame:
    """Target (name, id) ⟕ source (name, id) by name; ``missing`` marks a target the source list lacks."""
    found = source_classes.select("name", F.col("id").alias("source_id"))
    return (target_names.select("name", F.col("id").alias("target_id")).join(found, "name", "left")
            .withColumn("missing", F.col("source_id").isNull()))


def map_by_prefix(model_labels: DataFrame, aliases: dict[str, list[str]], organ_ids: dict[str, int]) -> DataFrame:
    """Model label (label, number) belongs to the organ whose alias its name starts with; several: the highest id.

    The aliases are a small vocabulary, so they become one expression and no join is needed.
    """
    hits = []
    for organ, number in organ_ids.items():
        starts = F.lit(False)
        for alias in aliases.get(organ, [organ]):
            starts = starts | F.startswith(F.col("label"), F.lit(alias))
        hits.append(F.when(starts, F.lit(number)))
    return (model_labels.withColumn("organ_id", F.array_max(F.array(*hits)))
            .where(F.col("organ_id").isNotNull()).select("label", "number", "organ_id"))


def unreached_organs(mapping: DataFrame, organs: DataFrame) -> DataFrame:
    """Organs no label maps to: must be empty before a model is accepted."""
    return organs.join(mapping.select("organ_id").distinct(), "organ_id", "left_anti")


def bad_labels(runs: DataFrame, classes: DataFrame) -> DataFrame:
    """Per case the voxels whose label is outside the allowed set ``classes(label)``."""
    outside = runs.join(classes.select("label").distinct(), "label", "left_anti")
    return (outside.groupBy("source", "case_id")
            .agg(F.countDistinct("label").alias("unexpected_labels"), F.sum("voxels").alias("voxels"),
                 F.min("label").alias("first_label")))
