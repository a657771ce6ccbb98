"""Which cases exist: from folders of files and from metadata tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runvox import vocabulary
from runvox.scale import fixed_table

SUFFIX = r"\.nii\.gz$"


def list_files(spark: SparkSession, path: str, glob: str = "*.nii.gz") -> DataFrame:
    """Paths and sizes only; file contents are never read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
            .load(path).select("path", F.col("length").alias("size")))


def label_folders(spark: SparkSession) -> DataFrame:
    return fixed_table(spark, vocabulary.LABEL_FOLDERS, ["source", "folder", "official_split"])


def cases_from_folders(files: DataFrame, folders: DataFrame) -> DataFrame:
    """(source, case_id, official_split, path) for files in a known folder ``<source>/<folder>/<case>.nii.gz``.

    ``folders`` is a fixed dimension of a few rows; the match is an equi-join on the folder part of the path.
    """
    known = folders.withColumn("_folder", F.concat_ws("/", "source", "folder"))
    parts = F.split(F.regexp_replace("path", r"/[^/]*$", ""), "/")
    tails = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda d: F.array_join(F.slice(parts, F.size(parts) - d + 1, d), "/"))
    tried = (files.where(F.col("path").rlike(SUFFIX) & (F.size(parts) >= 2))
             .withColumn("_folder", F.explode(tails)))
    case = F.regexp_replace(F.element_at(F.split("path", "/"), -1), SUFFIX, "")
    return tried.join(known, "_folder").select("source", case.alias("case_id"), "official_split", "path")


def cases_from_metadata(spark: SparkSession, path: str, source: str) -> DataFrame:
    """(source, case_id, official_split) from a ``;``-separated table whose header may start with a byte-order mark."""
    table = spark.read.csv(path, sep=";", header=True)
    names = [c.replace("﻿", "") for c in table.columns]
    table = table.toDF(*names)
    return table.select(F.lit(source).alias("source"), F.col("image_id").alias("case_id"),
                        F.col("split").alias("official_split"))


def pair_images(labels: DataFrame, images: DataFrame) -> DataFrame:
    """(source, label_path, candidates, matches, image_path): the image each label file belongs to.

    By source: ``labels…`` → ``images…``; ``label/label…`` → ``img/img…``; ``labels/X`` → ``images/X_0000``; the
    external set keeps its name or adds ``_0000``. ``matches`` must be 1.
    """
    p = F.col("label_path")
    moved = F.replace(p, F.lit("/labels"), F.lit("/images"))
    numbered = F.regexp_replace(moved, SUFFIX, "_0000.nii.gz")
    wanted = (F.when(F.col("source") == "btcv", F.array(F.replace(p, F.lit("/label/label"), F.lit("/img/img"))))
              .when(F.col("source") == "flare", F.array(numbered))
              .when(F.startswith(F.col("source"), F.lit("raos")), F.array(numbered, moved))
              .otherwise(F.array(moved)))
    tried = labels.select("source", "label_path", F.posexplode(wanted).alias("_n", "image_path"))
    there = images.select("image_path", F.lit(True).alias("_there"))
    found = tried.join(there, "image_path", "left")
    hit = F.when(F.col("_there"), F.col("image_path"))
    return found.groupBy("source", "label_path").agg(
        F.count(F.lit(1)).alias("candidates"), F.count("_there").alias("matches"),
        F.min_by(hit, F.when(F.col("_there"), F.col("_n"))).alias("image_path"))


def unpaired(pairs: DataFrame) -> DataFrame:
    """Labels without exactly one image (the external set takes the first of its two names)."""
    several = (F.col("matches") > 1) & ~F.startswith(F.col("source"), F.lit("raos"))
    return pairs.where((F.col("matches") == 0) | several)
