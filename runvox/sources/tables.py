"""Row tables in and out: CSV, JSON, text, shard replacement, completion records."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runvox.operators.manifest import content_id, file_inventory


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every field is read as text; empty is null; casts that fail give null instead of ending the job."""
    fields = T.StructType.fromDDL(schema).fields
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in fields])
    raw = spark.read.schema(text).csv(path, header=True)
    value = lambda f: F.nullif(F.col(f.name), F.lit(""))
    return raw.select(*[value(f).try_cast(f.dataType).alias(f.name) for f in fields])


def write_csv(table: DataFrame, path: str, order: list[str]) -> None:
    """Header, empty gaps, deterministic order (a range sort: many files, in order)."""
    table.orderBy(*order).write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="")


def split_from_json(spark: SparkSession, path: str) -> DataFrame:
    """[{train: […], val: […]}, …] → (fold, part, name). The document is a list of k folds."""
    doc = spark.read.text(path, wholetext=True).select(
        F.from_json("value", "array<struct<train:array<string>,val:array<string>>>").alias("folds"))
    return split_from_folds(doc)


def split_from_folds(doc: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, fold, part, name) from a column ``folds`` of parsed documents."""
    per_fold = doc.select(*keys, F.posexplode("folds").alias("fold", "f"))
    parts = F.map_from_arrays(F.array(F.lit("train"), F.lit("val")), F.array("f.train", "f.val"))
    return (per_fold.select(*keys, "fold", F.explode(parts).alias("part", "names"))
            .select(*keys, "fold", "part", F.explode("names").alias("name")))


def members_from_json(spark: SparkSession, path: str) -> DataFrame:
    """{members: {case: [ids]}} → (case_id, member_id)."""
    doc = spark.read.schema("members map<string,array<string>>").json(path, multiLine=True)
    return (doc.select(F.explode("members").alias("case_id", "ids"))
            .select("case_id", F.explode("ids").alias("member_id")))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One id per line, with its position, for ordered comparison."""
    doc = spark.read.text(path, wholetext=True).select(F.split(F.rtrim("value", F.lit("\r\n")), "\r?\n").alias("l"))
    return doc.select(F.posexplode("l").alias("position", "id"))


def log_ids(lines: DataFrame, pattern: str, group: int = 1) -> DataFrame:
    """Distinct ids a regular expression finds anywhere in ``lines(value)``."""
    return lines.select(F.explode(F.regexp_extract_all("value", F.lit(pattern), F.lit(group))).alias("id")).distinct()


def replace_shard(rows: DataFrame, path: str, shards: Sequence[str] = ()) -> None:
    """Write rows partitioned by shard: shards present in ``rows`` are replaced, all others stay. Safe to repeat.

    ``shards`` names the shards that were run again (plain names, as they stand in the folder); those that have no rows
    any more are emptied. A shard with many rows is written by several tasks.
    """
    kept = [c for c in rows.columns if c != "shard"]
    (rows.hint("rebalance", "shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("shard").parquet(path))
    if shards:
        present = {r["shard"] for r in rows.where(F.col("shard").isin(list(shards))).select("shard").distinct().collect()}
        for shard in sorted(set(shards) - present):
            rows.select(*kept).where(F.lit(False)).write.mode("overwrite").parquet(f"{path}/shard={shard}")


def completion_record(spark: SparkSession, outputs: str, record: str, facts: dict[str, str]) -> DataFrame:
    """Hash the finished outputs and write the one-row record, last. Readers gate on its presence."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(outputs)
    named = files.select(F.regexp_replace("path", r"^.*/", "").alias("name"), "content")
    done = content_id(file_inventory(named), "outputs", facts.get("recipe", "")).withColumn(
        "facts", F.lit(json.dumps(facts, sort_keys=True)))
    done.coalesce(1).write.mode("overwrite").json(record)
    return spark.read.json(record)
