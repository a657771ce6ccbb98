"""Progress and resumable scoring as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

ENTRY = "source string, name string, sha256 string"


def manifest_stream(spark: SparkSession, folder: str, schema: str = ENTRY, files_per_batch: int = 1000) -> DataFrame:
    """New manifest entry files (JSON lines) as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def verified_counts(entries: DataFrame) -> DataFrame:
    """Distinct verified files per source. State is one key per file ever verified, so it is bounded by the
    inventory. Counts only grow here; ``keep_counts`` follows files that turn corrupt."""
    return (entries.dropDuplicates(["source", "name", "sha256"]).groupBy("source")
            .agg(F.count(F.lit(1)).alias("verified")))


STATUS = "source string, name string, at long, ok boolean"


def _verdict() -> Column:
    """(at, bad): the larger one holds, so the latest entry does, and of entries with one ``at`` a failing one."""
    return F.struct("at", (~F.coalesce("ok", F.lit(False))).alias("bad"))


def keep_counts(entries: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Writes what every micro-batch of a stream (source, name, at, ok) says about its files below ``output``, a row per file;
    a repeated batch replaces its own. ``counted`` puts the batches together.

    A file stands as its latest entry by ``at`` says; an older one that comes late changes nothing. Entries without a name or
    ``at`` are ignored, a null ``ok`` is a failure.
    """
    def commit(batch: DataFrame, number: int) -> None:
        (batch.groupBy("source", "name").agg(F.max(_verdict()).alias("_v")).select("source", "name", "_v.*", F.lit(number).alias("batch"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(output))

    known = entries.where("name IS NOT NULL AND at IS NOT NULL")
    return (known.writeStream.outputMode("append").foreachBatch(commit).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def counted(spark: SparkSession, output: str) -> DataFrame:
    """Verified files per source as they stand, of every source that had one after some batch."""
    sofar = Window.partitionBy("source", "name").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    states = spark.read.parquet(output).withColumn("_s", F.max(F.struct("at", "bad")).over(sofar))
    files = states.groupBy("source", "name").agg(F.max("_s").alias("_s"), F.bool_or(~F.col("_s.bad")).alias("_once"))
    return (files.groupBy("source").agg(F.count_if(~F.col("_s.bad")).alias("verified"), F.bool_or("_once").alias("_once"))
            .where("_once").drop("_once"))


def with_progress(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """Total, percent and state from the expected inventory (a fixed, small table). Every source is kept: one that
    nobody expects is an error, one without files waits."""
    state = (F.when(F.col("total").isNull() | (F.col("verified") > F.col("total")), "ERROR")
             .when(F.col("verified") == F.col("total"), "COMPLETE")
             .when(F.col("verified") == 0, "WAITING").otherwise("IN_PROGRESS"))
    return (counts.join(expected, "source", "full_outer").fillna(0, ["verified"])
            .withColumn("percent", F.round(100 * F.col("verified") / F.col("total"), 1)).withColumn("state", state))


def landed_pairs(landed: DataFrame) -> DataFrame:
    """(source, case_id) of the cases whose truth and prediction have both landed, from a stream (source, case_id, side) with
    a row per file, ``side`` being ``truth`` or ``prediction``. State is one row per case; to be run in update mode."""
    has = lambda side: F.max((F.col("side") == side).cast("int")) == 1
    return (landed.groupBy("source", "case_id").agg(has("truth").alias("_t"), has("prediction").alias("_p"))
            .where("_t AND _p").select("source", "case_id"))


def resume(cases: DataFrame, score: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Score every new case once, whatever happens in between.

    Each micro-batch drops the cases already in the output, scores the rest and commits them under its batch number;
    a batch that is run again after a failure replaces its own partition.
    """
    def commit(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["source", "case_id"])
        try:
            done = spark.read.parquet(output).where(F.col("batch") != number).select("source", "case_id")
            fresh = fresh.join(done, ["source", "case_id"], "left_anti")
        except Exception as error:  # no output yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
        (score(fresh).withColumn("batch", F.lit(number)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(output))

    return (cases.writeStream.outputMode(mode).foreachBatch(commit).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
