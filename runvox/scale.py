"""Building blocks that keep global work (ranks, quantiles, loops) spread over the cluster."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; a scratch folder only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder: iterative jobs cut their lineage there")
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(root)
    return root


def fixed_table(spark: SparkSession, rows: Sequence[tuple], columns: Sequence[str]) -> DataFrame:
    """A small constant table as inline values: the optimizer knows its size and can broadcast it by itself."""
    def literal(v):
        return repr(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "\\'") + "'"
    values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")


def materialise(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back: lineage is cut, lost executors cost nothing, and the file
    size gives the optimizer true statistics for its own broadcast decisions."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/runvox/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, order: Sequence[str], weight: str | None = None, into: str = "position") -> DataFrame:
    """0-based global position in ``order`` (with ``weight``: the sum of the weights before the row).

    Range partitioning sorts the slices against each other, so no task sees more than its slice; only one row per
    slice passes through the offset window. The slices are written first, so a retry cannot move a boundary.
    """
    sliced = materialise(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ).withColumn("_slice", F.shiftright("_id", 33))
    amount = F.col(weight) if weight else F.lit(1)
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (sliced.groupBy("_slice").agg(F.sum(amount).alias("_n"))
              .select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    if weight:
        inside = Window.partitionBy("_slice").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
        local = F.coalesce(F.sum(weight).over(inside), F.lit(0))
    else:
        local = F.col("_id") - F.shiftleft(F.col("_slice"), 33)
    # one row per slice, so at most as many rows as shuffle partitions: always small enough to broadcast
    return (sliced.join(F.broadcast(starts), "_slice")
            .withColumn(into, (F.col("_start") + local).cast("long"))
            .drop("_id", "_slice", "_start"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per key, without a per-group value map in one task.

    Equal values are counted first (a value held by a third of all rows becomes one row), then ranked over the
    cluster; only the two neighbours of each quantile are kept. Key columns must not be null.
    """
    everything = not keys
    keys = ["_all"] if everything else list(keys)
    df = df.withColumn("_all", F.lit(1)) if everything else df
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_w"))
    placed = ranked(counted, [*keys, value], weight="_w")
    extent = placed.groupBy(*keys).agg(F.min("position").alias("_first"), F.sum("_w").alias("_n"))
    joined = placed.join(extent, keys)
    rank = F.col("position") - F.col("_first")
    picks = []
    for name, p in probabilities.items():
        at = F.lit(float(p)) * (F.col("_n") - 1)
        for end, target in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (rank <= target) & (target < rank + F.col("_w"))
            picks.append((f"_{name}_{end}", hit))
    kept = picks[0][1]
    for _, hit in picks[1:]:
        kept = kept | hit
    near = joined.where(kept).groupBy(*keys).agg(
        F.first("_n").alias("_n"), *[F.max(F.when(hit, F.col(value))).alias(n) for n, hit in picks])
    out = [] if everything else [F.col(k) for k in keys]
    for name, p in probabilities.items():
        at = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.col(f"_{name}_lo").cast("double"), F.col(f"_{name}_hi").cast("double")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return near.select(*out)
