"""Choosing what to run next: pending, limited, dealt out, batched."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runvox.scale import materialise, ranked


def pending(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Wanted (name, sha256) without a finished output of the same hash."""
    return wanted.join(done.select("name", "sha256"), ["name", "sha256"], "left_anti")


def reusable(elsewhere: DataFrame, wanted: DataFrame, here: DataFrame, key: str = "name") -> DataFrame:
    """Outputs present elsewhere that are wanted here and not here yet."""
    return elsewhere.join(wanted.select(key), key, "left_semi").join(here.select(key), key, "left_anti")


def limit_per_source(rows: DataFrame, n: int, order: Sequence[str] = ("case_id",)) -> DataFrame:
    """The first n rows of each source. Spark keeps n rows per task before the shuffle, so a hot source is cheap."""
    place = F.row_number().over(Window.partitionBy("source").orderBy(*order))
    return rows.withColumn("_n", place).where(F.col("_n") <= n).drop("_n")


def round_robin(rows: DataFrame, workers: int, order: Sequence[str]) -> DataFrame:
    """``worker`` = position in the global order, modulo the number of workers."""
    return ranked(rows, order).withColumn("worker", (F.col("position") % workers).cast("int")).drop("position")


def batches(rows: DataFrame, size: int, order: Sequence[str], probe: int = 1) -> DataFrame:
    """``batch``: the first ``probe`` rows alone as batch 0 (a trial of the whole path), then blocks of ``size``."""
    after = F.floor((F.col("position") - probe) / size)
    number = F.when(F.col("position") < probe, 0).otherwise(after + (1 if probe else 0))
    return ranked(rows, order).withColumn("batch", number.cast("long")).drop("position")


def median_pick(rows: DataFrame, size: str, tie: str) -> DataFrame:
    """The row at index n // 2 in order of size."""
    placed = ranked(rows, [size, tie])
    middle = placed.agg(F.floor(F.count(F.lit(1)) / 2)).scalar()
    return placed.where(F.col("position") == middle).drop("position")


def size_groups(files: DataFrame, limit: int, prefix: str = "prefix") -> DataFrame:
    """``archive`` per file: walking names in order, a new group opens when adding a file would exceed ``limit``.

    A group's start decides the next, so the walk is a chain of pointers: each file points to the first file that
    would no longer fit if a group began with it. The pointers come from running sums and a window over files of
    nearby sums; the starts are then found by doubling the pointers, in logarithmically many joins. No prefix is
    ever walked in one task. Files with equal names go by size, and the sums follow the positions, so reruns agree.
    """
    placed = ranked(files, [prefix, "name", "size"])
    placed = ranked(placed, ["position"], weight="size", into="before")
    key = [prefix]
    # first file whose end lies beyond before + limit, searched among files of the same and later limit-sized bands
    ends = placed.select(prefix, (F.col("before") + F.col("size")).alias("at"), F.col("position").alias("item"))
    asks = placed.select(prefix, (F.col("before") + limit).alias("at"), F.col("position").alias("asker"))
    band = F.floor(F.col("at") / limit).alias("band")
    line = ends.select(*key, "at", band, "item", F.lit(None).cast("long").alias("asker")).unionByName(
        asks.select(*key, "at", band, F.lit(None).cast("long").alias("item"), "asker"))
    later = (Window.partitionBy(prefix, "band").orderBy("at").rangeBetween(1, Window.unboundedFollowing))
    inside = line.withColumn("_next", F.min("item").over(later)).where("asker IS NOT NULL")
    firsts = ends.select(*key, band, "item").groupBy(prefix, "band").agg(F.min("item").alias("_first"))
    # one row per occupied band (total size / limit of them): the next band's first file
    bands = line.select(prefix, "band").distinct().join(firsts, [prefix, "band"], "left")
    following = Window.partitionBy(prefix).orderBy("band").rowsBetween(1, Window.unboundedFollowing)
    bands = bands.withColumn("_after", F.min("_first").over(following)).select(prefix, "band", "_after")
    # an oversized file does not fit even alone, yet forms its own group: the pointer moves at least one file on
    found = F.coalesce("_next", "_after")
    step = F.when(found.isNotNull(), F.greatest(found, F.col("asker") + 1))
    last = placed.groupBy(prefix).agg(F.max("position").alias("_last"), F.min("position").alias("_start"))
    hops = (inside.join(bands, [prefix, "band"]).join(last, prefix)
            .select(*key, F.col("asker").alias("item"), F.when(step <= F.col("_last"), step).alias("next"))
            .where("next IS NOT NULL"))
    hops = materialise(hops)
    starts = materialise(last.select(*key, F.col("_start").alias("item")))
    known = starts.count()
    while True:
        reached = starts.join(hops, [prefix, "item"]).select(*key, F.col("next").alias("item"))
        starts = materialise(starts.unionByName(reached).distinct())
        now = starts.count()
        if now == known:
            break
        known = now
        onward = hops.select(*key, F.col("item").alias("next"), F.col("next").alias("_n"))
        hops = materialise(hops.join(onward, [prefix, "next"]).select(*key, "item", F.col("_n").alias("next")))
    # number the starts, then each file belongs to the last start at or before it: a running count of starts
    marked = placed.join(starts.select(*key, F.col("item").alias("position"), F.lit(1).alias("_opens")),
                         [prefix, "position"], "left").fillna(0, ["_opens"])
    counted = ranked(marked.drop("before"), [prefix, "position"], weight="_opens", into="_opened")
    base = counted.groupBy(prefix).agg(F.min("_opened").alias("_base"))
    archive = F.col("_opened") + F.col("_opens") - F.col("_base") - 1
    return counted.join(base, prefix).withColumn("archive", archive.cast("long")).drop(
        "_opened", "_opens", "_base", "position")
