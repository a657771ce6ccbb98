"""Summaries of scores, outcomes, teachers and progress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runvox.functions.text import case_name, scoring_source
from runvox.scale import exact_quantiles, materialise

POOLED = "(all)"


def with_levels(df: DataFrame, levels: Sequence[Sequence[str]]) -> DataFrame:
    """Repeat each row once per grouping level; columns outside a level read ``(all)``."""
    columns = sorted({c for level in levels for c in level})
    copies = [F.struct(*[(F.col(c) if c in level else F.lit(POOLED)).alias(c) for c in columns]) for level in levels]
    rest = [c for c in df.columns if c not in columns]
    return df.withColumn("_level", F.explode(F.array(*copies))).select(*rest, "_level.*")


def medians(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Exact medians of several columns at once: one ranking of the (key, column, value) rows."""
    long = df.select(*keys, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(
        list(keys), list(values), "_metric", "_value")
    found = exact_quantiles(long, [*keys, "_metric"], "_value", {"_median": 0.5})
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_metric") == v, F.col("_median"))).alias(f"{v}_median")
                                      for v in values])


def summarise(scores: DataFrame, levels: Sequence[Sequence[str]], metrics: Sequence[str],
              counts: dict[str, Column]) -> DataFrame:
    """Counts, mean and median of each metric for every level; nulls are not scored.

    Means and medians read the scores separately, so the scores are stored first.
    """
    keys = sorted({c for level in levels for c in level})
    rows = with_levels(materialise(scores), levels)
    plain = rows.groupBy(*keys).agg(*[e.alias(n) for n, e in counts.items()],
                                    *[F.avg(m).alias(f"{m}_mean") for m in metrics])
    return plain.join(medians(rows, keys, metrics), keys, "left")


def by_scoring_source(scores: DataFrame) -> DataFrame:
    """Scores whose source is read off the case's name, as where only files of predictions are at hand."""
    return scores.withColumn("source", scoring_source(case_name(F.col("source"), F.col("case_id"))))


def score_summary(scores: DataFrame, organs: Sequence[str] | None = None, surface: Sequence[str] = ()) -> DataFrame:
    """By organ (source ``(all)``) and by source and organ."""
    rows = scores if organs is None else scores.where(F.col("organ").isin(list(organs)))
    return summarise(rows, [["organ"], ["source", "organ"]],
                     ["dice", *surface, "volume_error_ml", "absolute_volume_error_ml"],
                     {"scored": F.count("dice"), "miss": F.count_if("miss")})


def split_summary(scores: DataFrame, organs: Sequence[str] | None = None) -> DataFrame:
    """By split and organ, and pooled over all splits; of some organs only, if they are named."""
    rows = scores if organs is None else scores.where(F.col("organ").isin(list(organs)))
    return summarise(rows, [["organ"], ["split", "organ"]],
                     ["dice", "volume_error_ml", "absolute_volume_error_ml", "volume_error_pct",
                      "absolute_volume_error_pct"],
                     {"cases": F.count(F.lit(1)), "scored": F.count("dice"), "miss": F.count_if("miss"),
                      "reference_present": F.count("volume_error_pct")})


def outcome_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def crosstab(rows: DataFrame, key: str, pivot: str, values: Sequence[str]) -> DataFrame:
    """Counts of ``pivot`` values per key, zeros kept; the values are given, so no pass is spent finding them."""
    return rows.groupBy(key).agg(*[F.count_if(F.col(pivot) == v).alias(v) for v in values])


def median_sizes(cohort: DataFrame, organs: dict[str, str]) -> DataFrame:
    """Per source and organ: cases with a size > 0 and their median (0 if none). ``organs``: organ → column."""
    long = cohort.select("source", *[F.col(c).cast("double").alias(o) for o, c in organs.items()]).unpivot(
        ["source"], list(organs), "organ", "ml")
    present = long.groupBy("source", "organ").agg(F.count_if(F.col("ml") > 0).alias("present"))
    middle = exact_quantiles(long.where(F.col("ml") > 0), ["source", "organ"], "ml", {"median_ml": 0.5})
    return present.join(middle, ["source", "organ"], "left").fillna(0.0, ["median_ml"])


def teacher_pivot(scores: DataFrame, teachers: Sequence[str], must_have: str) -> DataFrame:
    """Mean Dice and median volume ratio per organ and source, one column per teacher; only groups that
    ``must_have`` scored."""
    key = ["organ", "source"]
    scores = materialise(scores)
    mean = scores.groupBy(*key).agg(
        *[F.avg(F.when(F.col("teacher") == t, F.col("dice"))).alias(f"{t}_dice_mean") for t in teachers],
        F.count_if(F.col("teacher") == must_have).alias("n"))
    ratio = exact_quantiles(scores.where(F.col("teacher").isin(list(teachers))), [*key, "teacher"], "volume_ratio",
                            {"m": 0.5})
    wide = ratio.groupBy(*key).agg(*[F.max(F.when(F.col("teacher") == t, F.col("m"))).alias(f"{t}_ratio_median")
                                     for t in teachers])
    return mean.where(F.col("n") > 0).join(wide, key, "left")


def external_table(scores: DataFrame, models: Sequence[str]) -> DataFrame:
    """Per organ and model: mean Dice and median signed volume error %, blanks ignored."""
    rows = materialise(scores.where(F.col("model").isin(list(models)) & F.col("dice").isNotNull()))
    mean = rows.groupBy("organ").agg(*[F.avg(F.when(F.col("model") == m, F.col("dice"))).alias(f"{m}_dice_mean")
                                       for m in models])
    middle = exact_quantiles(rows, ["organ", "model"], "volume_error_pct", {"m": 0.5})
    return mean.join(middle.groupBy("organ").agg(
        *[F.max(F.when(F.col("model") == m, F.col("m"))).alias(f"{m}_error_pct_median") for m in models]),
        "organ", "left")


def progress(verified: DataFrame, expected: DataFrame) -> DataFrame:
    """Per source: verified of expected(source, total), percent (1 dp) and state.

    ``verified`` has one row per file that passed its check. More files than expected, or a source nobody expects,
    is an error state, never progress.
    """
    done = verified.groupBy("source").agg(F.count(F.lit(1)).alias("verified"))
    table = expected.join(done, "source", "full_outer").fillna(0, ["verified"])
    state = (F.when(F.col("total").isNull() | (F.col("verified") > F.col("total")), "ERROR")
             .when(F.col("verified") == F.col("total"), "COMPLETE")
             .when(F.col("verified") == 0, "WAITING").otherwise("IN_PROGRESS"))
    return table.select("source", F.col("verified").cast("long").alias("verified"),
                        F.col("total").cast("long").alias("total"),
                        F.round(100 * F.col("verified") / F.col("total"), 1).alias("percent"), state.alias("state"))


def verdict(entries: DataFrame, expected: DataFrame, claimed_complete: bool) -> DataFrame:
    """One row: the run's state. Any entry whose check failed, any unexpected path or count, or a completion flag
    that the counts do not bear out makes it ``ERROR``. ``entries(source, status)`` comes from manifest verification.
    """
    bad = entries.agg(F.count_if(F.col("status") != "ok")).scalar()
    table = progress(entries.where(F.col("status") == "ok"), expected)
    counts = table.agg(F.sum("verified").alias("verified"), F.sum("total").alias("total"),
                       F.count_if(F.col("state") == "ERROR").alias("errors"),
                       F.count_if(F.col("state") != "COMPLETE").alias("open"))
    whole = counts.withColumn("bad", bad)
    state = (F.when((F.col("bad") > 0) | (F.col("errors") > 0), "ERROR")
             .when(F.lit(claimed_complete) & (F.col("open") > 0), "ERROR")
             .when(F.lit(claimed_complete), "COMPLETE").otherwise("IN_PROGRESS"))
    return whole.select("verified", "total", "bad", F.round(100 * F.col("verified") / F.col("total"), 1)
                        .alias("percent"), state.alias("state"))


def time_left(done: DataFrame) -> DataFrame:
    """Seconds per case and hours left from (completed, pending, elapsed_s) rows."""
    rate = F.col("elapsed_s") / F.col("completed")
    return done.withColumn("seconds_per_case", rate).withColumn(
        "hours_left", rate * (F.col("pending") - F.col("completed")) / 3600)


def size_by_suffix(inventory: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    """Number and total size of the members that end in each suffix."""
    ends = F.array(*[F.when(F.col("name").endswith(s), F.lit(s)) for s in suffixes])
    return (inventory.withColumn("suffix", F.explode(F.array_compact(ends))).groupBy("suffix")
            .agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("bytes")))
