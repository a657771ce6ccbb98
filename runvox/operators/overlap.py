"""Finding copies of known scans in another collection: by hash, by similarity, by geometry."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runvox import vocabulary
from runvox.scale import materialise

SHARE = 4096  # vectors of one cell that meet in one group
SHARE_VALUES = 1 << 24  # most values of such a group, 128 MB: fewer vectors where they are long
BLOCK = 512  # rows of one product


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def zscore(v: Column) -> Column:
    """Subtract the mean; divide by the population deviation where it is not 0."""
    n = F.size(v)
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"), lambda a: a / n)
    centred = F.transform(v, lambda x: x.cast("double") - mean)
    std = F.sqrt(F.aggregate(centred, F.lit(0.0), lambda a, x: a + x * x, lambda a: a / n))
    return F.transform(centred, lambda x: F.when(std > 0, x / std).otherwise(x))


def zscored(df: DataFrame, column: str, into: str) -> DataFrame:
    """As ``zscore`` on a column, with mean and deviation computed once per row."""
    n = F.size(column)
    mean = F.aggregate(column, F.lit(0.0), lambda a, x: a + x.cast("double"), lambda a: a / n)
    spread = F.aggregate(into, F.lit(0.0), lambda a, x: a + x * x, lambda a: F.sqrt(a / n))
    return (df.withColumn("_mean", mean)
            .withColumn(into, F.transform(column, lambda x: x.cast("double") - F.col("_mean")))
            .withColumn("_std", spread)
            .withColumn(into, F.transform(into, lambda x: F.when(F.col("_std") > 0, x / F.col("_std")).otherwise(x)))
            .drop("_mean", "_std"))


def exact_matches(scans: DataFrame, gold: DataFrame) -> DataFrame:
    """Scans whose ``md5`` a gold scan shares.

    One row per scan with the first of the gold copies and how many there are, so a group of copies on both sides
    stays linear; ``copy_members`` lists who belongs to a group.
    """
    first = F.min(F.struct("ordinal", "dataset", "id"))
    groups = gold.groupBy("md5").agg(first.alias("_g"), F.count(F.lit(1)).alias("gold_copies"))
    return scans.join(groups, "md5").select(
        F.col("id"), F.col("_g.dataset").alias("gold_dataset"), F.col("_g.id").alias("gold_scan"),
        F.lit("exact").alias("match_type"), F.lit(1.0).alias("corr"), "gold_copies")


def copy_members(scans: DataFrame, gold: DataFrame) -> DataFrame:
    """(md5, side, id) of every hash that occurs on both sides: the exact matches in factored form."""
    both = scans.select("md5", F.lit("scan").alias("side"), "id").unionByName(
        gold.select("md5", F.lit("gold").alias("side"), "id"))
    shared = both.groupBy("md5").agg(F.count_distinct("side").alias("_s")).where("_s = 2").select("md5")
    return both.join(shared, "md5", "left_semi")


def _axes(width: int, dims: int) -> list[list[float]]:
    """Orthonormal cosine directions. Neighbouring vectors have neighbouring projections on each."""
    k = np.arange(1, dims + 1)[:, None]
    return (np.sqrt(2 / width) * np.cos(np.pi * k * (np.arange(width) + 0.5) / width)).tolist()


def best_correlation(scans: DataFrame, gold: DataFrame, width: int, above: float, dims: int = 3,
                     digits: int = 9) -> DataFrame:
    """(key, gold_key, corr): for every scan vector the gold vector of highest correlation, if it exceeds ``above``.

    ``scans(key, v)``, ``gold(gold_key, v)`` with z-scored vectors of length ``width``; ties (to ``digits``) go to
    the lowest gold key. Exact: two vectors with r > above differ by less than sqrt(2 - 2 above) as unit vectors, so
    their projections on any direction do too. Cells of that width make candidates meet by equi-join, gold being
    offered to neighbour cells. Inside a cell whole groups of vectors meet in one matrix product, which returns one row
    per scan: pairs are never listed. A cell with many scans or many gold vectors is cut into groups of bounded size on
    both sides, so a hot cell is many tasks.
    """
    share = max(1, min(SHARE, SHARE_VALUES // width))
    step = float(np.sqrt(2 - 2 * above)) + 1e-6
    norm = float(np.sqrt(width))

    def cells(df: DataFrame) -> DataFrame:
        at = [F.aggregate(F.zip_with("v", F.array(*map(F.lit, axis)), lambda a, b: a * b), F.lit(0.0),
                          lambda s, x: s + x) for axis in _axes(width, dims)]
        return df.select("*", *[F.floor(a / (norm * step)).cast("int").alias(f"c{i}") for i, a in enumerate(at)])

    c = [f"c{i}" for i in range(dims)]
    one = F.array(F.lit(-1), F.lit(0), F.lit(1))
    near = cells(gold.withColumnRenamed("gold_key", "key"))
    for name in c:
        near = near.withColumn("_d", F.explode(one)).withColumn(name, F.col(name) + F.col("_d")).drop("_d")
    placed = cells(scans)
    groups = lambda df, name: df.groupBy(*c).agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias(name))
    load = groups(placed, "salts").join(groups(near, "parts"), c)
    one_of = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    group = [*c, "salt", "part"]
    left = placed.join(load, c).withColumn("salt", one_of("salts")).withColumn("part", each("parts"))
    right = near.join(load, c).withColumn("part", one_of("parts")).withColumn("salt", each("salts"))

    def compare(some: pd.DataFrame, golden: pd.DataFrame) -> pd.DataFrame:
        if some.empty or golden.empty:
            return pd.DataFrame({"key": [], "gold_key": [], "corr": []})
        golden = golden.sort_values("key")
        b, names = np.stack(golden["v"].to_numpy()), golden["key"].to_numpy()
        found = []
        for start in range(0, len(some), BLOCK):
            rows = some.iloc[start:start + BLOCK]
            r = np.round(np.stack(rows["v"].to_numpy()) @ b.T / width, digits)
            top = r.argmax(axis=1)
            found.append(pd.DataFrame({"key": rows["key"].to_numpy(), "gold_key": names[top],
                                       "corr": r[np.arange(len(rows)), top]}))
        best = pd.concat(found)
        return best[best["corr"] > above]

    found = (left.select(*group, "key", "v").groupBy(*group)
             .cogroup(right.select(*group, "key", "v").groupBy(*group))
             .applyInPandas(compare, "key bigint, gold_key bigint, corr double"))
    best = F.max(F.struct(F.col("corr"), (-F.col("gold_key")).alias("g")))
    return found.groupBy("key").agg(best.alias("_b")).select(
        "key", (-F.col("_b.g")).alias("gold_key"), F.col("_b.corr").alias("corr"))


def overlap_match(scans: DataFrame, gold: DataFrame, width: int, same_shape: float = vocabulary.SAME_SHAPE_R,
                  any_shape: float = vocabulary.ANY_SHAPE_R) -> DataFrame:
    """All recorded matches: exact hash first; otherwise the single best gold vector, accepted with the same shape
    above ``same_shape`` or with any shape above ``any_shape``.

    ``scans(id, md5, shape, v)``, ``gold(ordinal, dataset, id, md5, shape, v)``. Scans that share a hash are copies:
    one of them is compared and the result holds for all.
    """
    exact = exact_matches(scans, gold)
    open_ = scans.join(gold.select("md5").distinct(), "md5", "left_anti")
    single = open_.groupBy("md5", "shape").agg(F.first("v").alias("v"))
    keyed = materialise(single.withColumn("key", F.monotonically_increasing_id()))
    best = best_correlation(keyed.select("key", "v"), gold.select(F.col("ordinal").alias("gold_key"), "v"), width,
                            min(same_shape, any_shape))
    g = gold.select(F.col("ordinal").alias("gold_key"), F.col("dataset").alias("gold_dataset"),
                    F.col("id").alias("gold_scan"), F.col("shape").alias("gold_shape"))
    kind = (F.when((F.col("corr") > same_shape) & (F.col("shape") == F.col("gold_shape")), "shape+corr")
            .when(F.col("corr") > any_shape, "corr-only"))
    similar = (keyed.select("key", "md5", "shape").join(best, "key").join(g, "gold_key")
               .withColumn("match_type", kind).where("match_type is not null")
               .select("md5", "shape", "gold_dataset", "gold_scan", "match_type", "corr"))
    rows = open_.select("id", "md5", "shape").join(similar, ["md5", "shape"]).select(
        "id", "gold_dataset", "gold_scan", "match_type", "corr", F.lit(1).cast("long").alias("gold_copies"))
    return exact.unionByName(rows)


def geometry_key(shape: Column, zooms: Column, digits: int = 6) -> Column:
    """Sorted shape and sorted spacing, so a permuted scan keeps its key."""
    size = F.array_join(F.transform(F.sort_array(shape), lambda s: s.cast("string")), "x")
    mm = F.array_join(F.transform(F.sort_array(zooms), lambda z: F.format_number(z, digits)), "x")
    return F.concat_ws("@", size, mm)


def geometry_match(scans: DataFrame, collection: DataFrame) -> DataFrame:
    """Scans whose geometry occurs in the collection: how many members share it and the first of them.

    ``geometry_members`` lists the members per geometry, so a common geometry never multiplies into pairs.
    """
    groups = collection.groupBy("geometry").agg(F.count(F.lit(1)).alias("matches"), F.min("id").alias("first_match"))
    return scans.join(groups, "geometry")


def geometry_members(scans: DataFrame, collection: DataFrame) -> DataFrame:
    return collection.join(scans.select("geometry").distinct(), "geometry", "left_semi")


def method_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per source: cases found by both methods, with a common id, by one only, and by either.

    ``a``, ``b``: (source, case_id, match_id), a row for each of the ids that a method finds for a case. Both sides meet as
    inverted lists (case, id), so a case with many ids is never one row; rows without an id are not found.
    """
    ids = ["source", "case_id", "match_id"]
    both = (a.where("match_id IS NOT NULL").select(*ids, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
            .unionByName(b.where("match_id IS NOT NULL").select(*ids, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
            .groupBy(*ids).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b")))
    cases = both.groupBy("source", "case_id").agg(
        F.max("_a").alias("_a"), F.max("_b").alias("_b"), F.max(F.col("_a") * F.col("_b")).alias("_same"))
    x, y = F.col("_a") == 1, F.col("_b") == 1
    return cases.groupBy("source").agg(
        F.count_if(x & y).alias("both_methods"), F.count_if(F.col("_same") == 1).alias("same_id"),
        F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count(F.lit(1)).alias("either"))


def contamination(evaluation: DataFrame, *found: DataFrame) -> DataFrame:
    """Per source: evaluation cases, and how many any method found in the other collection."""
    hits = found[0].select("case_id")
    for more in found[1:]:
        hits = hits.unionByName(more.select("case_id"))
    marked = evaluation.join(hits.distinct().withColumn("_hit", F.lit(True)), "case_id", "left")
    return marked.groupBy("source").agg(F.count(F.lit(1)).alias("cases"),
                                        F.count_if(F.col("_hit").isNotNull()).alias("found"))


def shape_candidates(cropped: DataFrame, full: DataFrame, budget: int = 2) -> DataFrame:
    """For each cropped case the least total cropping (≤ budget) from a full shape, and how many full scans reach it.

    A crop only shrinks axes, so the full shape is one of a handful of offsets away and the match is an equi-join on
    distinct shapes; cases join back afterwards.
    """
    offsets = [(i, j, k) for i in range(budget + 1) for j in range(budget + 1 - i) for k in range(budget + 1 - i - j)]
    grown = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k"),
                               F.lit(i + j + k).alias("cost")) for i, j, k in offsets])
    axes = ["nx", "ny", "nz"]
    stock = full.groupBy(*axes).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    tried = (cropped.select(*axes).distinct().withColumn("_o", F.explode(grown))
             .select(*[F.col(a).alias(f"_{a}") for a in axes], F.col("_o.cost").alias("cost"),
                     *[(F.col(a) + F.col(f"_o.{o}")).alias(a) for a, o in zip(axes, "ijk", strict=True)]))
    reached = tried.join(stock, axes).groupBy(*[f"_{a}" for a in axes], "cost").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"))
    least = F.min(F.struct("cost", "n", "first"))
    best = reached.groupBy(*[F.col(f"_{a}").alias(a) for a in axes]).agg(least.alias("_b"))
    return cropped.join(best, axes).select(
        "id", F.col("_b.cost").alias("cost"), F.col("_b.n").cast("long").alias("candidates"),
        F.col("_b.first").alias("first_candidate"))


def with_evidence(overlap: DataFrame, low: float = vocabulary.SAME_SHAPE_R) -> DataFrame:
    """Evidence status per match type, and whether the correlation lies in [low, 1]."""
    status = F.create_map(*[F.lit(v) for pair in vocabulary.EVIDENCE_STATUS.items() for v in pair])
    return overlap.withColumn("evidence_status", status[F.col("match_type")]).withColumn(
        "corr_in_range", F.col("corr").between(low, 1.0))


def union_exports(*exports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The exports as one table, and its duplicates (atlas ids or gold scans recorded more than once)."""
    rows = exports[0]
    for more in exports[1:]:
        rows = rows.unionByName(more)
    ids = rows.groupBy(F.col("atlas_bdmap_id").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("atlas_bdmap_id").alias("column"), "value", "n")
    scans = rows.groupBy(F.concat_ws("/", "gold_dataset", "gold_scan").alias("value")).agg(
        F.count(F.lit(1)).alias("n")).select(F.lit("gold_scan").alias("column"), "value", "n")
    return rows, ids.unionByName(scans).where("n > 1")
