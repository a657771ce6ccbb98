"""Queries over whole flows: files read in one scan, cases that cannot be read, gates before scoring, the dataset build."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runvox import vocabulary
from runvox.operators import cohort, score
from runvox.operators.gates import Gate, prediction_gate
from runvox.operators.runs import length, pack_voxels
from runvox.plans import pipelines
from runvox.plans.catalog import Tables, query, r6
from runvox.plans.derived import ORGANS
from runvox.plans.voxel_queries import IDS, WRITE_ORDER, ORDER_SQL, volume_content
from runvox.scale import checkpoint_root, materialise
from runvox.sources import volume_source
from runvox.streaming import progress as streams

KEY = ["source", "case_id"]
_BAD_FILES = "k % 10 IN (3, 5, 7)"


def _scanned(t: Tables) -> DataFrame:
    """Label files, written below the shared folder and read by their path. One in ten ends in the middle, one is no volume at
    all, one holds numbers that are no labels."""
    def build() -> DataFrame:
        files = volume_content(t).join(t.base("v_header").select(*KEY, "k"), KEY)
        fraction = F.overlay("content", F.unhex(F.lit("0000803E")), F.lit(117), F.lit(4))  # every value becomes a quarter more
        content = (F.when(F.col("k") % 10 == 3, F.substring("content", 1, 400)).when(F.col("k") % 10 == 5, F.unhex(F.lit("6A756E6B")))
                   .when(F.col("k") % 10 == 7, fraction).otherwise(F.col("content")))
        root = f"{checkpoint_root(t.spark)}/runvox/{uuid.uuid4().hex}"
        names = F.concat_ws("/", "source", "case_id", F.lit("labels.nii.gz"))
        materialise(volume_source.write_files(files.select(names.alias("name"), content.alias("content")), root))
        return volume_source.scan(t.spark, root)
    return t.once("scanned_files", build)


@query("ingest_files", f"""SELECT * FROM (
    WITH v AS (SELECT source, case_id, x, y, z, max(organ_id) AS label FROM v_truth JOIN o_organ USING (organ) GROUP BY ALL),
    r AS (SELECT source, case_id, count(DISTINCT (label, x, y, island)) AS runs, count(*) AS voxels FROM (
        SELECT *, z - row_number() OVER (PARTITION BY source, case_id, label, x, y ORDER BY z) AS island FROM v) GROUP BY ALL)
    SELECT source, case_id, CASE WHEN k % 10 <> 5 THEN sx END AS sx, CASE WHEN k % 10 <> 5 THEN sy END AS sy,
           CASE WHEN k % 10 <> 5 THEN sz END AS sz, {_BAD_FILES} AS failed, CASE WHEN {_BAD_FILES} THEN 0 ELSE runs END AS runs,
           CASE WHEN {_BAD_FILES} THEN 0 ELSE voxels END AS voxels FROM v_header JOIN r USING (source, case_id))""")
def ingest_files(t: Tables) -> DataFrame:
    size = lambda i: F.max(F.get("shape", F.lit(i)))
    return _scanned(t).groupBy(*KEY).agg(
        size(0).alias("sx"), size(1).alias("sy"), size(2).alias("sz"), (F.count_if(F.col("kind") == "error") > 0).alias("failed"),
        F.count_if(F.col("kind") == "run").alias("runs"),
        F.coalesce(F.sum(F.when(F.col("kind") == "run", length())), F.lit(0)).cast("long").alias("voxels"))


@query("cohort_with_errors", f"""SELECT c.source, c.case_id, slice_thickness_mm, CASE WHEN NOT bad THEN adrenal_left END AS adrenal_left,
    CASE WHEN NOT bad THEN adrenal_right END AS adrenal_right, sides, CASE WHEN bad THEN 'error' ELSE scan END AS scan, bad AS has_error
    FROM o_cohort c JOIN (SELECT source, case_id, {_BAD_FILES} AS bad FROM v_header) USING (source, case_id)""")
def cohort_with_errors(t: Tables) -> DataFrame:
    """Cases whose files cannot be read stay in the cohort table and say so."""
    broken = volume_source.errors(_scanned(t)).groupBy(*KEY).agg(F.min("error").alias("error"))
    header = t.header.join(broken, KEY, "left")
    out = cohort.case_outcome(t.audit.decisions, t.audit.sides, header)
    return out.select(*KEY, "slice_thickness_mm", "adrenal_left", "adrenal_right", "sides", "scan", (F.col("error") != "").alias("has_error"))


def _gate(t: Tables) -> Gate:
    def build() -> Gate:
        k = t.base("v_header").select(*KEY, "k")
        sha = F.sha2(F.concat_ws("/", *KEY), 256)
        head = t.header.select(*KEY, "shape", "affine", "k")
        turned = F.transform("affine", lambda row: F.transform(row, lambda v: -v))
        files = (head.where("k % 9 <> 1").withColumn("affine", F.when(F.col("k") % 4 == 2, turned).otherwise(F.col("affine")))
                 .withColumn("file", F.explode(F.when(F.col("k") % 9 == 5, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
                 .select(*KEY, "shape", "affine", sha.alias("sha256")))
        record = k.select(*KEY, F.when(F.col("k") % 5 == 3, F.sha2(F.lit("other"), 256)).otherwise(sha).alias("sha256"))
        ids = F.create_map(*[F.lit(v) for pair in IDS.items() for v in pair])
        label = F.when((F.col("k") % 7 == 4) & (F.col("organ") == "liver"), 99).otherwise(ids[F.col("organ")])
        found = t.base("v_pred").join(k, KEY).groupBy(*KEY, label.alias("label")).agg(F.count(F.lit(1)).alias("voxels"))
        return prediction_gate(head.select(*KEY, "shape", "affine"), files, record, found, list(IDS.values()))
    return t.once("gate", build)


_REASONS = """SELECT source, case_id, CASE WHEN k % 9 = 1 THEN 'missing' WHEN k % 9 = 5 THEN 'duplicate' ELSE concat_ws(' ',
    CASE WHEN k % 5 = 3 THEN 'changed' END, CASE WHEN k % 4 = 2 THEN 'grid' END,
    CASE WHEN k % 7 = 4 AND (source, case_id) IN (SELECT (source, case_id) FROM v_pred WHERE organ = 'liver') THEN 'labels' END) END AS reasons
    FROM v_header"""


@query("gate_rejects", f"SELECT * FROM ({_REASONS}) WHERE reasons <> ''")
def gate_rejects(t: Tables) -> DataFrame:
    return _gate(t).rejects.select(*KEY, F.array_join("reasons", " ").alias("reasons"))


@query("gated_scores", f"""SELECT source, case_id, organ, round(reference_ml, 6) AS reference_ml, round(predicted_ml, 6) AS predicted_ml,
    round(dice, 6) AS dice, miss FROM o_metric JOIN (SELECT source, case_id FROM ({_REASONS}) WHERE reasons = '') USING (source, case_id)""")
def gated_scores(t: Tables) -> DataFrame:
    rows = pipelines.gated_scores(t.runs("v_truth", tiled=True), t.runs("v_pred", tiled=True), t.header, ORGANS, _gate(t))
    return rows.select(*KEY, "organ", r6("reference_ml"), r6("predicted_ml"), r6("dice"), "miss")


@query("build_rows", f"""SELECT * FROM (
    WITH best AS (SELECT source, case_id, organ, arg_max(root, voxels * 1e9 - first) AS root FROM o_size GROUP BY ALL),
    clean AS (SELECT c.source, c.case_id, c.organ, x, y, z FROM o_comp c JOIN best b ON b.source = c.source AND b.case_id = c.case_id
        AND b.organ = c.organ WHERE c.root = b.root OR c.organ NOT IN ('adrenal_left', 'adrenal_right')),
    top AS (SELECT source, case_id, x, y, z, arg_max(organ, place) AS organ, count(*) AS n FROM clean
        JOIN (VALUES {ORDER_SQL}) AS w(place, organ) USING (organ) GROUP BY ALL),
    lap AS (SELECT source, case_id, count(*) FILTER (WHERE n > 1) AS overlap_voxels FROM top GROUP BY ALL),
    seen AS (SELECT source, case_id, string_agg(CAST(organ_id AS VARCHAR), ' ' ORDER BY organ_id) AS labels_present FROM (
        SELECT DISTINCT source, case_id, organ_id FROM top JOIN o_organ USING (organ)) GROUP BY ALL),
    gone AS (SELECT source, case_id, organ, round((sum(voxels) - max(voxels)) * 3e-2, 4) AS ml FROM o_size GROUP BY ALL),
    wrong AS (SELECT h.source, h.case_id, k, scan, c.adrenal_right, CASE WHEN scan NOT LIKE 'kept%' THEN scan
        WHEN k % 6 = 2 THEN 'image grid differs from label grid'
        WHEN k % 4 = 1 AND c.adrenal_right <> 'keep' THEN 'adrenal_right: was keep, is ' || c.adrenal_right ELSE '' END AS error
        FROM o_cohort c JOIN v_header h USING (source, case_id))
    SELECT w.source, w.case_id, CASE WHEN starts_with(lower(w.case_id), w.source) THEN w.case_id ELSE w.source || '_' || w.case_id END AS name,
        CASE WHEN scan NOT LIKE 'kept%' THEN 'excluded' WHEN error <> '' THEN 'failed' WHEN k % 5 = 0 THEN 'test' ELSE 'train' END AS role,
        CASE WHEN error = '' THEN coalesce(l.ml, 0) END AS removed_left_ml, CASE WHEN error = '' THEN coalesce(r.ml, 0) END AS removed_right_ml,
        CASE WHEN error = '' THEN coalesce(overlap_voxels, 0) END AS overlap_voxels,
        CASE WHEN error = '' THEN coalesce(labels_present, '') END AS labels_present, error
    FROM wrong w LEFT JOIN lap USING (source, case_id) LEFT JOIN seen USING (source, case_id)
    LEFT JOIN gone l ON l.source = w.source AND l.case_id = w.case_id AND l.organ = 'adrenal_left'
    LEFT JOIN gone r ON r.source = w.source AND r.case_id = w.case_id AND r.organ = 'adrenal_right')""")
def build_rows(t: Tables) -> DataFrame:
    k = t.base("v_header").select(*KEY, "k")
    wrong = (F.col("k") % 4 == 1) & F.col("scan").startswith("kept")
    first = t.audit.cohort.join(k, KEY).withColumn("adrenal_right", F.when(wrong, "keep").otherwise(F.col("adrenal_right")))
    moved = F.transform("affine", lambda row: F.transform(row, lambda v: v + 1))
    images = t.header.select(*KEY, "shape", F.when(F.col("k") % 6 == 2, moved).otherwise(F.col("affine")).alias("affine"))
    roles = k.select(*KEY, F.when(F.col("k") % 5 == 0, "test").otherwise("train").alias("role"))
    rows, _ = pipelines.build_dataset(t.audit, first, images, roles, IDS, WRITE_ORDER)
    left, right = vocabulary.GLANDS
    return rows.select(*KEY, "name", "role", F.col(f"{left}_removed_ml").alias("removed_left_ml"), F.col(f"{right}_removed_ml").alias("removed_right_ml"),
                       "overlap_voxels", F.array_join(F.transform("labels_present", lambda i: i.cast("string")), " ").alias("labels_present"), "error")


@query("resume_scores", """SELECT source, case_id, organ, in_truth, in_prediction, intersection, round(dice, 6) AS dice, miss
    FROM o_count JOIN o_metric USING (source, case_id, organ)""")
def resume_scores(t: Tables) -> DataFrame:
    """Truth and prediction files land one after the other; a stream scores each case once both are there. The first run finds
    half of the predictions, the second one the rest, with files of the first announced again."""
    root = f"{checkpoint_root(t.spark)}/runvox/{uuid.uuid4().hex}"
    for name in ("v_truth", "v_pred"):
        pack_voxels(t.items(name)).write.parquet(f"{root}/{name}")
    header = t.header
    header.write.parquet(f"{root}/header")

    def scored(batch: DataFrame) -> DataFrame:
        new = materialise(batch.select(*KEY))  # read three times: the state of the stream is not
        mine = lambda name: batch.sparkSession.read.parquet(f"{root}/{name}").join(new, KEY, "left_semi")
        counts = score.confusion_of_tiles(mine("v_truth"), mine("v_pred"), mine("header"), ORGANS)
        names = ("in_truth", "in_prediction", "intersection")
        metrics = score.volume_metrics(counts.withColumns({f"_{n}": F.col(n) for n in names}))
        return metrics.select(*KEY, "organ", *[F.col(f"_{n}").alias(n) for n in names], "dice", "miss")

    cases = t.base("v_header").select(*KEY, "k")
    files = cases.withColumn("side", F.explode(F.array(F.lit("truth"), F.lit("prediction"))))
    for part in (files.where("side = 'truth' OR k % 2 = 0"), files.where("side = 'prediction'")):
        part.select(*KEY, "side").write.mode("append").json(f"{root}/landed")
        stream = t.spark.readStream.schema("source string, case_id string, side string").json(f"{root}/landed")
        streams.resume(streams.landed_pairs(stream), scored, f"{root}/scores", f"{root}/state", mode="update").awaitTermination()
    return t.spark.read.parquet(f"{root}/scores").select(*KEY, "organ", "in_truth", "in_prediction", "intersection", r6("dice"), "miss")
