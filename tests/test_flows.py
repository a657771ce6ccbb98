"""Gates and the dataset build on hand-made cases."""

from __future__ import annotations

import hashlib
import resource

import numpy as np

from runvox.operators import gates, manifest
from runvox.plans import pipelines

GRID = "source string, case_id string, shape array<int>, affine array<array<double>>"
EYE = np.eye(4).tolist()


def moved(by):
    a = np.eye(4)
    a[0, 3] = by
    return a.tolist()


def test_every_reason_and_their_counts(spark):
    cases = ["good", "close", "missing", "twice", "changed", "unrecorded", "grid", "shape", "nogrid", "labels", "two"]
    references = spark.createDataFrame([("s", c, [4, 4, 4], EYE) for c in cases], GRID)
    files = [("s", c, [4, 4, 4], EYE, c) for c in cases if c not in ("missing", "close", "grid", "shape", "nogrid", "two")]
    files += [("s", "twice", [4, 4, 4], EYE, "twice"), ("s", "close", [4, 4, 4], moved(9e-4), "close"), ("s", "grid", [4, 4, 4], moved(2e-3), "grid"),
              ("s", "shape", [4, 4, 5], EYE, "shape"), ("s", "nogrid", None, None, "nogrid"), ("s", "two", [4, 4, 4], moved(1.0), "other"),
              ("s", "stranger", [4, 4, 4], EYE, "x")]
    record = [("s", c, "old" if c == "changed" else c) for c in cases if c != "unrecorded"]
    labels = [("s", c, 1, 5) for c in cases] + [("s", "labels", 99, 1), ("s", "two", -1, 2), ("s", "good", 99, 0)]
    gate = gates.prediction_gate(references, spark.createDataFrame(files, GRID + ", sha256 string"),
                                 spark.createDataFrame(record, "source string, case_id string, sha256 string"),
                                 spark.createDataFrame(labels, "source string, case_id string, label int, voxels long"), [1, 2])
    got = {r.case_id: r.reasons for r in gate.judged.collect()}
    assert got == {"good": [], "close": [], "missing": ["missing"], "twice": ["duplicate"], "changed": ["changed"], "unrecorded": ["changed"],
                   "grid": ["grid"], "shape": ["grid"], "nogrid": ["grid"], "labels": ["labels"], "two": ["changed", "grid", "labels"]}
    assert gate.counts == {"cases": 11, "rejected": 9, "missing": 1, "duplicate": 1, "changed": 3, "grid": 4, "labels": 2}
    assert sorted(r.case_id for r in gate.accepted(references).collect()) == ["close", "good"]


def test_no_reject_is_scored(spark, run_table, header_table):
    one = np.zeros((4, 4, 4), bool)
    one[1, 1, 1:3] = True
    runs = run_table({("s", c, "liver"): one for c in ("a", "b")})
    header = header_table({("s", c): ((4, 4, 4), (1, 1, 1), None) for c in ("a", "b")})
    grid = header.select("source", "case_id", "shape", "affine")
    files = grid.where("case_id = 'a'").selectExpr("*", "'x' AS sha256")
    gate = gates.prediction_gate(grid, files, files.select("source", "case_id", "sha256"),
                                 spark.createDataFrame([], "source string, case_id string, label int, voxels long"), [5])
    rows = pipelines.gated_scores(runs, runs, header, ["liver", "spleen"], gate).collect()
    assert {(r.case_id, r.organ, r.dice) for r in rows} == {("a", "liver", 1.0), ("a", "spleen", None)}


def test_build_rows(spark, run_table, header_table):
    """Glands are cleaned before overlaps are counted; excluded and failed cases say why and are not composed."""
    gland = np.zeros((12, 12, 12), bool)
    gland[2:6, 2:6, 2:6] = True          # 64 voxels
    gland[9, 9, 9] = True                # a speckle, inside the liver
    right = np.zeros_like(gland)
    right[7:11, 2:6, 2:6] = True
    liver = np.zeros_like(gland)
    liver[5:10, 5:11, 5:11] = True       # overlaps the left gland in one voxel, the right one in three
    masks = {"adrenal_left": gland, "adrenal_right": right, "liver": liver}
    cases = ["whole", "grid", "drift", "out"]
    runs = run_table({("ts", c, o): m for c in cases for o, m in masks.items()})
    header = header_table({("ts", c): ((12, 12, 12), (3, 3, 6 if c == "out" else 3), None) for c in cases})
    done = pipelines.audit(runs, header, list(masks), pairs=[("adrenal_left", "adrenal_right")])
    scans = {r.case_id: r.scan for r in done.cohort.collect()}
    assert scans == {"whole": "kept_with_adrenal", "grid": "kept_with_adrenal", "drift": "kept_with_adrenal", "out": "excluded"}
    first = done.cohort.selectExpr("source", "case_id", "scan", "adrenal_left",
                                   "CASE WHEN case_id = 'drift' THEN 'absent' ELSE adrenal_right END AS adrenal_right")
    images = header.selectExpr("source", "case_id", "CASE WHEN case_id = 'grid' THEN array(1, 2, 3) ELSE shape END AS shape", "affine")
    roles = spark.createDataFrame([("ts", c, "train") for c in cases], "source string, case_id string, role string")
    ids = {"adrenal_left": 1, "adrenal_right": 2, "liver": 5}
    rows, composed = pipelines.build_dataset(done, first, images, roles, ids, ["liver", "adrenal_left", "adrenal_right"])
    got = {r.case_id: r for r in rows.collect()}
    w = got["whole"]
    assert (w.name, w.role, w.adrenal_left_removed_ml, w.adrenal_right_removed_ml, w.overlap_voxels, w.labels_present, w.error) == (
        "ts_whole", "train", 0.027, 0.0, 4, [1, 2, 5], "")
    assert (got["grid"].role, got["grid"].error) == ("failed", "image grid differs from label grid")
    assert got["drift"].role == "failed" and got["drift"].error.startswith("adrenal_right: was absent, is keep")
    assert (got["out"].role, got["out"].error, got["out"].labels_present) == ("excluded", "excluded", None)
    assert {r.case_id for r in composed.select("case_id").distinct().collect()} == {"whole"}


def test_inventory_of_files_by_path(spark, tmp_path):
    """A file many times larger than a piece is hashed piece by piece; empty files count too."""
    rng = np.random.default_rng(0)
    contents = {"deep/large.bin": rng.bytes(3_000_001), "empty": b"", "text.gz": b"no gzip at all"}
    for name, content in contents.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    paths = spark.createDataFrame([(n,) for n in contents], "name string")
    got = {r.name: (r.size, r.sha256, r.git_sha1) for r in manifest.path_inventory(paths, str(tmp_path), piece=4096).collect()}
    assert got == {n: (len(c), hashlib.sha256(c).hexdigest(), hashlib.sha1(b"blob %d\0" % len(c) + c).hexdigest()) for n, c in contents.items()}
    assert manifest.path_inventory(paths.limit(0), str(tmp_path)).count() == 0


def test_memory_of_an_inventory_is_one_piece(spark, tmp_path):
    """300 MB of zeros: the worker that hashes them grows by far less."""
    with open(tmp_path / "big", "wb") as file:
        file.truncate(300 << 20)

    def grown(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch
        yield pa.RecordBatch.from_pylist([{"name": "peak", "size": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, "sha256": "", "git_sha1": ""}])
    rows = manifest.path_inventory(spark.createDataFrame([("big",)], "name string").coalesce(1), str(tmp_path), piece=1 << 20)
    got = {r.name: r.size for r in rows.mapInArrow(grown, rows.schema).collect()}
    assert got["big"] == 300 << 20 and got["peak"] < 290_000


def test_counts_fall_when_files_turn_corrupt(spark, tmp_path):
    """Late older entries change nothing, of entries at one time the failing one counts, a restart goes on from the state."""
    from runvox.streaming import progress

    def run(rows):
        (spark.createDataFrame(rows, progress.STATUS).coalesce(1).write.mode("append").json(str(tmp_path / "in")))
        stream = progress.manifest_stream(spark, str(tmp_path / "in"), progress.STATUS)
        progress.keep_counts(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return {r.source: r.verified for r in progress.counted(spark, str(tmp_path / "out")).collect()}
    first = [("a", f"f{i}", 10, True) for i in range(4)] + [("b", "g", 10, False), ("b", "h", 10, None), ("a", None, 10, True), ("a", "x", None, True)]
    assert run(first) == {"a": 4}
    assert run([("a", "f0", 11, False), ("a", "f1", 9, False), ("a", "f2", 10, False), ("b", "g", 12, True), ("a", "f3", 10, True)]) == {"a": 2, "b": 1}
    assert run([("a", "f0", 12, True), ("b", "g", 13, False)]) == {"a": 3, "b": 0}


def test_files_that_turn_corrupt_are_followed_without_a_call_per_file(spark, tmp_path, capsys):
    """100,000 files took 88 s with a Python call and a state of its own for each."""
    from runvox.streaming import progress
    landed = str(tmp_path / "landed")
    for wave, (at, ok) in enumerate(((2, "true"), (3, "id % 5 > 0"), (1, "false"))):
        files = spark.range(2000).selectExpr("concat('s', id % 3) AS source", "concat('f', id) AS name", f"CAST({at} AS LONG) AS at", f"{ok} AS ok")
        files.write.mode("append").json(landed)
        run = progress.keep_counts(progress.manifest_stream(spark, landed, progress.STATUS), str(tmp_path / "out"), str(tmp_path / "state"))
        run.awaitTermination()
        capsys.readouterr()
        run.explain()
        assert "Pandas" not in capsys.readouterr().out
        got = {r.source: r.verified for r in progress.counted(spark, str(tmp_path / "out")).collect()}
        want = {f"s{k}": sum(1 for i in range(2000) if i % 3 == k and (wave == 0 or i % 5)) for k in range(3)}
        assert got == want
