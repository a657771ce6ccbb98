"""The volume data source: one scan, tagged rows, damaged files as rows, headers from the first bytes."""

from __future__ import annotations

import gzip
import io

import numpy as np
import pytest

from runvox.sources import volume_source as vs
from tests.test_tables import nifti_bytes


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("volumes")
    rng = np.random.default_rng(3)
    label = np.zeros((4, 3, 6), "u1")
    label[1, 1, 1:3], label[1, 1, 3:5], label[2, 0, 5] = 1, 2, 7  # touching labels
    half = np.zeros((2, 2, 6), "<f4")
    half[0, 0, 1:4] = 0.5
    ct = rng.integers(-1000, 2000, (4, 3, 5)).astype("<i2")
    whole = nifti_bytes(label, (2, 1.5, 3), np.diag([-2, 1.5, 3, 1.0]))
    files = {"ts/a/labels": whole, "ts/b/labels": whole[:len(whole) - 12], "amos/c/labels": nifti_bytes(half, code=16),
             "amos/d/labels": b"junk", "amos/e/ct": nifti_bytes(ct, code=4), "amos/f/ct": nifti_bytes(ct.astype("<i4") * 40, code=8),
             "amos/g/labels": b"", "deep/x/y/h/labels": nifti_bytes(label)}
    for name, content in files.items():
        path = root / f"{name}.nii.gz"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    (root / "ts" / "note.txt").write_text("no volume")
    return str(root), label, ct


def test_one_scan_gives_everything(spark, folder):
    root, label, ct = folder
    rows = vs.scan(spark, root, group_bytes=1).cache()
    assert {(r.source, r.case_id, r.structure) for r in vs.headers(rows).collect()} == {
        ("ts", "a", "labels"), ("ts", "b", "labels"), ("amos", "c", "labels"), ("amos", "e", "ct"), ("amos", "f", "ct"), ("y", "h", "labels")}
    assert sorted(r.case_id for r in vs.errors(rows).collect()) == ["b", "c", "d", "g"]
    got = {(r.case_id, r.x, r.y, z): r.label for r in vs.runs(rows).where("structure = 'labels'").collect() for z in range(r.z0, r.z1 + 1)}
    assert got == {(c, *map(int, p)): int(label[tuple(p)]) for c in "ah" for p in np.argwhere(label)}
    head = vs.headers(rows).where("case_id = 'a'").first()
    assert head.shape == [4, 3, 6] and head.zooms == [2.0, 1.5, 3.0] and head.affine[0][0] == -2.0
    rows.unpersist()


def test_masks_and_columns(spark, folder):
    root, _, ct = folder
    masks = vs.scan(spark, root, ("run",), masks=True).where("case_id IN ('a', 'c')").collect()
    assert {(r.case_id, r.label, r.x, r.y, r.z0, r.z1) for r in masks} == {("a", 1, 1, 1, 1, 4), ("a", 1, 2, 0, 5, 5), ("c", 1, 0, 0, 1, 3)}
    rows = vs.scan(spark, root, ("column",)).where("structure = 'ct'").collect()
    assert {(r.x, r.y): r.hu for r in rows if r.kind == "column"} == {(x, y): ct[x, y].tolist() for x in range(4) for y in range(3)}
    assert [r.case_id for r in rows if r.kind == "error"] == ["f"]  # beyond 16 bits: refused, not wrapped


def test_scaled_intensities_are_rounded():
    assert vs.intensities_of(np.array([1.6, -1.6, 0.4])).tolist() == [2, -2, 0]
    with pytest.raises(ValueError, match="16 bits"):
        vs.intensities_of(np.array([np.nan]))


def test_headers_need_only_the_first_bytes(spark, folder):
    """The rest of a large file is neither fetched nor inflated."""
    big = nifti_bytes(np.random.default_rng(1).integers(0, 255, (64, 64, 64)).astype("u1"))
    asked = []

    def read(n):
        asked.append(n)
        return io.BytesIO(big[:100_000] + b"damage").read(n)
    rows = list(vs.file_rows("p", read, ["header"], False))
    assert len(rows) == 1 and rows[0].column("kind")[0].as_py() == "header" and asked == [vs._HEAD_BYTES]
    plan = vs.scan(spark, folder[0], ("header",))
    assert sorted(r.case_id for r in plan.where("kind = 'header'").collect()) == ["a", "b", "c", "e", "f", "h"]
    assert sorted(r.case_id for r in plan.where("kind = 'error'").collect()) == ["d", "g"]


def test_groups_and_options(folder, spark):
    root = "file://" + folder[0]
    assert len(vs.VolumeReader({"path": root, "groupbytes": "1"}).partitions()) == 8
    assert len(vs.VolumeReader({"path": root}).partitions()) == 1
    with pytest.raises(ValueError, match="unknown parts"):
        vs.VolumeReader({"path": root, "parts": "pixels"})
    assert vs.scan(spark, folder[0], suffix=".none").count() == 0
    text = vs.scan(spark, folder[0])._jdf.queryExecution().executedPlan().toString()
    assert text.count("BatchScan") == 1


def test_written_files_come_back(spark, tmp_path):
    content = gzip.decompress(nifti_bytes(np.ones((2, 2, 2), "u1")))
    files = spark.createDataFrame([("s/k/labels.nii.gz", bytearray(content))], "name string, content binary")
    assert vs.write_files(files, str(tmp_path)).collect()[0].name == "s/k/labels.nii.gz"
    assert vs.runs(vs.scan(spark, str(tmp_path))).count() == 4


def test_label_files_hold_every_voxel_and_none_is_looked_up_in_a_map(spark, capsys):
    from runvox.plans import catalog
    from runvox.plans.voxel_queries import IDS, volume_content
    from runvox.sources.nifti import read_volume

    t = catalog.Tables(spark, "/root/testdata/sf0.001")
    files = volume_content(t)
    want = {}
    for r in t.base("v_truth").collect():
        at = (r.source, r.case_id, r.x, r.y, r.z)
        want[at] = max(want.get(at, 0), IDS[r.organ])
    got = {}
    for f in files.collect():
        data = read_volume(bytes(f.content))[1]
        got |= {(f.source, f.case_id, *p): int(data[p]) for p in zip(*map(lambda a: a.tolist(), data.nonzero()), strict=True)}
    assert got == want
    files.explain("extended")
    assert "map_from_entries" not in capsys.readouterr().out
