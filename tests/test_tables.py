import gzip
import hashlib
import struct

import duckdb
import numpy as np
from pyspark.sql import functions as F

from check_oracle import compare
from runvox import vocabulary
from runvox.functions import text
from runvox.operators import labels, manifest, report, work
from runvox.scale import fixed_table
from runvox.sources import nifti, registry, tables, volumes
from runvox.streaming import progress as streams


def nifti_bytes(data, zooms=(1.0, 1.0, 1.0), affine=None, code=2):
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *data.shape, 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, code, data.dtype.itemsize * 8)
    struct.pack_into("<8f", head, 76, 1, *zooms, 1, 1, 1, 1)
    struct.pack_into("<3f", head, 108, 352, 1, 0)
    if affine is not None:
        struct.pack_into("<h", head, 254, 1)
        struct.pack_into("<12f", head, 280, *np.asarray(affine)[:3].ravel())
    return gzip.compress(bytes(head) + data.tobytes(order="F"))


def test_volume_ingest(spark, tmp_path):
    rng = np.random.default_rng(9)
    label = rng.integers(0, 3, (5, 6, 7)).astype("u1")
    ct = rng.integers(-900, 900, (4, 3, 5)).astype("<i2")
    affine = np.array([[-2, 0, 0, 5], [0, 1.5, 0, 6], [0, 0, 3, 7], [0, 0, 0, 1.0]])
    for name, data in (("good", nifti_bytes(label, (2, 1.5, 3), affine)), ("ct", nifti_bytes(ct, code=4)), ("bad", b"junk")):
        (tmp_path / f"{name}.nii.gz").write_bytes(data)
    files = volumes.volume_files(spark, str(tmp_path)).select(
        F.lit("s").alias("source"), F.regexp_extract("path", r"([^/]+)\.nii\.gz$", 1).alias("case_id"),
        F.lit("l").alias("structure"), "content")
    good = files.where("case_id = 'good'")
    got = {(r.x, r.y, z): r.label for r in volumes.label_runs(good).collect() for z in range(r.z0, r.z1 + 1)}
    assert got == {tuple(int(i) for i in p): int(label[tuple(p)]) for p in np.argwhere(label)}
    heads = {r.case_id: r for r in volumes.headers(files).collect()}
    assert heads["good"].shape == [5, 6, 7] and np.allclose(heads["good"].affine, affine)
    assert heads["bad"].shape is None and heads["bad"].error
    assert [r.case_id for r in volumes.read_errors(files).collect()] == ["bad"]
    back = {(r.x, r.y): list(r.hu) for r in volumes.ct_columns(files.where("case_id = 'ct'")).collect()}
    assert back == {(x, y): ct[x, y].tolist() for x in range(4) for y in range(3)}


def test_quaternion_affine():
    head = bytearray(gzip.decompress(nifti_bytes(np.zeros((2, 2, 2), "u1"), (1, 2, 3))))
    struct.pack_into("<h", head, 252, 1)
    struct.pack_into("<6f", head, 256, 0, 0, 1, 4, 5, 6)  # half a turn about z
    assert np.allclose(nifti.read_header(bytes(head))["affine"], [[-1, 0, 0, 4], [0, -2, 0, 5], [0, 0, 3, 6], [0, 0, 0, 1]])


def test_registry(spark, tmp_path):
    for name in ("amos/train/labelsTr/amos_1.nii.gz", "flare/labels/F_1.nii.gz", "flare/images/F_1_0000.nii.gz", "amos/train/labelsTr/x.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    cases = registry.cases_from_folders(registry.list_files(spark, str(tmp_path)), registry.label_folders(spark))
    assert {(r.source, r.case_id, r.official_split) for r in cases.collect()} == {("amos", "amos_1", "train"), ("flare", "F_1", "train")}
    (tmp_path / "meta.csv").write_bytes("﻿image_id;split\ns0001;train\n".encode())
    meta = registry.cases_from_metadata(spark, str(tmp_path / "meta.csv"), "ts")
    assert [tuple(r) for r in meta.collect()] == [("ts", "s0001", "train")]


def test_tables_in_and_out(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c\nx,1.5,\ny,oops,3\n")
    got = tables.read_csv(spark, str(tmp_path / "t.csv"), "a string, b double, c int").orderBy("a").collect()
    assert [tuple(r) for r in got] == [("x", 1.5, None), ("y", None, 3)]
    (tmp_path / "s.json").write_text('[{"train": ["a", "b"], "val": ["c"]}, {"train": ["c"], "val": ["a"]}]')
    assert {tuple(r) for r in tables.split_from_json(spark, str(tmp_path / "s.json")).collect()} == {
        (0, "train", "a"), (0, "train", "b"), (0, "val", "c"), (1, "train", "c"), (1, "val", "a")}
    (tmp_path / "m.json").write_text('{"members": {"c1": ["x", "y"], "c2": ["z"]}}')
    assert tables.members_from_json(spark, str(tmp_path / "m.json")).count() == 3
    (tmp_path / "ids.txt").write_text("s1\r\ns2\n")
    assert [r.id for r in tables.read_ids(spark, str(tmp_path / "ids.txt")).orderBy("position").collect()] == ["s1", "s2"]
    wide = spark.createDataFrame([("x", None), ("a", 1)], "n string, v int")
    tables.write_csv(wide, str(tmp_path / "out"), ["n"])
    text_ = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text_.startswith("n,v\na,1\n") and text_.rstrip().endswith("x,")
    record = tables.completion_record(spark, str(tmp_path / "out"), str(tmp_path / "record"), {"recipe": "r"})
    assert record.count() == 1 and len(record.first().content_id) == 64


def test_names(spark):
    names = ["../outside", "/absolute", "a/../../b", "a\\b", "a//b", "C:/secret", "", "a/", "ok/name.txt", "..a/b..", "a/./b"]
    flagged = spark.createDataFrame([(n,) for n in names], "n string").where(text.unsafe_name(F.col("n")))
    assert {r.n for r in flagged.collect()} == set(names) - {"ok/name.txt", "..a/b.."}
    keys = spark.createDataFrame([("Left_Kidney cyst",), ("vertebrae_L1",)], "n string").select(text.canonical_key(F.col("n")).alias("k"))
    assert [r.k for r in keys.collect()] == ["cyst kidney left", "l1 vertebra"]


def test_label_maps(spark):
    assert all(set(ids) == set(vocabulary.ORGAN_IDS) for ids in vocabulary.LABEL_IDS.values())
    assert labels.organ_map(spark).count() == 27 + 21
    model = fixed_table(spark, [("liver_segment_1", 4), ("postcava", 7), ("lung", 9), ("adrenal_gland_left", 2)], ["label", "number"])
    got = labels.map_by_prefix(model, vocabulary.ORGAN_ALIASES, vocabulary.ORGAN_IDS)
    assert {r.number: r.organ_id for r in got.collect()} == {4: 5, 7: 8, 2: 1}
    organs = fixed_table(spark, [(i,) for i in vocabulary.ORGAN_IDS.values()], ["organ_id"])
    assert labels.unreached_organs(got, organs).count() == 6


def _entries(spark, n):
    rows = [(f"d/{i:03}.bin", f"content {i}".encode()) for i in range(n)]
    return rows, manifest.file_inventory(spark.createDataFrame(rows, "name string, content binary"))


def test_manifest(spark):
    rows, files = _entries(spark, 70)
    for r in files.where("name = 'd/003.bin'").collect():
        data = rows[3][1]
        assert (r.size, r.sha256) == (len(data), hashlib.sha256(data).hexdigest())
        assert r.git_sha1 == hashlib.sha1(b"blob %d\0" % len(data) + data).hexdigest()
    ident = lambda f, recipe="r": manifest.content_id(f, "k", recipe).first().content_id
    assert ident(files) == ident(files.orderBy(F.desc("name")))
    changed = files.withColumn("size", F.when(F.col("name") == "d/003.bin", 1).otherwise(F.col("size")))
    assert len({ident(files), ident(changed), ident(files, "other"), ident(files.where("name <> 'd/003.bin'"))}) == 4
    header = manifest.content_id(files, "k", "r")
    assert manifest.header_violations(header, files, "k", "r").count() == 0
    problems = lambda *a: {r.problem for r in manifest.header_violations(*a).collect()}
    assert problems(header, changed, "k", "r") == {"checksum mismatch"}
    assert "recipe changed" in problems(header, files, "k", "new") and "empty manifest" in problems(header, files.limit(0), "k", "r")
    actual = files.select("name", "size", F.col("sha256").alias("lfs_sha256"), F.lit(None).cast("string").alias("blob_id"))
    assert manifest.verify(files, actual).where("status <> 'ok'").count() == 0
    assert manifest.verify(changed, actual).where("status = 'size'").count() == 1


def test_progress_and_verdict(spark):
    expected = fixed_table(spark, list(vocabulary.EXPECTED_SCANS.items()), ["source", "total"])
    entries = lambda counts, bad=0: spark.createDataFrame(
        [(s, "hash" if i < bad else "ok") for s, n in counts.items() for i in range(n)], "source string, status string")
    some, whole = {"amos": 26}, vocabulary.EXPECTED_SCANS
    got = {r.source: r for r in report.progress(entries(some), expected).collect()}
    assert got["amos"].verified == 26 and got["amos"].state == "IN_PROGRESS" and got["btcv"].verified == 0
    state = lambda *a: report.verdict(*a).first().state
    assert state(entries(some), expected, False) == "IN_PROGRESS"
    assert state(entries(whole), expected, True) == "COMPLETE"
    assert state(entries({"amos": 1}, bad=1), expected, False) == "ERROR"
    assert state(entries({"amos": 1}), expected, True) == "ERROR"
    assert state(entries({"amos": 301}), expected, False) == "ERROR"


def test_size_groups_walk(spark):
    rng = np.random.default_rng(10)
    files = [(p, f"f{i:03}", int(s)) for p in "ab" for i, s in enumerate(rng.choice([0, 1, 5, 20, 60, 150], 60))]
    got = work.size_groups(spark.createDataFrame(files, "prefix string, name string, size long"), 100)
    want, group, total = {}, {}, {}
    for p, n, s in sorted(files):
        if p in total and total[p] + s > 100:
            group[p], total[p] = group[p] + 1, 0
        group.setdefault(p, 0)
        total[p] = total.get(p, 0) + s
        want[p, n] = group[p]
    assert {(r.prefix, r.name): r.archive for r in got.collect()} == want


def test_resume_scores_each_case_once(spark, tmp_path):
    landed, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    table = lambda names: spark.createDataFrame([("s", n) for n in names], "source string, case_id string")
    seen = []

    def score(batch):
        seen.extend(r.case_id for r in batch.collect())
        if "boom" in seen and seen.count("boom") == 1:
            raise RuntimeError("lost")
        return batch.withColumn("score", F.lit(1.0))

    def run():
        streams.resume(spark.readStream.schema("source string, case_id string").json(landed), score, out, state).awaitTermination()

    table("abc").write.mode("append").json(landed)
    run()
    table(["a", "d", "boom"]).write.mode("append").json(landed)
    try:
        run()
    except Exception:  # the second commit fails once
        pass
    run()
    run()
    got = [r.case_id for r in spark.read.parquet(out).collect()]
    assert sorted(got) == ["a", "b", "boom", "c", "d"] and seen.count("a") == 1


def test_damaged_and_float_volumes(spark):
    """Every damage becomes an error row; masks are tested before casting; touching labels are one piece."""
    import gzip
    import struct

    import numpy as np

    from runvox.sources import volumes

    def volume(data):
        head = bytearray(352)
        struct.pack_into("<i", head, 0, 348)
        struct.pack_into("<8h", head, 40, 3, *data.shape, 1, 1, 1, 1)
        struct.pack_into("<hh", head, 70, 16, 32)
        struct.pack_into("<8f", head, 76, 1, 1, 1, 1, 1, 1, 1, 1)
        struct.pack_into("<f", head, 108, 352)
        struct.pack_into("<h", head, 254, 1)
        for at, row in ((280, (1, 0, 0, 0)), (296, (0, 1, 0, 0)), (312, (0, 0, 1, 0))):
            struct.pack_into("<4f", head, at, *row)
        head[344:348] = b"n+1\0"
        return gzip.compress(bytes(head) + data.astype("<f4").tobytes(order="F"))

    half = np.zeros((2, 2, 6), np.float32)
    half[0, 0, 1:4] = 0.5
    steps = np.zeros((2, 2, 6), np.float32)
    steps[0, 0, 1:3], steps[0, 0, 3:5] = 1, 2
    good = volume(steps)
    rows = [("s", "half", "m", volume(half)), ("s", "steps", "m", good)]
    rng = np.random.default_rng(0)
    for k in range(40):
        bad = bytearray(good)
        bad[rng.integers(10, len(bad))] ^= 255
        rows.append(("s", f"bad{k}", "m", bytes(bad)))
    files = spark.createDataFrame(rows, "source string, case_id string, structure string, content binary")
    volumes.headers(files).collect()
    errors = {r.case_id for r in volumes.read_errors(files).collect()}
    assert "half" in errors and "steps" not in errors and len(errors) > 20
    assert {r.case_id for r in volumes.label_runs(files).collect()}.isdisjoint(errors)
    masks = {r.case_id: (r.z0, r.z1) for r in volumes.label_runs(files.where("case_id IN ('half', 'steps')"), masks=True).collect()}
    assert masks == {"half": (1, 3), "steps": (1, 4)}
    one = volumes.foreground(volumes.label_runs(files.where("case_id = 'steps'"))).collect()
    assert len(one) == 1


def test_deep_folders_and_missing_grids(spark):
    from runvox.operators import geometry
    from runvox.sources import registry

    files = spark.createDataFrame([("/r/src/a/b/c/d/e/f/case1.nii.gz",), ("/case0.nii.gz",)], "path string")
    folders = spark.createDataFrame([("src", "a/b/c/d/e/f", "train")], "source string, folder string, official_split string")
    assert [r.case_id for r in registry.cases_from_folders(files, folders).collect()] == ["case1"]
    grid = "source string, case_id string, shape array<int>, affine array<array<double>>"
    eye = [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 1.0]]
    first = spark.createDataFrame([("s", "a", [1, 1, 1], eye), ("s", "b", [1, 1, 1], eye), ("s", "c", [1, 1, 1], eye)], grid)
    second = spark.createDataFrame([("s", "a", [1, 1, 1], eye), ("s", "b", [1, 1, 1], None)], grid)
    assert sorted(r.case_id for r in geometry.grid_mismatch(first, second).collect()) == ["b", "c"]


def test_replaced_shards_keep_no_old_rows(spark, tmp_path):
    path = str(tmp_path / "shards")
    tables.replace_shard(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "shard string, v int"), path)
    tables.replace_shard(spark.createDataFrame([("a", 9)], "shard string, v int"), path, ["a", "b"])
    assert sorted(map(tuple, spark.read.parquet(path).select("shard", "v").collect())) == [("a", 9), ("c", 3)]
    tables.replace_shard(spark.createDataFrame([("b", 4)], "shard string, v int"), path, ["b"])
    assert sorted(map(tuple, spark.read.parquet(path).select("shard", "v").collect())) == [("a", 9), ("b", 4), ("c", 3)]


def test_progress_keeps_every_source(spark):
    counts = spark.createDataFrame([("a", 2), ("b", 3), ("x", 1)], "source string, verified long")
    expected = spark.createDataFrame([("a", 2), ("b", 4), ("c", 5)], "source string, total long")
    got = {r.source: (r.verified, r.total, r.state) for r in streams.with_progress(counts, expected).collect()}
    assert got == {"a": (2, 2, "COMPLETE"), "b": (3, 4, "IN_PROGRESS"), "c": (0, 5, "WAITING"), "x": (1, None, "ERROR")}


def test_pages_with_equal_urls(spark, tmp_path):
    """Equal names neither multiply rows nor lend each other's hashes; each page is judged by itself."""
    duck = duckdb.connect()
    duck.execute(f"""COPY (SELECT i AS page_id, 'https://a/' || i % 40 AS url, repeat('x', i % 7 + 1) || i AS html FROM range(600) AS r(i))
        TO '{tmp_path}/pages.parquet'""")
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    for name in ("manifest_violations", "verify_manifest", "reusable", "file_inventory"):
        assert compare(spark, duck, name, str(tmp_path)).startswith("ok"), name


def test_size_groups_of_equal_names(spark):
    """Equal names go by size, however the rows come."""
    files = [("p", f"n{i // 30}", 1 + i * 37 % 61) for i in range(120)]
    want, group, total = [], 0, 0
    for row in sorted(files):
        if total + row[2] > 100 and total:
            group, total = group + 1, 0
        total += row[2]
        want.append((*row, group))
    for some in (files, files[::-1]):
        got = work.size_groups(spark.createDataFrame(some, "prefix string, name string, size long"), 100)
        assert sorted(tuple(r) for r in got.select("prefix", "name", "size", "archive").collect()) == want


def test_fingerprint_of_a_body_of_one_voxel_is_that_of_its_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    source = "/root/testdata/sf0.001"
    spark.read.parquet(f"{source}/supplier.parquet").write.parquet(str(tmp_path / "supplier.parquet"))
    items = spark.read.parquet(f"{source}/lineitem.parquet")
    inside = "floor(l_extendedprice) % 2200 BETWEEN 1050 AND 1150"
    one = items.where(inside).groupBy("l_suppkey").agg(F.min_by(F.struct(*items.columns), F.struct("l_orderkey", "l_linenumber")).alias("i"))
    one.select("i.*").write.parquet(str(tmp_path / "lineitem.parquet"))
    duck = duckdb.connect()
    for name in ("supplier", "lineitem"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = entry.queries()["fingerprints"](spark, str(tmp_path))
    want = duck.execute(entry.oracle_sql()["fingerprints"])
    names = [d[0] for d in want.description]
    rows = sorted(str(r) for r in want.fetchall())
    assert sorted(str(tuple(r)) for r in got.select(*names).collect()) == rows and "nan" in rows[0]
