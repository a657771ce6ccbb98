import numpy as np
import pytest

from runvox.operators import fingerprints, overlap
from tests.conftest import label_26


def _unit(a):
    a = a - a.mean(1, keepdims=True)
    return a / a.std(1, keepdims=True)


def test_best_correlation_is_exact_under_skew(spark, monkeypatch):
    monkeypatch.setattr(overlap, "SHARE", 16)
    monkeypatch.setattr(overlap, "BLOCK", 8)
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(1, 24))
    near = centre + rng.normal(scale=0.12, size=(120, 24))  # a third of everything in one neighbourhood
    scans = _unit(np.vstack([near[:80], rng.normal(size=(160, 24))]))
    gold = _unit(np.vstack([near[80:], rng.normal(size=(60, 24)), scans[100:110] + rng.normal(scale=0.1, size=(10, 24))]))
    table = lambda a, k: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], f"{k} long, v array<double>")
    got = {r.key: (r.gold_key, r["corr"]) for r in overlap.best_correlation(table(scans, "key"), table(gold, "gold_key"), 24, 0.97).collect()}
    r = np.round(scans @ gold.T / 24, 9)
    want = {i: (int(r[i].argmax()), r[i].max()) for i in range(len(scans)) if r[i].max() > 0.97}
    assert len(want) > 60 and got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_shape_is_tested_on_the_single_best(spark):
    v = _unit(np.vstack([np.arange(16.0), np.arange(16.0) + np.r_[np.zeros(15), 2.5], np.arange(16.0)[::-1]]))
    scan = "id string, md5 string, shape array<int>, v array<double>"
    gold = spark.createDataFrame([(0, "A", "g0", "m0", [9], v[0].tolist()), (1, "A", "g1", "m1", [5], v[1].tolist()), (2, "B", "g2", "x", [5], v[2].tolist()), (3, "B", "g3", "x", [5], v[2].tolist())],
                                 "ordinal long, dataset string, " + scan)
    scans = spark.createDataFrame([("s0", "n0", [5], v[0].tolist()), ("s1", "x", [5], v[1].tolist()), ("s2", "n2", [5], v[1].tolist())], scan)
    got = {r.id: r for r in overlap.overlap_match(scans, gold, 16).collect()}
    assert (got["s0"].gold_scan, got["s0"].match_type) == ("g0", "corr-only")
    assert (got["s1"].gold_scan, got["s1"].match_type, got["s1"].gold_copies) == ("g2", "exact", 2)
    assert (got["s2"].gold_scan, got["s2"].match_type) == ("g1", "shape+corr")


def _zoom(a, n):
    for axis in range(3):
        at = np.arange(n) * (a.shape[axis] - 1) / (n - 1)
        lo = np.floor(at).astype(int)
        hi = np.minimum(lo + 1, a.shape[axis] - 1)
        w = (at - lo).reshape([-1 if i == axis else 1 for i in range(3)])
        a = a.take(lo, axis) * (1 - w) + a.take(hi, axis) * w
    return a


def test_fingerprint_of_flipped_turned_and_padded_copies(spark, header_table):
    rng = np.random.default_rng(8)
    body = rng.integers(-90, 90, (6, 7, 9))
    body[2, 3, 4] = 400
    padded = np.full((10, 12, 13), -1000)
    padded[2:8, 3:10, 1:10] = body
    copies = {"plain": (body, np.diag([1, 1, 1, 1])), "padded": (padded, np.diag([1, 1, 1, 1])),
              "flipped": (padded[::-1, ::-1], np.diag([-1, -1, 1, 1])),
              "turned": (body.transpose(2, 0, 1), np.array([[0, 1, 0, 0], [0, 0, 1, 0], [1, 0, 0, 0], [0, 0, 0, 1]])),
              "other": (np.where(body == body[0, 0, 0], body + 1, body), np.diag([1, 1, 1, 1])),
              "air": (np.full((4, 4, 4), -1000), np.diag([1, 1, 1, 1]))}
    ct = spark.createDataFrame([("s", n, x, y, [int(v) for v in a[x, y]]) for n, (a, _) in copies.items()
                                for x in range(a.shape[0]) for y in range(a.shape[1])],
                               "source string, case_id string, x int, y int, hu array<int>")
    header = header_table({("s", n): (a.shape, (1, 1, 1), m) for n, (a, m) in copies.items()})
    got = {r.case_id: r for r in fingerprints.fingerprints(ct, header, 8).collect()}
    assert len({got[n].md5 for n in ("plain", "padded", "flipped", "turned")}) == 1
    assert got["other"].md5 != got["plain"].md5 and got["air"].md5 is None and got["air"].v is None
    assert all(list(got[n].shape) == [6, 7, 9] for n in ("plain", "padded", "flipped", "turned"))
    part = max(label_26((body > -100) & (body < 100)), key=len)
    assert len(part) == body.size - 1
    want = _zoom(np.clip(body, -200, 300).astype(float), 8).ravel()
    assert np.allclose(got["turned"].v, (want - want.mean()) / want.std(), atol=1e-9)


def test_crop_candidates(spark):
    shapes = lambda rows: spark.createDataFrame(rows, "id string, nx int, ny int, nz int")
    full = shapes([("f1", 10, 10, 10), ("f2", 11, 10, 10), ("f3", 11, 10, 10), ("f4", 10, 10, 13)])
    got = overlap.shape_candidates(shapes([("a", 10, 10, 10), ("b", 11, 9, 10), ("c", 10, 10, 11), ("d", 30, 1, 1)]), full)
    assert {r.id: (r.cost, r.candidates, r.first_candidate) for r in got.collect()} == {
        "a": (0, 1, "f1"), "b": (1, 2, "f2"), "c": (2, 1, "f4")}
