"""Hard-negative mining against all pairs: ties, repeated rows and ids, short vectors, nulls, small parts."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from runvox.llm import negatives
from runvox.llm.queries import whole_vectors


def brute(rows, positives=5, wanted=5, low=80, high=100):
    """The rows of the operator from all inner products; ``rows``: (id, label, whole vector)."""
    good = [(i, k, v) for i, k, v in rows if i is not None and k is not None and v is not None and None not in v and sum(x * x for x in v) < 2**52]
    out = []
    for a, (i, k, v) in enumerate(good):
        if i % 5:
            continue
        score = [(-sum(x * y for x, y in zip(v, w, strict=False)), j, m == k) for b, (j, m, w) in enumerate(good) if b != a]
        for p, j, _ in sorted(x for x in score if x[2])[:positives]:
            hits = sorted((s, m) for s, m, same in score if not same and -low * p <= -100 * s <= -high * p)
            out += [(i, j, r + 1, m, -p, -s) for r, (s, m) in enumerate(hits[:wanted])]
    return Counter(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    out = []
    for i in range(260):
        v = (rng.normal(size=12) * rng.choice([3, 20, 40])).astype(int).tolist()
        out.append((i, i % 3, v))
    base = out[0][2]
    out += [(300 + i, i % 3, base) for i in range(40)]  # copies: ties of equal scores
    out += [(400, 7, base), (405, 8, base), (406, 8, base[:5]), (407, 0, []), (410, 1, base[:3]), (415, 9, [0] * 12), (416, 9, [0] * 12)]
    out += [(None, 0, base), (420, None, base), (421, 0, None), (425, 0, [1, None, 3]), (430, 0, [1 << 26] * 2), (431, 0, [(1 << 25)])]
    return out


@pytest.mark.parametrize(("cells", "positives", "wanted", "low", "high"), [(1 << 20, 5, 5, 80, 100), (500, 5, 5, 80, 100), (500, 2, 40, 30, 95)])
def test_mined(spark, rows, monkeypatch, cells, positives, wanted, low, high):
    monkeypatch.setattr(negatives, "CELLS", cells)  # few cells: many parts, which labels straddle
    monkeypatch.setattr(negatives, "BLOCK", 7)
    table = spark.createDataFrame([(*r, k, "x") for k, r in enumerate(rows)], "vec_id long, label int, vector array<long>, row int, part string")
    got = negatives.mined(table, F.col("vec_id") % 5 == 0, positives, wanted, low, high).collect()
    assert Counter(tuple(r) for r in got) == brute(rows, positives, wanted, low, high)


def test_rows_that_repeat_an_id(spark):
    """Each is a row of its own: it may be a positive of the other."""
    rnd = random.Random(2)
    rows = [(i // 2, i % 2, [rnd.randrange(-9, 9) for _ in range(6)]) for i in range(60)] + [(5, 0, [9] * 6)] * 3
    got = Counter(tuple(r) for r in negatives.mined(spark.createDataFrame(rows, "vec_id long, label int, vector array<long>"), F.col("vec_id") % 5 == 0).collect())
    assert got == brute(rows)


def test_index_leaves_out_and_loses_nothing():
    """Whatever the threshold, exactly the rows that reach it come through, with exact scores."""
    rng = np.random.default_rng(9)
    vectors = np.floor(rng.normal(size=(400, 30)) * rng.choice([1, 10, 60], (400, 1)))
    part = negatives.Part(np.arange(400), np.arange(400), np.zeros(400), vectors)
    anchors = np.floor(rng.normal(size=(9, 30)) * 20)
    want = anchors @ vectors.T
    for share in (-1.0, 0.0, 0.05, 0.2, 0.5, 0.9):
        least = share * np.sqrt((anchors ** 2).sum(axis=1)) * 60 * np.sqrt(30)
        rows, scores = part.join(anchors, least)
        assert (scores == want[:, rows]).all()
        assert set(np.flatnonzero((want >= least[:, None]).any(axis=0))) <= set(rows.tolist())
    assert len(part.join(anchors, np.full(9, 1e9))[0]) == 0


def test_components(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(7, 9, [0.5, -0.5]), (8, 9, [1 / 512, -1 / 512]), (14, None, [1.0]), (1, 1, [nan]), (2, 1, [inf]), (3, 1, [None]), (4, 1, None), (5, 1, [1e30])]
    got = {r.vec_id: (r.label, r.vector) for r in whole_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).collect()}
    assert set(got) == {7, 8, 14, 5}
    assert got[7] == (0, [128, -128]) and got[8] == (9, [0, -1]) and got[14][0] is None
    assert negatives.mined(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").transform(whole_vectors), F.lit(True)).count() >= 0


def test_no_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, vector array<long>")
    assert negatives.mined(empty, F.lit(True)).count() == 0
    one = spark.createDataFrame([(100, 1, [1, 2])], "vec_id long, label int, vector array<long>")
    assert negatives.mined(one, F.lit(True)).count() == 0
