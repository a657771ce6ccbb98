import pytest
from pyspark.sql import functions as F

from runvox.operators import folds
from runvox.scale import exact_quantiles, ranked


@pytest.fixture(scope="module")
def cases(spark):
    rows = [(s, f"{s}_{t}_{i:03}", t, float(i % 7 + i % 5))
            for s, t, n in (("ts", 1.5, 200), ("amos", 5.0, 60), ("amos", 1.25, 40), ("btcv", 3.0, 30)) for i in range(n)]
    return spark.createDataFrame(rows, "source string, case_id string, slice_thickness_mm double, volume double")


def test_fifths_are_even_and_order_free(cases):
    first = folds.five_folds(cases).collect()
    test = [r for r in first if r.fold == 0]
    assert len(test) == 66 and len(first) - len(test) == 264
    for s in ("ts", "amos", "btcv"):
        share = lambda rows, s=s: sum(r.source == s for r in rows) / len(rows)
        assert abs(share(test) - share(first)) < 0.01
    assert abs(sum(r.slice_thickness_mm == 5.0 for r in test) - 12) <= 1
    again = folds.five_folds(cases.orderBy(F.desc("case_id"))).where("fold = 0")
    assert {r.case_id for r in again.collect()} == {r.case_id for r in test}


def test_every_stratum_is_spread_evenly(cases):
    counts = {}
    for r in folds.five_folds(cases).collect():
        counts.setdefault(r.stratum, [0] * 5)[r.fold] += 1
    assert all(max(c) - min(c) <= 1 for c in counts.values())


def test_nested_split_is_a_partition(cases):
    rows = folds.split_roles(cases).collect()
    assert len({r.case_id for r in rows}) == len(rows) == 330
    n = {p: sum(r.role == p for r in rows) for p in ("test", "validation", "train")}
    assert n["test"] == 66 and n["validation"] in (52, 53) and sum(n.values()) == 330


def test_split_violations(spark):
    build = spark.createDataFrame([("a", "train"), ("b", "train"), ("c", "test")], "name string, role string")
    table = lambda rows: spark.createDataFrame(rows, "fold int, part string, name string")
    assert folds.split_violations(table([(0, "train", "a"), (0, "val", "b")]), build, 1).count() == 0
    bad = folds.split_violations(table([(0, "train", "a"), (0, "val", "a"), (0, "val", "b"), (0, "val", "b"), (0, "val", "c")]), build, 1)
    assert {(r.name, r.problem) for r in bad.collect()} == {
        ("a", "in both parts"), ("b", "listed twice"), ("c", "test case in fold")}


def test_quantiles_and_ranks_under_skew(spark):
    rows = [("hot", 1.0)] * 500 + [("hot", float(i)) for i in range(100)] + [("cold", 3.0), ("cold", 8.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    probs = {"a": 1 / 3, "m": 0.5, "z": 0.99}
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", probs).collect()}
    want = {r.k: r.q for r in df.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, probs.values()))).alias("q")).collect()}
    assert all(list(got[k][1:]) == pytest.approx(want[k]) for k in want)
    assert exact_quantiles(df, [], "v", {"m": 0.5}).first().m == 1.0
    order = ranked(df.distinct(), ["k", "v"]).orderBy("position").collect()
    assert [r.position for r in order] == list(range(len(order))) and [(r.k, r.v) for r in order] == sorted((r.k, r.v) for r in order)
