import numpy as np
import pytest

from pyspark.sql import functions as F

from runvox import vocabulary
from runvox.operators import cohort, components, geometry
from runvox.plans import pipelines

GRID = (30, 30, 30)


def _block(*parts, shape=GRID):
    mask = np.zeros(shape, bool)
    for p in parts:
        mask[tuple(slice(*s) if isinstance(s, tuple) else s for s in p)] = True
    return mask


KEEP = ((1, 12), (1, 11), (1, 11))
GLANDS = {
    "absent": (_block(), "absent"),
    "exactly one mL": (_block(((1, 11), (1, 11), (1, 11))), "exclude_small"),
    "keep": (_block(KEEP), "keep"),
    "speckle": (_block(KEEP, (20, 20, 20)), "keep_despeckled"),
    "fragment": (_block(KEEP, ((20, 27), (20, 27), (20, 27))), "exclude_fragmented"),
    "edge": (_block(KEEP, (20, 20, 20), (0, 5, 5)), "exclude_truncated"),
}


@pytest.fixture(scope="module")
def decisions(run_table, header_table):
    volumes = {("s", name, "adrenal_left"): mask for name, (mask, _) in GLANDS.items()}
    header = header_table({("s", name): (GRID, (1, 1, 1), None) for name in GLANDS})
    audit = pipelines.audit(run_table(volumes), header, list(vocabulary.ORGAN_IDS))
    return {(r.case_id, r.organ): r for r in audit.decisions.collect()}, {r.case_id: r for r in audit.cohort.collect()}


def test_every_branch_of_the_rule(decisions):
    glands, _ = decisions
    assert {n: glands[n, "adrenal_left"].decision for n in GLANDS} == {n: d for n, (_, d) in GLANDS.items()}
    assert all(glands[n, "adrenal_right"].decision == "absent" for n in GLANDS)
    assert glands["fragment", "adrenal_left"].second_ml == 0.343


def test_case_outcomes(decisions):
    _, cases = decisions
    assert cases["absent"].scan == "kept_no_adrenal"
    assert cases["keep"].scan == cases["speckle"].scan == "kept_with_adrenal"
    assert {cases[n].scan for n in ("exactly one mL", "fragment", "edge")} == {"excluded"}


def test_training_exclusion(run_table, header_table):
    g = (20, 20, 20)
    big = ((0, 12), (2, 12), (2, 12))
    masks = {"small": [((5, 8), (5, 8), (5, 8))], "small cut": [((5, 8), (5, 8), (0, 8))], "truncated": [big],
             "speckle": [big, ((15, 19), (15, 19), (15, 19))], "bigger speckle": [big, ((14, 19), (14, 19), (12, 19))],
             "fragment": [big, ((10, 19), (14, 19), (12, 19))]}
    runs = run_table({("s", n, "adrenal_left"): _block(*p, shape=g) for n, p in masks.items()})
    header = header_table({("s", n): (g, (1, 1, 1), None) for n in masks})
    sizes = components.component_sizes(components.label_components(runs))
    touch = geometry.edge_touch(geometry.extents(runs), header)
    decided = cohort.gland_decisions(cohort.component_profile(sizes), touch, header)
    got = {r.case_id: r.reason for r in cohort.training_exclusion(decided).collect()}
    assert got == {"small": "adrenal_left: exclude_small", "small cut": "", "truncated": "", "speckle": "",
                   "bigger speckle": "", "fragment": "adrenal_left: exclude_fragmented"}


def test_sides_follow_the_affine(run_table, header_table):
    left, right = _block(((5, 10), (10, 15), (10, 15))), _block(((20, 25), (10, 15), (10, 15)))
    volumes = {("s", c, o): m for c in ("ras", "lps") for o, m in (("kidney_left", left), ("kidney_right", right))}
    header = header_table({("s", "ras"): (GRID, (1, 1, 1), None), ("s", "lps"): (GRID, (1, 1, 1), np.diag([-1, -1, 1, 1])),
                           ("s", "none"): (GRID, (1, 1, 1), None)})
    got = geometry.sides_check(geometry.extents(run_table(volumes)), header, vocabulary.SIDE_PAIRS)
    assert {r.case_id: r.sides for r in got.collect()} == {
        "ras": "ok", "lps": "kidney_left is not left of kidney_right", "none": "ok"}


def test_tolerance_follows_the_second_operand(header_table):
    shift = lambda x: np.array([[1, 0, 0, x], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1.0]])
    grid = lambda x, shape=(4, 4, 4): header_table({("s", "a"): (shape, (1, 1, 1), shift(x))})
    agrees = lambda a, b, **k: geometry.grid_agreement(a, b, **k).first().agrees
    assert agrees(grid(1000.0), grid(1000.0109)) and not agrees(grid(1000.0), grid(1000.0109), rtol=0.0)
    assert not agrees(grid(0.0), grid(0.0), atol=-1.0) and not agrees(grid(0.0), grid(0.0, (4, 4, 5)))


def test_unreadable_case_is_not_judged(run_table, header_table):
    runs = run_table({("s", n, "adrenal_left"): _block(KEEP) for n in ("good", "bad")})
    header = header_table({("s", n): (GRID, (1, 1, 1), None) for n in ("good", "bad")}).withColumn(
        "error", F.when(F.col("case_id") == "bad", "broken file").otherwise(""))
    sizes = components.component_sizes(components.label_components(runs))
    touch = geometry.edge_touch(geometry.extents(runs), header)
    decisions = cohort.gland_decisions(cohort.component_profile(sizes), touch, header)
    sides = header.select("source", "case_id", F.lit("ok").alias("sides"))
    got = {r.case_id: r for r in cohort.case_outcome(decisions, sides, header).collect()}
    assert (got["bad"].scan, got["bad"].adrenal_left, got["bad"].adrenal_left_components) == ("error", None, None)
    assert (got["good"].scan, got["good"].adrenal_left) == ("kept_with_adrenal", "keep")


def test_swap_gate_sees_permuted_axes(run_table, header_table):
    """World x runs along array y, once in each direction; only the scan whose left organ lies right counts."""
    low, high = _block(((2, 5), (2, 5), (2, 5))), _block(((2, 5), (20, 23), (2, 5)))
    permuted = [[0, 1, 0, 0], [1, 0, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]
    flipped = [[0, -1, 0, 29], [1, 0, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]
    masks = {"right order": (low, high, permuted), "swapped": (high, low, permuted), "flipped": (low, high, flipped)}
    runs = run_table({("s", n, o): m for n, (left, right, _) in masks.items() for o, m in (("l", left), ("r", right))})
    header = header_table({("s", n): (GRID, (1, 1, 1), a) for n, (_, _, a) in masks.items()})
    got = geometry.swap_gate(geometry.extents(runs), header, "l", "r", ["case_id"]).collect()
    assert {r.case_id: r.swapped for r in got} == {"right order": 0, "swapped": 1, "flipped": 1}
