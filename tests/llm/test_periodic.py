"""Periodic runs against brute force: random sequences, nulls, empty and long texts, repeated ids, the planted query."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from runvox.llm import periodic
from runvox.llm.queries import QUERIES, with_planted_runs

SF = "/root/testdata/sf0.001"


def brute(w, exponent=4, least=6):
    """(start, length, period) of all runs, by comparing words one period apart."""
    number = {x: k for k, x in enumerate(dict.fromkeys(w))}
    w = np.array([number[x] for x in w])
    out = []
    for q in range(1, len(w) // exponent + 1):
        edges = np.flatnonzero(np.diff(w[q:] == w[:-q], prepend=False, append=False))
        for s, e in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True):
            n = e - s + q
            if n >= max(least, exponent * q) and not any((w[s + r:s + n] == w[s:s + n - r]).all() for r in range(1, q)):
                out.append((s, n, q))
    return sorted(out, key=lambda x: (x[0], x[2]))


def planted(i, w):
    h = zlib.crc32(str(i).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]


@pytest.mark.parametrize(("exponent", "least"), [(4, 6), (5, 12)])
def test_runs_of_random_sequences(exponent, least):
    rnd = random.Random(1)
    for _ in range(1500):
        n = rnd.randrange(1, 70)
        w = [rnd.randrange(rnd.choice([1, 2, 2, 3, 5])) for _ in range(n)]
        if rnd.random() < 0.7:
            a = rnd.randrange(n)
            p = 1 + (n - a) // rnd.randrange(3, 11)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        got = list(zip(*(x.tolist() for x in periodic.runs_of(np.array([*w, 99]), exponent, least)), strict=True))
        assert got == brute(w, exponent, least)


def test_every_period_at_its_least_length():
    """A run of exactly four periods (six words for period 1), at every offset to the blocks."""
    for q in range(1, 40):
        for shift in range(0, 70, 3):
            w = [1000 + i for i in range(shift)] + [i % q for i in range(max(6, 4 * q))] + [2000, 2001]
            got = list(zip(*(x.tolist() for x in periodic.runs_of(np.array(w))), strict=True))
            assert got == [(shift, max(6, 4 * q), q)]


def test_lower_exponents_are_refused():
    with pytest.raises(ValueError, match="4 periods"):
        periodic.runs_of(np.arange(3), exponent=3)


def test_wavelet_order_statistics():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 100):
        values = rng.permutation(n)
        tree = periodic.Wavelet(values)
        lo = rng.integers(0, n, 200)
        hi = np.minimum(n, lo + 1 + rng.integers(0, n, 200))
        x, k = rng.integers(0, n, 200), rng.integers(0, n, 200) % (hi - lo)
        assert tree.below(lo, hi, x).tolist() == [int((values[a:b] < v).sum()) for a, b, v in zip(lo, hi, x, strict=True)]
        assert tree.nth(lo, hi, k).tolist() == [sorted(values[a:b].tolist())[v] for a, b, v in zip(lo, hi, k, strict=True)]


def test_rows(spark):
    """Nulls, blanks, one word over and over, 1 MB of text, repeated and null ids, clashing column names."""
    long = ["x"] * 50_000 + [f"é{i}" for i in range(100_000)] + ["a", "b"] * 4
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "a\x0b a\na a a  a"), (6, " ".join(long)), (7, "a b a b a b a b c"), (7, "q"),
            (None, "A a A a A a A a"), (8, "a b a b a b a"), (9, "b a a a a a a a a b a a a a a a a a" * 4)]
    docs = spark.createDataFrame([(i, t, 1, "x", None) for i, t in rows], "doc_id long, text string, n_words int, runs string, start int")
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(docs).collect()), key=repr)
    want = []
    for i, t in rows:
        w = (t or "").split()
        runs = brute(w) if len(w) < 1000 else [(0, 50_000, 1), (150_000, 8, 2)]
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((i, len(w), runs, " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert got == sorted(want, key=repr)
    assert periodic.periodic_runs(docs.where("doc_id > 99")).count() == 0


def test_planted_texts(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 60))) for i in range(400)] + [(None, "a b"), (7, None)]
    got = {(r.doc_id, r.text) for r in with_planted_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = set()
    for i, t in rows:
        hit = i is not None and t and zlib.crc32(str(i).encode()) % 10 == 0
        want.add((i, " ".join(planted(i, t.split())) if hit else t))
    assert got == want


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert set(got) == set(docs)
    some = 0
    for i, t in docs.items():
        w = planted(i, (t or "").encode().split())
        runs = brute(w)
        some += bool(runs)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None, None, None)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()
    assert some > 5


def test_result_types(spark):
    kinds = dict(QUERIES["op11_periodic_runs"](spark, SF).dtypes)
    assert kinds == {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint",
                     "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"}
