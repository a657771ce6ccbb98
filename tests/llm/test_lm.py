"""Language-model scores against a brute-force model with exact dictionaries."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from runvox.llm import lm
from runvox.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, held, order, mass):
    """[(n_tokens, n_known, train_tokens, base, score)] with quantised counts, but without false positives."""
    def tokens(t):
        return [*(t or "").encode().lower().split(), "end"]
    words, grams = Counter(), Counter()
    for i, t in rows:
        if not held(i):
            w = ["start"] * (order - 1) + tokens(t)
            words.update(w[order - 1:])
            for k in range(1, order + 1):
                for e in range(order - 1 if k == order else order - 2, len(w)):
                    if e >= 0:
                        grams[tuple(w[e - k + 1:e + 1])] += 1
    n, v = sum(words.values()), len(words)

    def seen(g):
        return lm.COUNT_OF[int(lm.level_of(np.array([grams[g]]))[0])] if grams[g] else 0.0
    out = []
    for _, t in rows:
        w = ["start"] * (order - 1) + tokens(t)
        score = 0.0
        for e in range(order - 1, len(w)):
            p = (seen((w[e],)) + 1) / (n + v + 1)
            for k in range(2, order + 1):
                history = seen(tuple(w[e - k + 1:e]))
                p = (min(seen(tuple(w[e - k + 1:e + 1])), history) + mass * p) / (history + mass)
            score += math.log10(min(p, 1.0))
        own = w[order - 1:]
        base = sum(math.log10((words[x] + 1) / (n + v + 1)) for x in own)
        out.append((len(own), sum(words[x] > 0 for x in own), n, base, score))
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    vocabulary = [f"w{i}" if i % 5 else f"É{i}!" for i in range(60)]
    out = [(i, " \n\x0b"[i % 3].join(rnd.choice(vocabulary[:rnd.choice([3, 10, 60])]) for _ in range(rnd.choice([1, 4, 40, 200])))) for i in range(150)]
    out += [(200, None), (201, ""), (202, " \t"), (203, "W1 w1 É5!"), (204, "never seen"), (3, "again w1"), (None, "w1 w2"), (None, None), (205, "w1 " * 40_000)]
    return out


@pytest.mark.parametrize(("order", "broadcast"), [(1, 1 << 20), (2, 1 << 20), (2, 0), (3, 0)])
def test_scores(spark, rows, monkeypatch, order, broadcast):
    """Many probes leave no false positive; small slices and shards make several of each; both ways of probing."""
    monkeypatch.setattr(lm, "SHARD_BYTES", 60_000)
    monkeypatch.setattr(lm, "SLICE_BYTES", 5_000)

    def held(i):
        return i is not None and i % 4 == 1
    docs = spark.createDataFrame([(i, t, 1.0, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, score double, slice int")
    got = lm.scored(docs, F.col("doc_id") % 4 == 1, order=order, mass=3.0, probes=30, most_broadcast=broadcast).collect()
    want = brute(rows, held, order, 3.0)
    def near(x):
        return tuple(round(v, 6) if isinstance(v, float) else v for v in x)
    assert Counter((r.doc_id, r.held_out, *near((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score))) for r in got) == Counter(
        (i, held(i), *near(w)) for (i, _), w in zip(rows, want, strict=True))


def test_shards_without_repeated_or_single_sequences(spark):
    """A slice may have no sequence that occurs once, or none that occurs more often."""
    for kind in ("<u4", "<u8"):
        assert lm._planes(np.zeros(0, np.uint64), kind) == b"" and len(lm._unplaned(b"", kind)) == 0
    for texts in (["a b c d e f g"], ["a b c"] * 3):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = lm.scored(docs, F.lit(False), order=2, mass=3.0, probes=30).collect()
        want = brute(list(enumerate(texts)), lambda i: False, 2, 3.0)
        assert sorted(round(r.score, 6) for r in got) == sorted(round(w[-1], 6) for w in want)


def test_levels():
    counts = np.array([1, 2, 3, 4, 5, 6, 100, 10**9])
    levels = lm.level_of(counts)
    assert (np.diff(levels) >= 0).all() and levels[0] == 1
    assert (np.abs(lm.COUNT_OF[levels] - counts) <= 0.26 * counts).all()


def test_filter_keeps_levels_and_rarely_errs():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 32, 40_000, dtype=np.uint64))
    levels = rng.integers(1, 5, len(keys))
    field = lm.filled(keys, levels, 8)
    got = lm.probed(keys, field, 8)
    assert (got >= levels).all() and (got > levels).mean() < 0.012
    others = np.setdiff1d(rng.integers(0, 1 << 32, 40_000, dtype=np.uint64), keys)
    assert (lm.probed(others, field, 8) > 0).mean() < 0.008
    assert len(field) * 8 < 12 * levels.sum()


def test_no_training_text_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.scored(docs, F.lit(True)).collect()}
    assert got[1].n_known == got[1].train_tokens == 0 and got[1].base_score == 0.0 and got[2].n_tokens == 1
    assert lm.scored(docs.where("doc_id > 9"), F.lit(False)).count() == 0


def test_query(spark):
    """Exact base scores; the model tells held-out texts better than single words do."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in QUERIES["op13_lm_scoring"](spark, SF).collect()}
    want = brute(docs, lambda i: zlib.crc32(str(i).encode()) % 7 == 2, 2, lm.MASS)
    assert len(got) == len(docs)
    for (i, _), (n, known, train, base, score) in zip(docs, want, strict=True):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, n, known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=0.02) and r.score <= 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
