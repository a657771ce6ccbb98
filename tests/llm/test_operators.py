"""The training-data operators against brute force on small tables with nulls, empty texts, ties and repeated rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from runvox.llm import chat, covertree, minhash, mixing, packing, quality, substrings, toxicity, urlfilter, warc
from runvox.llm.queries import TOKENIZER, marked_conversation

DOCS = "doc_id long, text string, source string, rank int"


@pytest.fixture(scope="module")
def texts():
    """{id: text}: random words, near and exact copies, shared passages, short, empty and null ones."""
    rnd = random.Random(3)
    vocabulary = [f"w{i}" if i % 7 else f"É{i}!" for i in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(70)]
    out: dict[int, str | None] = {}
    for i in range(120):
        words = [rnd.choice(vocabulary) for _ in range(rnd.choice([1, 5, 40, 120, 300]))]
        if i % 5 == 0:
            at = rnd.randrange(len(words) + 1)
            words[at:at] = passage
        out[i] = " \n"[i % 2].join(words)
    for i in range(120, 180):
        words = (out[rnd.randrange(3)] or "").split() if i % 2 else out[10].split()
        for _ in range(rnd.randrange(4)):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        out[i] = " ".join(words)
    out |= {200: None, 201: "", 202: " \t\n", 203: "one", 204: "ONE", 205: "one two", 206: out[10], 207: out[10].upper()}
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if i % 11 == 0 else f"s{i % 3}", i) for i, t in texts.items()]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return (t or "").encode().split()


def roots(ids, pairs):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("shingle", "percent"), [(3, 85), (5, 80)])
def test_minhash(docs, texts, shingle, percent):
    sets = {}
    for i, t in texts.items():
        w = [x.lower() for x in words(t)]
        sets[i] = {tuple(w[k:k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set()
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = roots(sets, pairs)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, shingle, percent).collect()}
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


@pytest.mark.parametrize(("shingle", "percent"), [(5, 80), (3, 85)])
def test_minhash_meets_at_every_small_size(spark, shingle, percent):
    """Sets of 1 to 40 shingles and the same text with words added behind or in front, up to and beyond the threshold."""
    rows, family = [], {}
    for n in range(1, 41):
        for k in range(6):
            base = [f"{n}.{k}.{j}" for j in range(n + shingle - 1)]
            more = [f"x{j}.{n}.{k}" for j in range(n // 4 + 1)]
            for extra in ([], more[:1], more[:-1], more):
                family[len(rows)] = (n, k)
                rows.append((len(rows), " ".join(base + extra if k % 2 else extra + base), "s", 0))
    sets = {i: {tuple(t.split()[j:j + shingle]) for j in range(len(t.split()) - shingle + 1)} for i, t, _, _ in rows}
    pairs = [(a, b) for a in sets for b in range(a + 1, a + 4) if family.get(b) == family[a]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS), shingle, percent).collect()}
    assert got == roots(sets, pairs)


def test_minhash_refuses_thresholds_that_its_lists_do_not_hold_for(docs):
    with pytest.raises(ValueError, match="80 percent"):
        minhash.near_duplicates(docs, 5, 79)


def test_minhash_crowded_list(spark):
    """A list with more documents than a block, whose members differ from the first one too much to link with it."""
    rnd = random.Random(1)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(420):
        w = list(base)
        for _ in range(rnd.randrange(1, 9)):
            w[rnd.randrange(100)] = f"x{rnd.randrange(40)}"
        rows.append((i, " ".join(w), "s", 0))
    sets = {i: {tuple(t.split()[k:k + 3]) for k in range(98)} for i, t, _, _ in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = roots(sets, pairs)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS), 3, 85).collect()}
    assert got == want


def test_minhash_five_thousand_near_copies(spark):
    """One list of 5,000 copies with up to 12 changed words each: most are just below the threshold to most others."""
    rnd = random.Random(8)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(5000):
        w = list(base)
        for _ in range(rnd.randrange(1, 13)):
            w[rnd.randrange(100)] = f"x{rnd.randrange(30)}"
        rows.append((i, " ".join(w), "s", 0))
    codes: dict = {}
    sets = [sorted({codes.setdefault(tuple(t.split()[k:k + 3]), len(codes)) for k in range(98)}) for _, t, _, _ in rows]
    held = np.bincount(np.concatenate(sets), minlength=len(codes))
    place = np.full(len(codes), -1)
    place[held > 1] = np.arange((held > 1).sum())
    have = np.zeros((5000, int((held > 1).sum())), np.float32)
    for i, x in enumerate(sets):
        have[i, [p for p in place[x] if p >= 0]] = 1
    size = np.array([len(x) for x in sets])
    pairs = []
    for a in range(0, 5000, 500):
        common = have[a:a + 500] @ have.T
        both = size[a:a + 500, None] + size - common
        x, y = np.nonzero(100 * common >= 85 * both)
        pairs += zip((x + a).tolist(), y.tolist(), strict=True)
    want = roots(range(5000), pairs)
    assert 50 < len(set(want.values())) < 4950
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS), 3, 85).collect()}
    assert got == want


@pytest.mark.parametrize("block", [4096, 50])
def test_members_of_a_leader_meet_across_blocks(spark, monkeypatch, block):
    """However members are dealt into blocks, the same links are found."""
    monkeypatch.setattr(minhash, "BLOCK_DOCS", block)
    rnd = random.Random(11)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rnd.randrange(2, 7)):
            w[rnd.randrange(60)] = f"x{rnd.randrange(12)}"
        rows.append((i, " ".join(w), "s", 0))
    sets = {i: {tuple(t.split()[k:k + 3]) for k in range(58)} for i, t, _, _ in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS), 3, 85).collect()}
    assert got == roots(sets, pairs)


def test_clashing_names_in_dedup_stages(spark):
    """Columns may bear the names the stages use for themselves."""
    words50 = " ".join(f"p{j}" for j in range(60))
    rows = [(i, f"q{i} {words50}" if i < 4 else f"r{i} s t u v w", "s", -1, "x", "y", 5, 6) for i in range(8)]
    names = "doc_id long, text string, source string, _row int, spans string, _gone string, row int, doc int"
    table = spark.createDataFrame(rows, names)
    cut = substrings.without_repeats(table).collect()
    assert {tuple(r)[3:] for r in cut} == {(-1, "x", "y", 5, 6)} and sum(len(r.text.split()) for r in cut) == 61 + 3 + 4 * 6
    left = minhash.one_of_each_group(table).collect()
    assert {tuple(r)[3:] for r in left} == {(-1, "x", "y", 5, 6)} and sorted(r.doc_id for r in left) == [0, 4, 5, 6, 7]


def repeats(texts, width=50):
    first: dict = {}
    out = {}
    for i in sorted(texts):
        w = words(texts[i])
        seen = [tuple(w[k:k + width]) for k in range(len(w) - width + 1)]
        gone = {k + j for k, s in enumerate(seen) if first.get(s, i) < i for j in range(width)}
        for s in seen:
            first.setdefault(s, i)
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("bucket", [1000, 3])
def test_substrings(docs, texts, monkeypatch, bucket):
    monkeypatch.setattr(substrings, "BUCKET", bucket)  # small buckets: every minimiser is salted
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.repeated_words(docs).collect()}
    want = repeats(texts)
    assert got == want
    cut = {r.doc_id: r for r in substrings.without_repeats(docs).collect()}
    assert {i: len(words(r.text)) for i, r in cut.items()} == {i: n - g for i, (n, g, _) in want.items()}
    assert cut[3].rank == 3


def test_substrings_of_rows_that_repeat_an_id(spark):
    """Every row loses what its own text repeats of smaller ids, whatever other rows of its id hold."""
    passage = [f"p{j}" for j in range(60)]
    rows = [(1, passage), (2, [f"a{j}" for j in range(90)] + passage), (2, ["b"] * 5), (2, [f"c{j}" for j in range(150)]),
            (2, passage[:55]), (2, [f"d{j}" for j in range(95)] + passage[:55]), (None, passage)]
    table = spark.createDataFrame([(i, " ".join(w), "s", k) for k, (i, w) in enumerate(rows)], DOCS)
    kept = [rows[0][1], rows[1][1][:90], rows[2][1], rows[3][1], [], rows[5][1][:95], passage]
    assert {r.rank: r.text for r in substrings.without_repeats(table).collect()} == {k: " ".join(w) for k, w in enumerate(kept)}
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.repeated_words(table).collect())
    assert got == Counter((i, len(w), len(w) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest())
                          for (i, w), k in zip(rows, kept, strict=True))


def test_packing(spark, docs, texts):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    got = packing.packed_documents(docs, TOKENIZER, 256).collect()
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts.items()}
    want = {(i, k): (a, len(x[a:a + 256]), zlib.crc32(array("I", x[a:a + 256]).tobytes()))
            for i, x in ids.items() for k, a in enumerate(range(0, len(x), 256))}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    rows = defaultdict(list)
    for r in got:
        rows[r.sequence_id].append((r.offset, r.length))
    for parts in rows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    gaps: list[int] = []  # best-fit decreasing, to compare with
    for n in sorted((n for _, n, _ in want.values()), reverse=True):
        fit = min((g for g in gaps if g >= n), default=256)
        if fit in gaps:
            gaps.remove(fit)
        gaps.append(fit - n)
    assert len(rows) <= len(gaps)


def test_ids_of_words_are_those_of_the_text():
    ids = packing._Ids(TOKENIZER)
    for t in ("Don't stop, É! x's <|endoftext|> a<|endoftext|>.", "e\u0301\u0308 ß. İx \u0301a ΑΣ Aª, µ¹", "", " \t", "a.b... (855) Ab=\u0338"):
        words = t.encode().split()
        ids.learn(set(words))
        want = np.array(ids.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert b"".join(ids[w] for w in words) == want


def test_packing_plan_uses_every_length():
    counts = {60: 5, 45: 3, 40: 7, 30: 2, 29: 4, 11: 1, 1: 3, 100: 2}
    used = Counter()
    for times, pattern in packing.plan(counts, 100):
        assert sum(length * n for length, n in pattern) <= 100
        for length, n in pattern:
            used[length] += n * times
    assert used == counts


def test_words_are_encoded_together(monkeypatch):
    """Many plain words go to the tokenizer as one text; each gets the ids it has alone."""
    rnd = random.Random(8)
    words = {"".join(rnd.choice("abcdeßéÀÖÿøZ") for _ in range(rnd.randint(1, 14))) + rnd.choice(["", ".", ",!", "###", "</w>", "'s"]) for _ in range(3000)}
    words |= {"<|endoftext|>", "it's", "'", "x1y", "12", "e\u0301", "\u0130", "\ud55c\uae00", "a\u00a0b", "\x00", "</w>"}
    ids = packing._Ids(TOKENIZER)
    texts, encoded = [], ids._encoded
    monkeypatch.setattr(ids, "_encoded", lambda some: texts.extend(some) or encoded(some))
    ids.learn({w.encode() for w in words})
    ids.learn({w.encode() for w in words})
    alone = packing.Tokenizer.from_file(TOKENIZER)
    for w in words:
        assert np.frombuffer(ids[w.encode()], "<u4").tolist() == alone.encode(w, add_special_tokens=False).ids, w
    assert len(texts) < 0.5 * len(words)


def test_toxicity(spark):
    rnd = random.Random(5)
    rows, labels = [], []
    for i in range(900):
        w = [f"w{rnd.randrange(300)}" for _ in range(rnd.randrange(5, 120))]
        bad = i % 6 == 0
        if bad:
            w.insert(rnd.randrange(len(w)), rnd.choice(["Vile!", "viler", "vilest"]))
        rows.append((i, " ".join(w), "s", 0))
        if i % 3:
            labels.append((i, int(bad)))
        elif bad and i % 2 == 0:
            labels.append((i, 1))
    rows += [(1000, None, "s", 0), (1001, "", None, 0), (None, "vile", "s", 0), (5, rows[5][1], "s", 0)]
    label_table = spark.createDataFrame([*labels, (None, 1), (7777, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score(spark.createDataFrame(rows, DOCS), label_table).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert np.mean([r.predicted == int(r.doc_id % 6 == 0) for r in held]) > 0.97


def test_clean_judges_every_row_by_itself(spark):
    rnd = random.Random(7)
    rows = [(i, " ".join([f"w{rnd.randrange(300)}" for _ in range(40)] + ["vile"] * (i % 6 == 0)), "s", i) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i, *_ in rows], "doc_id long, toxic int")
    rows += [(None, "vile w1", "s", 600), (None, "w1 w2", "s", 601), (1, "vile w2", "s", 602), (0, "w3 w4", "s", 603)]
    kept = {r["rank"] for r in toxicity.clean(spark.createDataFrame(rows, DOCS), labels).collect()}
    assert kept == {r for i, t, _, r in rows if "vile" not in t}


@pytest.mark.parametrize("bits", [16, 24])
def test_toxic_texts_are_looked_up_by_id(spark, monkeypatch, bits):
    """The bitmap loses no id and the join lets none in wrongly; few other texts reach the join."""
    monkeypatch.setattr(toxicity, "FILTER_BITS", bits)
    docs = spark.range(-500, 20_000).selectExpr("id AS doc_id", "repeat('x', 5) AS text")
    docs = docs.unionByName(docs.where("doc_id % 1000 = 0"))
    wanted = spark.range(-600, 30_000, 50).selectExpr("id AS doc_id")
    got = toxicity._with_ids(docs, wanted.unionByName(wanted))
    want = docs.where("doc_id % 50 = 0")
    assert got.columns == ["doc_id", "text"] and got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert toxicity._with_ids(docs, wanted.limit(0)).count() == 0
    plan = toxicity._with_ids(docs, wanted)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner, (doc_id") < plan.index("_part#")  # the lookup lies below the join by id


def test_toxicity_on_the_cluster_equals_the_driver(spark, monkeypatch):
    """Gradients added up by tasks give the weights that one array gives."""
    rnd = random.Random(6)
    rows = [(i, " ".join([f"w{rnd.randrange(200)}" for _ in range(30)] + ["vile"] * (i % 7 == 0)), "s", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i, *_ in rows], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "ROUNDS", 4)
    a, b = toxicity.train(docs, labels), toxicity.train(docs, labels, local_sets=0)
    assert np.count_nonzero(a[0]) and np.allclose(a[0], b[0]) and np.isclose(a[1], b[1])


def test_non_negative_risk_learns_from_hidden_positives():
    """Unlabelled text that holds positives does not make their feature look clean."""
    positive = [np.array([1])] * 40
    unlabelled = [np.array([1])] * 100 + [np.array([2])] * 300
    w, bias = toxicity.fit(positive, unlabelled, 0.25)
    assert w[1] + bias > 0 > w[2] + bias


def test_mixing(docs, texts):
    size = {i: len(words(t)) for i, t in texts.items()}
    source = {i: None if i % 11 == 0 else f"s{i % 3}" for i in texts}
    sizes = Counter()
    for i, n in size.items():
        sizes[source[i]] += n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(names, [3, 1, 2, 3], strict=True))
    want, left, free = {}, 1.5 * sum(sizes.values()), set(names)
    while True:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not full:
            break
        for s in full:
            want[s] = 2.0 * sizes[s]
            left -= want[s]
        free -= full
    want |= {s: level * weight[s] for s in free}
    got = mixing.mix_report(docs).collect()
    assert {r.doc_id: r.size for r in got} == size
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in names:
        assert abs(taken[s] - want[s]) <= 1
    again = {r.doc_id: r.taken for r in mixing.mix_report(docs.orderBy(F.desc("doc_id"))).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    mixed = Counter()
    for r in mixing.mixed_documents(docs).collect():
        mixed[r.doc_id] += len(words(r.text))
    assert mixed == Counter({r.doc_id: r.taken for r in got if r.taken})


def test_mixing_of_rows_without_or_with_repeated_ids(spark):
    """Every source reaches its target, and each row gives the words that the mix takes from it."""
    rows = [(None if k % 4 == 0 else k // 3, " ".join(f"r{k}.{j}" for j in range(30 + k)), f"s{k % 2}", k) for k in range(60)]
    table = spark.createDataFrame(rows, DOCS)
    report = mixing.mix_report(table).collect()
    want = {len(words(rows[r.size - 30][1])): r.taken for r in report}
    taken, total = Counter(), Counter()
    for r in mixing.mixed_documents(table).collect():
        n, own = len(words(r.text)), set(words(rows[r["rank"]][1]))
        assert set(words(r.text)) <= own and r.doc_id == rows[r["rank"]][0]
        taken[30 + r["rank"]] += n
        total[r.source] += n
    assert taken == Counter({size: n for size, n in want.items() if n})
    targets = {f"s{r.size % 2}": r.target for r in report}
    assert all(abs(total[s] - t) <= 1 for s, t in targets.items())
    again = Counter((r["rank"], r.text) for r in mixing.mixed_documents(table.orderBy(F.desc("rank"))).collect())
    assert again == Counter((r["rank"], r.text) for r in mixing.mixed_documents(table).collect())


def test_shards_draw_their_sources():
    """Every shard but the last is full, sources get just what they need, and a shard is the same drawn alone."""
    need = np.array([700, 0, 41, 1259])
    parts = list(mixing.drawn(need, 64, 3, 0, 10**6))
    assert [k for k, _, _ in parts] == list(range(32)) and all(c.sum() == 64 for _, _, c in parts[:-1])
    assert (sum(c for _, _, c in parts) == need).all()
    done = np.zeros(4, int)
    for k, before, counts in parts:
        assert (before == done).all()
        done = done + counts
        (alone, again, same), = mixing.drawn(need, 64, 3, k, k + 1)
        assert alone == k and (again == before).all() and (same == counts).all()
    assert len({tuple(c) for _, _, c in parts[:-1]}) > 5
    huge = np.array([3 * 10**11, 10**11 + 7])
    _, _, counts = next(mixing.drawn(huge, 4096, 0, 0, 1))
    assert counts.sum() == 4096 and abs(counts[0] - 3072) < 200
    assert not list(mixing.drawn(np.zeros(2, int), 64, 0, 0, 5))


def test_clashing_names_in_the_mix(spark):
    rows = [(i, f"w{i} x y z", f"s{i % 2}", -1, "keep", 7) for i in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, _row int, copies string, place int")
    out = mixing.mixed_documents(table).collect()
    assert out and {(r["_row"], r["copies"], r["place"]) for r in out} == {(-1, "keep", 7)}


def test_permutation():
    for n in (1, 2, 3, 17, 100, 1025):
        x = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 9, np.uint64))
        assert sorted(x.tolist()) == list(range(n))


def test_warc(spark):
    long = "x" * 999 + "é"
    rows = [(1, "http://a/\r\nb", long, 0), (2, None, long, 0), (3, "u", long, 0), (3, "u", long, 0), (4, "u", "short", 0),
            (5, "u", "short", 0), (6, "u", None, 0), (7, "u", "", 0), (None, "u", long, 0), (8, "u", "WARC/1.1\r\n\r\nContent-Length: 3", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, header int")
    got = warc.archive_and_read(pages).collect()
    want = Counter()
    for p, _, h, _ in rows:
        b = (h or "").encode()
        again = len(b) >= 1000 and p != 3
        want[(p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", 3 if again else None)] += 1
    assert Counter(tuple(r) for r in got) == want
    assert warc.archive_and_read(pages.where("page_id > 99")).count() == 0


def test_quality(docs, texts):
    got = {r.doc_id: r for r in quality.report(docs).collect()}
    for i, t in texts.items():
        t = t or ""
        w = [x.decode() for x in words(t)]
        seen = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        twice = {k + j for k in range(len(w) - 7) if seen[tuple(w[k:k + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(twice))
        assert r.base_failed == (len(w) < 20 or 100 * len(twice) > 30 * len(w)) and not (r.base_failed and r.kept)


def test_repeated_windows(spark):
    unit = "a b c d e f g h i j"
    rows = [(0, " ".join([unit] * 4), "s", 0), (1, " ".join(["a"] * 9), "s", 0), (2, f"{unit} x {unit}", "s", 0)]
    got = {r.doc_id: r.n_repeat_words for r in quality.report(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {0: 40, 1: 9, 2: 20}


def test_cascade_order_and_verdict(spark):
    rows = spark.range(200).selectExpr("id", "id % 10 AS v")
    rules = [quality.Rule("rare", F.col("v") > 8), quality.Rule("often", F.col("v") < 7), quality.Rule("null", F.lit(None).cast("boolean"))]
    chain = quality.ordered(rows, rules)
    assert chain[0].name == "often" and chain[-1].name == "null"
    kept = rows.select("id", quality.verdict(chain).alias("k")).where("k").count()
    assert kept == 40


def test_chat(spark):
    rnd = random.Random(2)
    rows = []
    for c in range(40):
        for t in range(rnd.randrange(1, 40)):
            role = "system" if t == 0 and c % 3 == 0 else ["user", "assistant"][t % 2]
            rows.append((c, t, role, " ".join(rnd.choice(["a", "</turn>", "###", "\\h", "é", "\n"]) for _ in range(rnd.choice([0, 3, 30, 200])))))
    rows += [(50, 0, "system", "alone"), (51, None, None, None), (51, 0, "assistant", "same"), (51, 0, "assistant", "same"), (None, 1, "assistant", "x: y")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").unionByName(marked_conversation(spark))
    got = {r.conv_id: r for r in chat.digests(turns, budget=120, history=30).collect()}
    groups = defaultdict(list)
    for c, t, r, x in [*rows, (-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]:
        groups[c].append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(groups)
    for c, g in groups.items():
        g.sort()
        loss = "".join(x for *_, r, x in g if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for *_, r, x in g)
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (
            len(g), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    windows = chat.formatted(turns, budget=120, history=30).collect()
    assert all(w.text.startswith("### system: ") for w in windows if w.conv_id is not None and w.conv_id < 40 and w.conv_id % 3 == 0
               and len(groups[w.conv_id]) > 1)
    assert any(w.repeated for w in windows)


def test_covertree(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        x = rng.normal(size=8)
        rows.append((i, x.tolist(), i % 3))
        if i % 4 == 0:
            rows += [(1000 * k + i, (x * k + rng.normal(scale=0.06, size=8)).tolist(), i % 3) for k in (1, 2)]
    rows += [(5000, rows[0][1], 0), (5001, rows[0][1], 0), (5002, None, 0), (5003, [0.0] * 8, 0), (5004, [float("nan")] * 8, 0),
             (5005, rows[0][1], None), (5006, rows[0][1][:3], 0), (5007, [None] * 8, 0), (5008, [], 1)]
    rows = list({r[0]: r for r in rows}.values())
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    good = {i: np.array(v) for i, v, k in rows if v and k is not None and all(e is not None and np.isfinite(e) for e in v) and any(v)}
    label = {i: k for i, _, k in rows}
    pairs = [(a, b) for a in good for b in good if a < b and label[a] == label[b] and len(good[a]) == len(good[b])
             and good[a] @ good[b] / np.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) >= 0.98]
    want, links = roots(label, pairs), Counter(x for p in pairs for x in p)
    for block in (2048, 40):
        covertree.BLOCK = block
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in covertree.near_duplicates(table).collect()}
        assert got == {i: (links[i], want[i], want[i] == i) for i in label}
    covertree.BLOCK = 2048


def test_url_filter(spark):
    captures = spark.createDataFrame(
        [(1, "http://a.b.com/x/y", 10), (2, "http://a.b.com/x/y", 20), (3, "https://b.com", 10), (4, None, 10), (5, "http://a.b.com", None),
         (6, "not a url", 10), (7, "http://B.COM:80/", 300), (7, "http://B.COM:80/", 300)], "page_id long, url string, fetched int")
    entries = spark.createDataFrame(
        [("block", "b.com", "add", 5), ("block", "b.com", "remove", 15), ("block", "b.com", "add", 290), ("allow", "a.b.com/x", "add", 12),
         ("block", "a.b.com", "add", 20), ("block", "a.b.com", "remove", 20), (None, "b.com", "add", 0), ("block", "b.com", "other", 16)],
        "list string, key string, action string, at int")
    got = sorted((r.page_id, r.n_block, r.n_allow, r.blocked) for r in urlfilter.judged(captures, entries, 1000).collect())
    assert got == [(1, 1, 0, True), (2, 0, 1, False), (3, 1, 0, True), (4, 0, 0, False), (5, 0, 0, False), (6, 0, 0, False),
                   (7, 1, 0, True), (7, 1, 0, True)]


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert minhash.near_duplicates(empty).count() == 0
    assert substrings.repeated_words(empty).count() == 0
    assert packing.packed_documents(empty, TOKENIZER).count() == 0
    assert toxicity.score(empty, labels).count() == 0
    assert mixing.mix_report(empty).count() == 0
    assert quality.report(empty).count() == 0
    assert chat.digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert covertree.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_pipeline_stages(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "substring_dedup", "mixing_sources", "best_fit_packing"]
    sf_dir = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = rows
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, sf_dir)
        assert out.columns == rows.columns
    assert corpus_pipeline.STAGES[-1][1](spark, out, sf_dir).count() >= out.count()


def test_words_are_learnt_many_at_a_time_as_they_are_encoded_alone():
    import os
    from runvox.llm import packing, queries
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    words = "ÿÀÉ a×b, ß!! foo-bar, it's, 12 <|endoftext|> ok.. ,, ' İx Plain plain. PLAIN!? x\x1cy z\xa0a, q\u2028r".split(" ")
    ids = packing._Ids(queries.TOKENIZER)
    calls = []
    alone = ids._single
    ids._single = lambda texts: (calls.append(len(texts)), alone(texts))
    ids.learn({w.encode() for w in words})
    ids.learn(set())
    ids.learn({w.encode() for w in words})
    for w in words:
        assert ids[w.encode()] == np.array(ids.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes(), w
    assert sum(calls) < len(words)


def test_pipeline_stages_get_texts_in_batches_bounded_by_bytes(spark):
    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('a long text ', 1000) AS text")
    try:
        stage = corpus_pipeline.in_small_batches(lambda spark, docs, sf_dir: docs.mapInArrow(sizes, "n long"))
        got = [r.n for r in stage(spark, docs, "").collect()]
    finally:
        spark.conf.set(key, before)
    assert len(got) > 5 and max(got) <= corpus_pipeline.BATCH_BYTES + (1 << 16)
    assert all(hasattr(stage, "__wrapped__") for _, stage in corpus_pipeline.STAGES)
