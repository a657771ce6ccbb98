"""Near-duplicate documents by bottom-k sketches of one hash function.

Every document's set of word shingles is hashed once; its ``k`` smallest values are its sketch. Inverted lists of
retained values bring documents together, the union of two sketches estimates their similarity, and whole texts
decide. Documents with equal sets are one node, so copies never meet each other.

A list stands for a run of neighbouring retained values rather than one value: a passage that thousands of documents
share then opens few lists unless it fills most of a document. Similar documents share several runs, so each document
leaves out its longest lists, as in prefix filtering. One value that only one of two sets has breaks up to three runs,
too many for sets of up to six shingles; these open lists of single values. At a similarity of 0.8 or more, sets of up to
``SKETCH`` shingles (which are retained whole) always meet; larger ones miss each other with a probability below 1e-5 at
0.8 and 1e-7 at 0.85. Lower thresholds are refused: the run lengths don't hold for them.

Only components are wanted, so a large group of similar documents needs no list of all its pairs: in each list one
leader meets the others, and links contract the graph. What is left are pairs of documents of one list in different
components. Shingles that no other of these documents has bound the similarity of every pair from above, which sets
aside the many members of a group that differ too much from all others. The rest is told by what it gains and loses
against its leader: two documents differ in exactly the shingles in which their differences differ. So a group's members
travel once, as short lists of differences; sizes of gains, losses and unshared shingles rule out most pairs, and all
others are decided exactly by their differences, with no text moved again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runvox.llm.words import SLICE_BYTES, Words, binary, grouped, lists, longs, packed, shingles, slices, unpacked
from runvox.operators.components import connected
from runvox.scale import materialise

SKETCH = 64
LEAST_PERCENT = 80
#: (from size, to size, run, spare): sets in this range open a list per ``run`` neighbouring values; similar ones share
#: more than ``spare`` of them (None: as many as the threshold lets a set leave out). Every two similar sets are in one
#: range that holds for them: with ``x`` values in one set only, a union of ``u`` leaves ``u - x - (x + 1) * (run - 1)``
#: common runs at least, which is 2 or more for run 3 from u = 7 on and for run 4 from u = 25 on. Different sets with a
#: smaller union have 4 to 6 values.
RUNS = ((4, 6, 1, None), (6, 36, 3, 1), (25, None, 4, 1))
#: Documents that share lists get longer sketches. Pairs whose union sketch has a share of common values this far below
#: the threshold are not compared in full; a pair at the threshold falls there with a probability of about 1e-6.
LONG_SKETCH, SLACK = 256, 0.12
#: Members of a leader meet in blocks of about this many documents and differing shingles.
BLOCK_DOCS, BLOCK_VALUES = 4096, 1 << 20


def _raw(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A column of compressed texts as they were."""
    return [unpacked(t) for t in batch.column(name).to_pylist()]


def _compressed(docs: DataFrame) -> DataFrame:
    """(doc, text): texts that are compared travel compressed, two of them per pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array([packed(t) for t in binary(batch, "text")], pa.binary())], ["doc", "text"])

    return docs.select("doc", "text").mapInArrow(run, "doc long, text binary")


def sketches(docs: DataFrame, shingle: int, k: int = SKETCH, text: str = "text", key: str = "doc_id", compressed: bool = False) -> DataFrame:
    """(doc, n, digest, sketch) per row: set size, digest of the whole set, its ``k`` smallest hashes in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _raw(batch, "text") if compressed else binary(batch, "text")
            counts, digests, heads = [], [], []
            for a, b in slices(texts):
                words = Words([t and t.lower() for t in texts[a:b]])
                h = words.hashes()
                for i in range(b - a):
                    s = shingles(words, i, h, shingle)
                    counts.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    heads.append(s[:k])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()),
                 lists(heads, pa.int64())], ["doc", "n", "digest", "sketch"])

    return docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(
        run, "doc long, n long, digest binary, sketch array<long>")


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    """Sets whose sizes are too far apart can't reach the threshold."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def estimated(pairs: DataFrame, nodes: DataFrame, least: float, k: int = LONG_SKETCH) -> DataFrame:
    """The pairs (a, b) whose union sketch holds at least ``least`` values that both sketches have."""

    def fill(column: pa.ListArray, into: np.ndarray) -> None:
        sizes = np.diff(column.offsets.to_numpy())
        rows = np.repeat(np.arange(len(sizes)), sizes)
        places = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        into[rows, places] = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            top = np.iinfo(np.uint64).max
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                both = np.full((part.num_rows, 2 * k + 1), top, np.uint64)
                fill(part.column("sa"), both[:, :k])
                fill(part.column("sb"), both[:, k:2 * k])
                both.sort(axis=1)
                used = both[:, :-1] != top
                twice = (both[:, 1:] == both[:, :-1]) & used
                rank = np.cumsum(used & ~twice, axis=1, dtype=np.int32)
                size = np.minimum(rank[:, -1], k)
                shared = (twice & (rank < k)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(
                    pa.array(shared >= least * size))

    side = nodes.select("doc", "sketch")
    return (pairs.select("a", "b").join(side.toDF("b", "sb"), "b").join(side.toDF("a", "sa"), "a")
            .select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"))


def _sets_of_pairs(batch: pa.RecordBatch, shingle: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, a's set, b's set) for the rows (a, b, ta, tb) of a batch; a text that repeats in a slice is worked off once."""
    left, right = batch.column("a").to_pylist(), batch.column("b").to_pylist()
    ta, tb = batch.column("ta").to_pylist(), batch.column("tb").to_pylist()
    for lo, hi in slices([x + y for x, y in zip(ta, tb, strict=True)], SLICE_BYTES // 4):
        own: dict[int, int] = {}
        both: list[bytes] = []
        for i in range(lo, hi):
            for d, t in ((left[i], ta[i]), (right[i], tb[i])):
                if d not in own:
                    own[d] = len(both)
                    both.append(unpacked(t).lower())
        words = Words(both)
        h = words.hashes()
        sets = [shingles(words, j, h, shingle) for j in range(len(both))]
        for i in range(lo, hi):
            yield i, sets[own[left[i]]], sets[own[right[i]]]


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    return pairs.join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta"), "a").select("a", "b", "ta", "tb")


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, x, y in _sets_of_pairs(batch, shingle):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = common and 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return _with_texts(pairs, texts).mapInArrow(run, "a long, b long")


def _differences(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b, linked, gained, lost, differ): how many shingles only b has and only a has, and which these are, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, gained, lost, differ = [], [], [], []
            for _, x, y in _sets_of_pairs(batch, shingle):
                d = np.setxor1d(x, y, assume_unique=True)
                common = (len(x) + len(y) - len(d)) // 2
                linked.append(common > 0 and 100 * common >= percent * (common + len(d)))
                gained.append(len(y) - common)
                lost.append(len(x) - common)
                differ.append(d.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_()), pa.array(gained, pa.int64()), pa.array(lost, pa.int64()),
                 pa.array(differ, pa.binary())], ["a", "b", "linked", "gained", "lost", "differ"])

    return _with_texts(pairs, texts).mapInArrow(run, "a long, b long, linked boolean, gained long, lost long, differ binary")


def _labelled(entries: DataFrame, edges: DataFrame | None) -> DataFrame:
    """The entries with the component each document has so far."""
    if edges is None:
        return entries.withColumn("comp", F.col("doc"))
    roots = connected(edges, []).select(F.col("node").alias("doc"), "root")
    return entries.join(roots, "doc", "left").withColumn("comp", F.coalesce("root", "doc")).drop("root")


def _open(entries: DataFrame) -> DataFrame:
    """The lists that still hold documents of different components."""
    span = entries.groupBy("list").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo < _hi")
    return entries.join(span.select("list"), "list", "left_semi")


def _unshared(ids: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(doc, alone): how many shingles of each document none of the others has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _raw(batch, "text")
            doc = batch.column("doc").to_numpy()
            for a, b in slices(texts):
                words = Words([t.lower() for t in texts[a:b]])
                h = words.hashes()
                sets = [shingles(words, i, h, shingle) for i in range(b - a)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(doc[a:b], [len(s) for s in sets])), longs(np.concatenate(sets))], ["doc", "s"])

    held = texts.join(ids, "doc", "left_semi").select("doc", "text").mapInArrow(run, "doc long, s long")
    return (held.groupBy("s").agg(F.count(F.lit(1)).alias("held"), F.min("doc").alias("doc")).where("held = 1")
            .groupBy("doc").agg(F.count(F.lit(1)).alias("alone")))


def links(nodes: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b): links enough to connect all nodes that a chain of pairs at the threshold connects.

    ``nodes``: (doc, n, sketch), distinct sets; ``docs``: (doc, text).
    """
    if percent < LEAST_PERCENT:
        raise ValueError(f"similar sets surely meet from {LEAST_PERCENT} percent on, not at {percent}")
    parts = []
    for low, high, run, spare in RUNS:
        runs = F.expr(f"transform(sequence(1, size(sketch) - {run - 1}), i -> xxhash64(slice(sketch, i, {run})))")
        inside = (F.col("n") >= low) & (F.col("n") <= high if high else F.lit(True))
        most = F.ceil(F.col("n") * percent / 100) - 1 if spare is None else F.lit(spare)
        parts.append(nodes.where(inside).select("doc", "n", most.cast("int").alias("spare"),
                                                F.explode(F.array_distinct(runs)).alias("list")))
    every = reduce(DataFrame.unionByName, parts)
    shared = every.groupBy("list").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    chosen = every.join(shared, "list").groupBy("doc", "n", "spare").agg(
        F.sort_array(F.collect_list(F.struct("held", "list"))).alias("lists"), F.sum("held").alias("w"))
    chosen = materialise(chosen.where("size(lists) > spare").withColumn(
        "lists", F.expr("transform(slice(lists, 1, size(lists) - spare), x -> x.list)")))
    ids = chosen.select("doc").distinct()
    texts = materialise(_compressed(docs.join(ids, "doc", "left_semi")))
    members = materialise(sketches(texts, shingle, LONG_SKETCH, "text", "doc", compressed=True))
    entries = materialise(chosen.select("doc", "n", "w", F.explode("lists").alias("list")))
    least = percent / 100 - SLACK

    def test(pairs: DataFrame) -> DataFrame:
        return materialise(confirmed(materialise(estimated(pairs, members, least)), texts, shingle, percent))

    def star(entries: DataFrame, first: Column) -> DataFrame:
        leader = entries.groupBy("list").agg(F.max_by(F.struct("doc", "n", "comp"), first).alias("l"))
        return test(entries.join(leader, "list")
                    .where((F.col("comp") != F.col("l.comp")) & _sizes_fit(F.col("n"), F.col("l.n"), percent))
                    .select(F.col("l.doc").alias("a"), F.col("doc").alias("b")).distinct())

    # the best connected document of each list first
    found = star(entries.withColumn("comp", F.col("doc")), F.struct("w", "doc"))
    left = materialise(_open(_labelled(entries, found)))
    alone = _unshared(left.select("doc").distinct(), texts, shingle)
    left = (left.join(alone, "doc", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
            .where(F.col("alone") * percent <= F.col("n") * (100 - percent)))
    left = materialise(_open(left))
    # then what each document gains and loses against the best connected one that is left in its list
    leader = left.groupBy("list").agg(F.max_by("doc", F.struct("w", "doc")).alias("leader"))
    left = materialise(left.join(leader, "list"))
    pairs = left.where("doc <> leader").select(F.col("leader").alias("a"), F.col("doc").alias("b")).distinct()
    against = materialise(_differences(pairs, texts, shingle, percent))
    found = found.unionByName(against.where("linked").select("a", "b"))
    left = _open(_labelled(left.drop("comp").where("doc <> leader"), found))
    return found.unionByName(_between_members(left.select("leader", "doc", "n", "alone", "comp").distinct(), against, percent))


def _between_members(members: DataFrame, against: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of one leader in different components.

    ``gained`` counts the shingles a member has and its leader has not, ``lost`` those it lacks. Two members differ at least
    in the shingles that each has alone, and in as many more as the sizes of what they lost, or gained and share, are apart.
    """
    members = members.join(against.select(F.col("a").alias("leader"), F.col("b").alias("doc"), "gained", "lost", "differ"), ["leader", "doc"])
    size = members.groupBy("leader").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum(F.length("differ")) / (8 * BLOCK_VALUES))).cast("int").alias("blocks"),
        F.count(F.lit(1)).alias("held")).where("held > 1")
    dealt = (members.join(size, "leader").withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
             .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("leader", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "doc", "n", "alone", "comp",
                     "gained", "lost", "differ"))

    def tested(table: pa.Table) -> Iterator[tuple[int, int]]:
        own, doc, n, alone, comp, gained, lost = (table.column(c).to_numpy() for c in ("own", "doc", "n", "alone", "comp", "gained", "lost"))
        two = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        differ = [np.frombuffer(d, np.uint64) for d in table.column("differ").to_pylist()]
        ends = np.cumsum([0, *map(len, differ)])
        codes = np.unique(np.concatenate(differ), return_inverse=True)[1]
        mark = np.zeros(int(codes.max(initial=-1)) + 1, np.int8)
        shared = gained - alone
        for start in range(0, len(doc), 256):
            x = slice(start, start + 256)
            least = alone[x, None] + alone + np.abs(lost[x, None] - lost) + np.abs(shared[x, None] - shared)
            ok = (least * (100 + percent) <= (n[x, None] + n) * (100 - percent)) & (comp[x, None] != comp) & (doc[x, None] < doc)
            if two:
                ok &= own[x, None] != own
            for a in np.flatnonzero(ok.any(axis=1)).tolist():
                others = np.flatnonzero(ok[a]).tolist()
                a += start
                mine = codes[ends[a]:ends[a + 1]]
                mark[mine] = 1
                for b in others:
                    apart = len(mine) + ends[b + 1] - ends[b] - 2 * int(mark[codes[ends[b]:ends[b + 1]]].sum())
                    if apart * (100 + percent) <= (n[a] + n[b]) * (100 - percent):
                        yield int(doc[a]), int(doc[b])
                mark[mine] = 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["leader", "i", "j"], 256):
            leader, i, j = (table.column(c).to_numpy() for c in ("leader", "i", "j"))
            cuts = np.flatnonzero((np.diff(leader) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            links = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(leader)], strict=True):
                links += tested(table.slice(a, b - a))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    return dealt.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, text: str = "text",
                    key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Words are lower-cased in A-Z only. A text with fewer words than a shingle is one shingle; a text without words or
    a null text has none and links with nothing. Documents are linked when 100 * intersection >= percent * union of
    their distinct shingles; ``component_id`` is the smallest id that links reach, ``kept`` marks the document that has
    that id. Rows that repeat an id are one document. A row without an id links with nothing and is kept. An empty
    table gives no rows; other columns are not read.
    """
    stored = materialise(sketches(docs, shingle, SKETCH, text, key))
    sets = stored.where("n > 0 AND doc IS NOT NULL")
    nodes = sets.groupBy("digest").agg(F.min("doc").alias("doc"), F.max("n").alias("n"), F.max("sketch").alias("sketch"))
    copies = sets.groupBy("digest", "doc").agg(F.lit(1).alias("_")).join(
        nodes.select("digest", F.col("doc").alias("first")), "digest").where("doc <> first").select(
        F.col("first").alias("a"), F.col("doc").alias("b"))
    found = links(nodes.select("doc", "n", "sketch"), docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")),
                  shingle, percent)
    roots = materialise(connected(found.unionByName(copies), []))
    lowest = roots.groupBy("root").agg(F.min("node").alias("component"))
    member = roots.join(lowest, "root").select(F.col("node").alias("doc"), "component")
    out = stored.select("doc", "n").join(member, "doc", "left")
    component = F.coalesce("component", "doc")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"))


def one_of_each_group(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    key = F.col(names[docs.columns.index("doc_id")]).cast("long")
    gone = near_duplicates(docs, shingle, percent).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.toDF(*names).join(gone, key == F.col("_gone"), "left_anti").toDF(*docs.columns)
