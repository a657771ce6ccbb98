"""Repeated passages by super-k-mer partitioning.

A window is ``width`` consecutive words. Its minimiser is the smallest hash among its word groups of ``GRAM`` words;
consecutive windows of a document mostly share it, and such a run (a super-k-mer) travels as one packed string of words
to the bucket of its minimiser, where equal windows lie side by side after sorting. Equal windows have equal
minimisers, so a bucket counts its windows exactly. A minimiser that only one document has is not sent at all.

A minimiser that very many documents have is dealt into salted buckets. Each finds what repeats within it, and hands on
the first document of its windows, packed by hash range; a second pass over these ranges finds what repeats between
salts. Windows are compared by 128 bits of two hashes of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from runvox.llm.words import Words, binary, grouped, lists, packed, slices, unpacked, windows
from runvox.scale import materialise

GRAM = 6
#: Packed strings per bucket of a salted minimiser, on average.
BUCKET = 1000


def _runs(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, number of windows) of the super-k-mers of one document's word hashes."""
    grams = windows(h, GRAM)
    span = width - GRAM + 1
    low = grams
    size = 1
    while size * 2 <= span:  # minima over doubled spans; two of them cover the window
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    n = len(grams) - span + 1
    low = np.minimum(low[:n], low[span - size:span - size + n])
    first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    return low[first], first, np.diff(np.append(first, n))


def _small(docs: DataFrame) -> DataFrame:
    """``docs`` (row, doc, text) with its texts compressed: they are stored once and sent up to twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc"), pa.array([packed(t) for t in binary(batch, "text")], pa.binary())],
                ["row", "doc", "text"])

    return docs.select("row", "doc", "text").mapInArrow(run, "row long, doc long, text binary")


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [unpacked(t) for t in batch.column("text").to_pylist()]


def _scanned(docs: DataFrame, width: int) -> DataFrame:
    """(row, doc, n, sha, minimiser[], start[], windows[]) per row: words, hash of the text as it is, super-k-mers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch)
            counts, shas, parts = [], [], []
            for a, b in slices(texts):
                words = Words(texts[a:b])
                h = words.hashes()
                for i in range(b - a):
                    own = h[words.first[i]:words.first[i + 1]]
                    counts.append(len(own))
                    shas.append(hashlib.sha256(b" ".join(texts[a + i].split())).hexdigest())
                    none = np.zeros(0, np.int64)
                    parts.append(_runs(own, width) if len(own) >= width else (none, none, none))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc"), pa.array(counts, pa.int64()), pa.array(shas),
                 *[lists([p[k].astype(np.uint64) for p in parts], pa.int64()) for k in range(3)]],
                ["row", "doc", "n", "sha", "minimiser", "start", "windows"])

    return docs.select("row", "doc", "text").mapInArrow(
        run, "row long, doc long, n long, sha string, minimiser array<long>, start array<long>, windows array<long>")


def _packed(chosen: DataFrame, width: int) -> DataFrame:
    """(minimiser, salt, salts, row, doc, start, words): every chosen super-k-mer as one string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows, docs = _texts(batch), batch.column("row").to_pylist(), batch.column("doc").to_pylist()
            for r, runs in enumerate(batch.column("runs").to_pylist()):
                own = texts[r].split()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["minimiser"] for x in runs], pa.int64()), pa.array([x["salt"] for x in runs], pa.int32()),
                     pa.array([x["salts"] for x in runs], pa.int32()), pa.array([rows[r]] * len(runs), pa.int64()),
                     pa.array([docs[r]] * len(runs), pa.int64()),
                     pa.array([x["start"] for x in runs], pa.int64()),
                     pa.array([b" ".join(own[x["start"]:x["start"] + x["windows"] + width - 1]) for x in runs])],
                    ["minimiser", "salt", "salts", "row", "doc", "start", "words"])

    return chosen.select("row", "doc", "text", "runs").mapInArrow(
        run, "minimiser long, salt int, salts int, row long, doc long, start long, words binary")


def _joined(row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, number) of runs of neighbouring window starts."""
    order = np.lexsort((at, row))
    row, at = row[order], at[order]
    first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)))) if len(row) else np.zeros(0, int)
    return row[first], at[first], np.diff(np.append(first, len(row)))


def _settled(group, h1, h2, doc, at) -> tuple[np.ndarray, np.ndarray]:
    """Per window of each group: (a smaller document has it, its document is the first that has it), in sorted order."""
    new = np.concatenate(([True], (group[1:] != group[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
    lowest = np.repeat(doc[new], np.diff(np.append(np.flatnonzero(new), len(doc))))
    return doc > lowest, doc == lowest


_RUN = pa.schema([("row", pa.int64()), ("start", pa.int64()), ("windows", pa.int64()), ("minimiser", pa.int64()),
                  ("range", pa.int32()), ("h1", pa.list_(pa.int64())), ("h2", pa.list_(pa.int64())),
                  ("rows", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64())), ("ats", pa.list_(pa.int64()))])


def _bucket_repeats(packed: DataFrame, width: int) -> DataFrame:
    """Rows with ``start``: runs of windows that a smaller document has; rows without: first documents of the windows
    of salted buckets, packed by hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["minimiser", "salt"]):
            texts = table.column("words").to_pylist()
            for lo, hi in _group_slices(table, texts):
                words = Words(texts[lo:hi])
                part = table.slice(lo, hi - lo)
                a, b = words.hashes(1), words.hashes(2)
                starts = part.column("start").to_numpy()
                pieces = [(windows(a[f:e], width), windows(b[f:e], width)) for f, e in zip(words.first[:-1], words.first[1:], strict=True)]
                number = np.array([len(p[0]) for p in pieces])
                piece = np.repeat(np.arange(len(number)), number)
                h1, h2 = np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces])
                at = starts[piece] + np.arange(len(piece)) - np.repeat(np.cumsum(number) - number, number)
                row, doc, mini, salts, salt = (part.column(c).to_numpy()[piece] for c in ("row", "doc", "minimiser", "salts", "salt"))
                order = np.lexsort((at, row, doc, h2, h1, salt, mini))
                h1, h2, at, row, doc, mini, salts, salt = (x[order] for x in (h1, h2, at, row, doc, mini, salts, salt))
                group = np.cumsum(np.concatenate(([0], (mini[1:] != mini[:-1]) | (salt[1:] != salt[:-1]))))
                later, first = _settled(group, h1, h2, doc, at)
                r, s, n = _joined(row[later], at[later])
                rows = [{"row": x, "start": y, "windows": z} for x, y, z in zip(r.tolist(), s.tolist(), n.tolist(), strict=True)]
                on = np.flatnonzero(first & (salts > 1))
                if len(on):
                    part_of = (h1[on] % salts[on].astype(np.uint64)).astype(np.int32)
                    order = np.lexsort((part_of, group[on]))
                    on, part_of = on[order], part_of[order]
                    cuts = np.flatnonzero(np.concatenate(([True], (part_of[1:] != part_of[:-1]) | (group[on][1:] != group[on][:-1]))))
                    for u, v in zip(cuts, np.append(cuts[1:], len(on)), strict=True):
                        k = on[u:v]
                        rows.append({"minimiser": int(mini[k[0]]), "range": int(part_of[u]), "h1": h1[k].view(np.int64),
                                     "h2": h2[k].view(np.int64), "rows": row[k], "docs": doc[k], "ats": at[k]})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _RUN)

    return (packed.repartition("minimiser", "salt").sortWithinPartitions("minimiser", "salt")
            .mapInArrow(run, "row long, start long, windows long, minimiser long, range int, h1 array<long>, "
                             "h2 array<long>, rows array<long>, docs array<long>, ats array<long>"))


def _group_slices(table: pa.Table, texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes that end where a bucket ends."""
    mini, salt = table.column("minimiser").to_numpy(), table.column("salt").to_numpy()
    ends = np.append(np.flatnonzero((mini[1:] != mini[:-1]) | (salt[1:] != salt[:-1])) + 1, len(mini))
    sizes = np.cumsum([len(t) for t in texts])
    start = 0
    for k, e in enumerate(ends.tolist()):
        done = int(sizes[start - 1]) if start else 0
        if k == len(ends) - 1 or sizes[ends[k + 1] - 1] - done > limit:
            yield start, e
            start = e


def _between_salts(shared: DataFrame) -> DataFrame:
    """Runs of windows of which another salt of the same minimiser has a smaller document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["minimiser", "range"], 256):
            parts = {c: table.column(c).to_pylist() for c in ("h1", "h2", "rows", "docs", "ats")}
            number = [len(x) for x in parts["docs"]]
            flat = {c: np.concatenate([np.array(x, np.int64) for x in v]) for c, v in parts.items()}
            mini, part = (np.repeat(table.column(c).to_numpy(), number) for c in ("minimiser", "range"))
            order = np.lexsort((flat["ats"], flat["rows"], flat["docs"], flat["h2"], flat["h1"], part, mini))
            mini, part = mini[order], part[order]
            flat = {c: v[order] for c, v in flat.items()}
            group = np.cumsum(np.concatenate(([0], (mini[1:] != mini[:-1]) | (part[1:] != part[:-1]))))
            later, _ = _settled(group, flat["h1"], flat["h2"], flat["docs"], flat["ats"])
            r, s, n = _joined(flat["rows"][later], flat["ats"][later])
            yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(s), pa.array(n, pa.int64())], ["row", "start", "windows"])

    return (shared.select("minimiser", "range", "h1", "h2", "rows", "docs", "ats").repartition("minimiser", "range")
            .sortWithinPartitions("minimiser", "range").mapInArrow(run, "row long, start long, windows long"))


def repeats(docs: DataFrame, width: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scanned, texts, spans) of ``docs`` (row, doc, compressed text; stored row numbers are distinct, ids may repeat, none
    is null).

    scanned: (row, doc, n, sha) of every row; texts: (row, compressed text) of those that may hold repeats; spans: (row,
    spans) with the windows that a document with a smaller id has too, as (start, windows) pairs.
    """
    scanned = materialise(_scanned(docs, width))
    runs = scanned.where("size(minimiser) > 0").select(
        "row", "doc", F.explode(F.arrays_zip("minimiser", "start", "windows")).alias("r")).select("row", "doc", "r.*")
    several = (runs.groupBy("minimiser").agg(F.min("doc").alias("_lo"), F.max("doc").alias("_hi"), F.count(F.lit(1)).alias("held"))
               .where("_lo < _hi").select("minimiser", F.ceil(F.col("held") / BUCKET).cast("int").alias("salts")))
    salt = F.pmod(F.xxhash64("row"), F.col("salts")).cast("int")
    chosen = (runs.join(several, "minimiser").withColumn("salt", salt).groupBy("row")
              .agg(F.collect_list(F.struct("minimiser", "start", "windows", "salt", "salts")).alias("runs")))
    chosen = materialise(docs.join(chosen, "row"))
    found = materialise(_bucket_repeats(_packed(chosen, width), width))
    spans = (found.where("start IS NOT NULL").select("row", "start", "windows")
             .unionByName(_between_salts(found.where("start IS NULL"))))
    spans = spans.groupBy("row").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))
    return scanned.select("row", "doc", "n", "sha"), chosen.select("row", "text"), spans


def _kept(text: bytes, spans: list[dict], width: int) -> tuple[list[bytes], np.ndarray]:
    """The words of a text and which of them no span covers."""
    own = text.split()
    change = np.zeros(len(own) + 1, np.int64)
    for s in spans:
        change[s["start"]] += 1
        change[min(len(own), s["start"] + s["windows"] + width - 1)] -= 1
    return own, np.cumsum(change)[:-1] == 0


def _columns(docs: DataFrame, row: str) -> DataFrame:
    return docs.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc"), "text")


def repeated_words(docs: DataFrame, width: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): words that repeat a window of a document with a smaller id go.

    Windows are judged on the input. A null or empty text has no words; so has none to remove. Repeats inside one
    document, and documents with fewer words than a window, stay. Rows that repeat an id never remove each other's
    words; each loses what its own text repeats. Rows without an id are returned unchanged and remove nothing. Other columns are not read; an empty table
    gives no rows.
    """
    numbered = materialise(_small(_columns(docs.withColumn("_row", F.monotonically_increasing_id()), "_row")))
    scanned, texts, spans = repeats(numbered.where("doc IS NOT NULL"), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas = [], []
            for text, found in zip(_texts(batch), batch.column("spans").to_pylist(), strict=True):
                own, keep = _kept(text, found, width)
                removed.append(int((~keep).sum()))
                shas.append(hashlib.sha256(b" ".join([w for w, k in zip(own, keep.tolist(), strict=True) if k])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(removed, pa.int64()), pa.array(shas)], ["row", "gone", "new"])

    changed = texts.join(spans, "row").select("row", "text", "spans").mapInArrow(run, "row long, gone long, new string")
    out = scanned.join(changed, "row", "left").select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_words"), F.coalesce("gone", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("new", "sha").alias("kept_sha256"))
    nameless = _scanned(numbered.where("doc IS NULL"), width)
    return out.unionByName(nameless.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_words"),
                                           F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256")))


def without_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """``docs`` with repeated words cut out of ``text`` (the rest joined by spaces) and ``n_chars``, where there is such
    a column, counted anew. Texts that lose nothing stay as they are; all rows and columns, whatever their names, are
    kept."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    text, key, found = names[docs.columns.index("text")], names[docs.columns.index("doc_id")], f"c{len(names)}"
    numbered = materialise(docs.toDF(*names).withColumn("_row", F.monotonically_increasing_id()))
    own = numbered.select(F.col("_row").alias("row"), F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    _, _, spans = repeats(_small(own.where("doc IS NOT NULL")), width)
    both = numbered.join(spans.withColumnRenamed("row", "_row"), "_row", "left").select(*names, F.col("spans").alias(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary(batch, text)
            for r, spans in enumerate(batch.column(found).to_pylist()):
                if spans:
                    own, keep = _kept(texts[r] or b"", spans, width)
                    texts[r] = b" ".join([w for w, k in zip(own, keep.tolist(), strict=True) if k])
            new = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([new if n == text else batch.column(n) for n in names], names)

    schema = StructType([StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields, strict=True)])
    out = both.mapInArrow(run, schema).toDF(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
