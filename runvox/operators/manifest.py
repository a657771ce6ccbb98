"""Checksummed manifests: building, validating and verifying them as joins."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runvox import vocabulary
from runvox.functions.text import unsafe_name

FANOUT = 4096
_INVENTORY = pa.schema([("name", pa.string()), ("size", pa.int64()), ("sha256", pa.string()), ("git_sha1", pa.string())])


def blob_hashes(content: Column) -> list[Column]:
    """size, sha256 and the sha1 git gives the same bytes as a blob."""
    head = F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8"), F.unhex(F.lit("00")))
    return [F.octet_length(content).cast("long").alias("size"), F.sha2(content, 256).alias("sha256"),
            F.sha1(F.concat(head, content)).alias("git_sha1")]


def file_inventory(files: DataFrame) -> DataFrame:
    """(name, size, sha256, git_sha1) from ``files(name, content)``; other columns stay, before the size."""
    return files.select(*[c for c in files.columns if c != "content"], *blob_hashes(F.col("content")))


def path_inventory(paths: DataFrame, root: str, piece: int = 4 << 20) -> DataFrame:
    """(name, size, sha256, git_sha1) of the files ``paths(name)`` below ``root``, of any size.

    A file is read from an open stream in pieces of ``piece`` bytes that move both digests on, so a task holds one piece and
    never a file. The size is that of the file when it is opened; a file that changes while it is read has other bytes than
    its size says and ends the job.
    """
    root = root if "://" in root else f"file://{root.removeprefix('file:')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            out = []
            for name in batch.column("name").to_pylist():
                size = system.get_file_info(f"{base}/{name}").size
                whole, blob, seen = hashlib.sha256(), hashlib.sha1(b"blob %d\0" % (size or 0)), 0
                with system.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    while data := stream.read(piece):
                        whole.update(data)
                        blob.update(data)
                        seen += len(data)
                if seen != size:
                    raise ValueError(f"{name} has {size} bytes and gave {seen}")
                out.append((name, size, whole.hexdigest(), blob.hexdigest()))
            yield pa.RecordBatch.from_pylist([dict(zip(_INVENTORY.names, r, strict=True)) for r in out], _INVENTORY)

    return paths.select("name").mapInArrow(run, "name string, size long, sha256 string, git_sha1 string")


def content_id(files: DataFrame, kind: str, recipe: str, version: int = 1, fanout: int = FANOUT) -> DataFrame:
    """One row: an id of the whole manifest that any change to any entry changes.

    Entries are hashed one by one, then per bucket of their name's hash in name order, then over the buckets: two
    levels, so a manifest of any length never gathers in one task. The form is this library's own.
    """
    line = F.sha2(F.concat_ws("\u0001", "name", F.col("size").cast("string"), "sha256", "git_sha1"), 256)
    bucket = F.conv(F.substring(F.md5("name"), 1, 3), 16, 10).cast("int") % fanout
    joined = lambda order: F.sha2(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct(order, "h"))),
                                                              lambda s: s["h"])), 256)
    level = files.select(bucket.alias("b"), "name", line.alias("h")).groupBy("b").agg(joined("name").alias("h"))
    top = level.agg(joined("b").alias("h"), F.count(F.lit(1)).alias("_n")).where("_n > 0")
    return top.select(F.lit(version).alias("version"), F.lit(kind).alias("kind"), F.lit(recipe).alias("recipe"),
                      F.sha2(F.concat_ws("|", F.lit(str(version)), F.lit(kind), F.lit(recipe), "h"), 256)
                      .alias("content_id"))


def recipe_id(files: DataFrame) -> DataFrame:
    """Id over the hashes of the files that define the data rules (``name, content``)."""
    return content_id(file_inventory(files), "recipe", "").select(F.col("content_id").alias("recipe_id"))


def manifest_violations(files: DataFrame, prefixes: Sequence[str] | None = None) -> DataFrame:
    """(name, problem) for every malformed entry; empty means well-formed."""
    hexadecimal = lambda c, n: ~F.coalesce(F.col(c).rlike(f"^[0-9a-f]{{{n}}}$"), F.lit(False))
    problems = [F.when(unsafe_name(F.col("name")), "unsafe name"),
                F.when(F.col("size").isNull() | (F.col("size") < 0), "bad size"),
                F.when(hexadecimal("sha256", 64), "bad sha256"), F.when(hexadecimal("git_sha1", 40), "bad git_sha1")]
    if prefixes:
        inside = F.lit(False)
        for p in prefixes:
            inside = inside | F.col("name").startswith(p)
        problems.append(F.when(~inside, "unexpected path"))
    return files.select("name", F.explode(F.array_compact(F.array(*problems))).alias("problem"))


def header_violations(header: DataFrame, files: DataFrame, kind: str, recipe: str | None = None,
                      version: int = 1) -> DataFrame:
    """Problems of the manifest header (version, kind, recipe, content_id): wrong values, or an id that the entries
    do not give."""
    again = content_id(files, kind, recipe or "").select("content_id").scalar()
    one = header.withColumn("_id", again)
    problems = [F.when((F.col("version") != version) | (F.col("kind") != kind), "unsupported manifest"),
                F.when(F.col("recipe") != recipe, "recipe changed") if recipe else None,
                F.when(F.col("_id").isNull(), "empty manifest"),
                F.when(F.col("_id") != F.col("content_id"), "checksum mismatch")]
    return one.select(F.explode(F.array_compact(F.array(*[p for p in problems if p is not None]))).alias("problem"))


def verify(expected: DataFrame, actual: DataFrame, keys: Sequence[str] = ("name",)) -> DataFrame:
    """(keys, status) for every file on either side: ok, missing, unexpected, size, hash. ``keys`` tell files apart; where
    names may be equal, an id is needed beside the name.

    ``actual(name, size, lfs_sha256, blob_id)``: large files carry a sha256, small ones only a git blob id, and the
    one that is present decides.
    """
    keys = list(keys)
    e = expected.select(*keys, F.col("size").alias("_size"), "sha256", "git_sha1", F.lit(True).alias("_e"))
    a = actual.select(*keys, "size", "lfs_sha256", "blob_id", F.lit(True).alias("_a"))
    same = F.when(F.col("lfs_sha256").isNotNull(), F.col("lfs_sha256") == F.col("sha256")).otherwise(
        F.col("blob_id") == F.col("git_sha1"))
    status = (F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "unexpected")
              .when(F.col("size") != F.col("_size"), "size").when(~F.coalesce(same, F.lit(False)), "hash")
              .otherwise("ok"))
    return e.join(a, keys, "full_outer").select(*keys, status.alias("status"))


def bundle_missing(cases: DataFrame, inventory: DataFrame, fixed: Sequence[str], config: str,
                   train: Sequence[str] = tuple(vocabulary.TRAIN_SUFFIXES),
                   test: Sequence[str] = tuple(vocabulary.TEST_SUFFIXES)) -> DataFrame:
    """Required names (per case and role, plus fixed files) that are absent or empty.

    ``cases(name, role)`` with roles train / test; ``inventory(name, size)``.
    """
    fill = lambda s: F.replace(F.replace(F.lit(s), F.lit("{config}"), F.lit(config)), F.lit("{name}"), F.col("name"))
    wanted = F.when(F.col("role") == "train", F.array(*map(fill, train))).otherwise(F.array(*map(fill, test)))
    per_case = cases.select(F.explode(wanted).alias("name"))
    spark = cases.sparkSession
    needed = per_case
    if fixed:
        needed = per_case.unionByName(spark.range(1).select(F.explode(F.array(*map(F.lit, fixed))).alias("name")))
    return needed.join(inventory.where("size > 0").select("name"), "name", "left_anti")


def count_gate(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Sources whose row count differs from expected(source, total), unknown and absent sources included."""
    n = rows.groupBy("source").agg(F.count(F.lit(1)).alias("found"))
    return (n.join(expected, "source", "full_outer").fillna(0, ["found"])
            .where(~F.col("found").eqNullSafe(F.col("total")))
            .select("source", F.col("found").cast("long").alias("found"), F.col("total").cast("long").alias("total")))
