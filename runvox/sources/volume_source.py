"""Volume files as a data source: one scan opens each file once and yields everything that is asked of it as tagged rows.

``kind`` is ``header`` (grid of a file), ``run`` (foreground along z), ``column`` (intensities of one (x, y)) or ``error``.
A file that cannot be read, whatever is wrong with it, is one ``error`` row and never a failed job; its header is there if
that much could be read, its runs and columns are not. Asked for headers only, no more than the first block of a file is
fetched and 348 bytes of it are inflated.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from runvox.sources.nifti import read_header, read_volume, runs_of

NAME = "volume_files"
SCHEMA = ("path string, kind string, shape array<int>, zooms array<double>, affine array<array<double>>, label int, x int, y int, "
          "z0 int, z1 int, hu array<smallint>, error string")
_FIELDS = {"path": pa.string(), "kind": pa.string(), "shape": pa.list_(pa.int32()), "zooms": pa.list_(pa.float64()),
           "affine": pa.list_(pa.list_(pa.float64())), "label": pa.int32(), "x": pa.int32(), "y": pa.int32(), "z0": pa.int32(),
           "z1": pa.int32(), "hu": pa.list_(pa.int16()), "error": pa.string()}
PARTS = ("header", "run", "column")
_ROWS = 100_000
#: Enough compressed bytes for a header.
_HEAD_BYTES = 1 << 16


def _rows(columns: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in _FIELDS.items()], list(_FIELDS))


def _same(value: str, n: int) -> pa.Array:
    return pa.array([value] * n)


def _first_bytes(raw: bytes) -> bytes:
    """The header's bytes from the beginning of a file, compressed or not."""
    return zlib.decompressobj(31).decompress(raw, 348) if raw[:2] == b"\x1f\x8b" else raw[:348]


def labels_of(data: np.ndarray, masks: bool) -> np.ndarray:
    """Whole-number labels; of a mask file, whatever is above zero is 1."""
    if masks:
        return data > 0
    if data.dtype.kind == "f" and not (np.isfinite(data).all() and (data == np.rint(data)).all()):
        raise ValueError("labels are not whole numbers")
    return data


def intensities_of(data: np.ndarray) -> np.ndarray:
    """Intensities as 16-bit numbers: scaled values are rounded, values beyond 16 bits are refused."""
    values = np.rint(data) if data.dtype.kind == "f" else data
    if not np.isfinite(values).all() or (values.size and (values.min() < -32768 or values.max() > 32767)):
        raise ValueError("intensities do not fit in 16 bits")
    return values.astype(np.int16)


def file_rows(path: str, read, parts: Sequence[str], masks: bool) -> Iterator[pa.RecordBatch]:
    """All rows of one file. ``read(n)`` gives its first ``n`` bytes, ``read(None)`` all of them."""
    try:
        if set(parts) <= {"header"}:
            yield _header(path, read_header(_first_bytes(read(_HEAD_BYTES))))
            return
        raw = read(None)
        if "header" in parts:
            yield _header(path, read_header(_first_bytes(raw)))
        _, data = read_volume(raw)
        runs = runs_of(labels_of(data, masks)) if "run" in parts else None
        hu = intensities_of(data) if "column" in parts else None
    except Exception as error:  # whatever a damaged file does, it becomes a row
        yield _rows({"path": _same(path, 1), "kind": _same("error", 1), "error": pa.array([repr(error)])}, 1)
        return
    if runs is not None:
        for a in range(0, len(runs["x"]), _ROWS):
            part = {c: pa.array(v[a:a + _ROWS].astype(np.int32)) for c, v in runs.items()}
            n = len(part["x"])
            yield _rows({"path": _same(path, n), "kind": _same("run", n), **part}, n)
    if hu is not None:
        for x in range(hu.shape[0]):
            n, depth = hu.shape[1:]
            yield _rows({"path": _same(path, n), "kind": _same("column", n), "x": pa.array(np.full(n, x, np.int32)),
                         "y": pa.array(np.arange(n, dtype=np.int32)),
                         "hu": pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * depth), pa.array(hu[x].reshape(-1)))}, n)


def _header(path: str, head: dict) -> pa.RecordBatch:
    return _rows({"path": _same(path, 1), "kind": _same("header", 1), "shape": pa.array([head["shape"][:3]], pa.list_(pa.int32())),
                  "zooms": pa.array([head["zooms"]]), "affine": pa.array([head["affine"].tolist()])}, 1)


class FileGroup(InputPartition):
    """Files of one task."""

    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class VolumeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.suffix = options["path"], options.get("suffix", ".nii.gz")
        self.parts = [p for p in options.get("parts", "header,run").split(",") if p]
        if unknown := set(self.parts) - set(PARTS):
            raise ValueError(f"unknown parts {sorted(unknown)}, known are {PARTS}")
        self.masks = options.get("masks", "false").lower() == "true"
        self.group_bytes = int(options.get("groupbytes", 128 << 20))

    def partitions(self) -> list[InputPartition]:
        """Files in order of their paths, in groups of about ``groupBytes``; a larger file is a group of its own. Headers
        count as one block each."""
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.root)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(self.suffix))
        groups, held = [], self.group_bytes
        for path, size in files:
            size = min(size, _HEAD_BYTES) if self.parts == ["header"] else size
            if held + size > self.group_bytes or not groups:
                groups.append([])
                held = 0
            groups[-1].append(path)
            held += size
        return [FileGroup(g) for g in groups] or [FileGroup([])]

    def read(self, partition: FileGroup) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.root)
        for path in partition.paths:
            def read(n: int | None, path: str = path) -> bytes:
                with system.open_input_file(path) as file:
                    return file.read() if n is None else file.read(n)
            yield from file_rows(path, read, self.parts, self.masks)


class VolumeSource(DataSource):
    """``spark.read.format("volume_files")`` with options ``path`` (a folder as a URI), ``parts``, ``masks``, ``suffix`` and
    ``groupBytes``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> VolumeReader:
        return VolumeReader(dict(self.options))


def _uri(root: str) -> str:
    return root if "://" in root else f"file://{root.removeprefix('file:')}"


def scan(spark: SparkSession, root: str, parts: Sequence[str] = ("header", "run"), masks: bool = False, suffix: str = ".nii.gz",
         group_bytes: int = 128 << 20) -> DataFrame:
    """The rows of every file below ``root``. ``path`` is the whole path; ``source``, ``case_id`` and ``structure`` are its last
    three steps (folder, folder, file without its suffix)."""
    spark.dataSource.register(VolumeSource)
    root = _uri(root)
    rows = (spark.read.format(NAME).option("path", root).option("parts", ",".join(parts)).option("masks", str(masks).lower())
            .option("suffix", suffix).option("groupBytes", str(group_bytes)).load())
    steps = F.split("path", "/")
    named = F.element_at(steps, -1)
    return rows.select(F.get(steps, F.size(steps) - 3).alias("source"), F.get(steps, F.size(steps) - 2).alias("case_id"),
                       F.substring(named, F.lit(1), F.length(named) - len(suffix)).alias("structure"), "*")


def headers(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'header'").select("source", "case_id", "structure", "shape", "zooms", "affine")


def runs(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'run'").select("source", "case_id", "structure", "label", "x", "y", "z0", "z1")


def columns(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'column'").select("source", "case_id", "structure", "x", "y", "hu")


def errors(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'error'").select("source", "case_id", "structure", "error")


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Writes (name, content) rows below ``root`` from the tasks, gzip-compressed; (name, size) of what was written."""
    root = _uri(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            names, sizes = batch.column("name").to_pylist(), []
            for name, content in zip(names, batch.column("content").to_pylist(), strict=True):
                data = gzip.compress(content, mtime=0)
                system.create_dir(f"{base}/{name}".rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(f"{base}/{name}", compression=None) as out:
                    out.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes, pa.int64())], ["name", "size"])

    return files.select("name", "content").mapInArrow(run, "name string, size long")
