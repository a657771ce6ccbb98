"""Volume files → run-length tables. The only place a volume is decoded; everything after is tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runvox.operators.runs import union_runs
from runvox.sources.nifti import read_header, read_volume, runs_of

HEADER = ("source string, case_id string, structure string, shape array<int>, zooms array<double>, "
          "affine array<array<double>>, error string")
RUNS = "source string, case_id string, structure string, label int, x int, y int, z0 int, z1 int"
COLUMNS = "source string, case_id string, x int, y int, hu array<smallint>"
_ROWS = 200_000


def volume_files(spark: SparkSession, path: str, glob: str = "*.nii.gz", **tags: str) -> DataFrame:
    """(path, content, length): one row per file below ``path``."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
             .load(path))
    return files.select("path", "content", "length", *[F.lit(v).alias(k) for k, v in tags.items()])


def headers(files: DataFrame) -> DataFrame:
    """Geometry of each file (source, case_id, structure, content). A bad file is a row with ``error``."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                row = {"source": r.source, "case_id": r.case_id, "structure": r.structure, "shape": None,
                       "zooms": None, "affine": None, "error": ""}
                try:
                    h = read_header(r.content)
                    row |= {"shape": h["shape"][:3], "zooms": h["zooms"], "affine": h["affine"].tolist()}
                except Exception as error:  # whatever a damaged file does, it becomes a row
                    row["error"] = repr(error)
                out.append(row)
            yield pd.DataFrame(out, columns=list(row))

    return files.select("source", "case_id", "structure", "content").mapInPandas(read, HEADER)


def _labels(content: bytes, masks: bool) -> np.ndarray:
    """Whole-number labels of a file; of a mask file, whatever is above zero is 1."""
    _, data = read_volume(content)
    if masks:
        return data > 0
    if data.dtype.kind == "f" and not (np.isfinite(data).all() and (data == np.rint(data)).all()):
        raise ValueError("labels are not whole numbers")
    return data


def label_runs(files: DataFrame, masks: bool = False) -> DataFrame:
    """Runs of equal label of each file; with ``masks``, of its values above zero, as label 1.

    Files that cannot be decoded, and label files with values that are not whole numbers, give no rows here and an
    ``error`` row in ``read_errors``.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                try:
                    table = pd.DataFrame(runs_of(_labels(r.content, masks)))
                except Exception:
                    continue
                for start in range(0, len(table), _ROWS):
                    part = table.iloc[start:start + _ROWS]
                    yield part.assign(source=r.source, case_id=r.case_id, structure=r.structure)[
                        ["source", "case_id", "structure", "label", "x", "y", "z0", "z1"]]

    return files.select("source", "case_id", "structure", "content").mapInPandas(read, RUNS)


def read_errors(files: DataFrame, masks: bool = False) -> DataFrame:
    """(source, case_id, structure, error) of every file that cannot be decoded whole."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                try:
                    _labels(r.content, masks)
                except Exception as error:  # whatever a damaged file does, it becomes a row
                    yield pd.DataFrame([{"source": r.source, "case_id": r.case_id, "structure": r.structure,
                                         "error": repr(error)}])

    return files.select("source", "case_id", "structure", "content").mapInPandas(
        read, "source string, case_id string, structure string, error string")


def ct_columns(files: DataFrame) -> DataFrame:
    """One row per (x, y) column of each intensity volume."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                try:
                    _, data = read_volume(r.content)
                except Exception:
                    continue
                for x in range(data.shape[0]):
                    plane = data[x].astype("int16")
                    yield pd.DataFrame({"source": r.source, "case_id": r.case_id, "x": x,
                                        "y": range(plane.shape[0]), "hu": list(plane)})

    return files.select("source", "case_id", "structure", "content").mapInPandas(read, COLUMNS)


def foreground(runs: DataFrame) -> DataFrame:
    """Mask files: any non-zero value is foreground; touching runs of different values become one run."""
    return union_runs(runs.where(F.col("label") > 0), ["source", "case_id", "structure"])


def write_by_source(table: DataFrame, path: str) -> None:
    """Stored once, partitioned by source, so later jobs prune whole collections."""
    table.write.mode("overwrite").option("maxRecordsPerFile", 20_000_000).partitionBy("source").parquet(path)
