from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[8]").appName("runvox-tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g")
               .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def run_table(spark):
    """{(source, case, organ): boolean volume} → voxel runs."""
    from runvox import schemas
    from runvox.sources.nifti import runs_of

    def build(volumes: dict):
        rows = []
        for (source, case, organ), mask in volumes.items():
            r = runs_of(np.asarray(mask).astype(np.uint8))
            rows += [(source, case, organ, *map(int, v)) for v in zip(r["x"], r["y"], r["z0"], r["z1"], strict=True)]
        return spark.createDataFrame(rows, schemas.VOXEL_RUN)
    return build


@pytest.fixture(scope="session")
def header_table(spark):
    from runvox import schemas

    def build(cases: dict):
        rows = []
        for (source, case), (shape, zooms, affine) in cases.items():
            a = np.diag([*zooms, 1.0]) if affine is None else np.asarray(affine, float)
            rows.append((source, case, list(shape), [float(z) for z in zooms], a.tolist(),
                         float(np.prod(zooms)) / 1000))
        return spark.createDataFrame(rows, schemas.CASE_HEADER)
    return build


def label_26(mask: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Components of a mask by flood fill, in array order of their first voxel."""
    left = {tuple(int(i) for i in p) for p in np.argwhere(mask)}
    out = []
    for seed in sorted(left):
        if seed not in left:
            continue
        left.discard(seed)
        part, stack = [], [seed]
        while stack:
            p = stack.pop()
            part.append(p)
            for d in np.ndindex(3, 3, 3):
                q = (p[0] + d[0] - 1, p[1] + d[1] - 1, p[2] + d[2] - 1)
                if q in left:
                    left.discard(q)
                    stack.append(q)
        out.append(sorted(part))
    return out
