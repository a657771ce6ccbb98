"""Registered queries and their oracles. A query runs library operators on derived tables; its SQL computes the same
result another way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runvox.operators.runs import voxels_to_runs
from runvox.plans import derived, pipelines
from runvox.scale import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Derived tables of one data folder. The audit is stored once and read by every query that builds on it."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._kept: dict[str, object] = {}

    def table(self, name: str) -> DataFrame:
        """A given table; its schema is read once."""
        return self.once(name, lambda: self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"))

    def base(self, name: str) -> DataFrame:
        for t in derived.tables_of(name):
            self.table(t).createOrReplaceTempView(t)
        return self.spark.sql(derived.BASE[name])

    def once(self, name: str, build: Callable[[], object]) -> object:
        if name not in self._kept:
            self._kept[name] = build()
        return self._kept[name]

    @property
    def header(self) -> DataFrame:
        return derived.header_arrays(self.base("v_header"))

    def items(self, name: str) -> DataFrame:
        """The rows of a view of voxels with its repeated ones: what takes them together anyway is spared a shuffle."""
        self.base(name)
        return self.spark.sql(derived.BASE[name].replace("SELECT DISTINCT", "SELECT", 1))

    def runs(self, name: str, tiled: bool = False) -> DataFrame:
        return voxels_to_runs(self.items(name), tiled=tiled)

    @property
    def audit(self) -> pipelines.Audit:
        return self.once("audit", lambda: pipelines.audit(materialise(self.runs("v_truth")), self.header, derived.ORGANS))


_TABLES: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return _TABLES.setdefault((spark.sparkContext.applicationId, sf_dir), Tables(spark, sf_dir))


def forget() -> None:
    """Drop what earlier queries stored, so that the next one is measured whole."""
    _TABLES.clear()


def query(name: str, sql: str | None = None):
    """Register ``fn(Tables) -> DataFrame``; ``sql`` may use the shared and oracle views."""
    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = derived.oracle(sql)
        return fn
    return register


def r6(column: str | Column) -> Column:
    """Averages and products may differ in the last bits between engines."""
    name = column if isinstance(column, str) else None
    out = F.round(F.col(column) if name else column, 6)
    return out.alias(name) if name else out
