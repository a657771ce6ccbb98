"""Reading tables and column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runvox.llm.words import WORD


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_list(text: Column) -> Column:
    """The words of a text (null: none) without leaving the JVM."""
    blanks = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(blanks, " "), "")


def word_count(text: Column) -> Column:
    return F.size(word_list(text)).cast("long")


__all__ = ["WORD", "table", "word_count", "word_list"]
