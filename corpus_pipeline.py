"""A training-data pipeline over ``documents``: toxic documents go, one document of each near-duplicate group stays,
repeated passages are cut, sources are mixed to their weights, and the mix is packed into sequences."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from runvox.llm import minhash, mixing, packing, substrings, toxicity
from runvox.llm.queries import TOKENIZER
from runvox.llm.tables import table
from runvox.scale import materialise

#: Texts go to Python in batches of about so many bytes, however long they are: a worker holds its batch several times over, and
#: an executor keeps the workers of the stages before.
BATCH_BYTES = 4 << 20


def in_small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)
    return run


@in_small_batches
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


@in_small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group (five words, similarity of 0.8 or more)."""
    return minhash.one_of_each_group(docs, shingle=5, percent=80)


@in_small_batches
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words that a document with a smaller id has."""
    return substrings.without_repeats(docs, width=50)


@in_small_batches
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as documents."""
    return mixing.mixed_documents(docs)


@in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A place in a sequence for every piece of every document."""
    return packing.packed_documents(docs, TOKENIZER)


STAGES = [("toxicity", toxic), ("minhash_near_dedup", near_duplicates), ("substring_dedup", repeated_passages),
          ("mixing_sources", mix), ("best_fit_packing", pack)]

#: A trained classifier, a permuted mix and a packing can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
