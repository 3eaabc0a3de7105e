"""A training corpus from raw documents: five stages of the operators in ``lureline.llm``.

Each stage takes what its predecessor wrote and returns documents again, in their columns; the last one
returns token ids instead of texts. Every stage works on all rows it is given. The result of a stage is to
be written before the next one is called: a stage first deletes the intermediate tables of the one before.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from lureline.llm import balance, bpe, near, suffix, weak_quality
from lureline.llm.common import documents
from lureline.shared import new_path, recorded, remove

_left: list[str] = []  # tables of the stage before


def _stage(function: Callable) -> Callable:
    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left:
            remove(spark, _left.pop())
        with recorded(_left):
            return function(spark, docs, sf_dir)

    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier accepts."""
    return weak_quality.kept_rows(docs, weak_quality.fit(docs))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, the one with the smallest id."""
    return near.representatives(docs)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that an earlier document, or an earlier place, has already."""
    return suffix.shortened(docs)


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, also not at all."""
    return balance.mix(docs)


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens and digests of the ids and of the bytes decoded from them."""
    return bpe.digests(docs)


STAGES = [("quality_classifier", quality), ("simhash_near_dedup", near_duplicates), ("suffix_dedup", repeated_passages),
          ("source_mix", mixture), ("byte_bpe", tokens)]
ORACLE_SQL = None  # a trained classifier and a shingle hash are beyond SQL; tests compare a run with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each but the last is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
