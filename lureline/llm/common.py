"""Helpers of the subpackage: narrow inputs, bounded slices of Arrow text, tables written once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lureline.shared import materialise

__all__ = ["documents", "flat_text", "join_on", "map_arrow", "materialise", "narrow", "slices", "table"]

# Bytes of text that one step of a task works on; a single longer text is a step of its own.
SLICE_BYTES = 1 << 20
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under fixed names, so that further columns of any name cannot clash."""
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


def join_on(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join on equal values, null with null; the right keys are renamed, so common ancestors are no matter."""
    other = right.select(*[F.col(n).alias(f"_r_{n}") for n in names], *[c for c in right.columns if c not in names])
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"_r_{n}"))
    return left.join(other, same, how).drop(*[f"_r_{n}" for n in names])


def map_arrow(df: DataFrame, function: Callable, schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` over batches of bounded size.

    Spark's default of 10,000 rows a batch is meant for short rows; with whole texts the buffers of both
    processes would take more memory than the work itself. A smaller setting of the session is kept.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array and their offsets (one more than texts); null is empty."""
    filled = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = filled.buffers()
    at = np.frombuffer(offsets, np.int64)[filled.offset:filled.offset + len(filled) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0]:at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose text has about ``limit`` bytes at most, or one longer text."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_string())), 0))
    ends = np.cumsum(size, dtype=np.int64)
    start = 0
    while start < len(size):
        before = ends[start] - size[start]
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop
