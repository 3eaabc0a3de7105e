"""Sources: corpus CSV files, feature tables, optional sources, create-if-missing tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lureline.operators import corpus as C
from lureline.sources.split_csv import read_split_csv


def read_csv(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = True,
             split: bool = True) -> DataFrame:
    """CSV with header and doubled quotes, as spreadsheet tools write it.

    Mail bodies contain line breaks, which needs ``multi_line``. Such files are read in byte ranges by
    many tasks unless ``split`` is off, which leaves one task to a file. Without a schema every column is
    a string, read from the header only.
    """
    reader = spark.read.options(header=True, multiLine=multi_line, quote='"', escape='"')
    rows = (reader.schema(schema) if schema else reader).csv(path)
    return read_split_csv(spark, path, rows.schema) if multi_line and split else rows


def first_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows in file order."""
    return df.orderBy(*order).limit(n)


def feature_table(df: DataFrame, features: list[str] | None = None, id_column: str = "id",
                  label: str = "CLASS_LABEL") -> DataFrame:
    """Feature table as (id, features, label); by default every other column is a feature."""
    names = features or [c for c in df.columns if c not in (id_column, label)]
    return df.select(F.col(id_column).alias("id"), F.array(*[F.col(c).cast("double") for c in names]).alias("features"),
                     F.col(label).cast("int").alias("label"))


def available(df: DataFrame, wanted: list[str]) -> list[str]:
    return [c for c in wanted if c in df.columns]


def load_sources(plan: list[tuple[str, Callable[[], DataFrame], bool]],
                 row_no: str | None = None) -> tuple[list[DataFrame], list[str]]:
    """Unified corpora and the names of skipped ones.

    ``plan`` lists (name, loader, optional). A source that cannot be resolved while the plan is
    built, or that has no label column, is skipped when optional and an error otherwise.
    """
    usable, skipped = [], []
    for number, (name, loader, optional) in enumerate(plan):
        try:
            part = C.unify(loader(), name, number, row_no)
        except AnalysisException:
            if not optional:
                raise
            part = None
        if part is not None:
            usable.append(part)
        elif optional:
            skipped.append(name)
        else:
            raise ValueError(f"source {name} has no label column")
    return usable, skipped


def create_if_missing(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, built and written first when it does not exist."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        build().write.mode("errorifexists").parquet(path)
        return spark.read.parquet(path)
