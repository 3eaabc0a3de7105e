"""Sinks: cleaned tables, prepared splits, JSON reports, feedback log, models with score tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEEDBACK_SCHEMA = "content string, predicted string, actual string, user_comment string"


def write_csv(df: DataFrame, path: str) -> None:
    """CSV that keeps quotes, line breaks and blanks; an empty cell reads back as null."""
    df.write.options(header=True, quote='"', escape='"', quoteAll=False,
                     ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_splits(df: DataFrame, path: str) -> None:
    """Prepared rows partitioned by split, so a later read of one split prunes the others."""
    write_table(df, path, ["split"])


def write_report(long: DataFrame, path: str) -> None:
    """A long report table as JSON lines; reports are small by construction."""
    long.coalesce(1).write.mode("errorifexists").json(path)


def write_metadata(spark: SparkSession, path: str, **values: object) -> None:
    """Names, counts and settings of a prepared data set as one JSON document."""
    import json

    text = json.dumps(values)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def read_metadata(spark: SparkSession, path: str) -> dict:
    import json

    return json.loads(spark.read.text(path).first()["value"])


def append_feedback(feedback: DataFrame, path: str) -> None:
    columns = [c.split(" ")[0] for c in FEEDBACK_SCHEMA.split(", ")]
    feedback.select(*[F.col(c).cast("string") for c in columns]).write.mode("append").parquet(path)


def save_model(model, scores: DataFrame | None, path: str) -> None:
    """An ML model and, beside it, its score table."""
    model.write().save(f"{path}/model")
    if scores is not None:
        scores.write.mode("errorifexists").parquet(f"{path}/scores")
