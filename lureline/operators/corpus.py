"""Labelled mail corpora: one schema, union, keep-first deduplication, cleaning, profile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lureline.functions import text as T
from lureline.operators.ranking import medians, seeded_hash
from lureline.shared import materialise

UNIFIED = ["text_combined", "label", "source", "source_no", "row_no"]
# columns that the fallback does not join into the text
NO_TEXT = ["label", "urls", "sender", "receiver", "date"]


def subject_and_body(subject: Column, body: Column) -> Column:
    return F.concat(F.coalesce(subject, F.lit("")), F.lit(" "), F.coalesce(body, F.lit("")))


def combined_text(columns: list[str], excluded: list[str] = NO_TEXT) -> Column:
    """Mail text by the columns a corpus has; decided while the plan is built."""
    if "text_combined" in columns:
        return F.col("text_combined")
    if "subject" in columns and "body" in columns:
        return subject_and_body(F.col("subject"), F.col("body"))
    if "text" in columns:
        return F.col("text")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns if c not in excluded]
    return F.concat_ws(" ", *parts)


def unify(df: DataFrame, source: str, source_no: int, row_no: str | None = None,
          excluded: list[str] = NO_TEXT) -> DataFrame | None:
    """A corpus in the unified schema, or None when it has no label column."""
    if "label" not in df.columns:
        return None
    columns = [c for c in df.columns if c != row_no]
    position = F.col(row_no).cast("bigint") if row_no else F.monotonically_increasing_id()
    return df.select(
        combined_text(columns, excluded).alias("text_combined"), F.col("label").cast("int").alias("label"),
        F.lit(source).alias("source"), F.lit(source_no).alias("source_no"), position.alias("row_no"))


def union(corpora: list[DataFrame | None]) -> DataFrame:
    usable = [c for c in corpora if c is not None]
    if not usable:
        raise ValueError("no labelled corpus to combine")
    return reduce(lambda a, b: a.unionByName(b), usable)


def keep_first(df: DataFrame) -> DataFrame:
    """One row per text: the first in corpus order, then row order. Null texts are equal.

    One aggregation over digests of the texts, which combines on the map side, so a text with a third of all rows
    reaches the shuffle as one row per task. The input is evaluated once: row numbers that differ between two
    evaluations, as those of a shuffled corpus may, cannot lose or double a row.
    """
    digest = F.coalesce(F.sha2(F.col("text_combined").cast("binary"), 256), F.lit("")).alias("_digest")
    row = F.struct("text_combined", "label", "source", "source_no", "row_no")
    return df.groupBy(digest).agg(F.min_by(row, F.struct("source_no", "row_no")).alias("r")).select("r.*")


def combine(corpora: list[DataFrame | None]) -> DataFrame:
    return keep_first(union(corpora))


def is_blank(c: Column) -> Column:
    return T.strip(c) == ""


def clean(df: DataFrame, drop_null_text: bool = False) -> DataFrame:
    """Rows with a label and a text that is not blank; null texts stay unless asked for."""
    text = F.col("text_combined")
    keep = ~is_blank(text) if drop_null_text else text.isNull() | ~is_blank(text)
    return df.filter(F.col("label").isNotNull() & keep)


def sample(df: DataFrame, n: int = 1000, seed: int = 42, id_column: str = "row_no") -> DataFrame:
    """A repeatable random sample of n rows: the first n in hash order."""
    order = seeded_hash(id_column, seed)
    return df.orderBy(order, F.col(id_column)).limit(n)


def profile(df: DataFrame) -> DataFrame:
    """One row: text length mean, median and range, empty texts and missing labels with shares."""
    measured = df.select(F.length("text_combined").alias("n"), "label",
                         (F.col("text_combined").isNull() | is_blank(F.col("text_combined"))).alias("empty"))
    # equal combinations are counted once; mean and median then read the small table that this writes
    counted = materialise(measured.groupBy("n", "label", "empty").agg(F.count("*").alias("rows")), "profile")
    with_text = F.when(F.col("n").isNotNull(), F.col("rows"))
    base = counted.agg(
        F.sum("rows").alias("rows"), (F.sum(F.col("n") * with_text) / F.sum(with_text)).alias("mean_length"),
        F.min("n").alias("min_length"), F.max("n").alias("max_length"),
        F.coalesce(F.sum(F.when(F.col("empty"), F.col("rows"))), F.lit(0)).alias("empty_texts"),
        F.coalesce(F.sum(F.when(F.col("label").isNull(), F.col("rows"))), F.lit(0)).alias("missing_labels"))
    middle = medians(counted.select(F.lit("n").alias("column"), F.col("n").alias("value"), "rows"), count="rows")
    return base.select(
        "rows", "mean_length", middle.select("median").scalar().alias("median_length"), "min_length",
        "max_length", "empty_texts", (F.col("empty_texts") * 100.0 / F.col("rows")).alias("empty_pct"),
        "missing_labels", (F.col("missing_labels") * 100.0 / F.col("rows")).alias("missing_pct"))


def class_totals(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows, phishing and legitimate counts and their ratio."""
    ones = F.count(F.when(F.col(label) == 1, 1))
    zeros = F.count(F.when(F.col(label) == 0, 1))
    return df.agg(F.count("*").alias("rows"), ones.alias("phishing"), zeros.alias("legitimate"),
                  F.try_divide(ones, zeros).alias("ratio"))
