"""Ensembles: voting, weight search, stacking and blending over probability columns."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METHODS = ("voting", "weighted_voting", "stacking", "blending")


def vote(df: DataFrame, probabilities: list[str], voting: str = "soft",
         weights: list[float] | None = None) -> DataFrame:
    """Adds ``probability`` (soft) and ``prediction`` from the class 1 probability columns.

    Soft is the weighted mean; hard is the majority of verdicts, ties going to class 0.
    """
    if not probabilities:
        raise ValueError("an ensemble needs at least one model")
    weights = weights or [1.0] * len(probabilities)
    if len(weights) != len(probabilities):
        raise ValueError("number of weights must match number of models")
    if voting == "hard":
        yes = sum((F.when(F.col(p) > 0.5, w).otherwise(0.0) for p, w in zip(probabilities, weights)), F.lit(0.0))
        share = yes / sum(weights)
    elif voting == "soft":
        share = _mean(probabilities, weights)
    else:
        raise ValueError(f"unknown voting {voting}")
    return df.withColumn("probability", share).withColumn(
        "prediction", F.when(F.col("probability") > 0.5, 1).otherwise(0))


def _mean(probabilities: list[str], weights: list[float]) -> Column:
    total = None
    for p, w in zip(probabilities, weights):
        term = F.col(p) * F.lit(float(w)) if w != 1.0 else F.col(p)
        total = term if total is None else total + term
    return total / F.lit(float(sum(weights)))


def contributions(df: DataFrame, probabilities: list[str], keep: list[str],
                  weights: list[float] | None = None) -> DataFrame:
    """Each model's probability beside the ensemble's."""
    if not probabilities:
        raise ValueError("an ensemble needs at least one model")
    return vote(df, probabilities, "soft", weights).select(*keep, *probabilities, F.col("probability").alias("ensemble"))


def weight_draws(n_trials: int, n_models: int, seed: int = 42) -> list[list[float]]:
    """Repeatable uniform Dirichlet draws: normalised exponentials of hashed numbers."""
    draws = []
    for trial in range(n_trials):
        raw = []
        for model in range(n_models):
            digest = hashlib.md5(f"{seed}|{trial}|{model}".encode()).hexdigest()
            raw.append(-math.log((int(digest[:8], 16) + 1) / 4294967297.0))
        draws.append([r / sum(raw) for r in raw])
    return draws


def score_draws(df: DataFrame, probabilities: list[str], label: str, draws: list[list[float]]) -> DataFrame:
    """Confusion counts and F1 per weight draw, all draws in one pass over the data.

    A task weighs its rows by every draw and hands on three counts for each; no row is repeated. Rows without a
    label, or without one of the probabilities, count nowhere.
    """
    table = np.array(draws, dtype=float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, len(table)), np.int64)
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False)
            score = np.zeros((batch.num_rows, len(table)))
            for k in range(len(probabilities)):  # term by term, as a sum of columns would be
                term = batch.column(f"p{k}").to_numpy(zero_copy_only=False)[:, None] * table[None, :, k]
                score = term if k == 0 else score + term
            hit, known = score > 0.5, ~np.isnan(score)
            one, zero = (y == 1)[:, None], (y == 0)[:, None]
            total += np.stack([(hit & one).sum(0), (hit & zero).sum(0), (~hit & known & one).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(table)), pa.int32()), *map(pa.array, total)], ["trial", "tp", "fp", "fn"])

    rows = df.select(F.col(label).cast("double").alias("y"), *[F.col(p).cast("double").alias(f"p{k}") for k, p in enumerate(probabilities)])
    counts = rows.mapInArrow(run, "trial int, tp long, fp long, fn long").groupBy("trial").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    weights = F.array(*[F.array(*[F.lit(w) for w in ws]) for ws in draws])
    tp = F.col("tp")
    f1 = F.coalesce(F.try_divide((2 * tp).cast("double"), (2 * tp + F.col("fp") + F.col("fn")).cast("double")), F.lit(0.0))
    return counts.select("trial", F.get(weights, F.col("trial")).alias("weights"), "tp", "fp", "fn", f1.alias("f1"))


def best_weights(df: DataFrame, probabilities: list[str], label: str, n_trials: int = 100, seed: int = 42) -> DataFrame:
    """One row: the draw with the best F1, the earliest of equals; uniform when every F1 is 0."""
    n = len(probabilities)
    scored = score_draws(df, probabilities, label, weight_draws(n_trials, n, seed))
    best = scored.orderBy(F.desc("f1"), "trial").limit(1)
    uniform = F.array(*[F.lit(1.0 / n)] * n)
    return best.select(
        F.when(F.col("f1") > 0, F.col("trial")).alias("trial"), "f1",
        F.when(F.col("f1") > 0, F.col("weights")).otherwise(uniform).alias("weights"))


def blend(df: DataFrame, probabilities: list[str], label: str = "label", meta=None) -> Model:
    """Meta model over the base probabilities of a held-out set (default logistic regression)."""
    if not probabilities:
        raise ValueError("an ensemble needs at least one model")
    meta = meta or LogisticRegression()
    assembled = VectorAssembler(inputCols=probabilities, outputCol="_meta").transform(df)
    meta = meta.copy().setFeaturesCol("_meta").setLabelCol(label)
    return meta.fit(assembled.withColumn(label, F.col(label).cast("double")))


def apply_meta(model: Model, df: DataFrame, probabilities: list[str]) -> DataFrame:
    """Adds ``probability`` and ``prediction`` of a meta model, keeping the input columns."""
    assembled = VectorAssembler(inputCols=probabilities, outputCol="_meta").transform(df)
    scored = model.setProbabilityCol("_probability").setPredictionCol("_prediction").transform(assembled)
    return scored.select(*df.columns, vector_to_array("_probability")[1].alias("probability"),
                         F.col("_prediction").cast("int").alias("prediction"))
