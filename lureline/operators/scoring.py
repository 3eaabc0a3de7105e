"""Scoring records with a fitted model: verdicts, batch errors, model info, analysis rows."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lureline import fixed_values as V
from lureline.functions import messages as MSG
from lureline.functions import risk
from lureline.operators import models as M
from lureline.operators import pages as P
from lureline.shared import once

INDICATORS = "array<struct<name string, importance double>>"


def indicators(trained: M.Trained, names: list[str] = V.FEATURE_NAMES, n: int = 5) -> Column:
    """The model's top features as a constant; the same for every row."""
    ranked = sorted(zip(names, M.importance(trained) or []), key=lambda r: (-r[1], r[0]))[:n]
    if not ranked:
        return F.array().cast(INDICATORS)
    return F.array(*[F.struct(F.lit(a).alias("name"), F.lit(float(b)).alias("importance")) for a, b in ranked])


def predict(df: DataFrame, trained: M.Trained, names: list[str] = V.FEATURE_NAMES, features: str = "features") -> DataFrame:
    """Adds is_phishing, probability, confidence, model_used, top_features and error.

    Rows with a missing, wrongly sized or non-numeric feature array stay in the result: verdict
    null, error set. ``features`` is an array column.
    """
    size = len(names)
    values = F.col(features).cast("array<double>")
    bad = F.exists(values, lambda v: v.isNull() | F.isnan(v))
    error = (
        F.when(values.isNull(), "no features")
        .when(F.size(values) != size, F.concat(F.lit("expected "), F.lit(str(size)), F.lit(" features")))
        .when(bad, "feature is not a number"))
    filled = F.when(F.col("error").isNull(), values).otherwise(F.array_repeat(F.lit(0.0), size))
    keep = [c for c in df.columns if c != features]
    ready = df.withColumn("error", error)
    ready = ready.select(*keep, F.col(features).alias("_given"), "error", array_to_vector(filled).alias("features"))
    scored = trained.score(ready)
    fine = F.col("error").isNull()
    p = F.col("probability")
    return scored.select(
        *keep, F.col("_given").alias(features), F.when(fine, F.col("prediction") == 1).alias("is_phishing"),
        F.when(fine, p).alias("probability"), F.when(fine, F.greatest(p, 1 - p)).alias("confidence"),
        F.lit(trained.name).alias("model_used"), indicators(trained, names).alias("top_features"), "error")


def model_info(spark: SparkSession, trained: M.Trained, n_features: int) -> DataFrame:
    """One row: name, type, features expected, trees and depth where the model has them."""
    model = trained.model
    stage = model.stages[-1] if isinstance(model, PipelineModel) else model
    trees = stage.getNumTrees if hasattr(stage, "getNumTrees") else None
    depth = stage.getOrDefault("maxDepth") if hasattr(stage, "maxDepth") else None
    row = (trained.name, type(stage).__name__, n_features, trees, depth)
    return spark.createDataFrame([row], "model_name string, model_type string, features_expected int, trees int, max_depth int")


def load_first(spark: SparkSession, registry: list[tuple[str, str, type]]) -> M.Trained:
    """The first model of (name, path, class) that can be loaded."""
    problems = []
    for name, path, kind in registry:
        try:
            return M.load(spark, name, path, kind)
        except Exception as e:  # a missing or broken model leads to the next one
            problems.append(f"{name}: {type(e).__name__}")
    raise ValueError(f"no model could be loaded: {problems}")


def analyze(df: DataFrame, trained: M.Trained, content: str = "content", content_type: str = "type",
            html: str | None = None, features: str | None = None) -> DataFrame:
    """Full analysis row per content: verdict, risk, indicators, recommendation and reply.

    ``confidence`` is the phishing probability; ``class_confidence``, the probability of the chosen
    class, is what the reply quotes.
    """
    keep = [c for c in df.columns if c not in ("error", features)]
    if features is None:
        features = "_vector"
        df = P.content_vector(df, content, content_type, features, html)
    scored = predict(df, trained, features=features)
    p = F.col("probability")
    advised = risk.assess(scored.withColumn("probability", F.coalesce(p, F.lit(0.0))).withColumn("_fine", p.isNotNull()))
    fine = F.col("_fine")
    names = F.transform("top_features", lambda t: t["name"])
    response = MSG.reply(F.col("level"), F.col("is_phishing"), F.col("confidence"), F.col("recommendation"), names)
    return advised.select(
        *keep, "is_phishing", F.when(fine, F.col("probability")).alias("confidence"),
        F.col("confidence").alias("class_confidence"), F.when(fine, F.col("level")).alias("risk_level"),
        F.when(fine, F.col("score")).alias("risk_score"), F.col("top_features").alias("indicators"),
        F.when(fine, F.col("recommendation")).alias("recommendation"), F.when(fine, response).alias("response"), "error")


def chat(df: DataFrame, trained: M.Trained, message: str = "message", html: str | None = None) -> DataFrame:
    """Routes each message and analyses the ones that carry something to analyse.

    ``html`` holds the captured page of the message's link, null where there is none.
    """
    routed = once(df, {"_r": MSG.route(F.col(message))})
    routed = routed.withColumns({
        "route": F.col("_r.route"), "requires_analysis": F.col("_r.requires_analysis"),
        "extracted_content": F.col("_r.extracted_content"), "content_type": F.col("_r.content_type"),
        "reply": F.col("_r.message")}).drop("_r")
    done = analyze(routed, trained, "extracted_content", "content_type", html)
    shown = F.struct("is_phishing", "confidence", "risk_level", "risk_score", "recommendation")
    return done.select(*df.columns, "route", "requires_analysis", "extracted_content", "content_type", "reply",
                       F.when(F.col("requires_analysis"), shown).alias("analysis"))
