"""Rule tags and phishing confidence of mails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lureline import fixed_values as V
from lureline.functions import text as T
from lureline.functions import urls as U
from lureline.shared import once


def confidence(features: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted feature sum clamped to [0, 1]; a missing feature counts as absent."""
    score = F.lit(0.0)
    for name, weight in (weights or V.CONFIDENCE_WEIGHTS).items():
        if name in features:
            score = score + F.coalesce(features[name], F.lit(0)) * F.lit(weight)
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def tags(text_struct: Column, url_struct: Column) -> Column:
    rules = [
        ("high_urgency", text_struct["urgency_score"] > 0.3),
        ("contains_threats", text_struct["threat_score"] > 0.3),
        ("financial_content", text_struct["financial_score"] > 0.3),
        ("spelling_errors", text_struct["misspelling_score"] > 0),
        ("ip_address_url", url_struct["has_ip"] == 1),
        ("suspicious_domain", url_struct["suspicious_tld"] == 1),
        ("shortened_url", url_struct["shortening_service"] == 1),
    ]
    return F.array_compact(F.array(*[F.when(rule, F.lit(tag)) for tag, rule in rules]))


def level(conf: Column) -> Column:
    return F.when(conf >= 0.7, "high").when(conf >= 0.4, "medium").otherwise("low")


def tag_table(
    df: DataFrame, text_column: str, url_column: str | None = None,
    sentiment: tuple[str, str, str] | None = None, misspelled: str | None = None,
) -> DataFrame:
    """Adds automated_tags, confidence_score, risk_level, text_features and url_features.

    Row local, no shuffle; a text is brought to lower case once. ``sentiment`` and ``misspelled`` name columns that
    the lexicon operators added.
    """
    text = F.col(text_column)
    url = F.col(url_column) if url_column else F.lit(None).cast("string")
    mood = tuple(F.col(c) for c in sentiment) if sentiment else None
    wrong = F.col(misspelled) if misspelled else None
    out = once(df, {"_low": F.lower(text)}).withColumns({
        "text_features": F.when(F.length(text) > 0, T.text_features(text, mood, wrong, lowered=F.col("_low"))),
        "url_features": F.when(F.length(url) > 0, U.tagger_url_features(url)),
    })
    texts, links = F.col("text_features"), F.col("url_features")
    known = {n: texts[n] for n in T.TEXT_FEATURES}
    known.update({n: links[n] for n in
                  ("has_ip", "suspicious_tld", "has_at_symbol", "shortening_service")})
    out = out.withColumn("confidence_score", confidence(known))
    return out.withColumns({
        "automated_tags": tags(texts, links), "risk_level": level(F.col("confidence_score")),
    }).drop("_low")


def risk_distribution(tagged: DataFrame) -> DataFrame:
    """Rows and share per risk level. The window runs over at most three grouped rows."""
    counts = tagged.groupBy("risk_level").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("risk_level", "n", F.round(F.col("n") * 100.0 / total, 6).alias("pct"))
