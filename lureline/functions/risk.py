"""Risk tiers: from a phishing probability to level, score, advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lureline import fixed_values as V

TIER_SCHEMA = (
    "level string, color string, icon string, urgency string, recommendation string, "
    "description string, why_risky string, action_items array<string>, "
    "warning_signs array<string>, tactics array<string>, immediate array<string>"
)


def risk_level(p: Column) -> Column:
    return F.when(p <= 0.3, "low").when(p <= 0.7, "medium").otherwise("high")


def risk_score(p: Column) -> Column:
    return F.least(F.lit(100), (p.cast("double") * 100).cast("int"))


def confidence_level(p: Column) -> Column:
    best = F.greatest(p, 1 - p)
    return F.when(best >= 0.8, "high").when(best >= 0.6, "medium").otherwise("low")


def threat_level(p: Column) -> Column:
    chain = F
    for limit, name in V.THREAT_STEPS[:-1]:
        chain = chain.when(p <= limit, name)
    return chain.otherwise(V.THREAT_STEPS[-1][1])


def tier_table(spark: SparkSession) -> DataFrame:
    """The three constant tiers, one row each."""
    names = [c.split(" ")[0] for c in TIER_SCHEMA.split(", ")][1:]
    rows = [(lvl, *[tier[n] for n in names]) for lvl, tier in V.TIERS.items()]
    return spark.createDataFrame(rows, TIER_SCHEMA)


def assess(df: DataFrame, probability: str = "probability") -> DataFrame:
    """Adds level, score, confidence level, threat level and the tier's texts.

    The tier table has three rows, so the broadcast is always small and nothing shuffles.
    """
    p = F.col(probability)
    tiers = F.broadcast(tier_table(df.sparkSession))
    return df.withColumns({
        "level": risk_level(p), "score": risk_score(p),
        "confidence_level": confidence_level(p), "threat_level": threat_level(p),
    }).join(tiers, "level", "left")


def detailed(df: DataFrame, probability: str = "probability") -> DataFrame:
    """``assess`` plus the nested analysis record."""
    p = F.col(probability)
    texts = F.array(*[F.lit(t) for t in V.PREVENTION_TIPS])
    resources = F.struct(*[F.lit(v).alias(k) for k, v in V.HELPFUL_RESOURCES.items()])
    return assess(df, probability).withColumns({
        "severity_indicators": F.struct(
            "color", "icon", "urgency", F.col("confidence_level").alias("confidence")),
        "risk_breakdown": F.struct(
            p.alias("technical_score"),
            F.concat((p.cast("double") * 100).cast("int").cast("string"), F.lit("/100"))
            .alias("user_friendly_score"),
            F.initcap("level").alias("risk_category"), F.col("threat_level")),
        "explanation": F.struct(
            "why_risky", F.col("warning_signs").alias("what_to_look_for"),
            F.col("tactics").alias("how_phishers_work")),
        "next_steps": F.struct("immediate", texts.alias("prevention"),
                               resources.alias("resources")),
    })
