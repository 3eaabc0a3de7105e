"""Classification metrics as aggregates over prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lureline.functions import inference
from lureline.operators.ranking import running_totals

METRICS = ["accuracy", "precision", "recall", "f1"]


def _safe(a: Column, b: Column) -> Column:
    """Quotient, 0 when the denominator is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion_columns(label: Column, prediction: Column) -> list[Column]:
    def n(actual: int, guess: int) -> Column:
        return F.count(F.when((label == actual) & (prediction == guess), 1))

    return [n(0, 0).alias("tn"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(1, 1).alias("tp")]


def metric_columns() -> dict[str, Column]:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return {
        "accuracy": _safe(tp + tn, tp + tn + fp + fn), "precision": _safe(tp, tp + fp),
        "recall": _safe(tp, tp + fn), "f1": _safe(2 * tp, 2 * tp + fp + fn)}


def binary_metrics(df: DataFrame, by: list[str] | None = None, label: str = "label",
                   prediction: str = "prediction") -> DataFrame:
    """Confusion counts and accuracy, precision, recall, F1 (class 1 positive) per group."""
    counts = df.groupBy(*(by or [])).agg(*confusion_columns(F.col(label), F.col(prediction)))
    return counts.withColumns(metric_columns())


def _score_counts(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """Equal scores counted once, so ties and popular scores cost one row each."""
    y = F.col(label)
    return df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.count(F.when(y == 1, 1)).alias("pos"), F.count(F.when(y == 0, 1)).alias("neg"))


def roc_auc(df: DataFrame, by: list[str], label: str = "label", score: str = "probability") -> DataFrame:
    """Exact area under the ROC curve: share of ordered pairs, ties counted half."""
    ranked = running_totals(_score_counts(df, by, label, score), by, "score", ["neg"])
    wins = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.groupBy(*by).agg(F.try_divide(wins, pairs).alias("roc_auc"))


def roc_points(df: DataFrame, by: list[str], label: str = "label", score: str = "probability") -> DataFrame:
    """One ROC point per distinct score, taken as the threshold."""
    counts = _score_counts(df, by, label, score)
    ranked = running_totals(counts, by, "score", ["pos", "neg"], descending=True)
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    tp, fp = F.col("before_pos") + F.col("pos"), F.col("before_neg") + F.col("neg")
    return ranked.join(totals, by).select(
        *by, F.col("score").alias("threshold"), F.try_divide(fp, F.col("_n")).alias("fpr"),
        F.try_divide(tp, F.col("_p")).alias("tpr"))


def class_report(df: DataFrame, by: list[str] | None = None, label: str = "label",
                 prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, and macro and weighted averages."""
    by = by or []
    cells = df.groupBy(*by, F.col(label).cast("string").alias("_y"),
                       F.col(prediction).cast("string").alias("_p")).agg(F.count("*").alias("_n"))
    hit = F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("_y").alias("class"), F.col("_n").alias("support"), zero.alias("guessed"), hit.alias("tp")),
        F.struct(F.col("_p").alias("class"), zero.alias("support"), F.col("_n").alias("guessed"), zero.alias("tp")))
    sums = cells.select(*by, F.explode(sides).alias("s")).select(*by, "s.*").groupBy(*by, "class").agg(
        F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("tp").alias("tp"))
    classes = sums.select(
        *by, "class", _safe(F.col("tp"), F.col("guessed")).alias("precision"),
        _safe(F.col("tp"), F.col("support")).alias("recall"),
        _safe(2 * F.col("tp"), F.col("guessed") + F.col("support")).alias("f1"), "support")
    scores = ["precision", "recall", "f1"]
    weight = F.sum("support").cast("double")
    macro = classes.groupBy(*by).agg(
        F.lit("macro avg").alias("class"), *[F.avg(m).alias(m) for m in scores], F.sum("support").alias("support"))
    weighted = classes.groupBy(*by).agg(
        F.lit("weighted avg").alias("class"), *[(F.sum(F.col(m) * F.col("support")) / weight).alias(m) for m in scores],
        F.sum("support").alias("support"))
    return classes.unionByName(macro).unionByName(weighted)


def to_long(df: DataFrame, by: list[str], metrics: list[str] = METRICS) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(*by, F.explode(cells).alias("s")).select(*by, "s.metric", "s.value")


def fold_summary(scores: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Mean and population deviation over folds."""
    return scores.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
                                   F.count(value).alias("folds"))


def confidence_intervals(scores: DataFrame, by: list[str], value: str = "value", confidence: float = 0.95) -> DataFrame:
    """t interval of the mean over folds, from the population deviation; null bounds for a single fold."""
    s = fold_summary(scores, by, value)
    quantile = inference.t_quantile_of(F.lit(confidence), F.col("folds") - 1)
    half = quantile * F.col("std") / F.sqrt("folds")
    return s.select(*by, "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def paired_tests(first: DataFrame, second: DataFrame, fold: str = "fold", value: str = "value",
                 significance: float = 0.05) -> DataFrame:
    """Paired t and Wilcoxon signed-rank tests of two models over the same folds, with p-values.

    Zero differences leave the rank test; equal sizes share their mean rank. Where a statistic is
    unknown (one fold, equal differences, no difference at all) its p-value and verdict are null.
    """
    pairs = first.select(fold, F.col(value).alias("_a")).join(
        second.select(fold, F.col(value).alias("_b")), fold)
    diffs = pairs.select(F.round(F.col("_a") - F.col("_b"), 12).alias("d"))
    t_part = diffs.agg(F.count("*").alias("n"), F.avg("d").alias("mean_difference"),
                       F.try_divide(F.avg("d"), F.stddev_samp("d") / F.sqrt(F.count("*"))).alias("t_statistic"))
    size = F.abs("d")
    nonzero = diffs.filter("d <> 0")
    # one row per fold: the windows below run over a handful of rows
    equal = F.count("*").over(Window.partitionBy(size))
    ranked = nonzero.withColumn("_r", F.rank().over(Window.partitionBy(F.lit(0)).orderBy(size)) + (equal - 1) / 2)
    ranked = ranked.withColumn("_t", equal * equal - 1)  # summed over the rows of a tie: t^3 - t
    plus = F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("_r"))), F.lit(0.0))
    minus = F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("_r"))), F.lit(0.0))
    w = ranked.agg(F.struct(F.count("*").alias("n"), F.least(plus, minus).alias("w"), F.sum("_t").alias("ties"))
                   .alias("s")).scalar()
    both = t_part.withColumn("_w", w)
    both = both.select("n", "mean_difference", "t_statistic",
                       inference.t_p_value_of("t_statistic", F.col("n") - 1).alias("t_p_value"),
                       F.col("_w.w").alias("wilcoxon_statistic"),
                       inference.signed_rank_p_value_of("_w.w", "_w.n", "_w.ties").alias("wilcoxon_p_value"))
    return both.select("n", "mean_difference", "t_statistic", "t_p_value",
                       (F.col("t_p_value") < significance).alias("t_significant"), "wilcoxon_statistic",
                       "wilcoxon_p_value", (F.col("wilcoxon_p_value") < significance).alias("wilcoxon_significant"))


def fold_distribution(scores: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Box-plot numbers over folds; a group holds one value per fold, so the exact percentile is small."""
    q = F.percentile(value, [0.25, 0.5, 0.75])
    return scores.groupBy(*by).agg(
        F.min(value).alias("min"), q.alias("_q"), F.max(value).alias("max")).select(
        *by, "min", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"), "max")


def result_log(df: DataFrame, expected: str = "expected", predicted: str = "is_phishing",
               confidence: str = "confidence") -> DataFrame:
    """Per expected class and overall: tested, correct, accuracy %, mean confidence."""
    right = F.count(F.when(F.col(predicted) == F.col(expected), 1))
    per_class = df.groupBy(F.when(F.col(expected), "phishing").otherwise("legitimate").alias("group")).agg(
        F.count("*").alias("tested"), right.alias("correct"), F.avg(confidence).alias("mean_confidence"))
    overall = per_class.agg(
        F.lit("overall").alias("group"), F.sum("tested").alias("tested"), F.sum("correct").alias("correct"),
        (F.sum(F.col("mean_confidence") * F.col("tested")) / F.sum("tested")).alias("mean_confidence"))
    return per_class.unionByName(overall).withColumn("accuracy_pct", _safe(F.col("correct") * 100, F.col("tested")))


def prediction_counters(df: DataFrame, predicted: str = "is_phishing") -> DataFrame:
    """Totals and rates of verdicts; rates are 0 for an empty table. Works on streams too."""
    counts = df.groupBy().agg(
        F.count("*").alias("total_predictions"), F.count(F.when(F.col(predicted), 1)).alias("phishing_detected"),
        F.count(F.when(~F.col(predicted), 1)).alias("legitimate_detected"))
    return counts.withColumns({
        "phishing_rate": _safe(F.col("phishing_detected"), F.col("total_predictions")),
        "legitimate_rate": _safe(F.col("legitimate_detected"), F.col("total_predictions"))})


def leaderboard(scores: DataFrame, score: str = "val_f1", name: str = "model") -> DataFrame:
    """Models by score, best first, missing scores last; equal scores by name."""
    return scores.orderBy(F.desc_nulls_last(score), name)


def best_model(scores: DataFrame, score: str = "f1", name: str = "model") -> DataFrame:
    return scores.agg(F.max_by(name, F.struct(score, name)).alias(name), F.max(score).alias(score))


def feedback_agreement(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("predicted", "actual").agg(F.count("*").alias("n"))
