"""Metric, leaderboard and vote queries over repeatable pseudo predictions of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import inputs as I
from lureline.operators import ensemble as E
from lureline.operators import metrics as M
from lureline.operators import prep as P
from lureline.operators.ranking import hash_rank

FOLDS = 10


def _rounded(df: DataFrame, columns: list[str], digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def agg14_binary_metrics(spark, sf_dir) -> DataFrame:
    return _rounded(M.binary_metrics(I.long_predictions(spark, sf_dir), ["model"]), M.METRICS)


def agg15_roc_auc(spark, sf_dir) -> DataFrame:
    return _rounded(M.roc_auc(I.long_predictions(spark, sf_dir), ["model"]), ["roc_auc"])


def agg15_roc_points(spark, sf_dir) -> DataFrame:
    return _rounded(M.roc_points(I.long_predictions(spark, sf_dir), ["model"]), ["threshold", "fpr", "tpr"])


def agg16_class_report(spark, sf_dir) -> DataFrame:
    return _rounded(M.class_report(I.long_predictions(spark, sf_dir), ["model"]), ["precision", "recall", "f1"])


def _fold_scores(spark, sf_dir) -> DataFrame:
    """(model, fold, metric, value): metrics of each model on each stratified fold."""
    folds = P.assign_folds(I.predictions(spark, sf_dir), "doc_id", "label", FOLDS).select("doc_id", "fold")
    rows = I.long_predictions(spark, sf_dir).join(folds, "doc_id")
    return M.to_long(M.binary_metrics(rows, ["model", "fold"]), ["model", "fold"])


def agg17_fold_summary(spark, sf_dir) -> DataFrame:
    return _rounded(M.fold_summary(_fold_scores(spark, sf_dir), ["model", "metric"]), ["mean", "std"])


def cv5_confidence_intervals(spark, sf_dir) -> DataFrame:
    c = M.confidence_intervals(_fold_scores(spark, sf_dir), ["model", "metric"])
    return _rounded(c, ["mean", "low", "high"])


def cv6_jn1_paired_tests(spark, sf_dir) -> DataFrame:
    f1 = _fold_scores(spark, sf_dir).filter("metric = 'f1'")
    t = M.paired_tests(f1.filter("model = 'alpha'"), f1.filter("model = 'beta'"))
    return _rounded(t, ["mean_difference", "t_statistic", "wilcoxon_statistic"], 6).drop("t_p_value", "wilcoxon_p_value")


def cv8_fold_distribution(spark, sf_dir) -> DataFrame:
    d = M.fold_distribution(_fold_scores(spark, sf_dir), ["model", "metric"])
    return _rounded(d, ["min", "q1", "median", "q3", "max"])


def _split_scores(spark, sf_dir) -> DataFrame:
    """Leaderboard rows: train accuracy and validation scores; gamma has no validation."""
    splits = P.stratified_split(I.predictions(spark, sf_dir), "doc_id", "label").select("doc_id", "split")
    m = M.binary_metrics(I.long_predictions(spark, sf_dir).join(splits, "doc_id"), ["model", "split"])
    shown = (F.col("split") == "val") & (F.col("model") != "gamma")
    return m.groupBy("model").agg(
        F.max(F.when(F.col("split") == "train", F.col("accuracy"))).alias("train_accuracy"),
        *[F.max(F.when(shown, F.col(c))).alias(f"val_{c}") for c in M.METRICS])


def srt1_leaderboard(spark, sf_dir) -> DataFrame:
    board = M.leaderboard(_split_scores(spark, sf_dir))
    return _rounded(board, ["train_accuracy", *[f"val_{c}" for c in M.METRICS]])


def srt8_best_of_leaderboard(spark, sf_dir) -> DataFrame:
    return M.leaderboard(_split_scores(spark, sf_dir)).limit(1).select("model", F.round("val_f1", 9).alias("val_f1"))


def srt2_cv_leaderboard(spark, sf_dir) -> DataFrame:
    s = M.fold_summary(_fold_scores(spark, sf_dir).filter("metric = 'f1'"), ["model"])
    return M.leaderboard(s.select("model", F.round("mean", 9).alias("f1_mean"), F.round("std", 9).alias("f1_std")), "f1_mean")


def srt7_best_on_test(spark, sf_dir) -> DataFrame:
    splits = P.stratified_split(I.predictions(spark, sf_dir), "doc_id", "label").filter("split = 'test'")
    rows = I.long_predictions(spark, sf_dir).join(splits.select("doc_id"), "doc_id")
    return M.best_model(M.binary_metrics(rows, ["model"])).withColumn("f1", F.round("f1", 9))


def snk7_result_log(spark, sf_dir) -> DataFrame:
    rows = I.predictions(spark, sf_dir).select(
        (F.col("label") == 1).alias("expected"), (F.col("p_alpha") > 0.5).alias("is_phishing"),
        (F.col("p_alpha") * 100).alias("confidence"))
    return _rounded(M.result_log(rows), ["mean_confidence", "accuracy_pct"], 6)


def agg13_prediction_counters(spark, sf_dir) -> DataFrame:
    rows = I.predictions(spark, sf_dir).select((F.col("p_alpha") > 0.5).alias("is_phishing"))
    return _rounded(M.prediction_counters(rows), ["phishing_rate", "legitimate_rate"])


PROBS = [f"p_{m}" for m in I.MODELS]


def ens1_soft_voting(spark, sf_dir) -> DataFrame:
    v = E.vote(I.predictions(spark, sf_dir), PROBS)
    return v.select("doc_id", F.round("probability", 9).alias("probability"), "prediction")


def ens1_hard_voting(spark, sf_dir) -> DataFrame:
    return E.vote(I.predictions(spark, sf_dir), PROBS, voting="hard").select("doc_id", "prediction")


def ens2_weighted_voting(spark, sf_dir) -> DataFrame:
    v = E.vote(I.predictions(spark, sf_dir), PROBS, weights=[3.0, 2.0, 1.0])
    return v.select("doc_id", F.round("probability", 9).alias("probability"), "prediction")


def ens5_weight_search(spark, sf_dir) -> DataFrame:
    """F1 of 100 weight draws over all documents in one job."""
    t = E.score_draws(I.predictions(spark, sf_dir), PROBS, "label", E.weight_draws(100, 3))
    return t.select("trial", "tp", "fp", "fn", F.round("f1", 9).alias("f1"))


def ens5_best_weights(spark, sf_dir) -> DataFrame:
    b = E.best_weights(I.predictions(spark, sf_dir), PROBS, "label")
    return b.select("trial", F.round("f1", 9).alias("f1"),
                    F.transform("weights", lambda w: F.round(w, 9)).alias("weights"))


def ens7_contributions(spark, sf_dir) -> DataFrame:
    c = E.contributions(I.predictions(spark, sf_dir), PROBS, ["doc_id"])
    return c.select("doc_id", *[F.round(p, 9).alias(p) for p in PROBS], F.round("ensemble", 9).alias("ensemble"))


def cv1_win2_folds(spark, sf_dir) -> DataFrame:
    return P.assign_folds(I.predictions(spark, sf_dir), "doc_id", "label", 5).select("doc_id", "label", "fold")


def cv1_plain_folds(spark, sf_dir) -> DataFrame:
    return P.assign_folds(I.predictions(spark, sf_dir), "doc_id", None, 5).select("doc_id", "fold")


# ---- SQL ------------------------------------------------------------------------------------------------

def div(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0)"


CELLS = ("count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp, "
         "count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp")
METRIC_SQL = {"accuracy": div("(tp + tn)", "(tp + tn + fp + fn)"), "precision": div("tp", "(tp + fp)"),
              "recall": div("tp", "(tp + fn)"), "f1": div("(2 * tp)", "(2 * tp + fp + fn)")}


def metrics_sql(source: str, by: str) -> str:
    return (f"SELECT *, " + ", ".join(f"{e} AS {m}" for m, e in METRIC_SQL.items())
            + f" FROM (SELECT {by}, {CELLS} FROM {source} GROUP BY {by})")


RANKED = "row_number() OVER (PARTITION BY label ORDER BY md5('42|' || doc_id), doc_id)"
FOLDED = (f"{I.LONG_PREDICTIONS}, folds AS (SELECT doc_id, ({RANKED} - 1) % {FOLDS} AS fold FROM predictions), "
          "fold_rows AS (SELECT s.*, fold FROM scored s JOIN folds USING (doc_id)), fold_metrics AS ("
          + metrics_sql("fold_rows", "model, fold") + "), fold_scores AS ("
          + " UNION ALL ".join(f"SELECT model, fold, '{m}' AS metric, {m} AS value FROM fold_metrics" for m in METRIC_SQL) + ")")
SPLIT_CASE = ("CASE WHEN rk <= n_test THEN 'test' WHEN rk <= n_test + round((n - n_test) * (0.15::DOUBLE / 0.85::DOUBLE)) "
              "THEN 'val' ELSE 'train' END")
SPLITS = (f"ranked AS (SELECT doc_id, label, {RANKED} AS rk, count(*) OVER (PARTITION BY label) AS n, round(count(*) OVER "
          f"(PARTITION BY label) * 0.15::DOUBLE) AS n_test FROM predictions), splits AS (SELECT doc_id, {SPLIT_CASE} AS "
          "split FROM ranked)")
SPLIT_METRICS = (f"{I.LONG_PREDICTIONS}, {SPLITS}, split_rows AS (SELECT s.*, split FROM scored s JOIN splits USING "
                 f"(doc_id)), split_metrics AS ({metrics_sql('split_rows', 'model, split')}), board AS (SELECT model, "
                 "max(accuracy) FILTER (split = 'train') AS train_accuracy, "
                 + ", ".join(f"max({m}) FILTER (split = 'val' AND model <> 'gamma') AS val_{m}" for m in METRIC_SQL)
                 + " FROM split_metrics GROUP BY model)")
CLASSES = ("cells AS (SELECT model, CAST(label AS VARCHAR) AS y, CAST(prediction AS VARCHAR) AS p, count(*) AS n FROM scored "
           "GROUP BY ALL), per_class AS (SELECT model, c AS class, sum(n) FILTER (y = c) AS support, coalesce(sum(n) FILTER "
           "(p = c), 0) AS guessed, coalesce(sum(n) FILTER (y = c AND p = c), 0) AS tp FROM cells, (VALUES ('0'), ('1')) "
           "v(c) GROUP BY ALL), classes AS (SELECT model, class, " + div("tp", "guessed") + " AS precision, "
           + div("tp", "support") + " AS recall, " + div("2 * tp", "(guessed + support)")
           + " AS f1, CAST(support AS BIGINT) AS support FROM per_class)")


def r9(*columns: str) -> str:
    return ", ".join(f"round({c}, 9) AS {c}" for c in columns)


WEIGHT_RAW = "(-ln((CAST('0x' || md5('42|' || t || '|' || m)[1:8] AS BIGINT) + 1) / 4294967297.0::DOUBLE))"
DRAWS = (f"raw_draws AS (SELECT t, {', '.join(WEIGHT_RAW.replace(chr(39) + '|' + chr(39) + ' || m', chr(39) + '|' + str(m) + chr(39)) + f' AS e{m}' for m in range(3))} "
         "FROM range(100) r(t)), draws AS (SELECT t AS trial, e0 / (e0 + e1 + e2) AS w0, e1 / (e0 + e1 + e2) AS w1, "
         "e2 / (e0 + e1 + e2) AS w2 FROM raw_draws), trials AS (SELECT trial, w0, w1, w2, count(*) FILTER (s AND label = 1) "
         "AS tp, count(*) FILTER (s AND label = 0) AS fp, count(*) FILTER (NOT s AND label = 1) AS fn FROM (SELECT d.*, "
         "label, p_alpha * w0 + p_beta * w1 + p_gamma * w2 > 0.5::DOUBLE AS s FROM predictions, draws d) GROUP BY ALL), "
         "trial_scores AS (SELECT *, " + div("2 * tp", "(2 * tp + fp + fn)") + " AS f1 FROM trials)")

QUERIES = {f.__name__: f for f in (
    agg14_binary_metrics, agg15_roc_auc, agg15_roc_points, agg16_class_report, agg17_fold_summary,
    cv5_confidence_intervals, cv6_jn1_paired_tests, cv8_fold_distribution, srt1_leaderboard, srt8_best_of_leaderboard,
    srt2_cv_leaderboard, srt7_best_on_test, snk7_result_log, agg13_prediction_counters, ens1_soft_voting,
    ens1_hard_voting, ens2_weighted_voting, ens5_weight_search, ens5_best_weights, ens7_contributions,
    cv1_win2_folds, cv1_plain_folds)}

T9 = "2.2621571627409915::DOUBLE"  # 97.5 % point of Student t with 9 degrees of freedom
SQL = {
    "agg14_binary_metrics": (
        f"WITH {I.LONG_PREDICTIONS}, m AS ({metrics_sql('scored', 'model')}) SELECT model, tn, fp, fn, tp, {r9(*METRIC_SQL)} FROM m"),
    "agg15_roc_auc": (
        f"WITH {I.LONG_PREDICTIONS}, r AS (SELECT model, label, rank() OVER (PARTITION BY model ORDER BY probability) + "
        "(count(*) OVER (PARTITION BY model, probability) - 1) / 2 AS rk FROM scored) SELECT model, round((sum(rk) FILTER "
        "(label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / (CAST(count(*) FILTER "
        "(label = 1) AS DOUBLE) * count(*) FILTER (label = 0)), 9) AS roc_auc FROM r GROUP BY model"),
    "agg15_roc_points": (
        f"WITH {I.LONG_PREDICTIONS}, c AS (SELECT model, probability AS threshold, count(*) FILTER (label = 1) AS pos, "
        "count(*) FILTER (label = 0) AS neg FROM scored GROUP BY ALL) SELECT model, round(threshold, 9) AS threshold, "
        "round(sum(neg) OVER (PARTITION BY model ORDER BY threshold DESC) / sum(neg) OVER (PARTITION BY model), 9) AS fpr, "
        "round(sum(pos) OVER (PARTITION BY model ORDER BY threshold DESC) / sum(pos) OVER (PARTITION BY model), 9) AS tpr FROM c"),
    "agg16_class_report": (
        f"WITH {I.LONG_PREDICTIONS}, {CLASSES}, all_rows AS (SELECT * FROM classes UNION ALL SELECT model, 'macro avg', "
        "avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM classes GROUP BY model UNION ALL SELECT "
        "model, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * "
        "support) / sum(support), CAST(sum(support) AS BIGINT) FROM classes GROUP BY model) SELECT model, class, "
        f"{r9('precision', 'recall', 'f1')}, support FROM all_rows"),
    "agg17_fold_summary": (
        f"WITH {FOLDED} SELECT model, metric, round(avg(value), 9) AS mean, round(stddev_pop(value), 9) AS std, count(*) "
        "AS folds FROM fold_scores GROUP BY ALL"),
    "cv5_confidence_intervals": (
        f"WITH {FOLDED} SELECT model, metric, round(avg(value), 9) AS mean, round(avg(value) - {T9} * stddev_pop(value) / "
        f"sqrt(count(*)), 9) AS low, round(avg(value) + {T9} * stddev_pop(value) / sqrt(count(*)), 9) AS high FROM "
        "fold_scores GROUP BY ALL"),
    "cv6_jn1_paired_tests": (
        f"WITH {FOLDED}, d AS (SELECT round(a.value - b.value, 12) AS d FROM fold_scores a JOIN fold_scores b USING (fold, "
        "metric) WHERE metric = 'f1' AND a.model = 'alpha' AND b.model = 'beta'), t AS (SELECT count(*) AS n, avg(d) AS md, "
        "avg(d) / nullif(stddev_samp(d) / sqrt(count(*)), 0) AS t FROM d), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + "
        "(count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS rk FROM d WHERE d <> 0), w AS (SELECT least(coalesce(sum(rk) "
        "FILTER (d > 0), 0), coalesce(sum(rk) FILTER (d < 0), 0)) AS w, count(*) AS m, (SELECT coalesce(sum(c * c * c - c), 0) "
        "FROM (SELECT count(*) AS c FROM d WHERE d <> 0 GROUP BY abs(d))) AS ties FROM r) SELECT n, round(md, 6) AS "
        f"mean_difference, round(t, 6) AS t_statistic, abs(t) > {T9} AS t_significant, round(w, 6) AS "
        "wilcoxon_statistic, CASE WHEN m = 0 THEN NULL WHEN ties = 0 THEN w <= CASE m WHEN 6 THEN 0 WHEN 7 THEN 2 WHEN 8 THEN 3 "
        "WHEN 9 THEN 5 WHEN 10 THEN 8 ELSE -1 END ELSE abs(w - m * (m + 1) / 4) / sqrt(m * (m + 1) * (2 * m + 1) / 24 - "
        "ties / 48) > 1.959963984540054 END AS wilcoxon_significant FROM t, w"),
    "cv8_fold_distribution": (
        f"WITH {FOLDED} SELECT model, metric, round(min(value), 9) AS min, round(quantile_cont(value, 0.25), 9) AS q1, "
        "round(median(value), 9) AS median, round(quantile_cont(value, 0.75), 9) AS q3, round(max(value), 9) AS max FROM "
        "fold_scores GROUP BY ALL"),
    "srt1_leaderboard": (
        f"WITH {SPLIT_METRICS} SELECT model, {r9('train_accuracy', *['val_' + m for m in METRIC_SQL])} FROM board ORDER BY "
        "val_f1 DESC NULLS LAST, model"),
    "srt8_best_of_leaderboard": (
        f"WITH {SPLIT_METRICS} SELECT model, round(val_f1, 9) AS val_f1 FROM board ORDER BY board.val_f1 DESC NULLS LAST, model LIMIT 1"),
    "srt2_cv_leaderboard": (
        f"WITH {FOLDED} SELECT model, round(avg(value), 9) AS f1_mean, round(stddev_pop(value), 9) AS f1_std FROM "
        "fold_scores WHERE metric = 'f1' GROUP BY model ORDER BY 2 DESC"),
    "srt7_best_on_test": (
        f"WITH {SPLIT_METRICS} SELECT model, round(f1, 9) AS f1 FROM split_metrics WHERE split = 'test' ORDER BY "
        "split_metrics.f1 DESC, model DESC LIMIT 1"),
    "snk7_result_log": (
        f"WITH {I.PREDICTIONS}, r AS (SELECT label = 1 AS expected, p_alpha > 0.5::DOUBLE AS hit, p_alpha * 100 AS c FROM "
        "predictions) SELECT coalesce(CASE WHEN expected THEN 'phishing' WHEN NOT expected THEN 'legitimate' END, 'overall') "
        "AS \"group\", count(*) AS tested, count(*) FILTER (hit = r.expected) AS correct, round(avg(c), 6) AS "
        "mean_confidence, round(count(*) FILTER (hit = r.expected) * 100.0 / count(*), 6) AS accuracy_pct FROM r "
        "GROUP BY GROUPING SETS ((expected), ())"),
    "agg13_prediction_counters": (
        f"WITH {I.PREDICTIONS} SELECT count(*) AS total_predictions, count(*) FILTER (p_alpha > 0.5::DOUBLE) AS "
        "phishing_detected, count(*) FILTER (p_alpha <= 0.5::DOUBLE) AS legitimate_detected, round(count(*) FILTER (p_alpha "
        "> 0.5::DOUBLE) / count(*), 9) AS phishing_rate, round(count(*) FILTER (p_alpha <= 0.5::DOUBLE) / count(*), 9) AS "
        "legitimate_rate FROM predictions"),
    "ens1_soft_voting": (
        f"WITH {I.PREDICTIONS} SELECT doc_id, round((p_alpha + p_beta + p_gamma) / 3, 9) AS probability, CASE WHEN (p_alpha "
        "+ p_beta + p_gamma) / 3 > 0.5::DOUBLE THEN 1 ELSE 0 END AS prediction FROM predictions"),
    "ens1_hard_voting": (
        f"WITH {I.PREDICTIONS} SELECT doc_id, CASE WHEN CAST(p_alpha > 0.5::DOUBLE AS INT) + CAST(p_beta > 0.5::DOUBLE AS "
        "INT) + CAST(p_gamma > 0.5::DOUBLE AS INT) >= 2 THEN 1 ELSE 0 END AS prediction FROM predictions"),
    "ens2_weighted_voting": (
        f"WITH {I.PREDICTIONS} SELECT doc_id, round((p_alpha * 3 + p_beta * 2 + p_gamma) / 6, 9) AS probability, CASE WHEN "
        "(p_alpha * 3 + p_beta * 2 + p_gamma) / 6 > 0.5::DOUBLE THEN 1 ELSE 0 END AS prediction FROM predictions"),
    "ens5_weight_search": (
        f"WITH {I.PREDICTIONS}, {DRAWS} SELECT trial, tp, fp, fn, round(f1, 9) AS f1 FROM trial_scores"),
    "ens5_best_weights": (
        f"WITH {I.PREDICTIONS}, {DRAWS} SELECT trial, round(f1, 9) AS f1, [round(w0, 9), round(w1, 9), round(w2, 9)] AS "
        "weights FROM trial_scores ORDER BY trial_scores.f1 DESC, trial LIMIT 1"),
    "ens7_contributions": (
        f"WITH {I.PREDICTIONS} SELECT doc_id, {r9(*PROBS)}, round((p_alpha + p_beta + p_gamma) / 3, 9) AS ensemble FROM predictions"),
    "cv1_win2_folds": (
        f"WITH {I.PREDICTIONS} SELECT doc_id, label, ({RANKED} - 1) % 5 AS fold FROM predictions"),
    "cv1_plain_folds": (
        f"WITH {I.PREDICTIONS} SELECT doc_id, (row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) - 1) % 5 AS fold "
        "FROM predictions"),
}
