"""Data-quality queries over the order lines, with gaps, repeats and odd values made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import inputs as I
from lureline.operators import quality as Q

NUMERIC = ["item_count", "discount_score", "price", "price_with_tax", "tax", "part", "size_num", "label"]


def measured(spark, sf_dir) -> DataFrame:
    """Order lines as a feature table; every line number is one row, some cells are missing."""
    li = I.table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat_ws("-", "l_returnflag", "l_linestatus").alias("flags"),
        (F.col("l_quantity") - 2).alias("item_count"), (F.col("l_discount") * 11).alias("discount_score"),
        F.col("l_extendedprice").alias("price"), (F.col("l_extendedprice") * (F.col("l_tax") + 1)).alias("price_with_tax"),
        F.when(F.col("l_linenumber") != 3, F.col("l_tax")).alias("tax"), F.col("l_partkey").alias("part"),
        F.when(F.col("l_quantity") > 49, F.col("l_quantity") * 40).otherwise(F.col("l_quantity")).alias("size_num"),
        F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_linenumber") != 7, 0).alias("label"))


MEASURED = (
    "measured AS (SELECT concat_ws('-', l_returnflag, l_linestatus) AS flags, l_quantity - 2 AS item_count, "
    "l_discount * 11 AS discount_score, l_extendedprice AS price, l_extendedprice * (l_tax + 1) AS "
    "price_with_tax, CASE WHEN l_linenumber <> 3 THEN l_tax END AS tax, l_partkey AS part, CASE WHEN "
    "l_quantity > 49 THEN l_quantity * 40 ELSE l_quantity END AS size_num, CASE WHEN l_returnflag = 'R' THEN 1 "
    "WHEN l_linenumber <> 7 THEN 0 END AS label FROM lineitem)"
)
COLUMNS = ["flags", *NUMERIC]
SUBSET = ["flags", "item_count", "discount_score", "label"]


def repeated(spark, sf_dir) -> DataFrame:
    return I.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("user"),
        F.when(F.col("event_type") != "click", F.col("event_type")).alias("kind"))


REPEATED = (
    "repeated AS (SELECT event_id AS id, user_id AS \"user\", CASE WHEN event_type <> 'click' THEN event_type END "
    "AS kind FROM events)"
)


def agg1_missing_values(spark, sf_dir) -> DataFrame:
    return Q.missing_values(measured(spark, sf_dir)).select("column", "missing", F.round("pct", 6).alias("pct"))


def srt6_most_missing(spark, sf_dir) -> DataFrame:
    return Q.most_missing(measured(spark, sf_dir)).select("column", "missing")


def agg2_duplicates(spark, sf_dir) -> DataFrame:
    d = Q.duplicates(measured(spark, sf_dir), SUBSET)
    return d.select("rows", "duplicates", F.round("pct", 6).alias("pct"))


def agg2_duplicate_ids(spark, sf_dir) -> DataFrame:
    return Q.duplicate_ids(repeated(spark, sf_dir), "id", ["user", "kind"])


def agg2_duplicate_texts(spark, sf_dir) -> DataFrame:
    return Q.duplicate_ids(I.table(spark, sf_dir, "documents"), "doc_id", ["text"])


def agg3_label_distribution(spark, sf_dir) -> DataFrame:
    d = Q.label_distribution(measured(spark, sf_dir))
    return d.withColumns({"pct": F.round("pct", 6), "imbalance_ratio": F.round("imbalance_ratio", 6)})


def agg3_label_distribution_quality(spark, sf_dir) -> DataFrame:
    d = Q.label_distribution(I.table(spark, sf_dir, "labels"), "quality")
    return d.withColumns({"pct": F.round("pct", 6), "imbalance_ratio": F.round("imbalance_ratio", 6)})


def agg4_feature_statistics(spark, sf_dir) -> DataFrame:
    stats = Q.feature_statistics(measured(spark, sf_dir))
    return stats.select("column", *[F.round(c, 5).alias(c) for c in stats.columns if c != "column"])


def agg5_outliers(spark, sf_dir) -> DataFrame:
    return Q.outliers(measured(spark, sf_dir)).select("column", "outliers", F.round("pct", 6).alias("pct"))


def agg5_event_outliers(spark, sf_dir) -> DataFrame:
    events = I.table(spark, sf_dir, "events")
    return Q.outliers(events, ["value"]).select("column", "outliers", F.round("pct", 6).alias("pct"))


def agg6_correlations(spark, sf_dir) -> DataFrame:
    c = Q.correlations(measured(spark, sf_dir), NUMERIC)
    return c.select("feature1", "feature2", F.round("correlation", 6).alias("correlation"))


def agg6_high_correlations(spark, sf_dir) -> DataFrame:
    c = Q.high_correlations(measured(spark, sf_dir), NUMERIC)
    return c.select("feature1", "feature2", F.round("correlation", 6).alias("correlation"))


def agg6_wide_correlations(spark, sf_dir) -> DataFrame:
    """All pairs of the 64 embedding dimensions."""
    e = I.table(spark, sf_dir, "embeddings")
    wide = e.select(*[F.col("embedding")[i].alias(f"d{i:02d}") for i in range(64)])
    return Q.correlations(wide).select("feature1", "feature2", F.round("correlation", 6).alias("correlation"))


def agg7_flt4_consistency(spark, sf_dir) -> DataFrame:
    return Q.consistency(measured(spark, sf_dir))


def agg8_flt3_dataset_info(spark, sf_dir) -> DataFrame:
    return Q.dataset_info(measured(spark, sf_dir))


def agg9_quality_report(spark, sf_dir) -> DataFrame:
    r = Q.quality_report(measured(spark, sf_dir))
    return r.withColumns({c: F.round(c, 6) for c in ("duplicate_pct", "imbalance_ratio", "quality_score")})


def agg9_full_report(spark, sf_dir) -> DataFrame:
    return Q.full_report(measured(spark, sf_dir)).withColumn("value", F.round("value", 5))


MISSING_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS missing, count(*) FILTER ({c} IS NULL) * 100.0 "
    f"/ count(*) AS pct FROM measured" for c in COLUMNS)
STATS_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", avg({c}) AS mean, stddev_samp({c}) AS std, CAST(min({c}) AS DOUBLE) AS min, "
    f"CAST(max({c}) AS DOUBLE) AS max, CAST(median({c}) AS DOUBLE) AS median, skewness({c}) AS skew, "
    f"kurtosis({c}) AS kurtosis FROM measured" for c in NUMERIC)


def outlier_sql(columns: list[str], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (abs(({c} - m) / s) > 3) AS outliers, count(*) FILTER "
        f"(abs(({c} - m) / s) > 3) * 100.0 / count(*) AS pct FROM {source}, (SELECT avg({c}) AS m, "
        f"stddev_pop({c}) AS s FROM {source})" for c in columns)


CORR_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS feature1, '{b}' AS feature2, round(corr({a}, {b}), 6) AS correlation FROM measured"
    for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1:])
DISTRIBUTION = (
    "counts AS (SELECT {l} AS label, count(*) AS n FROM {t} WHERE {l} IS NOT NULL GROUP BY 1), whole AS (SELECT "
    "sum(n) AS total, count(*) AS n_labels, CASE WHEN count(*) = 2 THEN max(n) / min(n) END AS ratio FROM counts)"
)
DISTRIBUTION_SELECT = (
    "SELECT label, n, round(n * 100.0 / total, 6) AS pct, n_labels, round(ratio, 6) AS imbalance_ratio, "
    "coalesce(ratio > 3, false) AS imbalanced FROM counts, whole"
)
CONSISTENCY_SQL = (
    "SELECT 'negative_values' AS \"check\", 'item_count' AS \"column\", count(*) AS n FROM measured WHERE item_count < 0 "
    "UNION ALL SELECT 'negative_values', 'size_num', count(*) FROM measured WHERE size_num < 0 UNION ALL SELECT "
    "'invalid_ranges', 'discount_score', count(*) FROM measured WHERE discount_score < 0 OR discount_score > 1"
)
DUPLICATE_SQL = (
    "(SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT {c} FROM measured)) AS duplicates "
    "FROM measured)"
)
REPORT_SQL = (
    f"{MEASURED}, missing AS ({MISSING_SQL}), far AS ({outlier_sql(NUMERIC, 'measured')}), "
    + DISTRIBUTION.format(l="label", t="measured")
    + f", dup AS {DUPLICATE_SQL.format(c=', '.join(COLUMNS))}, base AS (SELECT rows, duplicates, duplicates * 100.0 / "
    "rows AS duplicate_pct, (SELECT sum(missing) FROM missing) AS missing, (SELECT sum(outliers) FROM far) AS outliers, "
    "(SELECT ratio FROM whole) AS imbalance_ratio FROM dup), scored AS (SELECT *, greatest(0.0, 100.0 - least(20.0, "
    "missing / rows * 100) - least(15.0, duplicate_pct) - least(10.0, outliers / (rows * 0.01)) - CASE WHEN "
    "imbalance_ratio > 3 THEN 10.0 ELSE 0.0 END) AS quality_score FROM base)"
)


def long_sql(check: str, column: str, metrics: list[str], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{check}' AS \"check\", CAST({column} AS VARCHAR) AS \"column\", '{m}' AS metric, "
        f"round(CAST({m} AS DOUBLE), 5) AS value FROM {source}" for m in metrics)


FULL_SQL = " UNION ALL ".join([
    long_sql("dataset_info", "NULL", ["total_samples", "total_features", "numeric_features", "text_features"],
             f"(SELECT count(*) AS total_samples, {len(COLUMNS)} AS total_features, {len(NUMERIC)} AS "
             f"numeric_features, {len(COLUMNS) - len(NUMERIC)} AS text_features FROM measured)"),
    long_sql("missing_values", '"column"', ["missing", "pct"], "(SELECT * FROM missing WHERE missing > 0)"),
    long_sql("duplicates", "NULL", ["duplicates", "pct"],
             "(SELECT duplicates, duplicates * 100.0 / rows AS pct FROM dup)"),
    long_sql("label_distribution", "label", ["n", "pct"],
             "(SELECT label, n, n * 100.0 / total AS pct FROM counts, whole)"),
    long_sql("feature_statistics", '"column"', ["mean", "std", "min", "max", "median", "skew", "kurtosis"],
             f"({STATS_SQL})"),
    long_sql("outliers", '"column"', ["outliers", "pct"], "(SELECT * FROM far WHERE outliers > 0)"),
    long_sql("consistency", '"column"', ["n"], f"(SELECT * FROM ({CONSISTENCY_SQL}) WHERE n > 0)"),
    long_sql("correlation", "feature1 || '|' || feature2", ["correlation"],
             f"(SELECT * FROM ({CORR_SQL}) WHERE abs(correlation) > 0.9)"),
    long_sql("quality", "NULL", ["quality_score"], "scored"),
])

QUERIES = {f.__name__: f for f in (
    agg1_missing_values, srt6_most_missing, agg2_duplicates, agg2_duplicate_ids, agg2_duplicate_texts,
    agg3_label_distribution, agg3_label_distribution_quality, agg4_feature_statistics, agg5_outliers,
    agg5_event_outliers, agg6_correlations, agg6_high_correlations, agg6_wide_correlations,
    agg7_flt4_consistency, agg8_flt3_dataset_info, agg9_quality_report, agg9_full_report)}

SQL = {
    "agg1_missing_values": (
        f"WITH {MEASURED} SELECT \"column\", missing, round(pct, 6) AS pct FROM ({MISSING_SQL}) WHERE missing > 0"),
    "srt6_most_missing": (
        f"WITH {MEASURED} SELECT \"column\", missing FROM ({MISSING_SQL}) WHERE missing > 0 ORDER BY missing DESC, "
        "\"column\" LIMIT 20"),
    "agg2_duplicates": (
        f"WITH {MEASURED} SELECT rows, duplicates, round(duplicates * 100.0 / rows, 6) AS pct FROM "
        + DUPLICATE_SQL.format(c=", ".join(SUBSET))),
    "agg2_duplicate_ids": (
        f"WITH {REPEATED} SELECT id FROM repeated QUALIFY row_number() OVER (PARTITION BY \"user\", kind "
        "ORDER BY id) > 1"),
    "agg2_duplicate_texts": (
        "SELECT doc_id AS id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1"),
    "agg3_label_distribution": f"WITH {MEASURED}, {DISTRIBUTION.format(l='label', t='measured')} {DISTRIBUTION_SELECT}",
    "agg3_label_distribution_quality": f"WITH {DISTRIBUTION.format(l='quality', t='labels')} {DISTRIBUTION_SELECT}",
    "agg4_feature_statistics": f"WITH {MEASURED} SELECT \"column\", " + ", ".join(
        f"round({m}, 5) AS {m}" for m in ("mean", "std", "min", "max", "median", "skew", "kurtosis")
    ) + f" FROM ({STATS_SQL})",
    "agg5_outliers": (
        f"WITH {MEASURED} SELECT \"column\", outliers, round(pct, 6) AS pct FROM "
        f"({outlier_sql(NUMERIC, 'measured')}) WHERE outliers > 0"),
    "agg5_event_outliers": (
        f"SELECT \"column\", outliers, round(pct, 6) AS pct FROM ({outlier_sql(['value'], 'events')}) WHERE outliers > 0"),
    "agg6_correlations": f"WITH {MEASURED} {CORR_SQL}",
    "agg6_high_correlations": f"WITH {MEASURED} SELECT * FROM ({CORR_SQL}) WHERE abs(correlation) > 0.9",
    "agg6_wide_correlations": " UNION ALL ".join(
        f"SELECT 'd{i:02d}' AS feature1, 'd{j:02d}' AS feature2, round(corr(embedding[{i + 1}], embedding[{j + 1}]), 6) "
        "AS correlation FROM embeddings" for i in range(64) for j in range(i + 1, 64)),
    "agg7_flt4_consistency": f"WITH {MEASURED} SELECT * FROM ({CONSISTENCY_SQL}) WHERE n > 0",
    "agg8_flt3_dataset_info": (
        f"WITH {MEASURED} SELECT count(*) AS total_samples, {len(COLUMNS)} AS total_features, {len(NUMERIC)} AS "
        f"numeric_features, {len(COLUMNS) - len(NUMERIC)} AS text_features FROM measured"),
    "agg9_quality_report": (
        f"WITH {REPORT_SQL} SELECT rows, duplicates, round(duplicate_pct, 6) AS duplicate_pct, missing, outliers, "
        "round(imbalance_ratio, 6) AS imbalance_ratio, round(quality_score, 6) AS quality_score, CASE WHEN "
        "quality_score >= 80 THEN 'GOOD' WHEN quality_score >= 60 THEN 'MODERATE' ELSE 'POOR' END AS grade FROM scored"),
    "agg9_full_report": f"WITH {REPORT_SQL} {FULL_SQL}",
}
