"""End-to-end plans: mail data preparation, model building, page and message analysis."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lureline.functions import tagging
from lureline.operators import corpus as C
from lureline.operators import ensemble as E
from lureline.operators import metrics as MT
from lureline.operators import models as M
from lureline.operators import prep as P
from lureline.operators import quality as Q
from lureline.operators.ranking import hash_rank
from lureline.shared import materialise

DEFAULTS = {
    "test_size": 0.15, "val_size": 0.15, "seed": 42, "max_features": 5000, "ngram_range": (1, 3), "min_df": 5,
    "max_df": 0.95, "smote": True, "normalise": True, "fit_scope": "train", "stop_words": None,
}


def prepared_mails(df: DataFrame, id_column: str, text: str = "text_combined", label: str = "label",
                   url_columns: list[str] | None = None, **settings) -> tuple[DataFrame, P.TfidfModel, list[str]]:
    """Clean, split, TF-IDF, metadata, oversample and scale: (id, features, label, split), model, names.

    The vocabulary is fitted on the training rows; ``fit_scope="all"`` fits it on every row.
    Vectors stay sparse until the dense steps (oversampling, scaling) are asked for.
    """
    s = {**DEFAULTS, **settings}
    encoded = P.encode_labels(df.filter(F.col(label).isNotNull()), label, "_label")
    cleaned = P.mail_components(encoded, text)
    split = materialise(P.stratified_split(cleaned, id_column, "_label", s["test_size"], s["val_size"], seed=s["seed"]), "split")
    fit_rows = split if s["fit_scope"] == "all" else split.filter("split = 'train'")
    model = P.fit_tfidf(fit_rows, "cleaned_text", s["stop_words"], s["max_features"], s["ngram_range"], s["min_df"], s["max_df"])
    columns = [*(url_columns or []), *P.METADATA]
    wide = P.combine_features(model.transform(split, "cleaned_text"), ["tfidf"], columns)
    rows = wide.select(F.col(id_column).alias("id"), "features", F.col("_label").alias("label"), "split")
    names = [*(f"tfidf_{t}" for t in model.terms), *columns]
    if s["smote"] or s["normalise"]:
        rows = materialise(rows, "mail-vectors")  # sparse, and read several times below
        arrays = rows.withColumn("features", vector_to_array("features"))
        if s["smote"]:
            train = P.smote(rows.filter("split = 'train'").drop("split"), seed=s["seed"]).withColumn("split", F.lit("train"))
            arrays = train.unionByName(arrays.filter("split <> 'train'").withColumn("synthetic", F.lit(False)))
        rows = arrays
        if s["normalise"]:
            rows = P.standardise(rows, "features", F.col("split") == "train", "features")
        rows = rows.withColumn("features", array_to_vector("features"))
    return rows, model, names


def mail_pipeline(corpora: list[DataFrame], path: str, **settings) -> dict[str, DataFrame]:
    """Combine, tag, prepare and audit mails; the combined table is written once.

    Returns the combined and tagged mails, the risk distribution, the prepared rows and the report.
    """
    combined = C.clean(C.combine(corpora), drop_null_text=True)
    # neighbours take numbers as ids: ranks in the order of a digest, as 64 bits of a hash would meet in large tables
    ranked = hash_rank(combined.withColumn("_digest", F.md5("text_combined")), "_digest", [], 0, "mail_id", "_mails")
    combined = ranked.select("mail_id", *combined.columns)
    combined.write.mode("errorifexists").parquet(path)
    combined = combined.sparkSession.read.parquet(path)
    tagged = tagging.tag_table(combined, "text_combined")
    prepared, _, _ = prepared_mails(combined, "mail_id", **settings)
    return {
        "combined": combined, "tagged": tagged, "risk": tagging.risk_distribution(tagged), "prepared": prepared,
        "report": Q.full_report(combined.select("text_combined", "label", "source_no"))}


def model_pipeline(train: DataFrame, validation: DataFrame, test: DataFrame, settings: dict[str, dict],
                   sample_size: int | None = None, seed: int = 42, k: int = 3) -> dict[str, DataFrame]:
    """Train the models, combine them, cross-validate, and evaluate everything on the test rows."""
    if sample_size is not None:
        train = P.uniform_sample(train, "id", sample_size, seed)
    done, failed = M.train_all(train, validation, settings, seed)
    board = M.compare(done)
    folds, _ = M.cross_validate_all(train, settings, k, seed)
    names = list(done)
    columns = [f"p_{n}" for n in names]
    scored = M.with_probabilities(test, done)
    long = None
    for n in names:
        part = scored.select(F.lit(n).alias("model"), "label", F.when(F.col(f"p_{n}") > 0.5, 1).otherwise(0).alias("prediction"))
        long = part if long is None else long.unionByName(part)
    if len(names) >= 2:  # an ensemble needs two models
        voted = E.vote(scored, columns).select(F.lit("voting").alias("model"), "label", "prediction")
        long = long.unionByName(voted)
    results = MT.binary_metrics(long, ["model"])
    failures = train.sparkSession.createDataFrame(list(failed.items()), "model string, error string")
    return {"leaderboard": board, "folds": folds, "test": results, "best": MT.best_model(results), "failed": failures}
