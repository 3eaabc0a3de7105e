"""Model, scoring and streaming queries. Training is iterative, so most have no check SQL."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml import classification as MC
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import advice as A
from catalog import inputs as I
from lureline import fixed_values as V
from lureline.operators import ensemble as E
from lureline.operators import metrics as MT
from lureline.operators import models as M
from lureline.operators import pages as PG
from lureline.operators import prep as P
from lureline.operators import scoring as S
from lureline.plans import pipelines as PL
from lureline.shared import materialise, new_path
from lureline.sources import sinks as K
from lureline.streaming import jobs as J

DIMS = 64
# library defaults; the net is told the width of its input
SETTINGS = {name: {} for name in ("logistic_regression", "svm_linear", "svm_rbf", "random_forest", "gradient_boosting",
                                  "naive_bayes", "decision_tree", "knn")} | {"dense_net": {"inputs": DIMS}}
# as many points as the forest's own grid; trees of a forest take MLlib some hundred times as long, see the README
TREE_GRID = {"maxBins": [16, 32, 64], "maxDepth": [15, 20, 25, M.MAX_DEPTH], "minSamplesSplit": [2, 5, 10], "minInstancesPerNode": [1, 2, 4]}
FEW = {n: SETTINGS[n] for n in ("logistic_regression", "decision_tree", "naive_bayes")}


def rows(spark, sf_dir) -> DataFrame:
    """Embeddings as (id, features vector, label, split)."""
    e = I.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
        F.when(F.col("label") < 3, 1).otherwise(0).alias("label"))
    return P.stratified_split(e, "id", "label")


def parts(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    r = rows(spark, sf_dir).cache()
    return tuple(r.filter(F.col("split") == s) for s in ("train", "val", "test"))


def _scores(name: str):
    def query(spark, sf_dir) -> DataFrame:
        train, val, _ = parts(spark, sf_dir)
        return M.train_model(name, train, val, **SETTINGS[name]).scores

    return query


def ml10_train_all_leaderboard(spark, sf_dir) -> DataFrame:
    """Three models and one with an impossible setting, which is skipped."""
    train, val, _ = parts(spark, sf_dir)
    done, failed = M.train_all(train, val, {**FEW, "random_forest": {"maxDepth": 99}})
    return M.compare(done).withColumn("skipped", F.lit(",".join(failed)))


def ml11_predict_probability(spark, sf_dir) -> DataFrame:
    train, _, test = parts(spark, sf_dir)
    return M.fit("logistic_regression", train, **SETTINGS["logistic_regression"]).score(test).select(
        "id", "probability", "prediction")


def ml6_naive_bayes_exact(spark, sf_dir) -> DataFrame:
    """Multinomial Bayes on absolute values, trained and applied on every row."""
    r = rows(spark, sf_dir)
    t = M.fit("naive_bayes", r)
    return t.score(r).select("id", F.round("probability", 6).alias("probability"), "prediction")


_FORESTS: dict[tuple[str, str], tuple[M.Trained, DataFrame]] = {}


def _forest(spark, sf_dir) -> tuple[M.Trained, DataFrame]:
    """The default forest on the 48 page features, trained once per session and data folder.

    Target: a rule over external links and digits, so that both classes occur.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FORESTS:
        v = PG.feature_vector(I.captured(spark, sf_dir)).select("page_id", "url", "features")
        y = F.when(F.get("features", F.lit(26)) + F.get("features", F.lit(13)) % 3 > 1, 1).otherwise(0)
        table = materialise(v.withColumn("label", y).withColumnRenamed("page_id", "id"), "page-vectors")
        train = table.withColumn("features", array_to_vector(F.col("features").cast("array<double>")))
        _FORESTS[key] = M.fit("random_forest", train), table
    return _FORESTS[key]


def srt3_top5_features(spark, sf_dir) -> DataFrame:
    return M.top_features(spark, _forest(spark, sf_dir)[0], V.FEATURE_NAMES, 5)


def srt4_srt5_top20_coefficients(spark, sf_dir) -> DataFrame:
    train, _, _ = parts(spark, sf_dir)
    t = M.fit("logistic_regression", train, **SETTINGS["logistic_regression"])
    return M.top_features(spark, t, [f"d{i}" for i in range(DIMS)], 20)


def cv2_cv3_cross_validate(spark, sf_dir) -> DataFrame:
    train, _, _ = parts(spark, sf_dir)
    folds, _ = M.cross_validate_all(train, FEW, 5)
    return MT.fold_summary(folds, ["model", "split", "metric"])


def cv4_grid_search(spark, sf_dir) -> DataFrame:
    """All 108 points of a grid as wide as the forest's, over five folds of a tree."""
    train, _, _ = parts(spark, sf_dir)
    return M.tune("decision_tree", train, TREE_GRID, 5, parallelism=8)[1]


def cv4_random_search(spark, sf_dir) -> DataFrame:
    train, _, _ = parts(spark, sf_dir)
    return M.tune("decision_tree", train, TREE_GRID, 5, "random", 20, parallelism=8)[1]


def cv4_tune_wrapped_models(spark, sf_dir) -> DataFrame:
    """Grids over all four models that are made of several stages."""
    train, _, _ = parts(spark, sf_dir)
    grids = {"svm_linear": {"regParam": [0.001, 0.1]}, "svm_rbf": {"gamma": [0.01, 0.1]}, "naive_bayes": {"smoothing": [0.5, 1.0]},
             "knn": {"k": [3, 7]}}
    out = None
    for name, grid in grids.items():
        scores = M.tune(name, train, grid, 5)[1].withColumn("model", F.lit(name))
        out = scores if out is None else out.unionByName(scores)
    return out


def cv7_learning_curve(spark, sf_dir) -> DataFrame:
    train, _, _ = parts(spark, sf_dir)
    return M.learning_curve("naive_bayes", train)


def ens3_stacking(spark, sf_dir) -> DataFrame:
    """Out-of-fold probabilities train the meta model; refitted bases feed it on the test rows."""
    train, _, test = parts(spark, sf_dir)
    base = {n: FEW[n] for n in ("naive_bayes", "decision_tree")}
    columns = [f"p_{n}" for n in base]
    meta = E.blend(M.out_of_fold(train, base), columns)
    models = {n: M.fit(n, train, **o) for n, o in base.items()}
    return E.apply_meta(meta, M.with_probabilities(test, models), columns).select("id", "label", "probability", "prediction")


def ens4_blending(spark, sf_dir) -> DataFrame:
    train, val, test = parts(spark, sf_dir)
    models = {n: M.fit(n, train, **FEW[n]) for n in ("naive_bayes", "decision_tree")}
    columns = [f"p_{n}" for n in models]
    meta = E.blend(M.with_probabilities(val, models), columns)
    return E.apply_meta(meta, M.with_probabilities(test, models), columns).select("id", "label", "probability", "prediction")


def ens6_ens8_voting_evaluation(spark, sf_dir) -> DataFrame:
    """Voting of two and, after adding one, of three models on train and validation rows."""
    train, val, _ = parts(spark, sf_dir)
    models = {n: M.fit(n, train, **FEW[n]) for n in ("naive_bayes", "decision_tree")}
    out = None
    for size in (2, 3):
        if size == 3:
            models["logistic_regression"] = M.fit("logistic_regression", train, **FEW["logistic_regression"])
        for split, part in (("train", train), ("validation", val)):
            voted = E.vote(M.with_probabilities(part, models), [f"p_{n}" for n in models])
            m = MT.binary_metrics(voted).withColumns({"models": F.lit(size), "split": F.lit(split)})
            out = m if out is None else out.unionByName(m)
    return out


def scr1_srt3_predict(spark, sf_dir) -> DataFrame:
    trained, table = _forest(spark, sf_dir)
    return S.predict(table, trained).select("id", "is_phishing", "probability", "confidence", "model_used", "top_features")


def scr2_batch_with_errors(spark, sf_dir) -> DataFrame:
    """Some rows lose their features or a part of them; they stay, with an error."""
    trained, table = _forest(spark, sf_dir)
    n = F.col("id")
    broken = F.when(n % 7 == 1, None).when(n % 7 == 2, F.slice("features", 1, 40)).otherwise(F.col("features"))
    done = S.predict(table.withColumn("features", broken), trained)
    return done.groupBy("error").agg(F.count("*").alias("n"), F.count("is_phishing").alias("verdicts"))


def scr3_snk4_model_info(spark, sf_dir) -> DataFrame:
    """A forest saved, and loaded as the fallback for a model that is not there."""
    trained, _ = _forest(spark, sf_dir)
    path = new_path(spark, "model")
    M.save(trained, path)
    loaded = S.load_first(spark, [("gone", path + "-none", PipelineModel),
                                  ("random_forest", path, MC.RandomForestClassificationModel)])
    return S.model_info(spark, loaded, len(V.FEATURE_NAMES))


def snk4_saved_ensembles(spark, sf_dir) -> DataFrame:
    """Voting with weights, stacking and seven neighbours: saved, loaded, and compared with themselves on the test rows."""
    train, val, test = parts(spark, sf_dir)
    models = {n: M.fit(n, train, **FEW[n]) for n in ("naive_bayes", "decision_tree")}
    meta = E.blend(M.with_probabilities(val, models), [f"p_{n}" for n in models])
    made = {"voting": M.ensemble(models, weights=[1.0, 2.0]), "stacking": M.ensemble(models, meta=meta), "knn": M.fit("knn", train, k=7)}
    out = None
    for name, trained in made.items():
        path = new_path(spark, name)
        M.save(trained, path)
        again = M.load(spark, name, path).score(test).select("id", F.col("probability").alias("again"))
        same = trained.score(test).join(again, "id").agg(
            F.count("*").alias("rows"), F.count(F.when(F.abs(F.col("probability") - F.col("again")) < 1e-9, 1)).alias("equal"))
        part = same.select(F.lit(name).alias("model"), "rows", "equal")
        out = part if out is None else out.unionByName(part)
    return out


def scr4_test_evaluation(spark, sf_dir) -> DataFrame:
    train, _, test = parts(spark, sf_dir)
    out = None
    for n, o in FEW.items():
        m = M.evaluate(M.fit(n, train, **o), test, "test")
        out = m if out is None else out.unionByName(m)
    return out


def scr5_analyze_pages(spark, sf_dir) -> DataFrame:
    trained, table = _forest(spark, sf_dir)
    content = table.select("id", F.col("url").alias("content"), F.lit("url").alias("type"), "features")
    return S.analyze(content, trained, features="features")


def scr6_chat(spark, sf_dir) -> DataFrame:
    trained, _ = _forest(spark, sf_dir)
    return S.chat(I.messages(spark, sf_dir), trained).drop("message")


def plan_mail_pipeline(spark, sf_dir) -> DataFrame:
    """Phase B end to end on the four corpora: rows per split and class after preparation."""
    from catalog.corpora import corpora
    from lureline.operators import corpus as C

    unified = [C.unify(df, n, i, "doc_id") for i, (n, df) in enumerate(corpora(spark, sf_dir))]
    out = PL.mail_pipeline(unified, new_path(spark, "mails"))
    return out["prepared"].groupBy("split", "label").agg(F.count("*").alias("n"))


def plan_model_pipeline(spark, sf_dir) -> DataFrame:
    out = PL.model_pipeline(*parts(spark, sf_dir), settings=FEW)
    return out["test"]


def snk3_prepared_splits(spark, sf_dir) -> DataFrame:
    """Prepared rows and metadata written, then read back per split."""
    path = new_path(spark, "prepared")
    r = rows(spark, sf_dir).select("id", vector_to_array("features").alias("features"), "label", "split")
    K.write_splits(r, f"{path}/rows")
    K.write_metadata(spark, f"{path}/meta", features=DIMS, splits=["train", "val", "test"])
    width = K.read_metadata(spark, f"{path}/meta")["features"]
    back = spark.read.parquet(f"{path}/rows")
    return back.groupBy("split", "label").agg(F.count("*").alias("n")).withColumn("width", F.lit(width))


def snk5_json_report(spark, sf_dir) -> DataFrame:
    """The quality report written as JSON lines and read back."""
    from catalog.audit import measured
    from lureline.operators import quality as Q

    path = new_path(spark, "report")
    K.write_report(Q.missing_values(measured(spark, sf_dir)), path)
    return spark.read.schema("column string, missing bigint, pct double").json(path).select(
        "column", "missing", F.round("pct", 6).alias("pct"))


# ---- streams: parquet files through an available-now run, read back from the sink ------------------------


def str1_tiered_stream(spark, sf_dir) -> DataFrame:
    """Order lines stream through the probability and tier columns."""
    schema = I.table(spark, sf_dir, "lineitem").schema
    source = J.file_stream(spark, sf_dir, schema, "lineitem.parquet")
    p = ((F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_linenumber")) % 1001).cast("double") / 1000.0
    out = J.tiered_probabilities(source.select("l_orderkey", "l_linenumber", p.alias("probability")))
    path = new_path(spark, "tiers")
    J.run_to_end(lambda: J.append_stream(out, path, path + "-state", once=True))
    return spark.read.parquet(path).select("l_orderkey", "l_linenumber", "level", "score")


def str1_chat_stream(spark, sf_dir) -> DataFrame:
    trained, _ = _forest(spark, sf_dir)
    schema = I.table(spark, sf_dir, "conversations").schema
    source = J.file_stream(spark, sf_dir, schema, "conversations.parquet")
    rows_in = source.select((F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), F.col("text").alias("message"))
    out = J.scored_messages(rows_in, trained)
    path = new_path(spark, "chat")
    J.run_to_end(lambda: J.append_stream(out, path, path + "-state", once=True))
    return spark.read.parquet(path).groupBy("route").agg(F.count("*").alias("n"), F.count("analysis").alias("analysed"))


def str2_running_counters(spark, sf_dir) -> DataFrame:
    """Verdict counters over the event stream."""
    schema = I.table(spark, sf_dir, "events").schema
    source = J.file_stream(spark, sf_dir, schema, "events.parquet")
    out = J.running_counters(source.select((F.col("value") > 10).alias("is_phishing")))
    path = new_path(spark, "counters")
    J.run_to_end(lambda: J.counters_stream(out, path, path + "-state", once=True))
    return J.latest_counters(spark, path).withColumns({
        c: F.round(c, 9) for c in ("phishing_rate", "legitimate_rate")})


def str3_feedback_stream(spark, sf_dir) -> DataFrame:
    schema = I.table(spark, sf_dir, "conversations").schema
    source = J.file_stream(spark, sf_dir, schema, "conversations.parquet")
    n = F.length("text")
    feedback = source.select(
        F.col("text").alias("content"), F.when(n % 3 == 0, "phishing").otherwise("legitimate").alias("predicted"),
        F.when(n % 2 == 0, "phishing").otherwise("legitimate").alias("actual"), F.col("role").alias("user_comment"))
    path = new_path(spark, "feedback-stream")
    J.run_to_end(lambda: J.feedback_stream(feedback, path, path + "-state", once=True))
    return MT.feedback_agreement(spark.read.parquet(path))


QUERIES = {
    "ml1_logistic_regression": _scores("logistic_regression"),
    "ml2_svm_linear": _scores("svm_linear"),
    "ml3_svm_rbf": _scores("svm_rbf"),
    "ml4_random_forest": _scores("random_forest"),
    "ml5_gradient_boosting": _scores("gradient_boosting"),
    "ml6_naive_bayes": _scores("naive_bayes"),
    "ml7_knn_scores": _scores("knn"),
    "ml8_decision_tree": _scores("decision_tree"),
    "ml9_dense_net": _scores("dense_net"),
    **{f.__name__: f for f in (
        ml6_naive_bayes_exact, ml10_train_all_leaderboard, ml11_predict_probability, srt3_top5_features,
        srt4_srt5_top20_coefficients, cv2_cv3_cross_validate, cv4_grid_search, cv4_random_search, cv4_tune_wrapped_models, snk4_saved_ensembles, cv7_learning_curve,
        ens3_stacking, ens4_blending, ens6_ens8_voting_evaluation, scr1_srt3_predict, scr2_batch_with_errors,
        scr3_snk4_model_info, scr4_test_evaluation, scr5_analyze_pages, scr6_chat, plan_mail_pipeline,
        plan_model_pipeline, snk3_prepared_splits, snk5_json_report, str1_tiered_stream, str1_chat_stream,
        str2_running_counters, str3_feedback_stream)},
}

BAYES_SQL = (
    "v AS (SELECT vec_id AS id, CASE WHEN label < 3 THEN 1 ELSE 0 END AS y, embedding FROM embeddings), cells AS (SELECT id, "
    "y, abs(CAST(unnest(embedding) AS DOUBLE)) AS x, generate_subscripts(embedding, 1) AS i FROM v), w AS (SELECT y, "
    "count(*) AS n FROM v GROUP BY y), f AS (SELECT y, i, sum(x) AS s FROM cells GROUP BY y, i), th AS (SELECT y, i, "
    "ln((s + 1) / (sum(s) OVER (PARTITION BY y) + count(*) OVER (PARTITION BY y))) AS t FROM f), pr AS (SELECT y, ln((n + 1) / "
    "(sum(n) OVER () + 2)) AS p FROM w), j AS (SELECT c.id, th.y, max(pr.p) + sum(c.x * th.t) AS s FROM cells c JOIN th USING (i) "
    "JOIN pr ON pr.y = th.y GROUP BY c.id, th.y), pp AS (SELECT id, 1 / (1 + exp(max(s) FILTER (y = 0) - max(s) FILTER (y = "
    "1))) AS p FROM j GROUP BY id)"
)
SQL = {
    "snk4_saved_ensembles": (
        "WITH v AS (SELECT vec_id AS id, CASE WHEN label < 3 THEN 1 ELSE 0 END AS label FROM embeddings), r AS (SELECT *, "
        "row_number() OVER (PARTITION BY label ORDER BY md5('42|' || id), id) AS rk, round(count(*) OVER (PARTITION BY label) "
        "* 0.15::DOUBLE) AS t FROM v) SELECT model, count(*) AS rows, count(*) AS \"equal\" FROM r, (VALUES ('voting'), ('stacking'), "
        "('knn')) m(model) WHERE rk <= t GROUP BY model"),
    "ml6_naive_bayes_exact": (
        f"WITH {BAYES_SQL} SELECT id, round(p, 6) AS probability, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS prediction FROM pp"),
    "snk3_prepared_splits": (
        "WITH v AS (SELECT vec_id AS id, CASE WHEN label < 3 THEN 1 ELSE 0 END AS label FROM embeddings), r AS (SELECT *, "
        "row_number() OVER (PARTITION BY label ORDER BY md5('42|' || id), id) AS rk, round(count(*) OVER (PARTITION BY label) "
        "* 0.15::DOUBLE) AS t, count(*) OVER (PARTITION BY label) AS n FROM v) SELECT CASE WHEN rk <= t THEN 'test' WHEN rk "
        "<= t + round((n - t) * (0.15::DOUBLE / 0.85::DOUBLE)) THEN 'val' ELSE 'train' END AS split, label, count(*) AS n, "
        f"{DIMS} AS width FROM r GROUP BY ALL"),
    "snk5_json_report": (
        "WITH m AS (SELECT count(*) AS n, count(*) FILTER (l_linenumber = 3) AS tax, count(*) FILTER (l_returnflag <> 'R' AND "
        "l_linenumber = 7) AS label FROM lineitem) SELECT * FROM (SELECT 'tax' AS \"column\", tax AS missing, round(tax * 100.0 / n, 6) AS pct "
        "FROM m UNION ALL SELECT 'label', label, round(label * 100.0 / n, 6) FROM m) WHERE missing > 0"),
    "str1_tiered_stream": (
        f"WITH {I.PROBABILITIES} SELECT l_orderkey, l_linenumber, {A.LEVEL_SQL} AS level, {A.SCORE_SQL} AS score FROM "
        "probabilities"),
    "str2_running_counters": (
        "SELECT count(*) AS total_predictions, count(*) FILTER (value > 10) AS phishing_detected, count(*) FILTER (value <= "
        "10) AS legitimate_detected, round(count(*) FILTER (value > 10) / count(*), 9) AS phishing_rate, round(count(*) "
        "FILTER (value <= 10) / count(*), 9) AS legitimate_rate FROM events"),
    "str3_feedback_stream": (
        "SELECT CASE WHEN length(text) % 3 = 0 THEN 'phishing' ELSE 'legitimate' END AS predicted, CASE WHEN length(text) % 2 "
        "= 0 THEN 'phishing' ELSE 'legitimate' END AS actual, count(*) AS n FROM conversations GROUP BY ALL"),
}
