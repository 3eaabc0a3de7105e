"""Models, scoring and streaming on the small driver tables."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from lureline.operators import models as M
from lureline.operators import scoring as S
from lureline.shared import new_path


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 160)
    x = rng.normal(0, 1, (160, 5)) + y[:, None] * 1.5
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i])) for i in range(160)], "id bigint, a array<double>, label int")
    return df.select("id", array_to_vector("a").alias("features"), "label").cache()


def test_models_learn_and_repeat(spark, rows):
    quick = {"logistic_regression": {"maxIter": 30}, "naive_bayes": {}, "decision_tree": {"maxDepth": 4}, "no_such_model": {}}
    done, failed = M.train_all(rows, None, quick)
    assert list(failed) == ["no_such_model"]
    for name in ("logistic_regression", "decision_tree"):
        scored = done[name].score(rows).collect()
        assert all(0 <= r.probability <= 1 for r in scored)
        right = sum(r.prediction == r.label for r in scored) / len(scored)
        assert right > 0.85, (name, right)
    again = M.fit("logistic_regression", rows, maxIter=30)
    assert M.importance(again) == M.importance(done["logistic_regression"])
    assert M.importance(done["naive_bayes"]) is None


def test_saved_rbf_pipeline_scores_the_same(spark, rows):
    t = M.fit("svm_rbf", rows, size=32, max_iter=10)
    path = new_path(spark, "rbf")
    M.save(t, path)
    back = M.load(spark, "svm_rbf", path, PipelineModel)
    a = t.score(rows).orderBy("id").select("probability").collect()
    b = back.score(rows).orderBy("id").select("probability").collect()
    assert [round(r[0], 9) for r in a] == [round(r[0], 9) for r in b]
    with pytest.raises(ValueError):
        S.load_first(spark, [("x", path + "-none", PipelineModel)])


def test_batch_keeps_broken_rows(spark, rows):
    t = M.fit("decision_tree", rows, maxDepth=3)
    df = spark.createDataFrame([(1, [0.1] * 5), (2, None), (3, [1.0]), (4, [float("nan")] * 5)], "id int, features array<double>")
    got = {r.id: r for r in S.predict(df, t, [f"f{i}" for i in range(5)]).collect()}
    assert got[1].error is None and got[1].is_phishing is not None
    assert [got[i].is_phishing for i in (2, 3, 4)] == [None] * 3
    assert got[3].error == "expected 5 features"


def test_cross_validation_and_search(spark, rows):
    folds = M.cross_validate("naive_bayes", rows, 2)
    assert folds.count() == 2 * 2 * 5
    with pytest.raises(ValueError):
        M.tune("decision_tree", rows, {"maxDepth": [2]}, search="other")
    best, scores = M.tune("decision_tree", rows, {"maxDepth": [1, 3]}, 2)
    assert scores.count() == 2 and best.settings["maxDepth"] in (1, 3)


def test_wrapped_models_are_tuned(spark, rows):
    grids = {"svm_linear": {"regParam": [0.01, 10.0], "maxIter": [5]}, "svm_rbf": {"gamma": [0.05], "size": [16, 32], "maxIter": [5]},
             "naive_bayes": {"smoothing": [0.1, 2.0]}, "knn": {"k": [1, 7]}, "decision_tree": {"minSamplesSplit": [2, 120]}}
    for name, grid in grids.items():
        best, scores = M.tune(name, rows, grid, 2)
        points = scores.collect()
        assert len(points) == 2 and all(0 <= r.f1 <= 1 for r in points), name
        assert best.settings.keys() == grid.keys() and best.score(rows).where("prediction IS NULL").count() == 0
    assert len(M.FOREST_GRID) == 4 and np.prod([len(v) for v in M.FOREST_GRID.values()]) == 108


def test_query_tunes_all_wrapped_models(spark, rows, monkeypatch):
    from catalog import learn

    made = spark.createDataFrame([("", 0.5)], "settings string, f1 double")
    grids = {}
    monkeypatch.setattr(learn, "parts", lambda *_: (rows, rows, rows))
    monkeypatch.setattr(M, "tune", lambda name, df, grid, k: grids.update({name: (grid, k)}) or (None, made))
    got = {r.model for r in learn.cv4_tune_wrapped_models(spark, "").collect()}
    assert got == grids.keys() == {"svm_linear", "svm_rbf", "naive_bayes", "knn"}
    assert all(k == 5 and [len(v) for v in grid.values()] == [2] for grid, k in grids.values())


def test_split_size_bounds_what_is_split(spark, rows):
    free, bound = (M.fit("decision_tree", rows, minSamplesSplit=n).model for n in (2, 200))
    assert free.numNodes > 1 and bound.numNodes == 1  # no part of 160 rows has 100 beside another one


def test_ensembles_and_neighbours_are_saved(spark, rows):
    from lureline.operators import ensemble as E

    bases = {"naive_bayes": M.fit("naive_bayes", rows), "svm_rbf": M.fit("svm_rbf", rows, size=16, max_iter=5), "knn": M.fit("knn", rows, k=3)}
    meta = E.blend(M.with_probabilities(rows, bases), [f"p_{n}" for n in bases])
    made = {"soft": M.ensemble(bases, weights=[1, 2, 0.5]), "hard": M.ensemble(bases, "hard"), "stacking": M.ensemble(bases, meta=meta),
            "knn": M.fit("knn", rows, k=7)}
    for name, trained in made.items():
        path = new_path(spark, "saved")
        M.save(trained, path)
        back = M.load(spark, name, path)
        a, b = ({r.id: (r.probability, r.prediction) for r in t.score(rows).collect()} for t in (trained, back))
        assert a == b and len(a) == 160, name
    assert back.model.k == 7
    columns = [f"p_{n}" for n in bases]
    plain = E.vote(M.with_probabilities(rows, bases), columns, "soft", [1, 2, 0.5])
    assert {r.id: r.probability for r in plain.collect()} == {r.id: r.probability for r in made["soft"].score(rows).collect()}
    with pytest.raises(ValueError):
        M.ensemble({})


def test_curve_and_stacking_share_their_folds(spark, rows):
    curve = M.learning_curve("naive_bayes", rows, 2, [0.3, 1.0]).collect()
    assert sorted((r.size, r.split) for r in curve) == [(0.3, "test"), (0.3, "train"), (1.0, "test"), (1.0, "train")]
    whole = M.cross_validate("naive_bayes", rows, 2).where("metric = 'f1'").groupBy("split").avg("value").collect()
    assert {r[0]: round(r[1], 9) for r in whole} == {r.split: round(r.mean, 9) for r in curve if r.size == 1.0}
    out = M.out_of_fold(rows, {"naive_bayes": {}}, 4)
    assert out.count() == 160 and out.where("p_naive_bayes IS NULL").count() == 0


def test_settings_that_give_one_model_are_fitted_once(spark, monkeypatch):
    rows = spark.range(400).select("id", array_to_vector(F.array(*[(F.hash("id", F.lit(j)) % 100).cast("double") for j in range(4)])).alias("features"),
                                   (F.hash("id", F.lit(0)) % 100 > 20).cast("int").alias("label"))
    fits = []
    fit = M.SplitTree._fit
    monkeypatch.setattr(M.SplitTree, "_fit", lambda self, d: fits.append(d.rdd.getNumPartitions()) or fit(self, d))
    grid = {"minSamplesSplit": [2, 5, 10], "minInstancesPerNode": [1, 2, 4]}
    scores = M.tune("decision_tree", rows.repartition(16), grid, 2)[1].collect()
    assert len(scores) == 9 and len(fits) == 5 * 2 + 1  # least parts of 1 to 5 rows
    assert set(fits) == {1}  # small tables are fitted by one task
    by = {r["settings"]: r["f1"] for r in scores}
    assert by["minInstancesPerNode=1, minSamplesSplit=10"] == by["minInstancesPerNode=4, minSamplesSplit=10"]


def test_limits_that_a_tree_stays_within_are_fitted_once(spark, monkeypatch):
    rows = spark.range(400).select("id", array_to_vector(F.array(*[(F.hash("id", F.lit(j)) % 100).cast("double") for j in range(4)])).alias("features"),
                                   (F.hash("id", F.lit(0)) % 100 > 20).cast("int").alias("label")).withColumn(
        "label", F.when(F.col("id") % 7 == 0, 1 - F.col("label")).otherwise(F.col("label")))
    single = {d: M.tune("decision_tree", rows, {"maxDepth": [d]}, 2)[1].first()["f1"] for d in (2, 25, 28, 30)}
    fits = []
    fit = M.SplitTree._fit
    monkeypatch.setattr(M.SplitTree, "_fit", lambda self, d: fits.append(self.value("maxDepth")) or fit(self, d))
    scores = M.tune("decision_tree", rows, {"maxDepth": [2, 25, 28, 30]}, 2)[1].collect()
    assert sorted(fits[:-1]) == [2, 2, 30, 30]  # two folds; the last fit is that of the best setting
    assert {r["settings"]: r["f1"] for r in scores} == {f"maxDepth={d}": v for d, v in single.items()}
    assert single[2] != single[30]
    assert M._family(M.SplitForest(maxDepth=5)) != M._family(M.SplitForest(maxDepth=6))  # forests are never shared


@pytest.mark.parametrize("local", [True, False])
def test_large_forests_are_tables_of_nodes(spark, rows, monkeypatch, local):
    whole = M.fit("random_forest", rows, numTrees=7, maxDepth=4)
    monkeypatch.setattr(M, "FOREST_NODES", 7 * 50)  # a tree of four levels has 31 nodes at most
    assert M.importance(M.fit("random_forest", rows, numTrees=7, maxDepth=4)) == M.importance(whole)
    monkeypatch.setattr(M, "FOREST_NODES", 45)
    monkeypatch.setattr(M.T, "GROUP_NODES", 40)
    if not local:
        monkeypatch.setattr(M.T, "MOST_BYTES", 0)  # too large for a task
    parted = M.fit("random_forest", rows, numTrees=7, maxDepth=4)
    nodes = parted.model.nodes
    assert parted.model.getNumTrees == nodes.select("tree").distinct().count() == 7 and nodes.count() > 40
    # the same trees as one MLlib model
    plain = M.T.load(nodes, M.SplitForest(numTrees=7).passes(M.T.small_table(spark, 5)), True, new_path(spark, "plain"))
    assert np.allclose(M.importance(parted), M.importance(M.Trained("plain", plain)))
    wanted = {r.id: (round(r.probability, 9), r.prediction) for r in M.Trained("plain", plain).score(rows).collect()}
    path = new_path(spark, "parts")
    M.save(parted, path)
    for trained in (parted, M.load(spark, "random_forest", path)):
        scored = trained.score(rows).collect()
        assert len(scored) == 160 and {r.id: (round(r.probability, 9), r.prediction) for r in scored} == wanted
        assert np.mean([r.prediction == r.label for r in scored]) > 0.85


def test_trees_of_large_tables_equal_those_of_mllib(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (3000, 5))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(0, 1, 3000) > 0.6).astype(int)
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i])) for i in range(3000)], "id bigint, a array<double>, label int").select(
        "id", array_to_vector("a").alias("features"), "label").repartition(3).cache()

    def shape(model):
        return model.numNodes, model.depth, [round(v, 9) for v in model.featureImportances.toArray()], [
            round(r[0][1], 9) for r in model.transform(rows).orderBy("id").select("probability").collect()]

    settings = [{"maxBins": 16, "minInstancesPerNode": 25}, {"maxBins": 64, "minInstancesPerNode": 25}, {"maxDepth": 3, "minSamplesSplit": 60}]
    passes = [shape(M.fit("decision_tree", rows, **s).model) for s in settings]
    monkeypatch.setattr(M, "LOCAL_ROWS", 1000)
    fitted = [M.fit("decision_tree", rows, **s).model for s in settings]
    assert all(m.nodes.count() == m.numNodes for m in fitted) and [shape(m) for m in fitted] == passes
    # a lower limit only cuts
    deep = M.SplitTree(maxDepth=12)
    ready = M._ready(rows)
    whole = deep.fit(ready)
    for limit in (5, 8):
        low = M.SplitTree(maxDepth=limit)
        assert whole.depth > limit and shape(low.under(whole, ready)) == shape(low.fit(ready))
    scores = M.tune("decision_tree", rows, {"maxDepth": [2, 5, 12]}, 2)[1].collect()
    monkeypatch.setattr(M, "LOCAL_ROWS", 10_000)
    again = M.tune("decision_tree", rows, {"maxDepth": [2, 5, 12]}, 2)[1].collect()
    assert [r.settings for r in scores] == [r.settings for r in again] and np.allclose([r.f1 for r in scores], [r.f1 for r in again], atol=0.02)


def test_partitions_of_a_fit_are_bounded_by_cores_and_rows(spark):
    wide = spark.range(0, 100_000, 1, 300)
    cores = spark.sparkContext.defaultParallelism
    assert M.dealt(wide, 100_000).rdd.getNumPartitions() == min(cores, 12)
    assert M.dealt(wide, 100_000, M.NET_TASK_ROWS).rdd.getNumPartitions() == cores
    assert M.dealt(wide, 5).rdd.getNumPartitions() == 1


def test_a_fold_model_scores_its_rows_once(spark, rows, monkeypatch):
    calls = []
    score = M.Trained.score
    monkeypatch.setattr(M.Trained, "score", lambda self, df, *names: calls.append(1) or score(self, df, *names))
    got = {(r.fold, r.split, r.metric): r.value for r in M.cross_validate("naive_bayes", rows, 2).collect()}
    assert len(calls) == 2 and len(got) == 2 * 2 * 5
    folds = M.P.assign_folds(rows, "id", "label", 2, 42, "stratified").cache()
    for f in range(2):
        train = folds.filter(F.col("fold") != f)
        fitted = M.fit("naive_bayes", train)
        for split, part in (("train", train), ("test", folds.filter(F.col("fold") == f))):
            m = M.evaluate(fitted, part, split).first()
            assert all(abs(got[f, split, s] - m[s]) < 1e-9 for s in ("accuracy", "precision", "recall", "f1"))
