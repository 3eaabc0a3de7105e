"""Classifiers on MLlib: training, scoring, importance, cross-validation, tuning.

Input tables carry ``features`` (vector), ``label`` (0/1) and an id. Models are MLlib pipeline
models, so they can be saved and loaded with the ML writer.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml import classification as C
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable,
    MLWriter)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lureline.operators import metrics as M
from lureline.operators import prep as P
from lureline.operators import trees as T
from lureline.operators.neighbors import nearest
from lureline.operators.ranking import hash_rank
from lureline.shared import materialise, new_path

MAX_DEPTH = 30  # deepest tree MLlib grows; stands for "no limit"
SCORES = [*M.METRICS, "roc_auc"]
PARALLEL_FITS = 4
TASK_ROWS = 8192  # fewer rows a task cost more by what each task hands on in every iteration than they save
NET_TASK_ROWS = 256  # a dense net computes some 10^5 products a row
MOST_TASK_ROWS = 1_000_000
TREE_MEMORY_MB = 512  # statistics of open nodes that a task holds at once
LOCAL_ROWS = 20_000  # from here a tree is grown by one task; MLlib's passes hand on more the more nodes are open
FOREST_NODES = 200_000  # nodes of trees that MLlib grows together, as the driver holds them all with their statistics


def dealt(df: DataFrame, rows: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """The rows in as many partitions as a fit uses well.

    Every partition hands on a whole gradient, or the statistics of all open tree nodes, in each iteration. Their number
    is therefore bounded by the cores instead of growing with the shuffles that made the table. ``df`` should be kept or
    written, as merged partitions are computed by one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(1, min(cores, rows // task_rows), -(-rows // MOST_TASK_ROWS)))


# ---- transformers used inside pipelines ------------------------------------------------------------------


class AbsoluteFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Absolute values of a vector column."""

    @keyword_only
    def __init__(self, inputCol: str = "features", outputCol: str = "absolute"):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        values = F.transform(vector_to_array(self.getInputCol()), lambda v: F.abs(v))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(values))


class FourierFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Random Fourier features: a projection whose inner products approach the RBF kernel.

    The projection is redrawn from the seed inside each task, so nothing but numbers is shipped.
    """

    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    size = Param(Params._dummy(), "size", "number of features", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCol: str = "features", outputCol: str = "fourier", gamma: float = 0.1,
                 size: int = 256, seed: int = 42):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, gamma=gamma, size=size, seed=seed)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        gamma, size, seed = (self.getOrDefault(p) for p in (self.gamma, self.size, self.seed))

        @F.pandas_udf("array<double>")
        def project(vectors):
            import pandas as pd

            x = np.stack(vectors.to_numpy()).astype(float) if len(vectors) else np.zeros((0, 1))
            rng = np.random.default_rng(seed)
            w = rng.normal(0.0, np.sqrt(2.0 * gamma), (x.shape[1], size))
            shift = rng.uniform(0.0, 2.0 * np.pi, size)
            return pd.Series(list(np.sqrt(2.0 / size) * np.cos(x @ w + shift)))

        values = project(vector_to_array(self.getInputCol()))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(values))


def _param(name: str, text: str, kind: Callable) -> Param:
    return Param(Params._dummy(), name, text, kind)


class Tunable(Estimator):
    """Estimators that put several MLlib stages together under Params of their own, so that grids reach them."""

    def __init__(self, **values) -> None:
        super().__init__()
        self._set(**{k: v for k, v in values.items() if v is not None})

    def value(self, name: str):
        param = self.getParam(name)
        return self.getOrDefault(param) if self.isDefined(param) else None

    def given(self, *names: str) -> dict:
        """The values of those Params that are set."""
        return {n: self.value(n) for n in names if self.value(n) is not None}


class CalibratedSVC(Tunable):
    """Linear SVM whose margins become probabilities by a sigmoid fitted on held-out rows; regParam defaults to 1 / rows."""

    featuresCol = _param("featuresCol", "vector column", TypeConverters.toString)
    idCol = _param("idCol", "id column that decides what is held out", TypeConverters.toString)
    maxIter = _param("maxIter", "iterations", TypeConverters.toInt)
    regParam = _param("regParam", "regularisation", TypeConverters.toFloat)
    seed = _param("seed", "random seed", TypeConverters.toInt)

    def __init__(self, **values) -> None:
        super().__init__(**{"featuresCol": "features", "idCol": "id", "maxIter": 100, "seed": 42, **values})

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        rows = dataset.count()
        parts = dealt(hash_rank(dataset, self.value("idCol"), ["label"], self.value("seed"), "_rank", "_n"), rows)
        held_out = F.col("_rank") <= F.col("_n") * 0.2
        weight = {"weightCol": "weight"} if "weight" in dataset.columns else {}
        penalty = self.value("regParam")
        svc = C.LinearSVC(featuresCol=self.value("featuresCol"), labelCol="label", maxIter=self.value("maxIter"), **weight,
                          regParam=1.0 / max(rows, 1) if penalty is None else penalty, rawPredictionCol="_raw", predictionCol="_svc")
        margin = VectorSlicer(inputCol="_raw", outputCol="_margin", indices=[1])
        sigmoid = C.LogisticRegression(featuresCol="_margin", labelCol="label", rawPredictionCol="_logit")
        svc_model = svc.fit(parts.filter(~held_out))
        return PipelineModel([svc_model, margin, sigmoid.fit(margin.transform(svc_model.transform(parts.filter(held_out))))])


class KernelSVC(CalibratedSVC):
    """The same over random Fourier features; gamma defaults to 1 / (dimensions * variance of all values)."""

    size = _param("size", "number of Fourier features", TypeConverters.toInt)
    gamma = _param("gamma", "kernel width", TypeConverters.toFloat)

    def __init__(self, **values) -> None:
        super().__init__(**{"size": 256, **values})

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        gamma, inputs = self.value("gamma"), self.value("featuresCol")
        if gamma is None:
            cells = dataset.select(F.explode(vector_to_array(inputs)).alias("x"), F.size(vector_to_array(inputs)).alias("d"))
            row = cells.agg(F.var_pop("x").alias("v"), F.max("d").alias("d")).first()
            gamma = 1.0 / (row["d"] * row["v"]) if row["v"] else 1.0
        fourier = FourierFeatures(inputCol=inputs, gamma=gamma, size=self.value("size"), seed=self.value("seed"))
        svc = CalibratedSVC(featuresCol="fourier", **self.given("idCol", "maxIter", "regParam", "seed"))
        return PipelineModel([fourier, *svc.fit(fourier.transform(dataset)).stages])


class AbsoluteBayes(Tunable):
    """Naive Bayes over absolute values, as its multinomial form takes no negative ones."""

    smoothing = _param("smoothing", "added to every count", TypeConverters.toFloat)
    modelType = _param("modelType", "form of naive Bayes", TypeConverters.toString)

    def __init__(self, **values) -> None:
        super().__init__(**{"smoothing": 1.0, "modelType": "multinomial", **values})

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        bayes = C.NaiveBayes(featuresCol="absolute", **self.given("smoothing", "modelType"))
        return Pipeline(stages=[AbsoluteFeatures(), bayes]).fit(dataset)


class SplitTree(Tunable):
    """Decision tree with a least size of nodes that are split.

    MLlib bounds the parts of a split only, so a node is split if both parts keep ``minInstancesPerNode`` rows and
    half of ``minSamplesSplit``.
    """

    maxDepth = _param("maxDepth", "deepest level", TypeConverters.toInt)
    maxBins = _param("maxBins", "bins of a feature", TypeConverters.toInt)
    minInstancesPerNode = _param("minInstancesPerNode", "least rows of a part", TypeConverters.toInt)
    minSamplesSplit = _param("minSamplesSplit", "least rows of a node that is split", TypeConverters.toInt)
    minInfoGain = _param("minInfoGain", "least gain of a split", TypeConverters.toFloat)
    impurity = _param("impurity", "gini or entropy", TypeConverters.toString)
    seed = _param("seed", "random seed", TypeConverters.toInt)
    kind: Callable[..., Estimator] = C.DecisionTreeClassifier
    passed = ("maxDepth", "maxBins", "minInfoGain", "impurity", "seed")
    many = False

    def __init__(self, **values) -> None:
        super().__init__(**{"maxDepth": MAX_DEPTH, "minInstancesPerNode": 1, "minSamplesSplit": 2, "seed": 42, **values})

    def _fit(self, dataset: DataFrame) -> Model:
        nodes = self.local_nodes(dataset) if dataset.count() >= LOCAL_ROWS else None
        return self.passes(dataset) if nodes is None else self.loaded(dataset, nodes)

    def local_nodes(self, dataset: DataFrame, trees: int = 1) -> DataFrame | None:
        """Nodes of trees that single tasks grow; None for tables and settings that are left to MLlib's passes."""
        given = self.given(*self.passed)
        bins = given.get("maxBins", 32)
        width = T.width_of(dataset)
        if (given.get("impurity", "gini"), given.get("featureSubsetStrategy", "auto"), given.get("subsamplingRate", 1.0)) != ("gini", "auto", 1.0):
            return None
        weight = F.col("weight") if "weight" in dataset.columns else F.lit(1.0)
        classes = {r["label"]: r for r in dataset.groupBy("label").agg(
            F.min(weight).alias("low"), F.max(weight).alias("high"), F.count(F.lit(1)).alias("n")).limit(3).collect()}
        one_weight = all(r["low"] is not None and r["low"] > 0 and r["high"] - r["low"] <= 1e-9 * r["high"] for r in classes.values())
        if classes.keys() != {0, 1} or not one_weight or bins > T.MOST_BINS or sum(r["n"] for r in classes.values()) * width > T.MOST_BYTES:
            return None
        rules = T.Rules((classes[0]["low"], classes[1]["low"]), self.value("maxDepth"), self.least(), given.get("minInfoGain", 0.0),
                        self.many and trees > 1, self.value("seed"))
        return T.nodes_of(dataset, trees, bins, rules)

    def loaded(self, dataset: DataFrame, nodes: DataFrame) -> Model:
        """The model of these nodes, which it carries along as ``nodes``."""
        model = T.load(nodes, self.passes(T.small_table(dataset.sparkSession, T.width_of(dataset))), self.many, new_path(dataset.sparkSession, "trees"))
        model.nodes = nodes
        return model

    def under(self, model: Model, dataset: DataFrame) -> Model:
        """The model for a lower limit of depth than that of ``model``, cut from its nodes where it carries them."""
        nodes = getattr(model, "nodes", None)
        return self.fit(dataset) if nodes is None else self.loaded(dataset, T.limited(nodes, self.value("maxDepth")))

    def passes(self, dataset: DataFrame) -> Model:
        weight = {"weightCol": "weight"} if "weight" in dataset.columns else {}
        # more memory saves passes over the rows; kept node numbers spare sending all trees along with each pass
        return type(self).kind(minInstancesPerNode=self.least(), cacheNodeIds=self.many, maxMemoryInMB=TREE_MEMORY_MB, **weight,
                               **self.given(*self.passed)).fit(dataset)

    def least(self) -> int:
        return max(self.value("minInstancesPerNode"), -(-self.value("minSamplesSplit") // 2))

    def effect(self) -> tuple:
        return (self.least(), *sorted(self.given(*self.passed).items()))

    def limit(self) -> int | None:
        """The deepest level, if a tree that ends above it is the same under every limit; a forest's draws depend on it."""
        return None if self.many else self.value("maxDepth")


class SplitForest(SplitTree):
    """Random forest with the same Params."""

    numTrees = _param("numTrees", "trees", TypeConverters.toInt)
    featureSubsetStrategy = _param("featureSubsetStrategy", "features that a split looks at", TypeConverters.toString)
    subsamplingRate = _param("subsamplingRate", "share of rows of a tree", TypeConverters.toFloat)
    kind = C.RandomForestClassifier
    passed = (*SplitTree.passed, "numTrees", "featureSubsetStrategy", "subsamplingRate")
    many = True

    def __init__(self, **values) -> None:
        super().__init__(**{"numTrees": 100, **values})

    def _fit(self, dataset: DataFrame) -> Model:
        """One MLlib forest, or a table of nodes where the driver should not hold them all.

        A tree has fewer than two nodes a row; where that leaves it open, one tree is grown to see how many there are.
        """
        trees, rows = self.value("numTrees"), dataset.count()
        if 2 * trees * rows <= FOREST_NODES:
            return self.passes(dataset)
        # a bag has its seed plus the number of a partition, so the seeds of parts lie far apart
        seeds = random.Random(self.value("seed"))
        sized = lambda n: self.copy({self.numTrees: n, self.seed: seeds.getrandbits(31)})
        size = sized(1).passes(dataset).totalNumNodes
        if trees * size <= FOREST_NODES or trees == 1:
            return self.passes(dataset)
        nodes = self.local_nodes(dataset, trees)
        if nodes is None:
            runs = -(-trees // max(1, FOREST_NODES // size))
            parts, start = [], 0
            for n in (trees // runs + (i < trees % runs) for i in range(runs)):
                path = new_path(dataset.sparkSession, "trees")
                sized(n).passes(dataset).write().save(path)
                parts.append(T.nodes_of_saved(dataset.sparkSession, path, start))
                start += n
            nodes = T.union(parts)
        return ForestTable(nodes, trees)


class _ForestWriter(MLWriter):
    def __init__(self, model: ForestTable) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.nodes.write.mode("errorifexists").parquet(f"{path}/nodes")


class _ForestReader(MLReader):
    def load(self, path: str) -> ForestTable:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = ForestTable(self.sparkSession.read.schema(T.NODES).parquet(f"{path}/nodes"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class ForestTable(Model, MLWritable, MLReadable):
    """A forest with more nodes than the driver should hold: they stay a table, which rows meet in tasks."""

    trees = _param("trees", "number of trees", TypeConverters.toInt)

    def __init__(self, nodes: DataFrame, trees: int | None = None) -> None:
        super().__init__()
        self.nodes = nodes
        if trees is not None:
            self._set(trees=trees)

    @property
    def featureImportances(self) -> DenseVector:
        """As MLlib's: gain times weight by feature, each tree and then the sum of all brought to one."""
        inner = self.nodes.filter("feature >= 0").groupBy("tree", "feature").agg(F.sum(F.col("gain") * (F.col("no") + F.col("yes"))).alias("v"))
        whole = inner.groupBy("tree").agg(F.sum("v").alias("all"))
        found = inner.join(whole, "tree").groupBy("feature").agg(F.sum(F.col("v") / F.col("all")).alias("v")).collect()
        out = np.zeros(1 + max((r["feature"] for r in found), default=-1))
        for r in found:
            out[r["feature"]] = r["v"]
        return Vectors.dense(out / out.sum() if out.sum() else out)

    @property
    def getNumTrees(self) -> int:
        return self.getOrDefault(self.trees)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Adds probability and prediction from the votes of all trees; the rows are written first and numbered.

        The rows of a stream cannot be, so the trees are loaded for them.
        """
        if dataset.isStreaming:
            spark, width = dataset.sparkSession, 1 + max(0, self.nodes.agg(F.max("feature")).first()[0])
            template = SplitForest(numTrees=self.getNumTrees).passes(T.small_table(spark, width))
            return T.load(self.nodes, template, True, new_path(spark, "trees")).transform(dataset)
        rows = materialise(dataset.withColumn("_row", F.monotonically_increasing_id()), "forest-rows")
        out = rows.join(T.votes(rows, self.nodes, self.getNumTrees), "_row").drop("_row")
        no, yes = F.col("_no"), F.col("_yes")
        return _as_classifier(out.withColumns({
            "probability": yes / (no + yes), "prediction": F.when(yes > no, 1).otherwise(0)}).drop("_no", "_yes"))

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()


def _as_classifier(scored: DataFrame) -> DataFrame:
    """Probability as a vector of both classes and prediction as a double, the columns of MLlib's classifiers."""
    p = F.col("probability")
    return scored.withColumns({"probability": array_to_vector(F.array(1 - p, p)), "prediction": F.col("prediction").cast("double")})


class _NeighbourWriter(MLWriter):
    def __init__(self, model: NeighbourModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.train.write.mode("errorifexists").parquet(f"{path}/train")


class _NeighbourReader(MLReader):
    def load(self, path: str) -> NeighbourModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = NeighbourModel(self.sparkSession.read.parquet(f"{path}/train"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class NeighbourModel(Model, MLWritable, MLReadable):
    """k nearest neighbours; the training table is the model."""

    neighbours = _param("neighbours", "k", TypeConverters.toInt)
    idCol = _param("idCol", "id column of both tables", TypeConverters.toString)

    def __init__(self, train: DataFrame, k: int = 5, id_column: str = "id") -> None:
        super().__init__()
        self.train = train
        self._set(neighbours=k, idCol=id_column)

    @property
    def k(self) -> int:
        return self.getOrDefault(self.neighbours)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Adds probability (share of class 1 among the neighbours) and prediction."""
        name = self.getOrDefault(self.idCol)

        pairs = nearest(dataset, self.train, self.k, name)
        known = self.train.select(F.col(name).alias("neighbour"), F.col("label").alias("_l"))
        share = pairs.join(known, "neighbour").groupBy("id").agg(F.avg("_l").alias("probability"))
        joined = dataset.join(share.withColumnRenamed("id", name), name, "left")
        return _as_classifier(joined.withColumn("prediction", F.when(F.col("probability") > 0.5, 1).otherwise(0)))

    def write(self) -> MLWriter:
        return _NeighbourWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _NeighbourReader()


class NeighbourClassifier(Tunable):
    """Keeps the training table for ``NeighbourModel``."""

    k = _param("k", "neighbours", TypeConverters.toInt)
    idCol = _param("idCol", "id column", TypeConverters.toString)

    def __init__(self, **values) -> None:
        super().__init__(**{"k": 5, "idCol": "id", **values})

    def _fit(self, dataset: DataFrame) -> NeighbourModel:
        name = self.value("idCol")
        return NeighbourModel(dataset.select(name, "features", "label"), self.value("k"), name)


class _EnsembleWriter(MLWriter):
    def __init__(self, model: EnsembleModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        names = list(self.model.bases)
        extra = {"bases": names, "meta": self.model.meta is not None}
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata=extra)
        for i, name in enumerate(names):
            self.model.bases[name].model.write().save(f"{path}/bases/{i}")
        if self.model.meta is not None:
            self.model.meta.write().save(f"{path}/meta")


class _EnsembleReader(MLReader):
    def load(self, path: str) -> EnsembleModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        part = lambda name: DefaultParamsReader.loadParamsInstance(f"{path}/{name}", self.sparkSession)
        bases = {name: Trained(name, part(f"bases/{i}")) for i, name in enumerate(metadata["bases"])}
        model = EnsembleModel(bases, meta=part("meta") if metadata["meta"] else None)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class EnsembleModel(Model, MLWritable, MLReadable):
    """Fitted models under their names, joined by a vote with weights or by a meta model over their probabilities."""

    voting = _param("voting", "soft or hard", TypeConverters.toString)
    weights = _param("weights", "weight of each model", TypeConverters.toListFloat)

    def __init__(self, bases: dict[str, Trained], voting: str = "soft", weights: list[float] | None = None, meta: Model | None = None) -> None:
        super().__init__()
        self.bases, self.meta = bases, meta
        self._set(voting=voting, weights=[float(w) for w in weights or [1.0] * len(bases)])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Adds probability and prediction; the probabilities of the bases are dropped again."""
        from lureline.operators import ensemble as E

        columns = [f"p_{n}" for n in self.bases]
        scored = with_probabilities(dataset, self.bases)
        if self.meta is not None:
            out = E.apply_meta(self.meta, scored, columns)
        else:
            out = E.vote(scored, columns, self.getOrDefault(self.voting), self.getOrDefault(self.weights))
        return _as_classifier(out.drop(*columns))

    def write(self) -> MLWriter:
        return _EnsembleWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _EnsembleReader()


def ensemble(bases: dict[str, Trained], voting: str = "soft", weights: list[float] | None = None, meta: Model | None = None,
             name: str = "ensemble") -> Trained:
    """An ensemble as a model of its own, which is scored, evaluated and saved like any other."""
    if not bases:
        raise ValueError("an ensemble needs at least one model")
    return Trained(name, EnsembleModel(bases, voting, weights, meta))


# ---- the model catalogue ------------------------------------------------------------------------------------

Factory = Callable[..., Estimator]


def _logistic(seed: int, n: int, **o) -> Estimator:
    return C.LogisticRegression(weightCol="weight", **{"maxIter": 1000, "regParam": 1.0 / n, "standardization": False, **o})


def _svm_linear(seed: int, n: int, max_iter: int | None = None, **o) -> Estimator:
    return CalibratedSVC(seed=seed, **{"maxIter": max_iter or 100, **o})


def _svm_rbf(seed: int, n: int, max_iter: int | None = None, **o) -> Estimator:
    return KernelSVC(seed=seed, **{"maxIter": max_iter or 100, **o})


def _forest(seed: int, n: int, **o) -> Estimator:
    return SplitForest(seed=seed, **o)


def _boosting(seed: int, n: int, **o) -> Estimator:
    return C.GBTClassifier(seed=seed, **{"maxIter": 100, "stepSize": 0.1, "maxDepth": 3, **o})


def _bayes(seed: int, n: int, **o) -> Estimator:
    return AbsoluteBayes(**o)


def _tree(seed: int, n: int, **o) -> Estimator:
    return SplitTree(seed=seed, **o)


def _neighbours(seed: int, n: int, **o) -> Estimator:
    return NeighbourClassifier(**o)


def _dense_net(seed: int, n: int, inputs: int = 48, hidden: tuple[int, ...] = (256, 128, 64), **o) -> Estimator:
    return C.MultilayerPerceptronClassifier(layers=[inputs, *hidden, 2], seed=seed, **{"maxIter": 50, **o})


MODELS: dict[str, Factory] = {
    "logistic_regression": _logistic, "svm_linear": _svm_linear, "svm_rbf": _svm_rbf, "random_forest": _forest,
    "gradient_boosting": _boosting, "naive_bayes": _bayes, "decision_tree": _tree, "dense_net": _dense_net,
    "knn": _neighbours,
}
# settings of the tuned forest and its search grid
TUNED_FOREST = {"numTrees": 300, "maxDepth": 25}
FOREST_GRID = {"numTrees": [100, 200, 300], "maxDepth": [15, 20, 25, MAX_DEPTH], "minSamplesSplit": [2, 5, 10],
               "minInstancesPerNode": [1, 2, 4]}


@dataclass
class Trained:
    """A fitted model under its catalogue name."""

    name: str
    model: PipelineModel | Model
    scores: DataFrame | None = None
    settings: dict = field(default_factory=dict)

    def score(self, df: DataFrame, probability: str = "probability", prediction: str = "prediction") -> DataFrame:
        """Adds the class 1 probability and the 0/1 prediction; row local except for neighbours.

        Models without a probability give 0 or 1.
        """
        out = self.model.transform(df.drop("probability", "prediction", "rawPrediction"))
        p = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
        return self._restore(df, out.withColumns({"_p": p, "_y": F.col("prediction").cast("int")}), probability, prediction)

    @staticmethod
    def _restore(df: DataFrame, out: DataFrame, probability: str, prediction: str) -> DataFrame:
        keep = [c for c in df.columns if c not in (probability, prediction)]
        return out.select(*keep, F.col("_p").alias(probability), F.col("_y").alias(prediction))


def build(name: str, seed: int, n: int, **settings) -> Estimator:
    if name not in MODELS:
        raise ValueError(f"model {name} not found")
    return MODELS[name](seed, n, **settings)


def _ready(df: DataFrame) -> DataFrame:
    return df if "weight" in df.columns else P.balanced_weights(df, "label")


def fit(name: str, train: DataFrame, seed: int = 42, **settings) -> Trained:
    """Fit one catalogue model with balanced class weights."""
    if name == "knn":
        return Trained(name, NeighbourModel(train, settings.get("k", 5)), settings=settings)
    # training reads its rows many times; keep them unless the caller already does
    held = train.storageLevel.useMemory or train.storageLevel.useDisk
    kept = train if held else train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = kept.count()
        estimator = build(name, seed, max(rows, 1), **settings)
        ready = dealt(_ready(kept), rows, NET_TASK_ROWS if name == "dense_net" else TASK_ROWS)
        return Trained(name, estimator.fit(ready), settings=settings)
    finally:
        if not held:
            kept.unpersist()


def evaluate(trained: Trained, df: DataFrame, split: str) -> DataFrame:
    """(model, split, counts, metrics) of one table."""
    scored = trained.score(df)
    m = M.binary_metrics(scored)
    return m.select(F.lit(trained.name).alias("model"), F.lit(split).alias("split"), *m.columns)


def train_model(name: str, train: DataFrame, validation: DataFrame | None = None, seed: int = 42, **settings) -> Trained:
    """Fit and score on the training and, if given, the validation rows."""
    trained = fit(name, train, seed, **settings)
    trained.scores = evaluate(trained, train, "train")
    if validation is not None:
        trained.scores = trained.scores.unionByName(evaluate(trained, validation, "validation"))
    return trained


def train_all(train: DataFrame, validation: DataFrame | None = None, settings: dict[str, dict] | None = None,
              seed: int = 42) -> tuple[dict[str, Trained], dict[str, str]]:
    """Train the named models; a model that fails is reported in the second result and skipped."""
    done, failed = {}, {}
    for name, options in (settings or {n: {} for n in MODELS}).items():
        try:
            done[name] = train_model(name, train, validation, seed, **options)
        except Exception as e:  # one model must not end the others
            failed[name] = f"{type(e).__name__}: {e}"
    return done, failed


def compare(done: dict[str, Trained]) -> DataFrame:
    """Leaderboard of trained models by validation F1."""
    rows = None
    for t in done.values():
        rows = t.scores if rows is None else rows.unionByName(t.scores)
    val = F.col("split") == "validation"
    wide = rows.groupBy("model").agg(
        F.max(F.when(~val, F.col("accuracy"))).alias("train_accuracy"),
        *[F.max(F.when(val, F.col(m))).alias(f"val_{m}") for m in M.METRICS])
    return M.leaderboard(wide)


def importance(trained: Trained) -> list[float] | None:
    """Tree importance, else absolute coefficients, else None."""
    model = trained.model
    stages = model.stages if isinstance(model, PipelineModel) else [model]
    for stage in stages:
        if hasattr(stage, "featureImportances"):
            return [float(x) for x in stage.featureImportances.toArray()]
    for stage in stages:
        if hasattr(stage, "coefficients"):
            return [abs(float(x)) for x in stage.coefficients.toArray()]
    return None


def top_features(spark: SparkSession, trained: Trained, names: list[str], n: int = 5) -> DataFrame:
    """(name, importance) of the n most important features; empty for models without importance."""
    values = importance(trained) or []
    rows = sorted(zip(names, values), key=lambda r: (-r[1], r[0]))[:n]
    return spark.createDataFrame(rows, "name string, importance double")


def with_probabilities(df: DataFrame, models: dict[str, Trained]) -> DataFrame:
    """Adds ``p_<name>`` for every model, one after the other without a join."""
    for name, trained in models.items():
        df = trained.score(df, f"p_{name}", f"_y_{name}").drop(f"_y_{name}")
    return df


# ---- cross-validation and tuning ---------------------------------------------------------------------------------


def _all_scores(trained: Trained, df: DataFrame, by: str) -> dict:
    """Scores of each group of the rows. The rows are read and scored once, their three small columns are kept meanwhile."""
    scored = trained.score(df).select(by, "label", "probability", "prediction").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = M.binary_metrics(scored, [by]).join(M.roc_auc(scored, [by]), by).collect()
        return {r[by]: {s: r[s] for s in SCORES} for r in found}
    finally:
        scored.unpersist()


def cross_validate(name: str, df: DataFrame, k: int = 5, strategy: str = "stratified", seed: int = 42,
                   id_column: str = "id", **settings) -> DataFrame:
    """(model, fold, split, metric, value) for train and test parts of each fold.

    Each fold leaves ten numbers on the driver.
    """
    folds = _folds(df, id_column, k, seed, strategy)
    spark = df.sparkSession

    def one(f: int) -> list[tuple]:
        trained = fit(name, folds.filter(F.col("fold") != f), seed, **settings)
        found = _all_scores(trained, folds.withColumn("split", F.when(F.col("fold") == f, "test").otherwise("train")), "split")
        return [(name, f, split, metric, float(v)) for split in ("train", "test")
                for metric, v in found[split].items() if v is not None]

    rows = [row for found in _parallel(one, range(k)) for row in found]
    return spark.createDataFrame(rows, "model string, fold int, split string, metric string, value double")


def _effect(estimator: Estimator) -> tuple:
    """All that a fit depends on: estimators of equal effect give equal models."""
    if isinstance(estimator, SplitTree):
        return estimator.effect()
    return tuple((p.name, str(estimator.getOrDefault(p))) for p in estimator.params if estimator.isDefined(p))


def _family(estimator: Estimator) -> tuple[tuple, int]:
    """The effect without the deepest level, and that level, for estimators that it may leave without influence."""
    limit = estimator.limit() if isinstance(estimator, SplitTree) else None
    effect = _effect(estimator)
    return (effect, 0) if limit is None else (tuple(v for v in effect if v != ("maxDepth", limit)), limit)


def _folds(df: DataFrame, id_column: str, k: int, seed: int, strategy: str = "stratified") -> DataFrame:
    """Rows with their fold, written once and read by every fit."""
    return materialise(P.assign_folds(df, id_column, "label", k, seed, strategy), "folds")


def _parallel(function: Callable, items, threads: int = PARALLEL_FITS) -> list:
    """Fits of different folds or settings side by side; each is a handful of Spark jobs."""
    with ThreadPool(threads) as pool:
        return pool.map(inheritable_thread_target(function), list(items))


def cross_validate_all(df: DataFrame, settings: dict[str, dict], k: int = 5, seed: int = 42) -> tuple[DataFrame, dict[str, str]]:
    """Fold scores of several models; a model that fails is reported and skipped."""
    out, failed = None, {}
    for name, options in settings.items():
        try:
            rows = cross_validate(name, df, k, seed=seed, **options)
            out = rows if out is None else out.unionByName(rows)
        except Exception as e:  # one model must not end the others
            failed[name] = f"{type(e).__name__}: {e}"
    if out is None:
        raise ValueError(f"no model could be validated: {failed}")
    return out, failed


def tune(name: str, df: DataFrame, grid: dict[str, list], k: int = 5, search: str = "grid", draws: int = 20,
         seed: int = 42, parallelism: int = 4, id_column: str = "id") -> tuple[Trained, DataFrame]:
    """Grid or random search by F1 over stratified folds; the best setting is refitted on all rows.

    Returns the model and (settings, f1) per tried point.
    """
    if search not in ("grid", "random"):
        raise ValueError(f"unknown search type: {search}")
    estimator = build(name, seed, max(df.count(), 1))
    builder = ParamGridBuilder()
    for param, values in grid.items():
        builder = builder.addGrid(getattr(estimator, param), values)
    points = builder.build()
    if search == "random" and len(points) > draws:
        points = random.Random(seed).sample(points, draws)
    f1 = MulticlassClassificationEvaluator(labelCol="label", metricName="fMeasureByLabel", metricLabel=1.0)
    # points that come to the same model are fitted once
    alike: dict[tuple, list[int]] = {}
    for i, point in enumerate(points):
        alike.setdefault(_effect(estimator.copy(point)), []).append(i)
    # a tree that ends within a lower limit is that limit's tree as well, so the highest limit is grown first
    families: dict[tuple, list[tuple[int, list[int]]]] = {}
    for same in alike.values():
        family, limit = _family(estimator.copy(points[same[0]]))
        families.setdefault(family, []).append((limit, same))
    for members in families.values():
        members.sort(reverse=True)
    folds = materialise(P.assign_folds(_ready(df), id_column, "label", k, seed).withColumn("label", F.col("label").cast("double")), "folds")
    found = np.zeros((len(points), k))
    for f in range(k):
        train, test = (folds.filter(rows_of).persist(StorageLevel.MEMORY_AND_DISK) for rows_of in (F.col("fold") != f, F.col("fold") == f))
        parts = [dealt(d, d.count()) for d in (train, test)]

        def score(members: list[tuple[int, list[int]]], parts: list[DataFrame] = parts) -> list[float]:
            model, values = None, []
            for limit, same in members:
                if model is None or model.depth > limit:
                    own = estimator.copy(points[same[0]])
                    model = own.fit(parts[0]) if model is None else own.under(model, parts[0])
                    values.append(f1.evaluate(model.transform(parts[1])))
                else:
                    values.append(values[-1])
            return values

        for members, values in zip(families.values(), _parallel(score, families.values(), parallelism)):
            for (_, same), value in zip(members, values):
                found[same, f] = value
        train.unpersist()
        test.unpersist()
    means = found.mean(axis=1)
    rows = [(", ".join(f"{p.name}={v}" for p, v in sorted(point.items(), key=lambda x: x[0].name)), float(s))
            for point, s in zip(points, means)]
    best = int(means.argmax())
    kept = folds.persist(StorageLevel.MEMORY_AND_DISK)
    model = estimator.fit(dealt(kept, kept.count()), points[best])
    kept.unpersist()
    settings = {p.name: v for p, v in points[best].items()}
    scores = df.sparkSession.createDataFrame(rows, "settings string, f1 double")
    return Trained(name, model, scores, settings), scores


def learning_curve(name: str, df: DataFrame, k: int = 5, sizes: list[float] | None = None, seed: int = 42,
                   id_column: str = "id", **settings) -> DataFrame:
    """(size, split, mean, std) of F1 when only the first share of each training part is used."""
    sizes = sizes or [i / 10 for i in range(1, 11)]
    folds = _folds(df, id_column, k, seed)
    # a row's rank within its class among the training rows of every fold that it trains, written once
    trains = folds.withColumn("_f", F.explode(F.array(*[F.lit(f) for f in range(k)]))).filter(F.col("_f") != F.col("fold"))
    ranked = materialise(hash_rank(trains, id_column, ["_f", "label"], f"{seed}-curve", "_rank", "_n"), "curve-ranks")

    def one(point: tuple[int, float]) -> list[tuple]:
        f, size = point
        part = ranked.filter((F.col("_f") == f) & (F.col("_rank") <= F.ceil(F.col("_n") * size))).drop("_rank", "_n", "_f")
        trained = fit(name, part, seed, **settings)
        return [(float(size), split, f, evaluate(trained, rows_of, split).first()["f1"])
                for split, rows_of in (("train", part), ("test", folds.filter(F.col("fold") == f)))]

    rows = [row for found in _parallel(one, [(f, size) for f in range(k) for size in sizes]) for row in found]
    scores = df.sparkSession.createDataFrame(rows, "size double, split string, fold int, value double")
    return M.fold_summary(scores, ["size", "split"]).drop("folds")


# ---- ensembles over fitted models -----------------------------------------------------------------------------------


def out_of_fold(df: DataFrame, settings: dict[str, dict], k: int = 5, seed: int = 42, id_column: str = "id") -> DataFrame:
    """Rows with ``p_<name>`` from models that did not see them."""
    folds = _folds(df, id_column, k, seed)

    def one(f: int) -> DataFrame:
        train, rest = folds.filter(F.col("fold") != f), folds.filter(F.col("fold") == f)
        return with_probabilities(rest, {n: fit(n, train, seed, **o) for n, o in settings.items()})

    out = None
    for part in _parallel(one, range(k)):
        out = part if out is None else out.unionByName(part)
    return out


def save(trained: Trained, path: str) -> None:
    """Model and score table by the ML and parquet writers."""
    from lureline.sources.sinks import save_model

    save_model(trained.model, trained.scores, path)


def load(spark: SparkSession, name: str, path: str, kind: type | None = None) -> Trained:
    """A saved model. ``kind`` is the class that was saved; without it the saved metadata say which."""
    if kind is None:
        return Trained(name, DefaultParamsReader.loadParamsInstance(f"{path}/model", spark))
    return Trained(name, kind.load(f"{path}/model"))
