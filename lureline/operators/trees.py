"""Trees of large tables, grown by single tasks over the bin numbers of all rows.

MLlib collects the statistics of all open nodes, each as large as features times bins, from every task in each pass, and
keeps all nodes on the driver. Deep trees have about a node for every few rows, so both grow with the table. Here a
feature becomes the number of its bin, one byte a cell, and a task that holds them grows whole trees, level by level, by
MLlib's rules: thresholds from a sample of rows, gini gain, the first of equal splits, Poisson bags and the square root of
the features for a forest, merged leaves of one prediction. Nodes go to a table in MLlib's format, never to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lureline.shared import materialise, new_path

MOST_BYTES = 64 << 20  # cells that a task holds, a byte each
MOST_BINS = 256
CELLS = 1 << 20  # node, feature and bin
PLACES = 1 << 22  # row and feature
SAMPLE_ROWS = 10_000
PACK_ROWS = 8192
GROUP_NODES = 2_000_000  # nodes that a task holds to score rows, some 50 bytes each
PACK = "pack bigint, n int, codes binary, labels binary"
NODES = ("tree int, id int, prediction double, impurity double, no double, yes double, n bigint, gain double, left int, "
         "right int, feature int, threshold double")


class Rules(NamedTuple):
    """What a tree is grown by; ``weights`` are those of a row of class 0 and 1."""

    weights: tuple[float, float]
    depth: int
    least: int
    gain: float
    forest: bool
    seed: int


class Tree(NamedTuple):
    feature: np.ndarray  # -1 in a leaf
    bin: np.ndarray      # the last bin of the left part
    left: np.ndarray
    right: np.ndarray
    counts: np.ndarray   # rows of class 0 and 1
    gain: np.ndarray


def thresholds(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """MLlib's candidates: middles of neighbouring values, all of them or those nearest to equal shares of the weight."""
    found, at = np.unique(values, return_inverse=True)
    middles = (found[:-1] + found[1:]) / 2
    if len(middles) <= bins - 1:
        return middles
    upto, stride = np.cumsum(np.bincount(at, weights)), weights.sum() / bins
    chosen, target = [], stride
    for i in range(1, len(found)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            chosen.append(middles[i - 1])
            target += stride
    return np.array(chosen)


def _best_splits(codes: np.ndarray, yes: np.ndarray, bags: np.ndarray | None, rows: np.ndarray, bounds: np.ndarray,
                 totals: np.ndarray, chosen: np.ndarray | None, bins: int, rules: Rules) -> tuple[np.ndarray, ...]:
    """Cost, feature, bin and left counts of each node's best split; rows stand node by node, cost is infinite without one."""
    nodes, width = len(bounds) - 1, codes.shape[1] if chosen is None else chosen.shape[1]
    w0, w1 = rules.weights
    cost, feature, place, left = np.full(nodes, np.inf), np.full(nodes, -1), np.zeros(nodes, int), np.zeros((nodes, 2))
    start = 0
    while start < nodes:
        stop = min(nodes, start + max(1, CELLS // (width * bins)))
        stop = max(start + 1, min(stop, int(np.searchsorted(bounds, bounds[start] + max(PACK_ROWS, PLACES // width), "right")) - 1))
        part = rows[bounds[start]:bounds[stop]]
        node = np.repeat(np.arange(stop - start), np.diff(bounds[start:stop + 1]))
        step = max(1, min(width, PLACES // max(len(part), 1)))
        for first in range(0, width, step):
            last = min(first + step, width)
            own = codes[part, first:last] if chosen is None else codes[part[:, None], chosen[start:stop][node, first:last]]
            at = ((node[:, None] * (last - first) + np.arange(last - first)) * bins + own)
            shape, size = (stop - start, last - first, bins), (stop - start) * (last - first) * bins
            one = yes[part]

            def counted(at: np.ndarray, weight: np.ndarray | None, size: int = size, shape: tuple = shape) -> np.ndarray:
                spread = None if weight is None else np.repeat(weight, at.shape[1])
                return np.bincount(at.ravel(), spread, size).reshape(shape).cumsum(2)[:, :, :-1]

            l1 = counted(at[one], None if bags is None else bags[part[one]])
            l0 = counted(at[~one], None if bags is None else bags[part[~one]])
            r0, r1 = totals[start:stop, 0, None, None] - l0, totals[start:stop, 1, None, None] - l1
            with np.errstate(divide="ignore", invalid="ignore"):
                # the impurity of a part times its weight is twice this
                here = l0 * w0 * (l1 * w1) / (l0 * w0 + l1 * w1) + r0 * w0 * (r1 * w1) / (r0 * w0 + r1 * w1)
            here[(l0 + l1 < rules.least) | (r0 + r1 < rules.least)] = np.inf
            flat = here.reshape(stop - start, -1)
            best = flat.argmin(1)
            each = np.arange(stop - start)
            better = np.flatnonzero(flat[each, best] < cost[start:stop])
            f, b = np.divmod(best[better], bins - 1)
            cost[start + better] = flat[better, best[better]]
            feature[start + better] = first + f if chosen is None else chosen[start + better, first + f]
            place[start + better] = b
            left[start + better] = np.column_stack([l0[better, f, b], l1[better, f, b]])
        start = stop
    return cost, feature, place, left


def grown(codes: np.ndarray, yes: np.ndarray, bins: int, rules: Rules, tree: int) -> Tree:
    """One tree, its nodes level by level. Rows are counted by class, so equal counts give equal gains."""
    rng = np.random.default_rng([rules.seed, tree])
    w = np.array(rules.weights)
    bags = rng.poisson(1.0, len(yes)).astype(float) if rules.forest else None
    rows = np.arange(len(yes)) if bags is None else np.flatnonzero(bags)
    each = np.ones(len(yes)) if bags is None else bags
    width = codes.shape[1]
    looked = int(np.ceil(np.sqrt(width))) if rules.forest else width
    counts = [np.array([[each[rows[~yes[rows]]].sum(), each[rows[yes[rows]]].sum()]])]
    features, places, lefts, rights, gains = [], [], [], [], []
    bounds, level, made = np.array([0, len(rows)]), 0, 1
    open_ = np.array([True])  # of the nodes of the present level
    while len(open_):
        here = counts[-1]
        open_ &= (here > 0).all(1) & (here.sum(1) >= 2 * rules.least) & (level < rules.depth)
        feature, place, left, gain = np.full(len(here), -1), np.zeros(len(here), int), np.zeros((len(here), 2)), np.full(len(here), -1.0)
        which = np.flatnonzero(open_)
        sizes = np.diff(bounds)
        rows = rows[np.repeat(open_, sizes)]
        within = np.concatenate([[0], np.cumsum(sizes[which])])
        if len(which):
            chosen = None
            if looked < width:
                chosen = np.sort(rng.random((len(which), width)).argpartition(looked, 1)[:, :looked], 1)
            cost, feature[which], place[which], left[which] = _best_splits(codes, yes, bags, rows, within, here[which], chosen, bins, rules)
            mass = here[which] * w
            whole = mass.sum(1)
            gain[which] = 2 * (mass.prod(1) / whole - cost) / whole
            # what rounding leaves of no gain is none
            none = which[~((gain[which] > 1e-14) & (gain[which] >= rules.gain))]
            feature[none], gain[none] = -1, -1.0
        cut = np.flatnonzero(feature >= 0)
        number = np.full(len(here), -1)
        number[cut] = made + 2 * np.arange(len(cut))
        features.append(feature)
        places.append(place)
        gains.append(gain)
        lefts.append(number)
        rights.append(np.where(number < 0, -1, number + 1))
        made += 2 * len(cut)
        if not len(cut):
            break
        child = np.empty((2 * len(cut), 2))
        child[0::2], child[1::2] = left[cut], here[cut] - left[cut]
        counts.append(child)
        node = np.repeat(which, sizes[which])
        kept = feature[node] >= 0
        rows, node = rows[kept], node[kept]
        rank = np.zeros(len(here), int)
        rank[cut] = np.arange(len(cut))
        to = 2 * rank[node] + (codes[rows, feature[node]] > place[node])
        rows = rows[np.argsort(to, kind="stable")]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(to, minlength=2 * len(cut)))])
        open_ = np.ones(2 * len(cut), bool)
        level += 1
    return merged(Tree(*[np.concatenate(x) for x in (features, places, lefts, rights, counts, gains)]), w)


def predictions(tree: Tree, weights: np.ndarray) -> np.ndarray:
    mass = tree.counts * weights
    return (mass[:, 1] > mass[:, 0]).astype(float)


def merged(tree: Tree, weights: np.ndarray) -> Tree:
    """Without pairs of leaves that have one prediction; children have higher numbers than their parent."""
    y = predictions(tree, weights)
    leaf = tree.left < 0
    while True:
        inner = np.flatnonzero(~leaf)
        a, b = tree.left[inner], tree.right[inner]
        gone = inner[leaf[a] & leaf[b] & (y[a] == y[b])]
        if not len(gone):
            break
        leaf[gone] = True
    return _reached(tree, leaf)


def _reached(tree: Tree, leaf: np.ndarray) -> Tree:
    """The nodes that are reached if ``leaf`` has no children, numbered anew in their order."""
    kept = np.zeros(len(leaf), bool)
    ids = np.array([0])
    while len(ids):
        kept[ids] = True
        inner = ids[~leaf[ids]]
        ids = np.concatenate([tree.left[inner], tree.right[inner]])
    number = np.cumsum(kept) - 1
    bare = leaf[kept]
    child = lambda ids: np.where(bare, -1, number[ids[kept]])
    return Tree(np.where(bare, -1, tree.feature[kept]), tree.bin[kept], child(tree.left), child(tree.right), tree.counts[kept],
                np.where(bare, -1.0, tree.gain[kept]))


def _packed(cuts: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pack = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, PACK_ROWS):
                part = batch.slice(start, PACK_ROWS)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, len(cuts))
                codes = np.column_stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)]).astype(np.uint8)
                y = part.column("y").to_numpy(zero_copy_only=False).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([pack]), pa.array([part.num_rows], pa.int32()), pa.array([codes.tobytes()]), pa.array([y.tobytes()])],
                    ["pack", "n", "codes", "labels"])
                pack += 1

    return run


def _growing(cuts: list[np.ndarray], trees: int, tasks: int, bins: int, rules: Rules):
    w = np.array(rules.weights)

    def rows_of(tree: Tree, number: int) -> pa.RecordBatch:
        mass = tree.counts * w
        share = mass / mass.sum(1)[:, None]
        cut = np.array([np.nan if f < 0 else cuts[f][b] for f, b in zip(tree.feature, tree.bin)])
        n = len(cut)
        columns = [np.full(n, number, np.int32), np.arange(n, dtype=np.int32), predictions(tree, w), 1 - (share ** 2).sum(1), mass[:, 0],
                   mass[:, 1], tree.counts.sum(1).astype(np.int64), tree.gain, tree.left.astype(np.int32),
                   tree.right.astype(np.int32), tree.feature.astype(np.int32), cut]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in NODES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for task, codes, labels in zip(*(batch.column(c).to_pylist() for c in ("task", "codes", "labels"))):
                xs, ys = held.setdefault(task, ([], []))
                xs.append(np.frombuffer(codes, np.uint8).reshape(-1, len(cuts)))
                ys.append(np.frombuffer(labels, np.uint8))
        if not held:
            return
        xs, ys = next(iter(held.values()))  # every task of this partition has the same rows
        codes, yes = np.concatenate(xs), np.concatenate(ys) > 0
        mine = sorted(held)
        del held, xs, ys
        for task in mine:
            for number in range(task, trees, tasks):
                yield rows_of(grown(codes, yes, bins, rules, number), number)

    return run


def nodes_of(df: DataFrame, trees: int, bins: int, rules: Rules) -> DataFrame:
    """The written nodes of all trees over ``features`` and ``label``. The driver gets a sample of rows and no node."""
    spark = df.sparkSession
    rows = df.select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("y"))
    total = rows.count()
    wanted = max(bins * bins, SAMPLE_ROWS)
    sample = (rows if wanted >= total else rows.sample(wanted / total, rules.seed)).toArrow()
    x = sample.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(sample.num_rows, -1)
    weights = np.array(rules.weights)[sample.column("y").to_numpy()]
    cuts = [thresholds(x[:, j], weights, bins) for j in range(x.shape[1])]
    packs = materialise(rows.mapInArrow(_packed(cuts), PACK), "bins")
    tasks = min(trees, spark.sparkContext.defaultParallelism)
    each = packs.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    dealt = each.repartitionByRange(tasks, "task").sortWithinPartitions("task", "pack")
    return materialise(dealt.mapInArrow(_growing(cuts, trees, tasks, bins, rules), NODES), "nodes")


def load(nodes: DataFrame, template: Model, forest: bool, path: str) -> Model:
    """The MLlib model of these nodes: a small model of the same settings whose nodes are exchanged."""
    template.write().save(path)
    split = F.struct(F.col("feature").alias("featureIndex"), F.when(F.col("feature") < 0, F.array().cast("array<double>")).otherwise(
        F.array("threshold")).alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    node = {"id": F.col("id"), "prediction": F.col("prediction"), "impurity": F.col("impurity"), "impurityStats": F.array("no", "yes"),
            "rawCount": F.col("n"), "gain": F.col("gain"), "leftChild": F.col("left"), "rightChild": F.col("right"), "split": split}
    columns = [c.alias(n) for n, c in node.items()]
    out = nodes.select(F.col("tree").alias("treeID"), F.struct(*columns).alias("nodeData")) if forest else nodes.select(*columns)
    out.write.mode("overwrite").parquet(f"{path}/data")
    return type(template).load(path)


def nodes_of_saved(spark: SparkSession, path: str, start: int) -> DataFrame:
    """The nodes of a forest that MLlib saved, its trees numbered from ``start``."""
    n = F.col("nodeData")
    columns = {"id": n["id"], "prediction": n["prediction"], "impurity": n["impurity"], "no": n["impurityStats"][0], "yes": n["impurityStats"][1],
               "n": n["rawCount"], "gain": n["gain"], "left": n["leftChild"], "right": n["rightChild"], "feature": n["split"]["featureIndex"],
               "threshold": F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0))}
    return spark.read.parquet(f"{path}/data").select((F.col("treeID") + start).alias("tree"), *[c.alias(k) for k, c in columns.items()])


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return materialise(out, "nodes")


def _voting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by key with the trees of a key first: votes of these trees for each row."""
    key, held = None, []
    for batch in batches:
        keys = batch.column("key").to_numpy()
        numbers = batch.column("row").to_numpy(zero_copy_only=False)
        kinds = batch.column("query").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(kinds.astype(np.int8)) != 0)) + 1
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
            if keys[start] != key:
                key, held = keys[start], []
            if not kinds[start]:
                for i in range(start, stop):
                    columns = [batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("ids", "feature", "x", "left", "right", "no", "yes")]
                    order = np.argsort(columns[0])
                    feature, threshold, left, right, no, yes = (c[order] for c in columns[1:])
                    leaf = feature < 0
                    at = np.arange(len(leaf))
                    share = yes / (no + yes)  # a leaf is its own child
                    held.append((np.where(leaf, 0, feature), threshold, np.where(leaf, at, left), np.where(leaf, at, right), leaf, share))
                continue
            x = batch.column("x").slice(start, stop - start).flatten().to_numpy(zero_copy_only=False).reshape(stop - start, -1)
            each, votes = np.arange(len(x)), np.zeros(len(x))
            for feature, threshold, left, right, leaf, share in held:
                node = np.zeros(len(x), np.int64)
                while not leaf[node].all():
                    node = np.where(x[each, feature[node]] > threshold[node], right[node], left[node])
                votes += share[node]
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers[start:stop].astype(np.int64)), pa.array(len(held) - votes), pa.array(votes)], ["_row", "_no", "_yes"])


def votes(rows: DataFrame, nodes: DataFrame, trees: int) -> DataFrame:
    """(_row, _no, _yes): shares of the classes in the leaves that a row reaches, summed over all trees.

    Trees are dealt to groups of at most about ``GROUP_NODES`` nodes; a task holds one group, and rows stream through it.
    """
    spark = rows.sparkSession
    groups = min(trees, -(-nodes.count() // GROUP_NODES))
    copies = max(1, -(-spark.sparkContext.defaultParallelism // groups))  # tasks that share the rows of a group
    packed = nodes.groupBy("tree").agg(*[F.collect_list(F.struct("id", "feature", "left", "right", "no", "yes", F.coalesce(
        "threshold", F.lit(float("nan"))).alias("x"))).alias("s")])
    number = (F.col("tree") % groups) * copies
    listed = {c: F.col(f"s.{f}") for c, f in (("ids", "id"), ("feature", "feature"), ("left", "left"), ("right", "right"), ("no", "no"), ("yes", "yes"))}
    a = packed.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).select(
        (number + F.col("_c")).alias("key"), F.lit(False).alias("query"), F.lit(None).cast("bigint").alias("row"), F.col("s.x").alias("x"),
        *[v.alias(c) for c, v in listed.items()])
    own = F.pmod(F.xxhash64("_row"), F.lit(copies)).cast("int")
    types = {f.name: f.dataType for f in a.schema}
    b = rows.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(
        (F.col("_g") * copies + own).alias("key"), F.lit(True).alias("query"), F.col("_row").alias("row"), vector_to_array("features").alias("x"),
        *[F.lit(None).cast(types[c]).alias(c) for c in listed])
    met = a.unionByName(b).repartition(groups * copies, "key").sortWithinPartitions("key", "query")
    found = met.mapInArrow(_voting, "_row bigint, _no double, _yes double")
    return found.groupBy("_row").agg(F.sum("_no").alias("_no"), F.sum("_yes").alias("_yes"))


def small_table(spark: SparkSession, width: int) -> DataFrame:
    """Two rows with vectors of that width, for a model that takes its settings but not its nodes from a fit."""
    return spark.createDataFrame([(Vectors.dense([float(v)] * width), float(v), 1.0) for v in (0, 1)], ["features", "label", "weight"])


def width_of(df: DataFrame) -> int:
    return df.select(F.size(vector_to_array("features")).alias("n")).first()["n"]


def limited(nodes: DataFrame, depth: int) -> DataFrame:
    """The tree of ``nodes`` as it is under a lower limit of its depth, which only cuts what lies below."""
    t = nodes.orderBy("id").toPandas()
    tree = Tree(*(t[c].to_numpy() for c in ("feature", "id", "left", "right")), t[["no", "yes"]].to_numpy(), t["gain"].to_numpy())
    level = np.zeros(len(t), int)
    for child in (tree.left, tree.right):
        assert (child[child >= 0] > np.flatnonzero(child >= 0)).all()
    ids, at = np.array([0]), 0
    while len(ids):
        level[ids] = at
        inner = ids[tree.left[ids] >= 0]
        ids, at = np.concatenate([tree.left[inner], tree.right[inner]]), at + 1
    cut = merged(_reached(tree, (tree.left < 0) | (level >= depth)), np.ones(2))
    old = t.iloc[cut.bin].reset_index(drop=True)  # "bin" carried the number of the node
    for name, values in (("feature", cut.feature), ("left", cut.left), ("right", cut.right), ("gain", cut.gain), ("id", np.arange(len(old)))):
        old[name] = values
    old.loc[old["feature"] < 0, "threshold"] = np.nan
    return nodes.sparkSession.createDataFrame(old[[c.split()[0] for c in NODES.split(", ")]], NODES)
