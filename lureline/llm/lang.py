"""Language identification in two levels: the family first, then the languages within it.

Every decision is made by linear support vector machines over hashed byte grams of the lower-cased
text, one for each pair of classes of a node. They are fitted by MLlib on a sample of labelled rows
that is bounded per language (``per_language``); every document is then scored where it lies, from its
whole text, without a shuffle. The model is a few rows of ``hashed.SIZE`` weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LinearSVC
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lureline.llm import hashed
from lureline.llm.common import documents, flat_text, map_arrow, materialise, narrow, slices
from lureline.shared import lookup_join

PER_LANGUAGE = 1200   # expected training rows of one language
SLOPE = 2.0           # of the logistic curve from margin to score
# Families of common language codes; another code is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi bn ur pa gu mr ne si",
    "semitic": "ar he mt am",
    "sinitic": "zh yue",
}


def family_of(language: str) -> str:
    return next((f for f, codes in FAMILIES.items() if language.lower().split("-")[0] in codes.split()), language)


@dataclass
class Model:
    """Nodes by name ("" is the family node) with their classes, and pair machines in one weight table."""

    nodes: dict[str, list[str]]
    pairs: list[tuple[str, int, int]]
    weights: np.ndarray
    biases: np.ndarray


def held_out(id_column: str) -> Column:
    """True for ids of the test part; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return flat_text(pc.utf8_lower(column.cast(pa.large_string())))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            rows = hashed.frequencies(*_lowered(part.column("text")))
            yield pa.RecordBatch.from_arrays(
                [part.column("lang"), pa.array([r[0] for r in rows], pa.list_(pa.int32())),
                 pa.array([r[1] for r in rows], pa.list_(pa.float64()))], ["lang", "slots", "values"])


@F.udf(VectorUDT())
def _vector(slots, values):
    return Vectors.sparse(hashed.SIZE, slots, values)


def training_rows(labelled: DataFrame, per_language: int) -> tuple[DataFrame, list[str]]:
    """Vectors of a repeatable sample by a hash of the id, about ``per_language`` rows for each language."""
    counts = materialise(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")), "lid-languages")
    if counts.isEmpty():
        return labelled, []
    unit = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = lookup_join(labelled, counts, "lang", "doc_id").where(unit < per_language / F.col("_n")).select("lang", "text")
    rows = materialise(map_arrow(sample, _features, "lang string, slots array<int>, values array<double>"), "lid-sample")
    found = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    return rows.select("lang", _vector("slots", "values").alias("features")), found


def fit(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
        per_language: int = PER_LANGUAGE) -> Model:
    """Learns from rows outside the test part that have a text and a language."""
    rows = narrow(df, doc_id=id_column, text=text_column, lang=lang_column)
    labelled = rows.where(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    vectors, languages = training_rows(labelled, per_language)
    families = sorted({family_of(x) for x in languages})
    nodes = {"": families} | {f: [x for x in languages if family_of(x) == f] for f in families}
    pairs, weights, biases = [], [], []
    for node, classes in nodes.items():
        member = {x: family_of(x) if node == "" else x for x in languages}
        for a, b in combinations(range(len(classes)), 2):
            of = {side: [x for x in languages if member[x] == classes[side]] for side in (a, b)}
            pair = vectors.where(F.col("lang").isin(of[a] + of[b])).select(
                "features", F.col("lang").isin(of[a]).cast("double").alias("label"))
            machine = LinearSVC(maxIter=15, regParam=1e-3).fit(pair)
            pairs.append((node, a, b))
            weights.append(machine.coefficients.toArray())
            biases.append(machine.intercept)
    table = np.array(weights, np.float32).reshape(len(pairs), hashed.SIZE)
    return Model(nodes, pairs, table, np.array(biases))


def _node_scores(model: Model, margins: np.ndarray, node: str) -> np.ndarray:
    """For each text and class of the node the mean score in its pairs; they sum to one over two classes."""
    classes = model.nodes[node]
    total = np.zeros((len(margins), len(classes)))
    for j, (owner, a, b) in enumerate(model.pairs):
        if owner == node:
            p = 1 / (1 + np.exp(-SLOPE * np.clip(margins[:, j], -50, 50)))
            total[:, a] += p
            total[:, b] += 1 - p
    return total / max(len(classes) - 1, 1) if len(classes) > 1 else total + 1.0


def predict(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; ``und`` with score 0 where there is no letter."""
    margins = hashed.linear_scores(*_lowered(column), model.weights) + model.biases
    family = _node_scores(model, margins, "") if model.nodes[""] else np.zeros((len(column), 0))
    letters = pc.fill_null(pc.match_substring_regex(column.cast(pa.large_string()), r"\p{L}"), False).to_numpy(zero_copy_only=False)
    names, scores = np.full(len(column), "und", object), np.zeros(len(column))
    if not family.shape[1]:
        return names.tolist(), scores
    best = family.argmax(axis=1)
    for f, name in enumerate(model.nodes[""]):
        mine = np.flatnonzero((best == f) & letters)
        inner = _node_scores(model, margins[mine], name)
        chosen = inner.argmax(axis=1)
        names[mine] = np.array(model.nodes[name], object)[chosen]
        scores[mine] = family[mine, f] * inner[np.arange(len(mine)), chosen]
    return names.tolist(), scores


def identify(df: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; repeated rows give repeated results.

    Only the text enters a prediction. Null, empty and letterless texts are ``und`` with score 0, and
    so is everything if nothing could be learned.
    """
    rows = narrow(df, doc_id=id_column, text=text_column).withColumn("held_out", held_out("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                names, scores = predict(model, part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores)],
                    ["doc_id", "held_out", "lang_pred", "score"])

    schema = T.StructType([rows.schema["doc_id"], T.StructField("held_out", T.BooleanType()),
                           T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return map_arrow(rows, run, schema)


def op9_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return identify(docs, fit(docs))


QUERIES = {"op9_language_id": op9_language_id}
SQL: dict[str, str] = {}
