"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or nothing on every document. Expectation-maximisation over the
counts of vote patterns, which are few whatever the corpus size, estimates how often each heuristic is
right and gives each pattern a posterior. A bounded sample of documents with these posteriors trains a
linear scorer over hashed byte grams and repetition features, which then judges every document by its
whole text. No label is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lureline.llm import hashed
from lureline.llm.common import documents, flat_text, map_arrow, materialise, narrow, slices
from lureline.llm.line_rules import repeated_words

TRAINING_ROWS = 6000   # expected size of the sample that the scorer is fitted on
EM_ROUNDS = 200
PRIOR_GOOD = 0.8       # start of the estimate
THRESHOLD = 0.5        # documents scored below are rejected
EXTRA = 4              # features besides byte grams: repeats of the word before, of passages, of words nearby, short texts
BLOCK = 100            # words among which distinct ones are counted, whatever the length of the text
SIZE = hashed.SIZE + EXTRA
# Frequent short words that running text of these languages has.
COMMON_WORDS = frozenset(
    "the of and to in a is that for it as was with be on are this from "
    "der die das und in den von zu mit ist des auf für nicht ein eine im dem "
    "de la le les et des en un une du que est pour dans par sur pas au "
    "el los las y del se por con para su al lo una como".encode().split())
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_MARKS = b"#$%&*<>|{}[]~^\\"
LABELLERS = ["marks", "capitals", "shouts", "echo", "variety", "common_words", "sentences", "word_shape"]


def _vote(bad: bool, good: bool) -> int:
    return -1 if bad else 1 if good else 0


def votes(text: str | None) -> tuple[list[int], tuple[float, float, float, float]]:
    """One vote per labeller (1 good, -1 bad, 0 none) and the repetition features of a text.

    Variety is told by the share of words in repeated passages and by the distinct words of each block of
    ``BLOCK`` words; a share over the whole text would fall with its length.
    """
    body = (text or "").encode()
    words = body.split()
    n = len(words)
    if not n:
        return [0] * len(LABELLERS), (0.0, 0.0, 0.0, 1.0)
    size = len(body)
    marks = size - len(body.translate(None, _MARKS))
    upper, lower = (size - len(body.translate(None, x)) for x in (_UPPER, _LOWER))
    shouts = body.count(b"!!") + body.count(b"??")
    echo = sum(map(eq, words, words[1:])) / max(n - 1, 1)
    repeated = repeated_words(words) / n
    variety = sum(len(set(words[k:k + BLOCK])) for k in range(0, n, BLOCK)) / n
    said = [w for w, before in zip(words, [b"", *words]) if w != before]  # an echo is no evidence of running text
    common = sum(w in COMMON_WORDS for w in said) / n
    ends = sum(w.endswith(b".") for w in said) / n
    spoken = b"".join(said)
    plain = (len(spoken) - len(spoken.translate(None, _LETTERS))) / (size - n + 1)
    out = [_vote(marks > 0.15 * n, False),  # five look for one defect each and say nothing without it
           _vote(upper > lower, False),
           _vote(shouts > 0.05 * n, False),
           _vote(echo > 0.15 and n >= 5, False),
           _vote((repeated > 0.5 or variety < 0.25) and n >= 20, False),
           _vote(common < 0.03 and n >= 20, common > 0.12),
           _vote((ends < 0.004 or ends > 0.8) and n >= 40, 0.01 < ends < 0.5),
           _vote(plain < 0.75 and n >= 20, plain > 0.9)]
    return out, (echo, repeated, 1 - variety, 1 / n)


def _pattern(marks: list[int]) -> int:
    """Votes as the digits of a number in base three."""
    return sum((v + 1) * 3 ** i for i, v in enumerate(marks))


def vote_patterns(df: DataFrame) -> DataFrame:
    """doc_id and the pattern of votes of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [_pattern(votes(t)[0]) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.int32())], ["doc_id", "pattern"])

    return map_arrow(df, run, T.StructType([df.schema["doc_id"], T.StructField("pattern", T.IntegerType())]))


def estimate(counts: dict[int, int], rounds: int = EM_ROUNDS) -> tuple[dict[int, float], dict[str, tuple[float, float]]]:
    """Posterior of "good" for each pattern, and for each labeller how often it says good of good and bad of bad documents.

    Votes are taken as independent given the class; a labeller that does not vote says nothing. The
    estimate starts from labellers that are right more often than not, which settles which class is which.
    """
    m = len(LABELLERS)
    patterns = np.array(sorted(counts), np.int64)
    weight = np.array([counts[int(p)] for p in patterns], float)
    marks = np.stack([patterns // 3 ** i % 3 - 1 for i in range(m)], axis=1)
    right = np.full((2, m), 0.8)   # rows: good documents voted good, bad documents voted bad
    prior = PRIOR_GOOD
    posterior = np.full(len(patterns), prior)
    for _ in range(rounds):
        good = np.log(prior) + np.where(marks > 0, np.log(right[0]), np.where(marks < 0, np.log(1 - right[0]), 0)).sum(axis=1)
        bad = np.log(1 - prior) + np.where(marks < 0, np.log(right[1]), np.where(marks > 0, np.log(1 - right[1]), 0)).sum(axis=1)
        new = 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))
        moved, posterior = np.abs(new - posterior).max(initial=0.0), new
        of_good, of_bad = weight * posterior, weight * (1 - posterior)
        right[0] = ((of_good[:, None] * (marks > 0)).sum(axis=0) + 4) / ((of_good[:, None] * (marks != 0)).sum(axis=0) + 5)
        right[1] = ((of_bad[:, None] * (marks < 0)).sum(axis=0) + 4) / ((of_bad[:, None] * (marks != 0)).sum(axis=0) + 5)
        prior = float(np.clip((of_good.sum() + 4) / (weight.sum() + 5), 0.02, 0.98))
        if moved < 1e-9:
            break
    accuracy = {name: (float(right[0, i]), float(right[1, i])) for i, name in enumerate(LABELLERS)}
    return dict(zip(patterns.tolist(), posterior.tolist())), accuracy


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            rows = hashed.frequencies(*flat_text(part.column("text")))
            voted = [votes(t) for t in part.column("text").to_pylist()]
            slots = [np.concatenate([r[0], np.arange(hashed.SIZE, SIZE)]) for r in rows]
            values = [np.concatenate([r[1], e]) for r, (_, e) in zip(rows, voted)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_pattern(v) for v, _ in voted], pa.int32()), pa.array(slots, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))],
                ["pattern", "slots", "values"])


@F.udf(VectorUDT())
def _vector(slots, values):
    return Vectors.sparse(SIZE, slots, values)


class Scorer:
    """Weights of the linear scorer, and what the labellers were found to be worth."""

    def __init__(self, weights: np.ndarray, bias: float, accuracy: dict[str, tuple[float, float]]) -> None:
        self.weights, self.bias, self.accuracy = weights, bias, accuracy

    def scores(self, column: pa.Array) -> np.ndarray:
        """Probability of "good" for each text."""
        grams = hashed.linear_scores(*flat_text(column), self.weights[None, :hashed.SIZE])[:, 0]
        extra = np.array([votes(t)[1] for t in column.to_pylist()]).reshape(-1, EXTRA)
        return 1 / (1 + np.exp(-np.clip(grams + extra @ self.weights[hashed.SIZE:] + self.bias, -50, 50)))


def fit(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", training_rows: int = TRAINING_ROWS) -> Scorer:
    """Votes of all documents, then a scorer from a repeatable sample of about ``training_rows`` of them."""
    rows = narrow(df, doc_id=id_column, text=text_column)
    voted = vote_patterns(rows).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["pattern"]: r["n"] for r in voted.collect()}  # at most 3^8 patterns
    posterior, accuracy = estimate(counts)
    if not counts:
        return Scorer(np.zeros(SIZE), 50.0, accuracy)
    unit = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(unit < training_rows / sum(counts.values()))
    made = map_arrow(sample.select("text"), _features, "pattern int, slots array<int>, values array<double>")
    made = materialise(made, "quality-sample")
    good = F.element_at(F.create_map(*[F.lit(x) for k, p in posterior.items() for x in (k, float(p))]), F.col("pattern"))
    soft = made.select(_vector("slots", "values").alias("features"), good.alias("p"))
    both = soft.select("features", F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight")))).alias("_s"))
    both = both.select("features", "_s.label", "_s.weight").where("weight > 1e-6")
    if both.select("label").distinct().count() < 2:
        return Scorer(np.zeros(SIZE), 50.0 if max(posterior.values()) >= 0.5 else -50.0, accuracy)
    fitted = LogisticRegression(weightCol="weight", maxIter=30, regParam=1e-4).fit(both)
    return Scorer(fitted.coefficients.toArray(), float(fitted.intercept), accuracy)


def judged(df: DataFrame, scorer: Scorer, id_column: str = "doc_id", text_column: str = "text",
           threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, quality_score and kept of every row; repeated rows give repeated results.

    Null, empty and blank texts have score 0 and are not kept. If the corpus gives only one class,
    every other document gets that class.
    """
    rows = narrow(df, doc_id=id_column, text=text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                blank = np.array([not (t or "").strip() for t in part.column("text").to_pylist()])
                scores = np.where(blank, 0.0, scorer.scores(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores), pa.array(scores >= threshold)],
                                                 ["doc_id", "quality_score", "kept"])

    schema = T.StructType([rows.schema["doc_id"], T.StructField("quality_score", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    return map_arrow(rows, run, schema)


def kept_rows(df: DataFrame, scorer: Scorer, text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns; texts are judged where they lie."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_column):
                blank = np.array([not (t or "").strip() for t in part.column(text_column).to_pylist()])
                yield part.filter(pa.array(~blank & (scorer.scores(part.column(text_column)) >= threshold)))

    return map_arrow(df, run, df.schema)


def op5_quality_classifier(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return judged(docs, fit(docs))


QUERIES = {"op5_quality_classifier": op5_quality_classifier}
SQL: dict[str, str] = {}
