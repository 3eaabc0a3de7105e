"""Feature preparation: splits, folds, weights, TF-IDF, token ids, scaling, oversampling."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lureline.functions import text as T
from lureline.operators.neighbors import nearest
from lureline.operators.ranking import hash_rank
from lureline.shared import BROADCAST_ROWS, lookup_join, materialise, once, row_hash

MAX_CLASSES = 10_000


# ---- splits and weights ------------------------------------------------------------------------------


def stratified_split(df: DataFrame, id_column: str, label: str, test_size: float = 0.15,
                     val_size: float | None = 0.15, val_of_rest: float | None = None, seed: int = 42) -> DataFrame:
    """Adds ``split``: test, val or train with exact per-class sizes, by hash rank.

    ``val_size`` is a share of all rows; ``val_of_rest`` gives it as a share of what the test set
    leaves instead.
    """
    rest = val_of_rest if val_of_rest is not None else (val_size or 0.0) / (1 - test_size)
    ranked = hash_rank(df, id_column, [label], seed, "_rank", "_n")
    n_test = F.round(F.col("_n") * F.lit(float(test_size)))
    n_val = F.round((F.col("_n") - n_test) * F.lit(float(rest)))
    split = F.when(F.col("_rank") <= n_test, "test").when(F.col("_rank") <= n_test + n_val, "val").otherwise("train")
    return ranked.select(*df.columns, split.alias("split"))


def split_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy("split", label).agg(F.count("*").alias("n"))


def assign_folds(df: DataFrame, id_column: str, label: str | None, k: int = 5, seed: int = 42,
                 strategy: str | None = None) -> DataFrame:
    """Adds ``fold`` 0..k-1; stratified by label, or plain without one."""
    strategy = strategy or ("stratified" if label else "standard")
    if strategy not in ("stratified", "standard"):
        raise ValueError(f"unknown CV strategy: {strategy}")
    by = [label] if strategy == "stratified" else []
    ranked = hash_rank(df, id_column, by, seed, "_rank", "_n")
    return ranked.select(*df.columns, ((F.col("_rank") - 1) % k).cast("int").alias("fold"))


def uniform_sample(df: DataFrame, id_column: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement; any n, since ranks are computed bucket by bucket."""
    return hash_rank(df, id_column, [], seed, "_rank", "_n").filter(F.col("_rank") <= n).select(*df.columns)


def class_counts(df: DataFrame, label: str) -> dict:
    """Rows per class, for steps that treat each class on its own; more classes than MAX_CLASSES are refused."""
    rows = df.groupBy(label).count().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} classes")
    return {r[0]: r[1] for r in rows if r[0] is not None}


def balanced_weights(df: DataFrame, label: str, out: str = "weight", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Adds n / (classes * class rows), the weight that balances the classes; null where the label is null.

    Any number of classes: they are counted into a table, which is joined by its size.
    """
    counted = materialise(df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("_class")).agg(
        F.count(F.lit(1)).alias("_size")), "classes")
    whole = counted.agg(F.sum("_size").alias("n"), F.count(F.lit(1)).alias("k")).select(F.struct("n", "k").alias("_all")).scalar()
    rows = df.withColumns({"_class": F.col(label), "_row": row_hash(df)})
    joined = lookup_join(rows, counted, "_class", "_row", max_rows=max_rows)
    weight = F.when(F.col("_size").isNotNull(), whole["n"] / (whole["k"] * F.col("_size")))
    return joined.withColumn(out, weight).select(*[c for c in df.columns if c != out], out)


def label_encoder(df: DataFrame, label: str, out: str = "label_index"):
    """Labels numbered in alphabetical order."""
    return StringIndexer(inputCol=label, outputCol=out, stringOrderType="alphabetAsc").fit(df)


def encode_labels(df: DataFrame, label: str, out: str = "label_index") -> DataFrame:
    return label_encoder(df, label, out).transform(df).withColumn(out, F.col(out).cast("int"))


# ---- mail components and TF-IDF ------------------------------------------------------------------------


def mail_components(df: DataFrame, text: str) -> DataFrame:
    """Adds the cleaned text and the metadata block."""
    c = F.col("cleaned_text")
    return df.withColumn("cleaned_text", T.clean_text(F.col(text))).withColumns({
        "has_subject": T.has_subject(F.col(text)), "first_line": T.first_line(c), "text_length": F.length(c),
        "word_count": F.size(T.words(c)), "avg_word_length": T.average_word_length(c)})


METADATA = ["text_length", "word_count", "avg_word_length", "has_subject"]


def with_ngrams(df: DataFrame, cleaned: str, stop_words: list[str], low: int = 1, high: int = 3, out: str = "_grams") -> DataFrame:
    """Adds the n-grams of words with two or more characters, stop words removed first.

    The text is cleaned and cut once a row, and each shorter gram is made once.
    """
    words = F.filter(F.split(F.col(cleaned), " "), lambda w: (F.length(w) >= 2) & ~w.isin(stop_words))
    rows = once(df, {"_g1": words})
    for n in range(2, high + 1):
        # each shorter gram joined with the word that follows it
        size = F.greatest(F.size("_g1") - (n - 1), F.lit(0))
        rows = once(rows, {f"_g{n}": F.zip_with(F.slice(f"_g{n - 1}", F.lit(1), size), F.slice("_g1", F.lit(n), size),
                                                lambda a, b: F.concat(a, F.lit(" "), b))})
    return rows.select(*df.columns, F.concat(*[F.col(f"_g{n}") for n in range(low, high + 1)]).alias(out))


CHUNK_WORDS = 1 << 20  # words that a task counts together before it hands their terms on
MOST_KNOWN = 100_000  # frequent grams that tasks are told of


def _counted_terms(docs: pa.Array, low: int, high: int, known: dict[int, pa.Array]) -> Iterator[pa.RecordBatch]:
    """(term, tf, df) of the n-grams of word lists, one batch for each n; ``known`` as in ``term_statistics``.

    Words become numbers, and a gram the number of its shorter one with that of its last word. In a stable order equal
    grams stand together with their documents ascending, so uses and documents are counted from the places of change.
    """
    words = docs.flatten().dictionary_encode()
    code, names = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
    doc = np.repeat(np.arange(len(docs)), np.diff(docs.offsets.to_numpy()))
    gram = code
    for n in range(1, high + 1):
        if n > 1:
            gram = gram[:len(doc) - n + 1] * len(names) + code[n - 1:]
            whole = (doc[n - 1:] == doc[:len(gram)]) & fine[:len(gram)] & fine[1:len(gram) + 1]
        else:
            whole = np.ones(len(code), bool)
        at = np.flatnonzero(whole)
        if not whole.any():
            return
        keys, owners = gram[whole], doc[:len(gram)][whole]
        order = np.argsort(keys, kind="stable")
        keys, owners = keys[order], owners[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(new)
        if n >= low or n in known:
            places = at[order[first]]
            parts = [names.take(pa.array(code[places + j])) for j in range(n)]
            terms = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")
        if n >= low:
            own = new.copy()
            own[1:] |= owners[1:] != owners[:-1]
            ends = np.append(first, len(keys))
            yield pa.RecordBatch.from_arrays(
                [terms, pa.array(np.diff(ends)), pa.array(np.add.reduceat(own.astype(np.int64), first))], ["term", "tf", "df"])
        # dense numbers for the next length; grams that run over the end of a document lead to none
        number = np.empty(len(keys), np.int64)
        number[order] = np.cumsum(new) - 1
        gram = np.zeros(len(doc), np.int64)
        gram[at] = number
        fine = np.zeros(len(doc), bool)
        fine[at] = pc.is_in(terms, value_set=known[n]).to_numpy(zero_copy_only=False)[number] if n in known else True


def term_statistics(df: DataFrame, cleaned: str, stop_words: list[str], low: int = 1, high: int = 3,
                    known: dict[int, list[str]] | None = None) -> DataFrame:
    """(term, tf, df): uses of each n-gram and documents that hold it.

    With ``known``, n-grams by n, a longer gram is counted only if both grams of length n at its ends are among them.
    A task counts the terms of many documents before anything is shuffled; it is handed the cleaned texts, not their grams.
    """
    stop = pa.array(stop_words, pa.string())
    sets = {n: pa.array(terms, pa.string()) for n, terms in (known or {}).items()}

    def lists(texts: pa.Array) -> pa.Array:
        cut = pc.split_pattern(texts, " ")
        flat = cut.flatten()
        kept = pc.and_(pc.greater_equal(pc.utf8_length(flat), 2), pc.invert(pc.is_in(flat, value_set=stop)))
        before = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))])
        sizes = pc.fill_null(pc.list_value_length(cut), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return pa.ListArray.from_arrays(pa.array(before[ends].astype(np.int32)), flat.filter(kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 100):  # few documents at a time, so that long ones do not add up
                held.append(lists(batch.column("c").slice(start, 100)))
                n += len(held[-1].values)
                if n > CHUNK_WORDS:
                    yield from _counted_terms(pa.concat_arrays(held), low, high, sets)
                    held, n = [], 0
        if held:
            yield from _counted_terms(pa.concat_arrays(held), low, high, sets)

    counted = df.select(F.col(cleaned).alias("c")).mapInArrow(run, "term string, tf long, df long")
    return counted.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def tfidf_vocabulary(df: DataFrame, cleaned: str, stop_words: list[str], max_features: int = 5000,
                     ngram_range: tuple[int, int] = (1, 3), min_df: int = 5, max_df: float = 0.95) -> DataFrame:
    """(term, tf, df, idf): the most frequent terms within the document frequency limits.

    Lengths are counted one after the other. A gram has no more uses and documents than the shorter grams at its ends, so
    one whose ends are used less than the last of ``max_features`` terms found so far, or stand in fewer than ``min_df``
    documents, is never kept and need not be counted. The texts are cleaned once and written.
    """
    low, high = ngram_range
    texts = materialise(df.select(cleaned), "cleaned-texts")
    n_docs = texts.count()
    known: dict[int, list[str]] = {}
    kept = None
    for n in range(low, high + 1):
        terms = materialise(term_statistics(texts, cleaned, stop_words, n, n, known).filter(F.col("df") >= min_df), "terms")
        fit = terms.filter(F.col("df") <= float(max_df) * n_docs)
        kept = (fit if kept is None else kept.unionByName(fit)).orderBy(F.desc("tf"), "term").limit(max_features)
        if n < high:
            full, least = kept.agg(F.count(F.lit(1)), F.min("tf")).first()
            often = terms.filter(F.col("tf") >= (least if full == max_features else 0)).select("term")
            found = often.limit(MOST_KNOWN + 1).collect()
            if len(found) <= MOST_KNOWN:  # else the next length is counted whole
                known[n] = [r["term"] for r in found]
    idf = F.log((F.lit(n_docs) + 1) / (F.col("df") + 1)) + 1
    return kept.select("term", "tf", "df", idf.alias("idf"))


@dataclass
class TfidfModel:
    """A fitted vocabulary. ``transform`` is row local: no join, no shuffle, sparse vectors."""

    terms: list[str]
    idf: list[float]
    stop_words: list[str]
    ngram_range: tuple[int, int]

    def transform(self, df: DataFrame, cleaned: str, out: str = "tfidf") -> DataFrame:
        if not self.terms:
            raise ValueError("TF-IDF vocabulary is empty")
        counter = CountVectorizerModel.from_vocabulary(self.terms, inputCol="_grams", outputCol="_counts")
        weigher = ElementwiseProduct(scalingVec=Vectors.dense(self.idf), inputCol="_counts", outputCol="_weighted")
        grams = with_ngrams(df, cleaned, self.stop_words, *self.ngram_range)
        scaled = Normalizer(p=2.0, inputCol="_weighted", outputCol=out).transform(
            weigher.transform(counter.transform(grams)))
        return scaled.select(*df.columns, out)


def fit_tfidf(df: DataFrame, cleaned: str, stop_words: list[str] | None = None, max_features: int = 5000,
              ngram_range: tuple[int, int] = (1, 3), min_df: int = 5, max_df: float = 0.95) -> TfidfModel:
    """Fit on ``df``; at most ``max_features`` rows reach the driver. Columns are in term order.

    Stop words default to Spark's English list.
    """
    if stop_words is None:
        from pyspark.ml.feature import StopWordsRemover

        stop_words = StopWordsRemover.loadDefaultStopWords("english")
    vocabulary = tfidf_vocabulary(df, cleaned, stop_words, max_features, ngram_range, min_df, max_df)
    rows = sorted(vocabulary.select("term", "idf").collect())
    return TfidfModel([r["term"] for r in rows], [r["idf"] for r in rows], stop_words, ngram_range)


def combine_features(df: DataFrame, vectors: list[str], columns: list[str], out: str = "features") -> DataFrame:
    """One vector from vector columns and numeric columns; an error when there is nothing."""
    if not vectors and not columns:
        raise ValueError("no features to combine")
    assembler = VectorAssembler(inputCols=[*vectors, *columns], outputCol=out, handleInvalid="keep")
    return assembler.transform(df)


def absolute(df: DataFrame, features: str = "features") -> DataFrame:
    """Absolute feature values, for models that need non-negative input."""
    values = F.transform(vector_to_array(features), lambda v: F.abs(v))
    return df.withColumn(features, array_to_vector(values))


# ---- token ids ---------------------------------------------------------------------------------------------

TOKEN_FILTER = r"""[!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~\t\n ]+"""
OOV = 1


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_FILTER), lambda w: w != "")


def token_vocabulary(df: DataFrame, id_column: str, text: str, vocab_size: int = 10_000) -> DataFrame:
    """(word, word_id): ids from 2 by frequency, then first appearance; 1 is out of vocabulary."""
    words = df.select(F.col(id_column).alias("doc"), F.posexplode(tokens(F.col(text))).alias("pos", "word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n"), F.min(F.struct("doc", "pos")).alias("first"))
    kept = counted.orderBy(F.desc("n"), "first").limit(max(vocab_size - 2, 0))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "first")  # at most vocab_size rows
    return kept.select("word", (F.row_number().over(order) + 1).alias("word_id"))


def encode_tokens(df: DataFrame, id_column: str, text: str, vocabulary: DataFrame, max_length: int = 500) -> DataFrame:
    """(id, tokens): word ids cut at ``max_length`` and padded with 0 at the end.

    Texts are cut before they are exploded, so a group never holds more than ``max_length`` rows.
    """
    cut = df.select(id_column, F.slice(tokens(F.col(text)), 1, max_length).alias("w"))
    words = cut.select(id_column, F.posexplode_outer("w").alias("pos", "word"))
    coded = lookup_join(words, materialise(vocabulary, "vocabulary"), "word", id_column)
    item = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("word_id", F.lit(OOV)).alias("v")))
    ids = F.transform(F.array_sort(F.collect_list(item)), lambda s: s["v"])
    padded = F.concat(F.col("ids"), F.array_repeat(F.lit(0), F.lit(max_length) - F.size("ids")))
    return coded.groupBy(id_column).agg(ids.alias("ids")).select(id_column, padded.alias("tokens"))


# ---- scaling and oversampling ---------------------------------------------------------------------------------


def standardise(df: DataFrame, features: str = "features", fit_on: Column | None = None, out: str = "scaled") -> DataFrame:
    """(x - mean) / population deviation per position, fitted on the rows of ``fit_on``.

    The moments are one aggregation and enter as a scalar subquery; constant positions are only
    centred. ``features`` is an array column.
    """
    train = df.filter(fit_on) if fit_on is not None else df
    vector = array_to_vector(F.col(features).cast("array<double>"))
    s = train.select(Summarizer.metrics("mean", "std", "count").summary(vector).alias("s"))
    shrink = F.sqrt((F.col("s.count") - 1) / F.col("s.count"))
    scale = F.transform(vector_to_array("s.std"), lambda v: F.when(v > 0, v * shrink).otherwise(1.0))
    moments = s.select(F.struct(vector_to_array("s.mean").alias("mean"), scale.alias("scale")).alias("m")).scalar()
    with_moments = df.withColumn("_m", moments)
    centred = F.zip_with(F.col(features).cast("array<double>"), F.col("_m.mean"), lambda x, m: x - m)
    keep = [c for c in df.columns if c != out]
    return with_moments.select(*keep, F.zip_with(centred, F.col("_m.scale"), lambda x, d: x / d).alias(out))


def standardise_columns(df: DataFrame, columns: list[str], fit_on: Column | None = None) -> DataFrame:
    """The same for named numeric columns."""
    train = df.filter(fit_on) if fit_on is not None else df
    m = train.select(F.struct(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c)
                                for c in columns]).alias("m")).scalar()
    scaled = {c: (F.col(c) - m[c]["mean"]) / F.when(m[c]["std"] > 0, m[c]["std"]).otherwise(1.0) for c in columns}
    return df.withColumns(scaled)


def smote(df: DataFrame, id_column: str = "id", features: str = "features", label: str = "label", k: int = 5,
          seed: int = 42, chunk: int = 10_000) -> DataFrame:
    """Rows plus synthetic ones until every class is as large as the largest.

    Output (id, features, label, synthetic); features come as an array or as a vector and leave as an array. A synthetic row lies between a row of its class and
    one of the row's k nearest rows of that class. Counts, neighbour and position come from ranks
    and hashes, so a run can be repeated. A row that needs many synthetic rows is repeated in two
    steps with a shuffle between, so no task builds them all.
    """
    counts = class_counts(df, label)
    largest = max(counts.values())
    base = df.select(F.col(id_column).alias("id"), F.col(features).alias("features"), F.col(label).alias("label"))

    def numbers(c: str) -> Column:
        vector = isinstance(df.schema[features].dataType, VectorUDT)  # sparse ones stay so up to the end
        return vector_to_array(c) if vector else F.col(c).cast("array<double>")

    out = base.select("id", numbers("features").alias("features"), "label", F.lit(False).alias("synthetic"))
    for value, size in counts.items():
        needed = largest - size
        if needed == 0:
            continue
        rows = base.filter(F.col("label") == value)
        own = hash_rank(rows, "id", [], seed, "_rank", "_n").withColumn(
            "_copies", F.lit(needed // size) + F.when(F.col("_rank") <= needed % size, 1).otherwise(0))
        copied = own.filter("_copies > 0")  # only these need neighbours
        pairs = nearest(copied.select(rows.columns), rows, min(k, size - 1), same_table=True) if size > 1 else None
        first = copied.withColumn(
            "_c", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_copies") / chunk).cast("int") - 1)))
        if needed > size * chunk:
            first = first.repartition("id", "_c")
        upto = F.least(F.col("_copies"), (F.col("_c") + 1) * chunk) - 1
        each = first.withColumn("_i", F.explode(F.sequence((F.col("_c") * chunk).cast("bigint"), upto.cast("bigint"))))
        digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col("id").cast("string"), F.lit("|"), F.col("_i").cast("string")))

        def number(start: int) -> Column:
            return F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")

        if pairs is None:
            made = each.withColumn("_mate", F.col("features"))
        else:
            # the mate is drawn by its id, so only the drawn vectors travel
            groups = pairs.groupBy("id").agg(
                F.transform(F.array_sort(F.collect_list(F.struct("rank", "neighbour"))), lambda s: s["neighbour"]).alias("_mates"))
            drawn = each.join(groups, "id").withColumn("neighbour", F.get("_mates", (number(1) % F.size("_mates")).cast("int")))
            made = drawn.join(rows.select(F.col("id").alias("neighbour"), F.col("features").alias("_mate")), "neighbour")
        made = made.withColumn("_gap", number(9) / F.lit(4294967296.0))
        point = F.zip_with(numbers("features"), numbers("_mate"), lambda a, b: a + (b - a) * F.col("_gap"))
        out = out.unionByName(made.select("id", point.alias("features"), "label", F.lit(True).alias("synthetic")))
    return out
