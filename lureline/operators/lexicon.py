"""Sentiment and spelling from word lists that the caller supplies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lureline.shared import is_small, lookup_join, materialise

WORD = r"[a-z']+"
SAMPLED = 16           # one text in so many is looked at for frequent words
FREQUENT = 50_000      # words whose entries of a large lexicon are broadcast
LONGEST_FREQUENT = 64


def sentiment(df: DataFrame, id_column: str, text: str, lexicon: DataFrame, alpha: float = 15.0) -> DataFrame:
    """(id, compound, negative, positive) by a lexicon (token, valence).

    compound = s / sqrt(s^2 + alpha) of the valence sum; the shares count each rated word one
    stronger than its valence and each other word as 1. A lexicon that can be broadcast meets the words where they are,
    and only sums are shuffled. Of a larger one the entries of frequent words are broadcast, so that the join carries one
    row per different rare word of a text and no hot key; which words these are is taken from a part of the texts and
    changes no result.
    """
    lexicon = materialise(lexicon.select("token", "valence"), "lexicon")
    words = df.select(id_column, F.explode_outer(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))),
                                                                      F.lit(WORD), F.lit(0))).alias("token"))
    n = F.col("token").isNotNull().cast("bigint").alias("n")
    if is_small(lexicon):
        return _shares(_valences(words.select(id_column, "token", n).join(F.broadcast(lexicon), "token", "left"), [id_column]), id_column, alpha)
    seen = words.where((F.pmod(F.xxhash64(id_column), F.lit(SAMPLED)) == 0) & (F.length("token") <= LONGEST_FREQUENT))
    often = seen.groupBy("token").count().orderBy(F.desc("count"), "token").limit(FREQUENT).select("token")
    head = materialise(often.join(lexicon, "token", "left"), "frequent-words").withColumn("_frequent", F.lit(True))
    met = words.select(id_column, "token", n).join(F.broadcast(head), "token", "left").withColumn(
        "token", F.when(F.col("_frequent").isNull(), F.col("token")))
    # a row for the frequent words of a text, and one for each rare word
    counted = materialise(_valences(met, [id_column, "token"]), "rated-words")
    rare = counted.where(F.col("token").isNotNull()).select(id_column, "token", "n").hint("shuffle_merge")
    rated = _valences(rare.join(lexicon, "token", "left"), [id_column])
    return _shares(counted.where(F.col("token").isNull()).drop("token").unionByName(rated), id_column, alpha)


def _valences(words: DataFrame, by: list[str]) -> DataFrame:
    """Sums over (token, valence, n) rows: uses, valences, and the words of each sign."""
    v, n = F.coalesce("valence", F.lit(0.0)), F.col("n")
    return words.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum(v * n).alias("s"), F.sum(F.when(v > 0, (v + 1) * n).otherwise(0.0)).alias("pos"),
        F.sum(F.when(v < 0, (1 - v) * n).otherwise(0.0)).alias("neg"), F.sum(F.when(v == 0, n).otherwise(0)).alias("neu"))


def _shares(sums: DataFrame, id_column: str, alpha: float) -> DataFrame:
    sums = sums.groupBy(id_column).agg(*[F.sum(c).alias(c) for c in ("s", "pos", "neg", "neu")])
    whole = F.col("pos") + F.col("neg") + F.col("neu")
    return sums.select(
        id_column, F.round(F.col("s") / F.sqrt(F.col("s") * F.col("s") + alpha), 4).alias("compound"),
        F.round(F.coalesce(F.try_divide("neg", whole), F.lit(0.0)), 3).alias("negative"),
        F.round(F.coalesce(F.try_divide("pos", whole), F.lit(0.0)), 3).alias("positive"))


def misspelled(df: DataFrame, id_column: str, text: str, dictionary: DataFrame, prefix: int = 1000) -> DataFrame:
    """(id, misspelling_score): 1 when a word of the first 1000 characters is not in the dictionary.

    The first 1000 characters are what the rule looks at by definition.
    """
    head = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, prefix))
    words = df.select(id_column, F.explode_outer(F.array_distinct(
        F.regexp_extract_all(head, F.lit(r"\p{L}+"), F.lit(0)))).alias("token"))
    known = dictionary.select("token").distinct().withColumn("known", F.lit(1))
    checked = lookup_join(words, known, "token", id_column)
    wrong = F.col("token").isNotNull() & F.col("known").isNull()
    return checked.groupBy(id_column).agg(F.max(wrong.cast("int")).alias("misspelling_score"))
