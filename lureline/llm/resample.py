"""Importance resampling towards a target distribution over hashed word runs.

Features are runs of words, hashed by CRC-32 into buckets. How much more often the target uses a bucket than
the corpus is the gain of its features; a document's weight is their mean. Gumbel noise that depends on the
document's id alone turns weights into scores whose highest ones are a draw without replacement.

Words have a head and a tail. Frequent words are found exactly: each block of text hands on what it holds in
a share of EPSILON or more, so at most 1 / EPSILON of them can reach that share of the whole, which bounds
what is broadcast. For the head the CRC state of every word and the bucket of every frequent pair are looked
up; all other features are hashed directly. A CRC continues from the state of the words before, so a longer
run costs one step. Both ways feed the same totals, which are exact, whatever the head holds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lureline.llm.common import documents, map_arrow, materialise, narrow, slices, table

BUCKETS = 10_000
MAX_RUN = 1
SHARE = 10             # percent of the eligible documents that are drawn
MIN_WORDS = 20
SEED = 2024
EPSILON = 1e-4         # share of a block and of all words from which on a word or pair is frequent
BLOCK_WORDS = 1_000_000
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words_of(body: bytes) -> list[bytes]:
    """Runs of letters, digits and bytes beyond ASCII, A-Z in lower case."""
    return body.translate(_LETTERS).split()


def runs_of(words: list[bytes], run: int) -> Iterator[bytes]:
    return map(b" ".join, zip(*[words[k:] for k in range(run)]))


def _frequent(max_run: int, epsilon: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [Counter() for _ in range(min(max_run, 2))]
        seen = [0, 0]

        def rows() -> pa.RecordBatch:
            found = [(k + 1, x, n) for k, c in enumerate(counters) for x, n in c.items() if n >= epsilon * seen[k]]
            for k, c in enumerate(counters):
                found.append((k + 1, None, seen[k]))
                c.clear()
                seen[k] = 0
            kinds = pa.array([x[0] for x in found], pa.int32())
            return pa.RecordBatch.from_arrays([kinds, pa.array([x[1] for x in found], pa.binary()),
                                               pa.array([x[2] for x in found], pa.int64())], ["run", "feature", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                for text in part.column("text").to_pylist():
                    words = words_of((text or "").encode())
                    for start in range(0, len(words), BLOCK_WORDS):
                        own = words[start:start + BLOCK_WORDS + 1]
                        counters[0].update(own[:BLOCK_WORDS])
                        seen[0] += min(len(own), BLOCK_WORDS)
                        if max_run > 1:
                            counters[1].update(runs_of(own, 2))
                            seen[1] += len(own) - 1
                        if seen[0] > BLOCK_WORDS:
                            yield rows()
        yield rows()

    return run


def head(df: DataFrame, max_run: int = MAX_RUN, epsilon: float = EPSILON) -> tuple[dict[bytes, int], dict[bytes, int]]:
    """CRC states of the frequent words and of the frequent pairs, at most 1 / epsilon of each.

    Holds every feature with twice that share of all of its kind: what blocks do not hand on is less than one share.
    """
    counted = map_arrow(df.select("text"), _frequent(max_run, epsilon), "run int, feature binary, n long")
    sums = counted.groupBy("run", "feature").agg(F.sum("n").alias("n"))
    sums = materialise(sums, "frequent-features")
    whole = {r["run"]: r["n"] for r in sums.where("feature IS NULL").collect()}
    least = F.lit(0.0)
    for run, n in whole.items():
        least = F.when(F.col("run") == run, F.lit(epsilon * n)).otherwise(least)
    states: tuple[dict, dict] = ({}, {})
    for r in sums.where(F.col("feature").isNotNull() & (F.col("n") >= least)).collect():
        feature = bytes(r["feature"])
        states[r["run"] - 1][feature] = crc32(feature)
    return states


class _States(dict):
    """CRC states of words: head ones are held, tail ones hashed on demand and not kept."""

    def __missing__(self, word: bytes) -> int:
        return crc32(word)


def _longer(words: list[bytes], states: list[int], run: int) -> list[int]:
    """States of all runs of ``run`` words from those of one word less."""
    return [crc32(b" " + w, s) for w, s in zip(words[run - 1:], states)]


def _totals(states: dict[bytes, int], pairs: dict[bytes, int], max_run: int, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _States(states)
        total = np.zeros(buckets, np.int64)

        def add(found: list[int], counts: list[int] | None = None) -> None:
            slots = np.array(found, np.int64) % buckets
            weights = None if counts is None else np.array(counts, np.float64)
            total[:] += np.bincount(slots, weights, buckets).astype(np.int64)

        for batch in batches:
            for part in slices(batch, "text"):
                texts = [(t or "").encode() for t in part.column("text").to_pylist()]
                single = Counter(words_of(b" ".join(texts)))
                add([known[w] for w in single], list(single.values()))
                if max_run > 1:
                    double: Counter = Counter()
                    for text in texts:
                        words = words_of(text)
                        double.update(zip(words, words[1:]))
                        if max_run > 2:
                            longer = _longer(words, [known[w] for w in words], 2)
                            for k in range(3, max_run + 1):
                                longer = _longer(words, longer, k)
                                add(longer)
                    found = [pairs.get(a + b" " + b) for a, b in double]
                    found = [crc32(b" " + b, known[a]) if s is None else s for s, (a, b) in zip(found, double)]
                    add(found, list(double.values()))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    return run


def bucket_totals(df: DataFrame, states: dict[bytes, int], pairs: dict[bytes, int], max_run: int = MAX_RUN,
                  buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket; the number of buckets bounds what is collected."""
    parts = map_arrow(df.select("text"), _totals(states, pairs, max_run, buckets), "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the logarithm of target over corpus share of each bucket, one added to every count."""
    s, t = corpus.astype(float), target.astype(float)
    ratio = ((t + 1) * (s.sum() + len(s))) / ((s + 1) * (t.sum() + len(t)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weights(states: dict[bytes, int], pairs: dict[bytes, int], gain: list[int], max_run: int) -> Callable:
    buckets = len(gain)

    class WordGains(dict):
        def __missing__(self, word: bytes) -> int:
            return gain[crc32(word) % buckets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _States(states)
        of_word = WordGains({w: gain[s % buckets] for w, s in states.items()})
        of_pair = {p: gain[s % buckets] for p, s in pairs.items()}
        for batch in batches:
            for part in slices(batch, "text"):
                n_words, n_features, weights = [], [], []
                for text in part.column("text").to_pylist():
                    words = words_of((text or "").encode())
                    total, n = sum(map(of_word.__getitem__, words)), len(words)
                    if max_run > 1:
                        for pair, a, b in zip(runs_of(words, 2), words, words[1:]):
                            own = of_pair.get(pair)
                            total += gain[crc32(b" " + b, known[a]) % buckets] if own is None else own
                        n += max(len(words) - 1, 0)
                        if max_run > 2:
                            longer = _longer(words, [known[w] for w in words], 2)
                        for k in range(3, max_run + 1):
                            longer = _longer(words, longer, k)
                            total += sum(gain[s % buckets] for s in longer)
                            n += len(longer)
                    n_words.append(len(words))
                    n_features.append(n)
                    weights.append(total // n if n else 0)
                columns = [pa.array(x, pa.int64()) for x in (n_words, n_features, weights)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "n_words", "n_features", "weight"])

    return run


def ranked(df: DataFrame, share: int = SHARE) -> DataFrame:
    """Adds ``rank`` to the drawn ones of the ``eligible`` rows: by score downwards, equal ones by id, null last.

    Rows are sorted over range partitions, numbered inside each and shifted by the sizes of those before; the
    sizes, one per partition, are all that reaches the driver.
    """
    spark = df.sparkSession
    ordered = df.where("eligible").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    numbered = materialise(ordered.withColumn("_at", F.monotonically_increasing_id()), "by-score")
    part = F.shiftright("_at", 33)
    sizes = sorted(numbered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = np.concatenate([[0], np.cumsum([r["n"] for r in sizes])]).tolist()
    drawn = before[-1] * share // 100
    offsets = spark.createDataFrame([(r["part"], b) for r, b in zip(sizes, before)], "_part long, _before long")
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    placed = numbered.join(F.broadcast(offsets), part == F.col("_part"))
    placed = placed.select(*df.columns, F.when(rank <= drawn, rank).alias("rank"))
    return placed.unionByName(df.where("NOT eligible").withColumn("rank", F.lit(None).cast("long")))


def importance(df: DataFrame, target: DataFrame, id_column: str = "doc_id", text_column: str = "text",
               target_text: str = "text", max_run: int = MAX_RUN, buckets: int = BUCKETS, share: int = SHARE,
               min_words: int = MIN_WORDS, seed: int = SEED, epsilon: float = EPSILON) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every row of ``df``.

    A null text has no words, weight 0 and is never drawn; a null id hashes as the empty string and comes last
    among equal scores. Repeated rows count as often as they stand there, get equal scores and ranks of their
    own. Empty tables on either side are counts of zero. Other columns are not read.
    """
    rows, wanted = narrow(df, doc_id=id_column, text=text_column), narrow(target, text=target_text)
    states, pairs = head(rows, max_run, epsilon)
    corpus = bucket_totals(rows, states, pairs, max_run, buckets)
    gain = gains(corpus, bucket_totals(wanted, states, pairs, max_run, buckets)).tolist()
    fields = [T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight")]
    weighted = map_arrow(rows, _weights(states, pairs, gain, max_run), T.StructType([rows.schema["doc_id"], *fields]))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighted.select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"),
                             (F.col("n_words") >= min_words).alias("eligible"))
    return ranked(materialise(scored, "scores"), share).drop("eligible")


def op11_importance_resampling(spark, sf_dir):
    return importance(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOUND = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = {"op11_importance_resampling": f"""
WITH d AS (SELECT doc_id, {_FOUND} AS w FROM documents),
 x AS (SELECT doc_id, unnest(w) AS word FROM d),
 y AS (SELECT unnest({_FOUND}) AS word FROM benchmark),
 v AS (SELECT word, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b FROM (SELECT word, 1 AS a, 0 AS b FROM x
   UNION ALL SELECT word, 0, 1 FROM y) GROUP BY word),
 p AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
   lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
 u AS (SELECT word, a, b, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(word))),
   lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT)),
   lambda c, o: xor(c >> 8, steps[(xor(c, o) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM v, p),
 k AS (SELECT bucket, sum(a)::DOUBLE AS s, sum(b)::DOUBLE AS t FROM u GROUP BY bucket),
 z AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM k),
 g AS (SELECT word, floor(1000 * ln(((t + 1) * (s_all + {BUCKETS})) / ((s + 1) * (t_all + {BUCKETS}))))::BIGINT AS gain
   FROM u JOIN k USING (bucket), z),
 n AS (SELECT doc_id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM x JOIN g USING (word) GROUP BY doc_id),
 f AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
   coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
     + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN n USING (doc_id)),
 r AS (SELECT *, CASE WHEN n_features >= {MIN_WORDS} THEN row_number() OVER (PARTITION BY n_features >= {MIN_WORDS}
   ORDER BY score DESC, doc_id) END AS r FROM f)
SELECT doc_id, n_features, weight, score,
 CASE WHEN r <= (SELECT count(*) * {SHARE} // 100 FROM r WHERE n_features >= {MIN_WORDS}) THEN r END AS rank FROM r"""}
QUERIES = {"op11_importance_resampling": op11_importance_resampling}
