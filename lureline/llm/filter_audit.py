"""Filter interaction audit: what each filter removes under every order of the filters.

A document that fails the filters in F survives a set S of filters if S and F share nothing. Which of the 32
sets it survives is its truth table, one 32-bit word. Carry-save adders sum the words of a part and label
position by position, so a task returns 32 counts for each of them. Survivors of sets are all that is needed:
what a step removes is the difference of two sets, and so are the documents that only one filter fails.

Exact copies are told by a 128-bit digest. The smallest id of a digest is a minimum that combines before the
shuffle, and it meets its rows on digest and id together, so a large group of copies is no hot key. The text
is read once; what is shuffled are digests, ids and words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lureline.llm.common import documents, map_arrow, materialise, narrow, slices, table

FILTERS = "ABCDE"  # few words, few distinct words, many capitals, symbols, copies
SETS = 1 << len(FILTERS)
COPY = 1 << FILTERS.index("E")
MIN_WORDS = 100
MIN_DISTINCT = 80          # percent of words
MAX_CAPITALS = 10          # percent of code points
SYMBOLS = b"#$%&*|"        # fixed by the result contract
_CAPITALS = bytes(range(65, 91))
HELD_GROUPS = 20_000       # parts and labels whose counts a task holds before it hands them on
RESULT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def survival_word(failed: int) -> int:
    """Bit S is set if a document that fails ``failed`` passes every filter in S; as a signed 32-bit number."""
    word = sum(1 << s for s in range(SETS) if not s & failed)
    return word - (1 << 32) if word >> 31 else word


WORDS = [survival_word(f) for f in range(SETS)]


def failures(text: str | None) -> int:
    """Which of the filters A to D the whole text fails."""
    text = text or ""
    body = text.encode()
    words = body.split()
    capitals = len(body) - len(body.translate(None, _CAPITALS))
    return ((len(words) < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT * len(words)) << 1
            | (100 * capitals > MAX_CAPITALS * len(text)) << 2
            | (len(body.translate(None, SYMBOLS)) < len(body)) << 3)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            texts = part.column("text").to_pylist()
            digests = [hashlib.blake2b((t or "").encode(), digest_size=16).digest() for t in texts]
            words = [WORDS[failures(t)] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("part"), pa.array(digests, pa.binary()), pa.array(words, pa.int32())],
                ["doc_id", "part", "digest", "word"])


def position_counts(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit set.

    A carry-save adder turns three words of one weight into a sum of that weight and a carry of twice the
    weight; it works on whole arrays until two words of each weight are left.
    """
    out = np.zeros(32, np.int64)
    bits = np.arange(32, dtype=np.uint32)
    level, weight = words.astype(np.uint32, copy=False), 1
    while len(level):
        carries = []
        while len(level) > 2:
            third = -(-len(level) // 3)
            a, b, c = (np.pad(level[k * third:(k + 1) * third], (0, third - len(level[k * third:(k + 1) * third]))) for k in range(3))
            half = a ^ b
            carries.append(a & b | c & half)
            level = half ^ c
        for word in level:
            out += weight * ((word >> bits) & np.uint32(1)).astype(np.int64)
        level, weight = np.concatenate(carries) if carries else level[:0], 2 * weight
    return out


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, int], np.ndarray] = {}

    def rows() -> pa.RecordBatch:
        keys = list(held)
        columns = {"part": pa.array(np.repeat([k[0] for k in keys], SETS).tolist(), pa.string()),
                   "label": pa.array(np.repeat([k[1] for k in keys], SETS), pa.int32()),
                   "filters": pa.array(np.tile(np.arange(SETS), len(keys)), pa.int32()),
                   "n": pa.array(np.concatenate([held[k] for k in keys]), pa.int64())}
        return pa.RecordBatch.from_pydict(columns)

    for batch in batches:
        parts = batch.column("part").dictionary_encode()
        words = batch.column("word").to_numpy(zero_copy_only=False).view(np.uint32)
        code = parts.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 4 + batch.column("label").to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        groups, first = np.unique(code[order], return_index=True)
        for group, own in zip(groups, np.split(words[order], first[1:])):
            key = parts.dictionary[int(group) // 4].as_py(), int(group) % 4
            held[key] = held.get(key, 0) + position_counts(own)
        if len(held) > HELD_GROUPS:
            yield rows()
            held.clear()
    if held:
        yield rows()


def survival_counts(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                    part_column: str = "lang") -> DataFrame:
    """(part, filters, documents, good, toxic): documents of a part that pass all filters of a set, by label.

    ``filters`` has bit k set for the k-th filter. A null text is empty and a null part the empty string. A
    document is good or toxic if any of its label rows says so. A copy is a row whose text an id smaller than
    its own has; rows that repeat an id and its text are no copies of each other, and a null id counts as
    larger than any other.
    """
    part = F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part")
    rows = df.select(F.col(id_column).alias("doc_id"), part, F.col(text_column).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("part", T.StringType()),
                           T.StructField("digest", T.BinaryType()), T.StructField("word", T.IntegerType())])
    measured = materialise(map_arrow(rows, _measure, schema), "filter-words")
    firsts = measured.groupBy("digest").agg(F.min("doc_id").alias("first")).select(F.col("digest").alias("_digest"), "first")
    marked = measured.join(firsts, (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("first")), "left")
    word = F.col("word").bitwiseAND(F.when(F.col("_digest").isNull(), F.lit(WORDS[COPY])).otherwise(F.lit(-1)))
    known = narrow(labels, _id=id_column, quality="quality", toxic="toxic").groupBy("_id").agg(
        (F.max(F.when(F.col("quality") == 1, 1).otherwise(0)) + F.max(F.when(F.col("toxic") == 1, 2).otherwise(0))).alias("label"))
    labelled = marked.select("doc_id", "part", word.alias("word")).join(known, F.col("doc_id") == F.col("_id"), "left")
    counted = map_arrow(labelled.select("part", "word", F.coalesce("label", F.lit(0)).alias("label")), _survivors,
                        "part string, label int, filters int, n long")
    has = F.col("label").bitwiseAND
    return counted.groupBy("part", "filters").agg(
        F.sum("n").alias("documents"), F.sum(F.when(has(1) == 1, F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(has(2) == 2, F.col("n")).otherwise(0)).alias("toxic"))


def _orders(group: pd.DataFrame) -> pd.DataFrame:
    by_set = np.zeros((SETS, 3), np.int64)
    by_set[group["filters"]] = group[["documents", "good", "toxic"]].to_numpy()
    whole = SETS - 1
    rows = []
    for order in permutations(range(len(FILTERS))):
        passed = 0
        for step, k in enumerate(order, 1):
            own = 1 << k
            gone = by_set[passed] - by_set[passed | own]
            passed |= own
            failing = by_set[0, 0] - by_set[own, 0]
            rows.append((group["part"].iloc[0], "".join(FILTERS[x] for x in order), step, by_set[passed, 0], gone[0],
                         failing - gone[0], by_set[whole ^ own, 0] - by_set[whole, 0], gone[1], gone[2], k))
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in RESULT.split(", ")])
    total = out.groupby("shapley")["removed"].sum()
    out["shapley"] = out["shapley"].map(total)
    return out.astype({"step": "int32"})


def audit(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          part_column: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step; see ``survival_counts`` for nulls and repeats.

    kept, removed, redundant (fails this filter, but removed before), unique_fails (fails this one only),
    good_lost and toxic_lost (removed here and labelled so), shapley (removed by this filter, summed over all
    orders). An empty table gives no rows. A part's 32 counts are one small group.
    """
    return survival_counts(df, labels, id_column, text_column, part_column).groupBy("part").applyInPandas(_orders, RESULT)


def op12_filter_audit(spark, sf_dir):
    return audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


_WORD = r"[^\x20\x09-\x0D]+"
SQL = {"op12_filter_audit": f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
 w AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS w FROM d),
 m AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
 l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
 f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
   (len(w) < {MIN_WORDS})::INT + 2 * (100 * len(list_distinct(w)) < {MIN_DISTINCT} * len(w))::INT
   + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MAX_CAPITALS} * length(t))::INT
   + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > first)::INT AS failed
   FROM w JOIN m USING (t) LEFT JOIN l USING (doc_id)),
 c AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, failed),
 v(x, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
 o AS (SELECT p.x || q.x || r.x || s.x || u.x AS filter_order, [p.b, q.b, r.b, s.b, u.b] AS bits
   FROM v p, v q, v r, v s, v u WHERE p.b | q.b | r.b | s.b | u.b = 31),
 k AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
   FROM o, range(1, 6) y(step)),
 r AS (SELECT part, filter_order, step, own,
   coalesce(sum(n) FILTER (failed & (before | own) = 0), 0)::BIGINT AS kept,
   coalesce(sum(n) FILTER (failed & before = 0 AND failed & own > 0), 0)::BIGINT AS removed,
   coalesce(sum(n) FILTER (failed & before > 0 AND failed & own > 0), 0)::BIGINT AS redundant,
   coalesce(sum(n) FILTER (failed = own), 0)::BIGINT AS unique_fails,
   coalesce(sum(good) FILTER (failed & before = 0 AND failed & own > 0), 0)::BIGINT AS good_lost,
   coalesce(sum(toxic) FILTER (failed & before = 0 AND failed & own > 0), 0)::BIGINT AS toxic_lost
   FROM c, k GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
 (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r"""}
QUERIES = {"op12_filter_audit": op12_filter_audit}
