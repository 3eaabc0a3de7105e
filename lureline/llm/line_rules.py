"""Quality rules: line frequency across the documents of a host.

Lines are normalised and hashed, the distinct documents (by text: exact copies are one document) that
hold a line are counted per host, lines above the limit are taken away, and a document that keeps too
few of its words is rejected. The text is read once, by tasks of its own split; what is shuffled
afterwards are hashes and counts. Line counts combine before the shuffle, so a line that stands in a
third of all documents is no hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lureline.llm.common import documents, join_on, map_arrow, materialise, narrow, slices

MAX_DOCUMENTS = 20     # a line in more distinct documents of a host is removed, however large the host is
MIN_LEFT = 0.30        # a document must keep this share of its words
MIN_WORDS = 10
MAX_REPEATED = 20      # percent of words in repeated windows
WINDOW = 5
SYMBOLS = b"#*$%&|<>"  # fixed by the result contract
_DIGITS = bytes.maketrans(b"0123456789", b"0000000000")


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words which the text holds twice or more."""
    n, m = len(words), len(words) - width + 1
    if m < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    code, bound, radix = ids[:m], len(known), len(known)
    for k in range(1, width):
        if bound * radix >= 1 << 62:
            values, code = np.unique(code, return_inverse=True)
            bound = len(values)
        code, bound = code * radix + ids[k:m + k], bound * radix
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    twice = (counts[inverse] > 1).astype(np.int32)
    edges = np.zeros(n + 1, np.int32)
    edges[:m] += twice
    edges[width:] -= twice
    return int((np.cumsum(edges)[:n] > 0).sum())


def normal_line(line: bytes) -> bytes:
    """A-Z in lower case, digits as 0, white space as single blanks."""
    return b" ".join(line.lower().translate(_DIGITS).split())


def measures(text: str | None) -> tuple:
    """Word and symbol counts of one text, and its distinct normalised lines with their words."""
    body = (text or "").encode()
    words = body.split()
    seen: set[bytes] = set()
    lines: dict[int, int] = {}
    repeats = 0
    for line in body.split(b"\n"):
        own = line.split()
        if not own:
            continue
        repeats += line in seen
        seen.add(line)
        key = xxhash.xxh3_64_intdigest(normal_line(line)) - (1 << 63)
        lines[key] = lines.get(key, 0) + len(own)
    return (xxhash.xxh3_64_intdigest(body) - (1 << 63), len(words), len(b"".join(words).decode()),
            len(body) - len(body.translate(None, SYMBOLS)), repeats, repeated_words(words), list(lines),
            list(lines.values()))


MEASURES = [("text_hash", T.LongType()), ("n_words", T.LongType()), ("word_chars", T.LongType()),
            ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()),
            ("lines", T.ArrayType(T.LongType())), ("line_words", T.ArrayType(T.LongType()))]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 6 + [pa.list_(pa.int64())] * 2
    for batch in batches:
        for part in slices(batch, "text"):
            rows = [measures(t) for t in part.column("text").to_pylist()]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("host"), *columns],
                                             ["doc_id", "host", *[n for n, _ in MEASURES]])


def common_lines(measured: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """host and line of every line that too many distinct documents of the host hold."""
    held = measured.select("host", "text_hash", F.explode("lines").alias("line")).distinct()
    counts = held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("holders"))
    return counts.where(F.col("holders") > max_documents).select("host", "line")


def measure(df: DataFrame, id_column: str = "doc_id", text_column: str = "text",
            host_column: str = "source") -> DataFrame:
    """One row of counts per document, written once to the shared folder: the text is read a single time."""
    rows = narrow(df, doc_id=id_column, host=host_column, text=text_column)
    schema = T.StructType([rows.schema["doc_id"], rows.schema["host"], *[T.StructField(*m) for m in MEASURES]])
    return materialise(map_arrow(rows, _measure, schema), "line-measures")


def verdicts(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source",
             max_documents: int = MAX_DOCUMENTS, min_left: float = MIN_LEFT) -> DataFrame:
    """One row per row of ``df``: counts, words in removed lines, ``base_failed`` and ``kept``.

    A null text has no words and fails the base rules; null hosts are one host. Repeated rows give
    repeated results. Documents are told apart by id, host and text. No row is dropped.
    """
    base = measure(df, id_column, text_column, host_column)
    key = ["doc_id", "host", "text_hash"]
    common = common_lines(base, max_documents)
    rows = base.select(*key, F.explode(F.arrays_zip("lines", "line_words")).alias("_l"))
    rows = rows.select(*key, F.col("_l.lines").alias("line"), F.col("_l.line_words").alias("words"))
    hit = join_on(rows, common, ["host", "line"], "left_semi")
    hit = hit.groupBy(*key, "line").agg(F.max("words").alias("words"))  # repeated rows count once
    gone = hit.groupBy(*key).agg(F.sum("words").alias("removed_words"))
    joined = join_on(base, gone, key, "left")
    removed = F.coalesce("removed_words", F.lit(0)).cast("bigint")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("n_words") - removed >= min_left * F.col("n_words"))).alias("kept"),
        removed.alias("removed_words"))


def op10_line_frequency(spark, sf_dir):
    return verdicts(documents(spark, sf_dir))


_WORD = r"[^\x20\x09-\x0D]+"
SQL = {"op10_line_frequency": f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
 b AS (SELECT doc_id, source, t, regexp_extract_all(t, '{_WORD}') AS w,
   list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS ls FROM d),
 w AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM b),
 g AS (SELECT doc_id, i, [word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o,
   lead(word, 4) OVER o] AS gram FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
 f AS (SELECT doc_id, i, gram[5] IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS twice FROM g),
 c AS (SELECT doc_id, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
   AS covered FROM f),
 r AS (SELECT doc_id, count(*) FILTER (WHERE covered) AS n_repeat_words FROM c GROUP BY doc_id),
 l AS (SELECT doc_id, source, t, unnest(list_transform(ls, lambda l: array_to_string(regexp_extract_all(translate(l,
   'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '{_WORD}'), ' '))) AS line FROM b),
 x AS (SELECT source, line FROM l GROUP BY source, line HAVING count(DISTINCT t) > {MAX_DOCUMENTS}),
 q AS (SELECT doc_id, sum(len(string_split(l.line, ' '))) AS gone FROM l
   JOIN x ON l.source IS NOT DISTINCT FROM x.source AND l.line = x.line GROUP BY doc_id)
SELECT b.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
 length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
 coalesce(n_repeat_words, 0) AS n_repeat_words,
 len(w) < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {MAX_REPEATED} * len(w) AS base_failed,
 NOT (len(w) < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {MAX_REPEATED} * len(w))
   AND len(w) - coalesce(gone, 0) >= {MIN_LEFT} * len(w) AS kept, coalesce(gone, 0)::BIGINT AS removed_words
FROM b LEFT JOIN r USING (doc_id) LEFT JOIN q USING (doc_id)"""}
QUERIES = {"op10_line_frequency": op10_line_frequency}
