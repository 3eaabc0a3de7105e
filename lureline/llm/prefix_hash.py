"""Document fingerprints from prefix polynomial hashes.

For a text of code points c the array H[i] = sum of c[j] * B^j for j < i, modulo a prime, is kept for two
primes. Any two spans are compared from it in constant time, and the longest common extension of two
positions is found by binary search. The fingerprint is the hash of the whole text with its length; the
likeness of two texts is what their prefix arrays share: common beginning, common end, and equal spans
in between, of which every one is looked up.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lureline.llm.common import documents, map_arrow, narrow

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1566083941)
SPAN = 32          # code points of the spans looked for between the common ends
RANGE_ROWS = 2_000
MAX_RANGES = 65_536  # bounds the range ends that the driver holds and broadcasts


class Powers:
    """Powers of the bases and of their inverses, grown to the longest text that a worker has met."""

    def __init__(self) -> None:
        self.up = [np.ones(1, np.uint64) for _ in PRIMES]
        self.down = [np.ones(1, np.uint64) for _ in PRIMES]

    def grow(self, n: int) -> None:
        for k, (p, b) in enumerate(zip(PRIMES, BASES)):
            for rows, base in ((self.up, b), (self.down, pow(b, -1, p))):
                have = rows[k]
                while len(have) <= n:
                    step = np.uint64(pow(base, len(have), p))
                    have = np.concatenate([have, have * step % np.uint64(p)])
                rows[k] = have


POWERS = Powers()


class Prefix:
    """Prefix arrays of one text."""

    def __init__(self, text: str) -> None:
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(codes)
        POWERS.grow(self.n + 1)
        self.h = []
        for k, p in enumerate(PRIMES):
            rows = np.zeros(self.n + 1, np.uint64)
            # below 2^31 texts of 2^33 code points fit into the sum before it is reduced
            np.cumsum(codes * POWERS.up[k][:self.n] % np.uint64(p), out=rows[1:])
            self.h.append(rows % np.uint64(p))

    def span(self, start: int, stop: int) -> tuple[int, ...]:
        """Hash of a span, the same for equal spans at any place of any text."""
        return tuple((int(h[stop]) - int(h[start])) * int(down[start]) % p
                     for h, down, p in zip(self.h, POWERS.down, PRIMES))

    def fingerprint(self) -> str:
        return "".join(f"{x:08x}" for x in self.span(0, self.n)) + f"{self.n:x}"

    def spans(self, start: int, stop: int, width: int = SPAN, k: int = 0) -> np.ndarray:
        """Hashes by prime number ``k`` of all spans of ``width`` that begin in start..stop-width."""
        p = np.uint64(PRIMES[k])
        rows = self.h[k][start:stop + 1]
        if stop - start < width:
            return np.zeros(0, np.uint64)
        return (rows[width:] + p - rows[:-width]) * POWERS.down[k][start:stop - width + 1] % p


def extension(a: Prefix, i: int, b: Prefix, j: int, limit: int) -> int:
    """Longest common extension to the right of a[i:] and b[j:], at most ``limit``."""
    low, high = 0, limit
    while low < high:
        middle = (low + high + 1) >> 1
        if a.span(i, i + middle) == b.span(j, j + middle):
            low = middle
        else:
            high = middle - 1
    return low


def extension_left(a: Prefix, i: int, b: Prefix, j: int, limit: int) -> int:
    """Longest common extension to the left of a[:i] and b[:j], at most ``limit``."""
    low, high = 0, limit
    while low < high:
        middle = (low + high + 1) >> 1
        if a.span(i - middle, i) == b.span(j - middle, j):
            low = middle
        else:
            high = middle - 1
    return low


def _marked(values: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Places of ``values`` that may be among ``others``: all that are, and one in eight or fewer besides."""
    mask = np.uint64((1 << (8 * len(others)).bit_length()) - 1)
    table = np.zeros(int(mask) + 1, bool)
    table[others & mask] = True
    return np.flatnonzero(table[values & mask])


def _shared(names: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each name the first places, as many as its count."""
    order = np.argsort(names, kind="stable")
    sizes = np.bincount(names, minlength=len(counts))
    number = np.arange(len(names)) - (np.cumsum(sizes) - sizes)[names[order]]
    return np.sort(order[number < counts[names[order]]])


def _between(a: Prefix, b: Prefix, head: int, tail: int) -> int:
    """Code points between the common ends in spans that both texts have, each as often as both have it; less of both sides."""
    own, other = a.spans(head, a.n - tail), b.spans(head, b.n - tail)
    if not len(own) or not len(other):
        return 0
    mine = _marked(own, other)
    theirs = _marked(other, own[mine])
    if not len(mine) or not len(theirs):
        return 0
    both = np.concatenate([own[mine] << np.uint64(31) | a.spans(head, a.n - tail, k=1)[mine],
                           other[theirs] << np.uint64(31) | b.spans(head, b.n - tail, k=1)[theirs]])
    names = np.unique(both, return_inverse=True)[1]
    sides = names[:len(mine)], names[len(mine):]
    counts = np.minimum(*[np.bincount(x, minlength=int(names.max()) + 1) for x in sides])
    covered = []
    for places, side in zip((mine, theirs), sides):
        starts = places[_shared(side, counts)]
        covered.append(int(np.minimum(np.diff(starts), SPAN).sum()) + SPAN if len(starts) else 0)
    return min(covered)


def likeness(a: Prefix, b: Prefix) -> float:
    """Share of both texts in common ends and equal spans, 0 to 1; 1 for equal texts, also for two empty ones."""
    shorter = min(a.n, b.n)
    if a.n == b.n and a.span(0, a.n) == b.span(0, b.n):
        return 1.0
    head = extension(a, 0, b, 0, shorter)
    tail = extension_left(a, a.n, b, b.n, shorter - head)
    return 2 * (head + tail + _between(a, b, head, tail)) / (a.n + b.n)


def edited(text: str, following: str) -> str:
    """The last third replaced by as many first code points of the following text, or all it has."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


FINGERPRINTS = [("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()),
                ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType())]


def _row(text: str, own: Prefix, following: str, other: Prefix) -> tuple:
    changed = edited(text, following)
    third = Prefix(changed)
    return (len(text), hashlib.sha256(changed.encode()).hexdigest(), own.fingerprint(), third.fingerprint(),
            likeness(own, third), likeness(own, other))


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the row after it in its range; the rows that close a range give no row."""
    pending = None
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    for batch in batches:
        ids, out = [], []
        closing = batch.column("closing").to_pylist()
        ranges = batch.column("range").to_pylist()
        texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
        for i in range(batch.num_rows):
            text = texts[i].as_py()
            prefix = Prefix(text)
            if pending is not None and pending[2] == ranges[i]:
                ids.append(pending[3])
                out.append(_row(pending[0], pending[1], text, prefix))
            pending = None if closing[i] else (text, prefix, ranges[i], batch.column("doc_id")[i])
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.as_py() for x in ids], batch.column("doc_id").type),
                 *[pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]],
                ["doc_id", *[n for n, _ in FINGERPRINTS]])


def _range_of(column: Column, bounds: list[int]) -> Column:
    """Number of the range, from the highest ids down; null ids are in the last. Two short scans find it."""
    width = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[i:i + width] for i in range(0, len(bounds), width)]
    if not blocks:
        return F.when(column.isNull(), F.lit(1)).otherwise(F.lit(0))
    longs = lambda values: F.array(*[F.lit(x).cast("bigint") for x in values])
    block = F.size(F.filter(longs([b[0] for b in blocks]), lambda x: x <= column))  # 0: below all bounds
    inside = F.size(F.filter(F.element_at(F.array(*map(longs, blocks)), F.greatest(block, F.lit(1))), lambda x: x <= column))
    above = F.when(block == 0, F.lit(0)).otherwise((block - 1) * width + inside)
    return F.when(column.isNull(), F.lit(len(bounds) + 1)).otherwise(F.lit(len(bounds)) - above)


def fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of every row's text and of its edited text, and their likeness.

    Ids are integers. The next row is the one after it by descending id, then by descending text; null ids come last, and
    after the last row comes the first. A null text is empty. Repeated rows follow each other. A single row is its own
    next. An empty table gives no rows.

    Rows go to ranges of the id with about ``RANGE_ROWS`` rows each (more beyond ``MAX_RANGES`` ranges); the
    only copies are the first row of each range, which closes the range before it.
    """
    rows = narrow(df, doc_id=id_column, text=text_column)
    ids = rows.select("doc_id")
    cuts = min(MAX_RANGES, max(1, ids.count() // RANGE_ROWS))
    bounds = ids.approxQuantile("doc_id", [k / cuts for k in range(1, cuts)], 0.25 / cuts) if cuts > 1 else []
    placed = rows.withColumn("range", _range_of(F.col("doc_id"), sorted({int(x) for x in bounds})))
    heads = placed.groupBy("range").agg(F.max("doc_id").alias("head"))
    before = F.lag("range").over(Window.orderBy("range"))  # over one row for each range
    last = heads.select(F.max("range").alias("last"))
    heads = heads.select("head", F.coalesce(before, F.lit(last.first()["last"])).alias("closes"))
    marked = placed.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    dealt = marked.select("doc_id", "text", F.explode(F.filter(F.array(
        F.struct("range", F.lit(False).alias("closing")),
        F.struct(F.col("closes").alias("range"), F.lit(True).alias("closing"))),
        lambda x: x["range"].isNotNull())).alias("_r")).select("doc_id", "text", "_r.range", "_r.closing")
    # more partitions than ranges, so that few ranges meet in one
    ordered = dealt.repartition(4 * (len(bounds) + 1), "range").sortWithinPartitions(
        "range", "closing", F.col("doc_id").desc_nulls_last(), F.col("text").desc_nulls_last())
    schema = T.StructType([rows.schema["doc_id"], *[T.StructField(*f) for f in FINGERPRINTS]])
    return map_arrow(ordered, _in_order, schema)


def op1_prefix_fingerprints(spark, sf_dir):
    return fingerprints(documents(spark, sf_dir))


QUERIES = {"op1_prefix_fingerprints": op1_prefix_fingerprints}
SQL: dict[str, str] = {}
