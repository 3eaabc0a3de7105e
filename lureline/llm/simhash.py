"""SimHash near-duplicates by exact comparison of tiles.

Distinct fingerprints are cut into tiles by the bit counts of their four quarters. Fingerprints within the
radius differ in all these counts together by the radius at most, so a pair of tiles beyond that is
skipped; all other pairs are compared in full with numpy exclusive-or and bit counts. A tile pair hands
on a spanning forest of its links instead of every link, and components are found by alternating large
and small star contractions over tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lureline.llm.common import documents, join_on, map_arrow, materialise, narrow, slices
from lureline.shared import Tables

SHINGLE = 3
RADIUS = 3
SEED = 42
QUARTERS = 4
TILE_ROWS = 16384   # larger cells are cut into blocks of about this many fingerprints
CELL_BASE = 32      # above the highest count of a quarter and the radius
STEP = 1024         # rows of a tile that are compared at once

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """64-bit SimHash over word shingles, repeats included; fewer words are one shingle, no word gives zero."""
    return _majority([xxhash.xxh64_intdigest(x, SEED) for x in _shingles(text, width)])


def _shingles(text: str | None, width: int) -> list[memoryview]:
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return []
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    joined = memoryview(b" ".join(words))
    width = min(width, len(words))
    return [joined[a:b] for a, b in zip([0, *(ends[:len(words) - width] + 1).tolist()], ends[width - 1:].tolist())]


def _majority(hashes: list[int]) -> int:
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        part = np.array(hashes[k:k + 4096], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = SHINGLE) -> DataFrame:
    """doc_id and ``fp`` (64 bits as a long); a null text counts as empty."""
    rows = narrow(df, doc_id=id_column, text=text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values = [_signed(fingerprint(t, width)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(values, pa.int64())], ["doc_id", "fp"])

    schema = T.StructType([rows.schema["doc_id"], T.StructField("fp", T.LongType())])
    return map_arrow(rows, run, schema)


def neighbour_cells(radius: int, parts: int = QUARTERS) -> list[tuple[int, ...]]:
    """Differences of bit counts within the radius, one of each pair of opposite ones, and zero."""
    near = [d for d in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, d)) <= radius]
    return [d for d in near if d >= (0,) * parts]


def _forest(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> list[tuple[int, int]]:
    """Links between two tiles reduced to a star for each component that they make."""
    values = a if same else np.concatenate([a, b])
    base = 0 if same else len(a)
    label = np.arange(len(values))
    touched = False
    for start in range(0, len(a), STEP):
        for other in range(start if same else 0, len(b), STEP):
            near = np.bitwise_count(a[start:start + STEP, None] ^ b[None, other:other + STEP]) <= radius
            left, right = np.nonzero(near)
            left, right = left + start, right + other
            keep = (left != right) if same else np.ones(len(left), bool)
            right = right + base
            left, right = left[keep], right[keep]
            if not len(left):
                continue
            touched = True
            while True:  # smallest label of each component made so far
                low = np.minimum(label[left], label[right])
                if (label[left] == low).all() and (label[right] == low).all():
                    break
                np.minimum.at(label, label[left], low)
                np.minimum.at(label, label[right], low)
                while (label[label] != label).any():
                    label = label[label]
    if not touched:
        return []
    moved = np.flatnonzero(label != np.arange(len(values)))
    return [(int(values[i]), int(values[label[i]])) for i in moved]


def _compared(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links: list[tuple[int, int]] = []
            same = batch.column("same").to_pylist()
            for i in range(batch.num_rows):
                words = [batch.column(c)[i].values.to_numpy().view(np.uint64) for c in ("fps", "others")]
                links += _forest(*words, same[i], radius)
            yield pa.RecordBatch.from_arrays(
                [pa.array([_signed(x[k]) for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def tiles(distinct: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """cell (bit counts as one number), block and the fingerprints of each tile."""
    size = 64 // QUARTERS
    mask = F.lit((1 << size) - 1)
    count = lambda k: F.bit_count(F.shiftrightunsigned("fp", size * k).bitwiseAND(mask))
    cell = sum((count(k) * F.lit(CELL_BASE ** (QUARTERS - 1 - k)) for k in range(QUARTERS)), F.lit(0)).cast("int")
    rows = distinct.select("fp", cell.alias("cell"))
    sizes = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile_rows).alias("blocks"))  # at most 17^4 rows
    rows = rows.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("fp"), "blocks"))
    return rows.groupBy("cell", "block").agg(F.collect_list("fp").alias("fps"))


def links(distinct: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Pairs (a, b) of first words whose components are those of all links within the radius.
    """
    made = materialise(tiles(distinct, tile_rows), "simhash-tiles")
    steps = [sum(d * CELL_BASE ** (QUARTERS - 1 - k) for k, d in enumerate(diff)) for diff in neighbour_cells(radius)]
    reach = F.explode(F.transform(F.array(*[F.lit(s) for s in steps]), lambda s: F.col("cell") + s))
    left = made.select("cell", "block", "fps", reach.alias("near"))
    right = made.select(F.col("cell").alias("near"), F.col("block").alias("other"), F.col("fps").alias("others"))
    pairs = left.join(right, "near").where((F.col("cell") != F.col("near")) | (F.col("block") <= F.col("other")))
    same = (F.col("cell") == F.col("near")) & (F.col("block") == F.col("other"))
    pairs = pairs.select("fps", "others", same.alias("same"))
    return map_arrow(pairs, _compared(radius), "a long, b long")


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return join_on(both.where("b > a"), least, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    pulled = join_on(down, least, ["a"]).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return pulled.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, tables: Tables | None = None, name: str = "links") -> DataFrame:
    """node and root (smallest node of its component) for each node of ``edges`` that is not a root itself.

    Every round halves the depth of the remaining trees at least; rounds end when nothing changes. The links of a
    round are written to ``tables`` under ``name``, and those of the round before are deleted.
    """
    tables = tables or Tables(edges.sparkSession)
    state, before = tables.write(edges.where("a != b").distinct(), name), None
    while True:
        mark = state.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark["n"] == 0 or mark == before:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark
        state = tables.write(_small_star(_large_star(state)), name)


def grouped(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = SHINGLE,
            radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable by links) of every row of ``df``.

    Equal texts have equal fingerprints and are one node. Null and wordless texts have fingerprint zero
    and are linked like any other. Null ids are passed over when the smallest is taken; a component without
    any id has a null one. Repeated rows give repeated results.
    """
    docs = materialise(fingerprints(df, id_column, text_column, width), "simhash")
    distinct = materialise(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    found = components(links(distinct, radius, tile_rows)).withColumnRenamed("node", "fp")
    linked = join_on(distinct, found, ["fp"], "left").withColumn("root", F.coalesce("root", "fp"))
    roots = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = materialise(join_on(linked, roots, ["root"]).select("fp", "component_id"), "simhash-labels")
    return docs.join(labels, "fp").select("doc_id", "fp", "component_id")


def hex_digits(column: str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def op3_simhash_tiles(spark, sf_dir):
    return grouped(documents(spark, sf_dir)).select("doc_id", hex_digits("fp").alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash_tiles": op3_simhash_tiles}
SQL: dict[str, str] = {}
