"""Near duplicates by SimHash: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Nodes are distinct shingle sets, told apart by 128 bits. Two sets that are alike by 0.8 share one of their six
smallest shingle hashes but for some 4 in 10^6 pairs, so nodes meet in buckets of one such hash. A bucket is cut
into tiles; within a tile, and between two of them, the 128-bit SimHashes are compared exactly with numpy
exclusive-or and bit counts. Squares of a tile pair are skipped whose set sizes or bit counts lie too far apart.
What lies within the radius is a candidate; a tile hands on a spanning forest of its candidates, never pairs.

Nodes joined by candidates are a group. Its sets come together once and each candidate pair that is not joined
yet is counted out, so links are exact. A group beyond one tile is first compared with its first tile only, which
joins near copies of one text by as many comparisons as there are rows; then what is not in the largest part is
compared with all rows of the group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lureline.llm.common import map_arrow, narrow, slices
from lureline.llm.simhash import SEED, _majority, _shingles, _signed, components
from lureline.shared import BROADCAST_ROWS, Tables, lookup_join

SHINGLE = 5
SHARE = (4, 5)
RADIUS = 36       # 128 * acos(2 * 0.8 / 1.8) / pi = 19 bits differ on average at 0.8, with a deviation of 4
LEAST = 6         # smallest shingle hashes that are buckets; a pair at 0.8 misses all with probability 2 * (1 / 9) ** 6
TILE_ROWS = 8192
TILE_BYTES = 4 << 20
SMALL = 32        # rows of a bucket that is compared together with others
STEP = 1024       # rows of a tile that are compared at once


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct word shingles in order; fewer words are one shingle."""
    return np.unique(np.array([xxhash.xxh64_intdigest(x, SEED) for x in _shingles(text, width)], np.uint64))


def set_key(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def simhash(hashes: np.ndarray) -> tuple[int, int]:
    """Two words of the SimHash of a shingle set, each shingle once."""
    mixed = hashes ^ hashes >> np.uint64(31)
    mixed = mixed * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return _signed(_majority(hashes)), _signed(_majority(mixed ^ mixed >> np.uint64(32)))


def _nodes(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingle_set(t, width) for t in part.column("text").to_pylist()]
                words = [simhash(x) for x in sets]
                least = [x[:LEAST].view(np.int64) for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([set_key(x) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int32()),
                     *[pa.array([w[k] for w in words], pa.int64()) for k in (0, 1)], pa.array(least, pa.list_(pa.int64()))],
                    ["doc_id", "key", "size", "fp", "fp2", "least"])

    return run


def _key_numbers(column: pa.Array) -> np.ndarray:
    """128-bit keys as two columns of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, 2)


def _key_bytes(keys: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(keys, "<u8").tobytes()
    offsets = np.arange(len(keys) + 1, dtype=np.int32) * 16
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


class _Rows:
    """Nodes of a tile: keys, labels, set sizes, SimHashes, and shingle sets if they are needed."""

    def __init__(self, keys, labels, size, words, flat=None) -> None:
        self.keys, self.labels, self.size, self.words, self.flat = keys, labels, size, words, flat
        self.ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])

    @classmethod
    def of(cls, batch: pa.RecordBatch, start: int, stop: int) -> _Rows:
        part = batch.slice(start, stop - start)
        keys = _key_numbers(part.column("key"))
        names = part.schema.names
        labels = _key_numbers(part.column("label")) if "label" in names else keys
        flat = part.column("set").flatten().to_numpy(zero_copy_only=False).view(np.uint64) if "set" in names else None
        words = np.stack([part.column(c).to_numpy().view(np.uint64) for c in ("fp", "fp2")], 1)
        return cls(keys, labels, part.column("size").to_numpy(), words, flat)

    @classmethod
    def joined(cls, parts: list[_Rows]) -> _Rows:
        if len(parts) == 1:
            return parts[0]
        put = lambda name: np.concatenate([getattr(p, name) for p in parts])
        return cls(put("keys"), put("labels"), put("size"), put("words"), None if parts[0].flat is None else put("flat"))

    def by_size(self) -> _Rows:
        """Different nodes in order of their set sizes."""
        _, first = np.unique(self.keys, axis=0, return_index=True)
        order = first[np.argsort(self.size[first], kind="stable")]
        flat = None
        if self.flat is not None:
            flat = np.concatenate([self.flat[self.ends[i]:self.ends[i + 1]] for i in order]) if len(order) else self.flat
        return _Rows(self.keys[order], self.labels[order], self.size[order], self.words[order], flat)

    def set_of(self, i: int) -> np.ndarray:
        return self.flat[self.ends[i]:self.ends[i + 1]]


def _near(a: _Rows, b: _Rows, same: bool, radius: int, share: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs within the radius whose sizes allow the similarity; both sides are in order of size."""
    low, high = share
    bits = [np.bitwise_count(x.words).sum(1).astype(int) for x in (a, b)]
    for i in range(0, len(a.size), STEP):
        own = slice(i, i + STEP)
        for j in range(i if same else 0, len(b.size), STEP):
            other = slice(j, j + STEP)
            if high * a.size[own][-1] < low * b.size[j] or high * b.size[other][-1] < low * a.size[i]:
                continue
            if max(bits[0][own].min() - bits[1][other].max(), bits[1][other].min() - bits[0][own].max()) > radius:
                continue
            away = np.bitwise_count(a.words[own, None, 0] ^ b.words[None, other, 0])
            away += np.bitwise_count(a.words[own, None, 1] ^ b.words[None, other, 1])
            close = away <= radius
            small = np.minimum(a.size[own, None], b.size[None, other])
            close &= high * small >= low * np.maximum(a.size[own, None], b.size[None, other])
            if same and i == j:
                close = np.triu(close, 1)
            left, right = np.nonzero(close)
            if len(left):
                yield left + i, right + j


class _Forest:
    """Labels of what links have joined so far; every joining link is one edge of a spanning forest."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[left], label[right]
            low = np.minimum(a, b)
            if (a == b).all():
                return
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while (label[label] != label).any():
                label[:] = label[label]

    def star(self) -> tuple[np.ndarray, np.ndarray]:
        moved = np.flatnonzero(self.label != np.arange(len(self.label)))
        return moved, self.label[moved]


def _alike(row: np.ndarray, others: _Rows, at: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """Which of the sets at ``at`` have the similarity with the set ``row``, counted exactly."""
    low, high = share
    size = others.size[at]
    flat = np.concatenate([others.set_of(i) for i in at])
    place = np.searchsorted(row, flat)
    hit = row[np.minimum(place, len(row) - 1)] == flat
    common = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(size)[:-1]]), dtype=np.int64)
    return high * common >= low * (size + len(row) - common)


def _links(a: _Rows, b: _Rows | None, exact: bool, radius: int, share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a spanning forest of the links within ``a`` or between ``a`` and ``b``; known labels are joined already."""
    same = b is None
    b = a if same else b
    base = 0 if same else len(a.size)
    keys = a.keys if same else np.concatenate([a.keys, b.keys])
    forest = _Forest(len(keys))
    known = a.labels if same else np.concatenate([a.labels, b.labels])
    _, first, group = np.unique(known, axis=0, return_index=True, return_inverse=True)
    forest.join(np.arange(len(keys)), first[group.ravel()])
    before = forest.label.copy()
    for left, right in _near(a, b, same, radius, share):
        if not exact:
            forest.join(left, right + base)
            continue
        for i in np.unique(left):
            partners = right[np.searchsorted(left, i):np.searchsorted(left, i, "right")]
            partners = partners[forest.label[partners + base] != forest.label[i]]
            for k in range(0, len(partners), STEP):
                some = partners[k:k + STEP]
                some = some[_alike(a.set_of(i), b, some, share)]
                forest.join(np.full(len(some), i), some + base)
    moved = np.flatnonzero(forest.label != before)
    return keys[moved], keys[forest.label[moved]]


def _small_buckets(batch: pa.RecordBatch, small: np.ndarray, radius: int, share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Candidates within many small buckets at once: rows k places apart that have the same pair."""
    at = np.flatnonzero(small)
    part = batch.take(pa.array(at))
    pairs, rows = part.column("pair").to_numpy(), _Rows.of(part, 0, len(at))
    low, high = share
    found: list[tuple] = [(rows.keys[:0], rows.keys[:0])]
    for k in range(1, SMALL):
        left = np.flatnonzero(pairs[k:] == pairs[:-k])
        if not len(left):
            break
        right = left + k
        away = np.bitwise_count(rows.words[left] ^ rows.words[right]).sum(1)
        sizes = rows.size[left], rows.size[right]
        near = (away <= radius) & (high * np.minimum(*sizes) >= low * np.maximum(*sizes))
        found.append((rows.keys[left[near]], rows.keys[right[near]]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _compared(exact: bool, radius: int, share: tuple[int, int]) -> Callable:
    """Over nodes sorted by (pair, side): links among the rows of side 0 if they ask for it, and between both sides."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, parts, held, within = None, [], None, False

        def rows(found: tuple) -> Iterator[pa.RecordBatch]:
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([_key_bytes(found[0]), _key_bytes(found[1])], ["a", "b"])

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if held is None and parts:
                held = _Rows.joined(parts).by_size()
                if within and len(held.size) > 1:
                    yield from rows(_links(held, None, exact, radius, share))

        for batch in batches:
            if not batch.num_rows:
                continue
            pairs, sides = batch.column("pair").to_numpy(), batch.column("side").to_numpy()
            inside = batch.column("within").to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(pairs) != 0) | (np.diff(sides) != 0)) + 1, [len(pairs)]]).tolist()
            small = np.zeros(len(pairs), bool)
            if not exact:
                runs = np.array(cuts)
                own = (np.diff(runs) <= SMALL) & (sides[runs[:-1]] == 0) & inside[runs[:-1]]
                own[0] &= pairs[0] != pair
                own[-1] = False  # may go on in the next batch
                own[:-1] &= pairs[runs[1:-1]] != pairs[runs[:-2]]
                small = np.repeat(own, np.diff(runs))
                if small.any():
                    yield from rows(_small_buckets(batch, small, radius, share))
            for start, stop in zip(cuts, cuts[1:]):
                if small[start]:
                    continue
                if pairs[start] != pair:
                    yield from close()
                    pair, parts, held, within = pairs[start], [], None, False
                if sides[start] == 0:
                    parts.append(_Rows.of(batch, start, stop))
                    within = within or bool(inside[start:stop].any())
                else:
                    yield from close()
                    for first in range(start, stop, STEP):
                        if held is not None:
                            yield from rows(_links(held, _Rows.of(batch, first, min(first + STEP, stop)).by_size(), exact, radius, share))
        yield from close()

    return run


def _compare(rows: DataFrame, exact: bool, radius: int, share: tuple[int, int]) -> DataFrame:
    sorted_rows = rows.repartition("pair").sortWithinPartitions("pair", "side")
    return map_arrow(sorted_rows, _compared(exact, radius, share), "a binary, b binary")


def _tile_pairs(group: Column, tile: Column, blocks: Column) -> Column:
    """(pair, side, within) of every tile pair that a row of the tile belongs to."""
    other = F.sequence(F.lit(0).cast("bigint"), blocks - 1)
    pair = lambda i, j: F.xxhash64(group, i, j)
    return F.transform(other, lambda o: F.struct(
        pair(F.least(tile, o), F.greatest(tile, o)).alias("pair"), F.when(o < tile, 1).otherwise(0).alias("side"),
        (o == tile).alias("within")))


def candidates(nodes: DataFrame, radius: int, share: tuple[int, int], tile_rows: int) -> DataFrame:
    """Spanning forests (a, b) of the candidate pairs of every bucket of ``nodes`` (key, size, fp, fp2, least)."""
    met = nodes.select(F.explode("least").alias("bucket"), "key", "size", "fp", "fp2")
    large = met.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / tile_rows).alias("blocks")).where("blocks > 1")
    cut = lookup_join(met, large, "bucket", "key").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("bigint")))
    tile = F.pmod(F.xxhash64("key"), "blocks")
    pairs = cut.select(F.explode(_tile_pairs(F.col("bucket"), tile, F.col("blocks"))).alias("_p"), "key", "size", "fp", "fp2")
    return _compare(pairs.select("_p.*", "key", "size", "fp", "fp2"), False, radius, share)


def _sets(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingle_set(t, width) for t in part.column("text").to_pylist()]
                right = [set_key(x) == k for x, k in zip(sets, part.column("key").to_pylist())]
                part = part.drop_columns(["text"]).append_column("set", pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())))
                yield part.filter(pa.array(right, pa.bool_()))

    return run


def with_sets(rows: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """``members`` with the shingle sets of their texts. Rows of an id whose text is another one are left out."""
    few = members.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    own = members.withColumnRenamed("first", "_first")
    joined = rows.join(F.broadcast(own) if few else own, F.col("doc_id").eqNullSafe(F.col("_first"))).drop("doc_id", "_first")
    schema = T.StructType([*[f for f in joined.schema.fields if f.name != "text"], T.StructField("set", T.ArrayType(T.LongType()))])
    return map_arrow(joined, _sets(width), schema)


def verified(rows: DataFrame, members: DataFrame, tables: Tables, width: int, radius: int, share: tuple[int, int],
             tile_rows: int, tile_bytes: int) -> DataFrame:
    """Spanning forest (a, b) of the exact links within each group of ``members`` (group, key, first, size, fp, fp2)."""
    weight = F.greatest(F.ceil(F.sum("size") * 8 / tile_bytes), F.ceil(F.count(F.lit(1)) / tile_rows))
    large = tables.write(members.groupBy("group").agg(weight.alias("blocks")).where("blocks > 1"), "near-large")
    cut = lookup_join(members, large, "group", "key").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("bigint")))
    cut = tables.write(cut.withColumn("tile", F.pmod(F.xxhash64("key"), "blocks")), "near-tiles")
    zero, seen = F.lit(0).cast("bigint"), F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
    pair = lambda *parts: F.xxhash64("group", *parts)
    meeting = lambda p, side, within: F.struct(p.alias("pair"), side.alias("side"), within.alias("within"))
    with_first = F.when(F.col("tile") == 0, F.transform(seen, lambda t: meeting(pair(t), F.lit(0), t == 0))).otherwise(
        F.array(meeting(pair("tile"), F.lit(1), F.lit(False))))
    used = ["key", "size", "fp", "fp2", "set"]
    first = with_sets(rows, cut, width).select(F.explode(with_first).alias("_p"), *used).select("_p.*", *used)
    links = tables.write(_compare(first, True, radius, share), "near-links")
    if large.isEmpty():
        return links
    # the rest of groups beyond one tile: rows outside the largest part against all rows
    labels = components(links, tables)
    part = cut.where("blocks > 1").join(labels, cut.key == labels.node, "left").drop("node")
    part = tables.write(part.withColumn("label", F.coalesce("root", "key")).drop("root"), "near-parts")
    sizes = part.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    rest = part.join(main, "group").withColumn("minor", F.col("label") != F.col("main")).drop("main")
    count = rest.where("minor").groupBy("group").agg(weight.alias("minors"))
    rest = tables.write(rest.join(count, "group"), "near-rest")
    mine = F.pmod(F.xxhash64("key", F.lit(1)), "minors")
    held = F.when(F.col("minor"), F.transform(seen, lambda s: meeting(pair(mine, s), F.lit(0), F.lit(False)))).otherwise(
        F.array().cast("array<struct<pair:bigint,side:int,within:boolean>>"))
    passing = F.transform(F.sequence(zero, F.col("minors") - 1), lambda m: meeting(pair(m, F.col("tile")), F.lit(1), F.lit(False)))
    second = with_sets(rows, rest, width).select(F.explode(F.concat(held, passing)).alias("_p"), "label", *used)
    more = tables.write(_compare(second.select("_p.*", "label", *used), True, radius, share), "near-more")
    return links.unionByName(more)


def near_groups(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = SHINGLE,
                share: tuple[int, int] = SHARE, radius: int = RADIUS, tile_rows: int = TILE_ROWS,
                tile_bytes: int = TILE_BYTES) -> DataFrame:
    """doc_id and component_id (smallest id reachable over links) of every row of ``df``.

    Texts are linked where their shingle sets are alike by ``share`` or more. Null, empty and wordless texts have
    the empty set and are one group. Null ids are passed over when the smallest is taken; a group without any id
    has a null one. Repeated rows give repeated results; an empty table gives no rows. Other columns are not read.
    """
    rows = narrow(df, doc_id=id_column, text=text_column)
    tables = Tables(df.sparkSession)
    numbers = [T.StructField("size", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in ("fp", "fp2")]]
    schema = T.StructType([rows.schema["doc_id"], T.StructField("key", T.BinaryType()), *numbers,
                           T.StructField("least", T.ArrayType(T.LongType()))])
    docs = tables.write(map_arrow(rows, _nodes(width), schema), "near-docs")
    nodes = docs.groupBy("key").agg(F.min("doc_id").alias("first"), *[F.first(n).alias(n) for n in ("size", "fp", "fp2", "least")])
    nodes = tables.write(nodes, "near-nodes")
    found = tables.write(candidates(nodes, radius, share, tile_rows), "near-candidates")
    groups = components(found, tables, "near-groups")
    heads = groups.select(F.col("root").alias("node"), "root").distinct()
    members = groups.unionByName(heads).select(F.col("node").alias("key"), F.col("root").alias("group"))
    members = tables.write(nodes.drop("least").join(members, "key"), "near-members")
    tables.drop("near-candidates", "near-groups")
    links = verified(rows, members, tables, width, radius, share, tile_rows, tile_bytes)
    roots = components(links, tables).withColumnRenamed("node", "key")
    named = nodes.select("key", "first").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = tables.write(named.join(least, "root").select("key", "component_id"), "near-labels")
    out = tables.write(docs.select("doc_id", "key").join(labels, "key").select("doc_id", "component_id"), "near-result")
    tables.drop(*[n for n in tables.paths if n != "near-result"])
    return out


def representatives(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = SHINGLE) -> DataFrame:
    """The rows of ``df`` that stand for their group of near duplicates, with all their columns: those with the smallest id.

    Rows of one id that differ in text stay together; of rows equal in id and text one stays. A group without any
    id is kept whole, so null ids alone lose no text. All null, empty and wordless texts are one group, of which
    the one with the smallest id stays. Groups are those of ``near_groups``.
    """
    name = lambda column: F.coalesce(F.col(column).cast("string"), F.lit("none"))
    heads = near_groups(df, id_column, text_column, width).where("component_id IS NULL OR doc_id = component_id")
    heads = heads.select(name("doc_id").alias("_s_id")).distinct()
    rows = df.withColumn("_s_key", name(id_column)).withColumn("_s_text", F.xxhash64(text_column))
    first = rows.join(heads, F.col("_s_key") == F.col("_s_id"), "left_semi")
    number = F.row_number().over(Window.partitionBy("_s_key", "_s_text", text_column).orderBy("_s_key"))
    return first.withColumn("_s_no", number).where("_s_no = 1").select(*df.columns)
