"""Nearest neighbours: exact by pivot cells, or by random-projection hash tables with measured recall.

Both ways deal rows to keys, a cell or a hash bucket, and a query visits several keys. Reference rows and visits
of a key meet in one sorted stream: a task holds the bounded chunk of reference rows of its present key and
compares queries batch by batch with numpy, so nothing is packed or paired. Each visit yields one row with the k
best of its chunk, and the lists of a query are merged in a second sorted stream that holds k entries.

The exact way visits a query's own cell first. The distance to the k-th row found there says which other cells can
still hold a nearer one, and which rows of these are worth an exact distance.

Of equal vectors only the k smallest ids can be neighbours, as equal distances are ordered by id. The others are
left out before anything is dealt, so a large group of copies makes no hot key.

Vectors may be sparse: they travel as values and places, and become full rows block by block inside a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lureline.shared import lookup_join, materialise

PIVOTS = 64
BLOCK_ROWS = 1024
SPARSE_ROWS = 256          # sparse rows that are made full at a time
QUERY_ROWS = 256           # queries that are compared at a time
CHUNK_BYTES = 8 << 20      # reference rows of a cell that a task holds at a time; a visit is sent once for each such chunk
SAMPLE_ROWS = 4096         # reference rows, chosen by hash, that hash thresholds are medians of
TABLES = 12
PROBES = 12
BUCKET_ROWS = 512
RELATIVE_SLACK = 1e-9  # far above the rounding of distances that come from differences
FOUND = "id bigint, near array<bigint>, away array<double>"


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances from differences, one row of the short ``b`` at a time: nothing cancels far from the origin."""
    out = np.empty((len(a), len(b)))
    for j, row in enumerate(b):
        away = a - row
        out[:, j] = np.sqrt(np.einsum("ij,ij->i", away, away))
    return out


def _matrix(values: pa.Array, places: pa.Array, width: int) -> np.ndarray:
    """Number lists as rows of one length; those with places stand there among zeros."""
    flat = values.flatten().to_numpy(zero_copy_only=False)
    if places.null_count == len(places):
        return flat.reshape(len(values), -1)
    out = np.zeros((len(values), width))
    sizes = pc.list_value_length(values).to_numpy(zero_copy_only=False)
    full = places.is_null().to_numpy(zero_copy_only=False)
    of_full = np.repeat(full, sizes)
    columns = np.empty(len(flat), np.int64)
    columns[of_full] = np.tile(np.arange(width), int(full.sum()))
    columns[~of_full] = places.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(values)), sizes), columns] = flat
    return out


class _Chunk:
    """Reference rows of one key, compared block by block. Sparse rows are made full only while they are compared.

    Rows stand in the order of the column that varies most, as two rows are at least as far apart as their values in any
    column: a query passes over the blocks whose range of that column lies beyond its limit.
    """

    def __init__(self, ids: list[np.ndarray], values: list[pa.Array], places: list[pa.Array], width: int) -> None:
        self.ids, self.values, self.places, self.width = np.concatenate(ids), pa.concat_arrays(values), pa.concat_arrays(places), width
        self.centre = self._rows(0).mean(axis=0)
        # the first rows say which column it is, any column is right
        self.column = int(np.nan_to_num(self._rows(0).var(axis=0), nan=-1.0).argmax())
        along = np.concatenate([self._rows(i)[:, self.column] for i in range(0, len(self.ids), BLOCK_ROWS)])
        order = np.argsort(along, kind="stable")
        self.ids, along = self.ids[order], along[order]
        self.values, self.places = self.values.take(pa.array(order)), self.places.take(pa.array(order))
        self.size = BLOCK_ROWS if self.places.null_count == len(self.ids) else SPARSE_ROWS
        self.starts = range(0, len(self.ids), self.size)
        self.low = along[::self.size]
        self.high = along[np.minimum(np.arange(self.size - 1, len(along) + self.size - 1, self.size), len(along) - 1)]
        self.kept = [self._block(i) for i in self.starts] if self.places.null_count == len(self.ids) else None

    def _rows(self, start: int, size: int = BLOCK_ROWS) -> np.ndarray:
        return _matrix(self.values.slice(start, size), self.places.slice(start, size), self.width)

    def _block(self, start: int) -> tuple[np.ndarray, ...]:
        b = self._rows(start, self.size)
        y = b - self.centre
        ny = (y * y).sum(1)
        # with two more places one product gives whole squared distances
        return self.ids[start:start + self.size], b, np.column_stack([-2.0 * y, ny, np.ones(len(y))]).T, ny.max()

    def along(self, queries: pa.RecordBatch) -> pa.RecordBatch:
        """The queries in the order of the column that the reference rows stand in."""
        values, places, n = queries.column("features"), queries.column("places"), queries.num_rows
        column = [_matrix(values.slice(i, BLOCK_ROWS), places.slice(i, BLOCK_ROWS), self.width)[:, self.column] for i in range(0, n, BLOCK_ROWS)]
        return queries.take(pa.array(np.argsort(np.concatenate(column), kind="stable")))

    def best(self, a: np.ndarray, own: np.ndarray | None, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row number in ``a``, id and distance of the k nearest within ``limit``, equal distances by id.

        Squared distances by a matrix product about a common centre choose the candidates; all within its rounding
        error of the limit are kept, and differences decide among them. ``own`` are ids that are left out.
        """
        limit, along = limit.copy(), a[:, self.column]
        at, near, away = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        last = k - (own is None)  # a row's own id may be among those that come first
        # the blocks around the middle of the queries come first and draw the limits in
        middle = np.median(along) if len(along) else 0.0
        for i in np.argsort(np.maximum(self.low - middle, middle - self.high), kind="stable"):
            reach = limit * (1 + RELATIVE_SLACK)
            some = np.flatnonzero(~((self.low[i] - along > reach) | (along - self.high[i] > reach)))
            if not len(some):
                continue
            ids, b, y, most = self.kept[i] if self.kept else self._block(self.starts[i])
            x = a[some] - self.centre
            nx = (x * x).sum(1)
            slack = 16 * np.finfo(float).eps * (a.shape[1] + 4) * (nx + most)
            square = np.column_stack([x, np.ones(len(x)), nx]) @ y
            bound = reach[some] ** 2 + slack
            near_enough = square <= bound[:, None]
            # a limit that lets many rows through is drawn in to the last that is needed
            loose = np.flatnonzero(np.count_nonzero(near_enough, axis=1) > last + 1)
            if len(loose) and last < len(b):
                bound[loose] = np.minimum(bound[loose], np.partition(square[loose], last, axis=1)[:, last] + slack[loose])
                near_enough[loose] = square[loose] <= bound[loose, None]
            rows, columns = np.nonzero(near_enough)
            rows = some[rows]
            if own is not None:
                other = own[rows] != ids[columns]
                rows, columns = rows[other], columns[other]
            if not len(rows):
                continue
            exact = np.empty(len(rows))
            step = max(1, (1 << 20) // a.shape[1])  # many equal distances make many candidates
            for j in range(0, len(rows), step):
                gap = a[rows[j:j + step]] - b[columns[j:j + step]]
                exact[j:j + step] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
            at, near, away = np.concatenate([at, rows]), np.concatenate([near, ids[columns]]), np.concatenate([away, exact])
            order = np.lexsort((near, away, at))
            at, near, away = at[order], near[order], away[order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            keep = place < k
            at, near, away, place = at[keep], near[keep], away[keep], place[keep]
            full = place == k - 1
            limit[at[full]] = np.minimum(limit[at[full]], away[full])
        return at, near, away


def _lists(rows: np.ndarray, n: int, ids: np.ndarray, away: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Entries in the order of their rows as one list a row."""
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(ids, pa.int64())), pa.ListArray.from_arrays(ends, pa.array(away, pa.float64()))


def _best_of_chunk(k: int, same_table: bool, width: int) -> Callable:
    """Over rows (key, query, id, reach, features, places) sorted by key with the reference rows of each key first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, values, places, chunk = None, [], [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, own = batch.column("key").to_numpy(), batch.column("id").to_numpy()
            query = batch.column("query").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(query.astype(np.int8)) != 0)) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                if keys[start] != key:
                    key, ids, values, places, chunk = keys[start], [], [], [], None
                if not query[start]:
                    ids.append(own[start:stop])
                    values.append(batch.column("features").slice(start, stop - start))
                    places.append(batch.column("places").slice(start, stop - start))
                elif ids:
                    chunk = chunk or _Chunk(ids, values, places, width)
                    step = QUERY_ROWS if chunk.kept else BLOCK_ROWS  # blocks that are made full anew serve more queries
                    part = chunk.along(batch.slice(start, stop - start))  # near ones together pass over the same blocks
                    numbers, reach = part.column("id").to_numpy(), part.column("reach").to_numpy(zero_copy_only=False)
                    for first in range(0, part.num_rows, step):
                        last = min(first + step, part.num_rows)
                        rows = _matrix(part.column("features").slice(first, last - first), part.column("places").slice(first, last - first), width)
                        at, near, away = chunk.best(rows, numbers[first:last] if same_table else None, reach[first:last], k)
                        found, at = np.unique(at, return_inverse=True)  # a visit that finds nothing hands nothing on
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(numbers[first:last][found]), *_lists(at, len(found), near, away)], ["id", "near", "away"])

    return run


def _merged(k: int) -> Callable:
    """Over rows (id, near, away) sorted by id: the k best of each id, every neighbour once."""
    def best(ids: np.ndarray, near: np.ndarray, away: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((away, near, ids))
        ids, near, away = ids[order], near[order], away[order]
        once = np.ones(len(ids), bool)
        once[1:] = (ids[1:] != ids[:-1]) | (near[1:] != near[:-1])
        ids, near, away = ids[once], near[once], away[once]
        order = np.lexsort((near, away, ids))
        ids, near, away = ids[order], near[order], away[order]
        rank = np.arange(len(ids)) - np.searchsorted(ids, ids) + 1
        keep = rank <= k
        return ids[keep], near[keep], away[keep], rank[keep]

    def rows(found: tuple) -> pa.RecordBatch:
        columns = [pa.array(found[0]), pa.array(found[1]), pa.array(found[2]), pa.array(found[3].astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, ["id", "neighbour", "distance", "rank"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            sizes = np.diff(batch.column("near").offsets.to_numpy())
            own = np.repeat(batch.column("id").to_numpy(), sizes)
            more = (own, batch.column("near").flatten().to_numpy(), batch.column("away").flatten().to_numpy())
            found = best(*[np.concatenate(x) for x in zip(held, more)])
            open_ = found[0] == found[0][-1] if len(found[0]) else np.zeros(0, bool)
            yield rows(tuple(x[~open_] for x in found))
            held = tuple(x[open_] for x in found[:3])
        yield rows(best(*held))

    return run


def _no_limit() -> Column:
    return F.lit(float("inf")).alias("reach")


def _visited(refs: DataFrame, visits: DataFrame, k: int, same_table: bool, width: int) -> DataFrame:
    """(id, near, away) of each visit: the nearest rows among ``refs`` (key, id, features, places) that have its key.

    ``visits`` carry a distance ``reach`` too, beyond which nothing is looked for.
    """
    sides = refs.select("key", F.lit(False).alias("query"), "id", _no_limit(), "features", "places").unionByName(
        visits.select("key", F.lit(True).alias("query"), "id", "reach", "features", "places"))
    met = sides.repartition("key").sortWithinPartitions("key", "query")
    return met.mapInArrow(_best_of_chunk(k, same_table, width), FOUND)


def _best_lists(found: DataFrame, k: int) -> DataFrame:
    return found.repartition("id").sortWithinPartitions("id").mapInArrow(
        _merged(k), "id bigint, neighbour bigint, distance double, rank int")


def _plain(df: DataFrame, id_column: str, features: str) -> DataFrame:
    """(id, features, places): number arrays have no places, sparse vectors the ones of their values."""
    row_id = F.col(id_column).cast("bigint").alias("id")
    if not isinstance(df.schema[features].dataType, VectorUDT):
        return df.select(row_id, F.col(features).cast("array<double>").alias("features"), F.lit(None).cast("array<int>").alias("places"))
    vector = F.unwrap_udt(features)
    return df.select(row_id, vector["values"].alias("features"), vector["indices"].alias("places"))


def _width(df: DataFrame, features: str) -> int:
    """Length of the vectors, from one row."""
    size = F.size(features)
    if isinstance(df.schema[features].dataType, VectorUDT):
        vector = F.unwrap_udt(features)
        size = F.coalesce(vector["size"], F.size(vector["values"]))
    row = df.select(size.alias("n")).first()
    return 0 if row is None else row["n"]


def _without_late_copies(refs: DataFrame, need: int) -> DataFrame:
    """Rows that are among the ``need`` smallest ids of their vector; the limit works before the shuffle."""
    same = refs.withColumn("_hash", F.xxhash64("features", "places"))  # is compared before the long arrays are
    order = F.row_number().over(Window.partitionBy("_hash", "features", "places").orderBy("id"))
    return same.withColumn("_copy", order).where(F.col("_copy") <= need).drop("_copy", "_hash")


def _sample(refs: DataFrame, n: int, width: int) -> np.ndarray:
    """At most n reference vectors, chosen by a hash of the id."""
    chosen = refs.orderBy(F.md5(F.col("id").cast("string")), "id").limit(n).select("features", "places").toArrow()
    if not chosen.num_rows:
        return np.zeros((0, width))
    return _matrix(chosen.column("features").combine_chunks(), chosen.column("places").combine_chunks(), width)


def _chunked(refs: DataFrame, visits: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Cuts keys with many reference rows into chunks; a visit of such a key goes to all its chunks."""
    large = refs.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("chunks")).where("chunks > 1")
    chunks = F.coalesce("chunks", F.lit(1))
    cut = lookup_join(refs, large, "key", "id").withColumn("chunk", F.pmod(F.xxhash64("id"), chunks))
    gone = lookup_join(visits, large, "key", "id").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)))
    as_number = lambda df: df.withColumn("key", F.xxhash64("key", "chunk"))
    return as_number(cut), as_number(gone)


def _cells(pivots: np.ndarray, need: int, radius: dict[int, float] | None = None) -> Callable:
    """Over rows (id, features, places): cell, distance to its pivot, and all cells that can hold a neighbour.

    ``reach`` is an upper bound of the need-th neighbour's distance. With the radius of each cell, ``cells`` are the
    cells within that reach and ``least`` the least distances that their rows can have.
    """
    width = pivots.shape[1]
    numbers = np.array(sorted(radius or {}), np.int64)
    radii = np.array([(radius or {})[c] for c in numbers.tolist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, QUERY_ROWS):
                part = batch.slice(start, QUERY_ROWS)
                d = _distances(_matrix(part.column("features"), part.column("places"), width), pivots)
                cell = d.argmin(1)
                # pivots are reference rows: the need-th nearest pivot is at least as far as the need-th neighbour
                reach = np.partition(d, need - 1, axis=1)[:, need - 1] if need <= len(pivots) else np.full(len(d), np.inf)
                least = d[:, numbers] * (1 - RELATIVE_SLACK) - radii
                rows, columns = np.nonzero(least <= reach[:, None])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(cell), pa.array(d[np.arange(len(d)), cell]), pa.array(reach),
                     *_lists(rows, len(d), numbers[columns], least[rows, columns])],
                    [*part.schema.names, "key", "dist", "reach", "cells", "least"])

    return run


PLACED = "id bigint, features array<double>, places array<int>, key bigint, dist double, reach double, cells array<bigint>, least array<double>"


def nearest(queries: DataFrame, refs: DataFrame, k: int, id_column: str = "id", features: str = "features",
            same_table: bool = False, block_rows: int | None = None) -> DataFrame:
    """(id, neighbour, distance, rank): the k nearest reference rows of each query, Euclidean, exact.

    Equal distances are ordered by neighbour id. ``same_table`` leaves a row out of its own list. Ids are unique
    bigints; features are number arrays or vectors of one length. A query visits its own cell, then the cells that by
    the triangle inequality can still hold one of its k nearest rows; on data without clusters these are many, see
    ``nearest_hashed``. A task holds ``block_rows`` reference rows of a cell, by default ``CHUNK_BYTES``, so a query is
    sent out about once a cell however long the table is, until cells outgrow that.
    """
    r, q = _plain(refs, id_column, features), _plain(queries, id_column, features)
    need = k + 1 if same_table else k
    r = materialise(_without_late_copies(r, need), "reference-rows")
    size = F.coalesce(F.size("features"), F.lit(0)) * 8 + F.greatest(F.size("places"), F.lit(0)) * 4
    rows, volume = r.agg(F.count(F.lit(1)), F.sum(size)).first()
    width = _width(refs, features)
    pivots = _sample(r, min(PIVOTS, max(need, rows // (block_rows or BLOCK_ROWS))), width)
    if not len(pivots):
        return queries.sparkSession.createDataFrame([], "id bigint, neighbour bigint, distance double, rank int")
    held = block_rows or max(BLOCK_ROWS, CHUNK_BYTES * rows // max(volume, 1))
    placed = materialise(r.mapInArrow(_cells(pivots, need), PLACED).drop("reach", "cells", "least"), "reference-cells")
    radius = {x["key"]: x["r"] for x in placed.groupBy("key").agg(F.max("dist").alias("r")).collect()}  # at most PIVOTS rows
    placed = placed.drop("dist")
    q = materialise(q.mapInArrow(_cells(pivots, need, radius), PLACED).drop("dist"), "query-cells")
    home = _visited(*_chunked(placed, q.drop("cells", "least"), held), k, same_table, width)
    if len(radius) == 1:
        return _best_lists(home, k)
    home = materialise(_best_lists(home, k), "home-neighbours")
    bounds = home.where(F.col("rank") == k).select("id", F.col("distance").alias("_b"))
    within = q.join(bounds, "id", "left").withColumn("reach", F.least("reach", "_b")).drop("_b")
    cells = F.arrays_zip("cells", "least")
    open_ = F.filter(cells, lambda c: (c["least"] <= F.col("reach")) & (c["cells"] != F.col("key")))
    visits = within.withColumn("_c", F.explode(open_)).select(F.col("_c.cells").alias("key"), "id", "features", "places", "reach")
    away = _visited(*_chunked(placed, visits, held), k, same_table, width)
    return _best_lists(away.unionByName(home.select("id", F.array("neighbour").alias("near"), F.array("distance").alias("away"))), k)


def _hashed(directions: np.ndarray, thresholds: np.ndarray, probes: int) -> Callable:
    """Bucket of each vector in every table, and with ``probes`` the buckets across the nearest thresholds too."""
    tables, bits, width = directions.shape
    flips = np.array(list(product((0, 1), repeat=min(bits, 6))), np.int64)

    @F.pandas_udf("array<bigint>")
    def codes(vectors: pd.Series) -> pd.Series:
        x = np.stack(vectors.to_numpy()).astype(float)
        side = x @ directions.reshape(-1, width).T - thresholds.ravel()
        side = side.reshape(len(x), tables, bits)
        weights = np.int64(1) << np.arange(bits, dtype=np.int64)
        code = ((side > 0) * weights).sum(2)
        if probes > 1 and bits:
            margin = np.abs(side)
            close = np.argsort(margin, axis=2)[:, :, :flips.shape[1]]
            cost = np.take_along_axis(margin, close, 2) ** 2 @ flips.T
            best = np.argpartition(cost, min(probes, cost.shape[2]) - 1, axis=2)[:, :, :probes]
            change = weights[close] @ flips.T  # sums of distinct powers of two, so xor is exclusive or of bits
            code = code[:, :, None] ^ np.take_along_axis(change, best, 2)
        else:
            code = code[:, :, None]
        code = code + (np.arange(tables, dtype=np.int64) << 40)[None, :, None]
        return pd.Series(list(code.reshape(len(x), -1)))

    return codes


def _as_arrays(df: DataFrame, features: str) -> DataFrame:
    vector = isinstance(df.schema[features].dataType, VectorUDT)
    return df.withColumn(features, vector_to_array(features)) if vector else df


def nearest_hashed(queries: DataFrame, refs: DataFrame, k: int, id_column: str = "id", features: str = "features",
                   same_table: bool = False, tables: int = TABLES, probes: int = PROBES, bucket_rows: int = BUCKET_ROWS,
                   block_rows: int = BLOCK_ROWS, seed: int = 7) -> DataFrame:
    """As ``nearest``, but a query only meets rows that share one of ``tables`` times ``probes`` hash buckets with it.

    A table cuts the space by random projections at their medians into buckets of about ``bucket_rows`` rows; a
    query also visits the buckets across the thresholds that it lies nearest to. Distances and order are exact,
    rows may be missing. The work of a query does not grow with the table, while the share that is found falls slowly.
    Recall at 10, against ``nearest``: 0.996 over 51,282 vectors of 64 numbers in 128 buckets a table (0.921 with 8
    tables and 8 probes, 0.9999 with 16 and 16).
    """
    r, q = _plain(_as_arrays(refs, features), id_column, features), _plain(_as_arrays(queries, features), id_column, features)
    r = materialise(_without_late_copies(r, k + 1 if same_table else k), "reference-rows")
    sample = _sample(r, SAMPLE_ROWS, 0)
    if not len(sample):
        return queries.sparkSession.createDataFrame([], "id bigint, neighbour bigint, distance double, rank int")
    bits = min(32, max(0, int(np.ceil(np.log2(max(1, r.count() / bucket_rows))))))
    directions = np.random.default_rng(seed).normal(size=(tables, bits, sample.shape[1]))
    thresholds = np.median(sample @ directions.reshape(-1, sample.shape[1]).T, axis=0).reshape(tables, bits)

    def dealt(df: DataFrame, count: int) -> DataFrame:
        return df.select(_hashed(directions, thresholds, count)("features").alias("keys"), "id", "features", "places")

    keyed = F.explode("keys").alias("key")
    placed = materialise(dealt(r, 1), "reference-buckets").select(keyed, "id", "features", "places")
    visits = dealt(q, probes).select(keyed, "id", "features", "places", _no_limit())
    return _best_lists(_visited(*_chunked(placed, visits, block_rows), k, same_table, sample.shape[1]), k)


def knn_classify(queries: DataFrame, refs: DataFrame, k: int = 5, id_column: str = "id", features: str = "features",
                 label: str = "label", search: Callable[..., DataFrame] = nearest) -> DataFrame:
    """(id, prediction, votes): the most frequent label of the k neighbours, the smallest of equals.

    ``search`` is ``nearest`` or ``nearest_hashed``.
    """
    pairs = search(queries, refs, k, id_column, features)
    known = refs.select(F.col(id_column).cast("bigint").alias("neighbour"), F.col(label).alias("label"))
    votes = pairs.join(known, "neighbour").groupBy("id", "label").agg(F.count("*").alias("votes"))
    w = Window.partitionBy("id").orderBy(F.desc("votes"), "label")
    return votes.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(
        "id", F.col("label").alias("prediction"), "votes")
