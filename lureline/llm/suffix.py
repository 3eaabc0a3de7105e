"""Exact removal of repeated byte strings with suffix arrays over shards of the corpus.

A string of ``length`` bytes that also starts earlier in the corpus (in a smaller id, or further left in
the same text) is removed wherever it starts again. Every window of that length belongs to one anchor,
the leftmost smallest of its hashed ``GRAM``-byte grams, so equal windows have equal anchors at equal
places, and

1. anchors that occur once in the corpus are dropped: nothing around them can repeat;
2. around each other anchor a text gives a region, the windows that belong to it; regions go to the
   shard of their anchor's hash, where all equal windows meet;
3. of equal regions all but the earliest go whole; a shard sorts the suffixes of the distinct regions of
   its anchors by induced sorting (``induced``), reads groups of equal windows off the permuted common
   prefixes, and hands back all of a group but the earliest;
4. spans of a text are united and cut out.

A text is known by its id and a 64-bit hash of id and text, so two ids never share a result. Where hashes
of two ids collide they exchange wanted anchors only, which adds regions that repeat nothing.

Only hashes of anchors are counted over the whole corpus. The shuffle of the texts is one and the same
for steps 2 and 4. Equal regions within a text are sent once with their places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lureline.llm.common import documents, flat_text, map_arrow, slices
from lureline.llm.induced import permuted_prefixes, suffix_array

LENGTH = 100
GRAM = 32
SHARD_BYTES = 2 << 20     # region bytes that one suffix array takes, more only for a single anchor
SEGMENT = 1 << 22         # windows of a text that are searched for anchors at once
_BASE = 0x9E3779B97F4A7C15
_LAST = (1 << 63) - 1
_OFFSET_BITS = 24

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            rows = np.full(size, np.uint64(base))
            rows[0] = 1
            _powers[k] = np.cumprod(rows)
    return _powers[0][:n], _powers[1][:n]


def gram_hashes(body: np.ndarray, width: int) -> np.ndarray:
    """Mixed 64-bit polynomial hash of every ``width`` bytes."""
    up, down = _grown(len(body) + 1)
    sums = np.zeros(len(body) + 1, np.uint64)
    np.cumsum(body * up[:len(body)], out=sums[1:])
    out = (sums[width:] - sums[:-width]) * down[:len(body) - width + 1]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from minima that run from block bounds in both directions."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def _segment_anchors(body: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    grams = gram_hashes(body, gram)
    low = np.uint64((1 << _OFFSET_BITS) - 1)
    keyed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    at = (_window_minima(keyed, length - gram + 1) & low).astype(np.int64)
    return grams[at].view(np.int64), at, np.arange(len(at))


def anchors(body: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """For each run of windows with one anchor: text number, first window within the text, windows, anchor hash."""
    empty = np.zeros(0, np.int64)
    if len(body) < length:
        return empty, empty, empty, empty
    found = []
    for start in range(0, len(body) - length + 1, SEGMENT):
        part = body[start:start + SEGMENT + length - 1]
        hashes, at, windows = _segment_anchors(part, length, gram)
        windows = windows + start
        owner = np.searchsorted(offsets, windows, "right") - 1
        inside = windows + length <= offsets[owner + 1]
        hashes, at, windows, owner = hashes[inside], at[inside] + start, windows[inside], owner[inside]
        if not len(at):
            continue
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])]))
        count = np.diff(np.append(first, len(at)))
        found.append((owner[first], windows[first] - offsets[owner[first]], count, hashes[first]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (empty,) * 4


ALONE, FIRST, OTHER = 0, 1, 2  # within a slice of texts: the anchor's only row, its first of several, a further one


def _anchor_rows(length: int):
    """A row for each anchor hash of a text, and whether it repeats within the slice of texts read together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                owner, _, _, hashes = anchors(*flat_text(part.column("text")), length)
                order = np.argsort(hashes, kind="stable")
                owner, hashes = owner[order], hashes[order]
                same = hashes[1:] == hashes[:-1]
                after, before = np.append(same, False), np.append(False, same)[:len(hashes)]
                kind = np.where(before, OTHER, np.where(after, FIRST, ALONE))[:len(hashes)]
                fresh = ~(before & np.append(False, owner[1:] == owner[:-1])[:len(hashes)])  # a text's own repeats are one row
                keys = np.asarray(part.column("_key"))[owner[fresh]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[fresh]), pa.array(keys), pa.array(kind[fresh].astype(np.int32))], ["anchor", "_key", "kind"])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose anchor is known to repeat, or stands in a neighbouring row; rows come ordered by anchor."""
    held = None  # the last row, which the next batch decides

    def decided(anchor, key, kind, final):
        same = anchor[1:] == anchor[:-1]
        stays = (kind != ALONE) | np.append(False, same) | np.append(same, False)
        if not final:
            # the last row is decided with the next batch; it takes along that it has an equal neighbour
            last = (anchor[-1:], key[-1:], np.where(np.append(False, same)[-1:], OTHER, kind[-1:]))
            return anchor[:-1][stays[:-1]], key[:-1][stays[:-1]], last
        return anchor[stays], key[stays], None

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(c)) for c in ("anchor", "_key", "kind")]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns)]
        anchor, key, held = decided(*columns, False)
        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(key)], ["anchor", "_key"])
    if held is not None:
        anchor, key, _ = decided(*held, True)
        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(key)], ["anchor", "_key"])


REGIONS = "anchor long, ord long, _key long, places array<int>, region binary"


def _regions(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                wanted = part.column("anchors").combine_chunks() if isinstance(part.column("anchors"), pa.ChunkedArray) else part.column("anchors")
                known = np.unique(wanted.flatten().to_numpy())
                body, offsets = flat_text(part.column("text"))
                owner, first, count, hashes = anchors(body, offsets, length)
                at = np.searchsorted(known, hashes)
                at[at == len(known)] = 0
                hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
                owner, first, count, hashes = owner[hit], first[hit], count[hit], hashes[hit]
                raw = body.tobytes()
                starts = (offsets[owner] + first).tolist()
                ends = (offsets[owner] + first + count + length - 1).tolist()
                once: dict[tuple, list[int]] = {}
                hash_of: list[int] = []
                for o, h, place, a, b in zip(owner.tolist(), hashes.tolist(), first.tolist(), starts, ends):
                    places = once.setdefault((o, raw[a:b]), [])
                    if not places:
                        hash_of.append(h)
                    places.append(place)
                owners = np.fromiter((k[0] for k in once), np.int64, len(once))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hash_of, pa.int64()), pa.array(np.asarray(part.column("ord"))[owners]),
                     pa.array(np.asarray(part.column("_key"))[owners]), pa.array(list(once.values()), pa.list_(pa.int32())),
                     pa.array([k[1] for k in once], pa.binary())], ["anchor", "ord", "_key", "places", "region"])

    return run


def repeated_windows(regions: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Byte spans of each region covered by windows that equal a window further ahead in the list or the region."""
    sizes = np.array([len(r) for r in regions], np.int64)
    text = np.zeros(int(sizes.sum()) + len(regions) + 1, np.uint16)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    inside = np.ones(len(text), bool)
    inside[ends] = inside[-1] = False
    text[inside] = np.frombuffer(b"".join(regions), np.uint8).astype(np.uint16) + 2
    text[ends] = 1  # between regions; 0 closes the string
    sa = suffix_array(text, 258)
    # only whether it reaches `length` is asked, and chains of reducible values end with their region
    common = permuted_prefixes(np.minimum(text, 255), sa, length + int(sizes.max()) + 8, divider=1)
    reach = common[sa] >= length
    group = np.cumsum(~reach)
    whole = np.zeros(len(text), bool)  # places from which a window fits into the region
    marks = np.zeros(len(text) + 1, np.int32)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.maximum(ends - length + 1, starts), -1)
    whole = np.cumsum(marks[:-1]) > 0
    member = np.flatnonzero((reach | np.append(reach[1:], False)) & whole[sa])
    if not len(member):
        return [[] for _ in regions]
    owner = group[member]
    edges = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    earliest = np.repeat(np.minimum.reduceat(sa[member], edges), np.diff(np.append(edges, len(member))))
    again = np.sort(sa[member][sa[member] != earliest])
    out: list[list[tuple[int, int]]] = [[] for _ in regions]
    if not len(again):
        return out
    breaks = np.flatnonzero(np.diff(again) > 1)
    region = np.searchsorted(ends, again, "left")
    breaks = np.union1d(breaks, np.flatnonzero(np.diff(region)))
    lows = again[np.concatenate([[0], breaks + 1])]
    highs = again[np.concatenate([breaks, [len(again) - 1]])]
    for r, a, b in zip(np.searchsorted(ends, lows, "left").tolist(), lows.tolist(), highs.tolist()):
        base = int(starts[r])
        out[r].append((a - base, b - base + length))
    return out


SPANS = "ord long, _key long, low int, high int"


def _span_rows(order: np.ndarray, key: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(order), pa.array(key), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))],
                                      ["ord", "_key", "low", "high"])


def _places(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All places in one array and the offsets of the rows."""
    at = column.offsets.to_numpy()
    return column.values.to_numpy()[at[0]:at[-1]].astype(np.int64), (at - at[0]).astype(np.int64)


class _Heads:
    """First occurrences of distinct regions, collected anchor by anchor until a suffix array is worth it.

    The windows of one region hold their anchor at different places, so no two of them are equal. An anchor
    with a single distinct region therefore repeats nothing but whole regions, and needs no suffix array.
    """

    def __init__(self, length: int) -> None:
        self.length, self.size = length, 0
        self.open: list[tuple[int, int, int, bytes]] = []     # of the anchor that may go on in the next batch
        self.anchor: int | None = None
        self.waiting: list[tuple[int, int, int, bytes]] = []  # of anchors with several distinct regions

    def close(self) -> None:
        if len(self.open) > 1:
            self.waiting += self.open
            self.size += sum(len(h[3]) for h in self.open)
        self.open, self.anchor = [], None

    def add(self, anchor: np.ndarray, heads: list[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        bounds = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])[:len(anchor)]).tolist() + [len(anchor)]
        for a, b in zip(bounds[:-1], bounds[1:]):
            if int(anchor[a]) != self.anchor:
                self.close()
                if self.size >= SHARD_BYTES:
                    yield self.solved()
                self.anchor = int(anchor[a])
            self.open += heads[a:b]

    def solved(self) -> pa.RecordBatch:
        heads = sorted(self.waiting, key=lambda h: h[:3])  # in the order of their first places
        self.waiting, self.size = [], 0
        found = [(o, k, place + a, place + b) for (o, k, place, _), spans in
                 zip(heads, repeated_windows([h[3] for h in heads], self.length)) for a, b in spans]
        return _span_rows(*np.array(found, np.int64).reshape(-1, 4).T)


def _shards(length: int):
    """Spans to remove, from rows in the order of anchor, region, ord and key.

    All of a run of equal regions but its first place go whole, as they stream by; what is kept in memory is
    one row for each distinct region of the anchors of a shard, however often it occurs.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, last = _Heads(length), None  # last: anchor, region, ord and key of the run that goes on
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, order, key = (batch.column(c).to_numpy() for c in ("anchor", "ord", "_key"))
            region, (place, at) = batch.column("region"), _places(batch.column("places"))
            fresh = np.ones(len(anchor), bool)
            fresh[1:] = (anchor[1:] != anchor[:-1]) | np.asarray(pc.not_equal(region[1:], region[:-1]))
            fresh[0] = last is None or (int(anchor[0]), region[0].as_py()) != last[:2]
            number = np.cumsum(fresh) - 1  # of the head within the batch; -1 is the last batch's
            first = np.flatnonzero(fresh)
            ahead = (0, 0) if last is None else last[2:]
            head_order, head_key = np.append(order[first], ahead[0])[number], np.append(key[first], ahead[1])[number]
            copy = (order != head_order) | (key != head_key)  # rows equal to the head in id and text are the head
            row = np.repeat(np.arange(len(anchor)), np.diff(at))
            gone = copy[row] | fresh[row]
            gone[at[first]] = False  # the first place of a head stays
            row, low = row[gone], place[gone]
            yield _span_rows(order[row], key[row], low, low + pc.binary_length(region).to_numpy()[row])
            last = (int(anchor[-1]), region[len(anchor) - 1].as_py(), int(head_order[-1]), int(head_key[-1]))
            yield from heads.add(anchor[first], list(zip(order[first].tolist(), key[first].tolist(), place[at[first]].tolist(),
                                                         region.take(pa.array(first)).to_pylist())))
        heads.close()
        if heads.waiting:
            yield heads.solved()

    return run


def united(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by spans; touching spans are one run."""
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    first = np.concatenate([[True], low[1:] > high[:-1]]) if len(low) else np.zeros(0, bool)
    return low[first], high[np.append(first[1:], True)] if len(low) else high


def _keyed(df: DataFrame) -> DataFrame:
    """Adds ``_key``, the same for rows with equal id and text and never null; with ``ord`` it names a text."""
    return df.select("*", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("_key"))


def _ord() -> Column:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST))


def spans(df: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """From columns doc_id and text, and others: the keyed rows dealt out by key, and arrays of spans to remove per key.

    Both uses of the dealt texts read the same columns without a filter in between, so Spark shuffles them
    once. Of an anchor that repeats within a slice only one row per slice goes to the anchor's own
    partition, the others to partitions by text; a frequent anchor is no hot key.
    """
    dealt = _keyed(df).repartition("_key")
    held = map_arrow(_keyed(df).select("_key", "text"), _anchor_rows(length), "anchor long, _key long, kind int")
    route = F.when(F.col("kind") == OTHER, F.xxhash64("anchor", "_key")).otherwise(F.col("anchor"))
    wanted = map_arrow(held.repartition(route).sortWithinPartitions("anchor"), _repeated, "anchor long, _key long")
    wanted = wanted.groupBy(F.col("_key").alias("_k")).agg(F.collect_set("anchor").alias("anchors"))  # a text's own
    carried = [F.col(c) for c in df.columns if c not in ("doc_id", "text")]  # to read the very rows of the other use
    joined = dealt.join(wanted, F.col("_key") == F.col("_k"), "left").select(
        *carried, _ord().alias("ord"), "_key", "text",
        F.coalesce("anchors", F.array().cast("array<bigint>")).alias("anchors"))
    sharded = map_arrow(joined, _regions(length), REGIONS).repartition("anchor").sortWithinPartitions(
        "anchor", "region", "ord", "_key")
    found = map_arrow(sharded, _shards(length), SPANS)
    return dealt, found.groupBy(F.col("_key").alias("_k")).agg(F.collect_list(F.struct("low", "high", "ord")).alias("spans"))


CUT = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_bytes", T.BinaryType())]


def _cut(part: pa.RecordBatch) -> tuple[list[int], list[int], list[int], list[bytes]]:
    """Bytes, removed bytes, runs and what is left of each text of a slice."""
    body, offsets = flat_text(part.column("text"))
    raw, offsets = body.tobytes(), offsets.tolist()
    size, removed, runs, kept = [], [], [], []
    for i, own in enumerate(part.column("spans")):
        text = raw[offsets[i]:offsets[i + 1]]
        size.append(len(text))
        pieces = own.values
        if pieces is None or not len(pieces):
            removed.append(0)
            runs.append(0)
            kept.append(text)
            continue
        low, high = united(*(pieces.field(k).to_numpy() for k in (0, 1)))
        removed.append(int((high - low).sum()))
        runs.append(len(low))
        bounds = [0, *np.stack([low, high], axis=1).ravel().tolist(), len(text)]
        kept.append(b"".join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2])))
    return size, removed, runs, kept


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            *counts, kept = _cut(part)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text"), *[pa.array(x, pa.int64()) for x in counts], pa.array(kept, pa.binary())],
                ["doc_id", "text", *[n for n, _ in CUT]])


def _with_spans(df: DataFrame, length: int) -> DataFrame:
    """The rows of ``df`` with the spans to remove; texts are dealt out by key."""
    dealt, removed = spans(df, length)
    own = F.filter("spans", lambda s: s["ord"] == _ord())  # texts of other ids may share the key
    return dealt.join(removed, F.col("_key") == F.col("_k"), "left").select(*df.columns, own.alias("spans"))


def deduplicated(df: DataFrame, length: int = LENGTH) -> DataFrame:
    """n_bytes, n_removed, n_spans and kept_bytes next to doc_id and text, for every row of ``df``.

    ``df`` has the columns doc_id, an integer, and text; null texts are empty, null ids come after all others. Rows of
    one id are ordered by a hash of their texts; rows equal in both are one document and get the same
    result, as its first occurrence. Bytes are cut where the spans end, also within a character.
    """
    rows = _with_spans(df.select("doc_id", "text"), length)
    schema = T.StructType([rows.schema["doc_id"], rows.schema["text"], *[T.StructField(*c) for c in CUT]])
    return map_arrow(rows, _measured, schema)


def shortened(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH) -> DataFrame:
    """``df`` with its texts deduplicated, all columns and their order as before. Ids are integers.

    Rows whose whole content repeats earlier, so that no word is left, are dropped; rows that were not
    touched stay as they are, null texts included. ``n_chars`` is the length of the text again, if there
    is such a column.
    """
    names = {c: f"_c{i}" for i, c in enumerate(df.columns)}
    rows = df.select(*[F.col(c).alias(a) for c, a in names.items()])
    rows = rows.withColumn("doc_id", F.col(names[id_column])).withColumn("text", F.col(names[text_column]))
    extra = [a for c, a in names.items() if c not in (id_column, text_column)]
    found = _with_spans(rows.select("doc_id", "text", *extra), length)
    kept = [found.schema[x] for x in ("doc_id", *extra)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                _, removed, _, left = _cut(part)
                texts = [t if not n else b.decode("utf-8", "ignore") for n, t, b in
                         zip(removed, part.column("text").to_pylist(), left)]
                words = pa.array([not n or bool(t.split()) for n, t in zip(removed, texts)], pa.bool_())
                out = pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], pa.array(texts, pa.string())],
                                                 [*[f.name for f in kept], "text"])
                yield out.filter(words)

    cut = map_arrow(found, run, T.StructType([*kept, T.StructField("text", T.StringType())]))
    back = {id_column: F.col("doc_id"), text_column: F.col("text")}
    values = {c: back.get(c, F.col(a)) for c, a in names.items()}
    if "n_chars" in values:
        values["n_chars"] = F.when(F.col("text").isNull(), values["n_chars"]).otherwise(F.length("text")).cast(df.schema["n_chars"].dataType)
    return cut.select(*[v.alias(c) for c, v in values.items()])


def op8_suffix_dedup(spark, sf_dir):
    done = deduplicated(documents(spark, sf_dir))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
# the same by all windows of 100 bytes: hex digits, two for a byte
SQL = {"op8_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS x, strlen(coalesce(text, '')) AS n FROM documents),
 w AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 200)) AS g FROM d, unnest(range(greatest(n - 99, 0))) AS t(i)),
 again AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
 marked AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) + 100 AS fresh FROM again),
 counted AS (SELECT doc_id, i, count(*) FILTER (WHERE fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
 runs AS (SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM counted GROUP BY doc_id, run),
 cut AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM runs),
 kept AS (SELECT doc_id, sum(hi - lo) AS removed, count(*) AS spans, max(hi) AS tail,
   string_agg(substr(x, (2 * before + 1)::BIGINT, (2 * (lo - before))::BIGINT), '' ORDER BY lo) AS front FROM cut JOIN
   d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
 sha256(unhex(coalesce(front, '') || substr(x, (2 * coalesce(tail, 0) + 1)::BIGINT))) AS kept_sha256 FROM d LEFT JOIN
   kept USING (doc_id)"""}
