"""Data-quality checks as long tables and one-row reports."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from lureline.operators.ranking import bucket_of, medians, middle_buckets, middle_values
from lureline.shared import materialise

_NUMERIC = (S.ByteType, S.ShortType, S.IntegerType, S.LongType, S.FloatType, S.DoubleType, S.DecimalType)
_NESTED = (S.ArrayType, S.MapType, S.StructType)
MOMENTS = ("n", "sx", "sy", "sxx", "syy", "sxy")
COUNT_LIKE = ("count", "length", "num")
RATE_LIKE = ("score", "probability", "confidence")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if not isinstance(f.dataType, (*_NUMERIC, S.BooleanType, S.TimestampType, S.DateType))]


def named_like(columns: list[str], parts: tuple[str, ...]) -> list[str]:
    return [c for c in columns if any(p in c.lower() for p in parts)]


def _value(df: DataFrame, column: str) -> Column:
    """Numeric value with NaN taken as missing."""
    c = F.col(column)
    if isinstance(df.schema[column].dataType, (S.FloatType, S.DoubleType)):
        c = F.when(~F.isnan(c), c)
    return c.cast("double")


def _is_missing(df: DataFrame, column: str) -> Column:
    c = F.col(column)
    if isinstance(df.schema[column].dataType, (S.FloatType, S.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def _long(one_row: DataFrame, structs: list[Column]) -> DataFrame:
    return one_row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def missing_values(df: DataFrame) -> DataFrame:
    """(column, missing, pct) of columns with missing cells; one pass."""
    counts = df.agg(F.count("*").alias("_rows"), *[
        F.count(F.when(_is_missing(df, c), 1)).alias(c) for c in df.columns])
    rows = _long(counts, [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("missing"),
                                   (F.col(f"`{c}`") * 100.0 / F.col("_rows")).alias("pct"))
                          for c in df.columns])
    return rows.filter("missing > 0")


def most_missing(df: DataFrame, n: int = 20) -> DataFrame:
    return missing_values(df).orderBy(F.desc("missing"), "column").limit(n)


def _digest(df: DataFrame, subset: list[str] | None = None) -> list[Column]:
    """Two 64-bit hashes that stand for the row, so that no text is shuffled; nulls count by their place."""
    columns = subset or df.columns
    cells = [F.to_json(c) if isinstance(df.schema[c].dataType, _NESTED) else F.col(f"`{c}`") for c in columns]
    gaps = F.concat(*[F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in columns])
    return [F.xxhash64(F.lit(seed), gaps, *cells).alias(f"_h{seed}") for seed in (1, 2)]


def duplicates(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """One row: rows, rows that repeat an earlier one, their share."""
    groups = df.select(*_digest(df, subset)).groupBy("_h1", "_h2").agg(F.count("*").alias("n"))
    return groups.agg(
        F.sum("n").alias("rows"), (F.sum("n") - F.count("*")).alias("duplicates"),
        ((F.sum("n") - F.count("*")) * 100.0 / F.sum("n")).alias("pct"))


def duplicate_ids(df: DataFrame, id_column: str, subset: list[str]) -> DataFrame:
    """Ids of all rows that repeat an earlier row.

    The first id of each group is a map-side combined minimum; the anti join then runs on the
    unique id, so a huge group neither sits in one task nor skews a join.
    """
    keyed = df.select(F.col(id_column).alias("id"), *_digest(df, subset))
    firsts = keyed.groupBy("_h1", "_h2").agg(F.min("id").alias("id")).select("id")
    return keyed.select("id").join(firsts, "id", "left_anti")


def label_distribution(df: DataFrame, label: str = "label", imbalance_limit: float = 3.0) -> DataFrame:
    """(label, n, pct, n_labels, imbalance_ratio, imbalanced); ratio only for exactly two labels."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return _distribution(counts, imbalance_limit)


def _distribution(counts: DataFrame, imbalance_limit: float = 3.0) -> DataFrame:
    ratio = F.when(F.count("*") == 2, F.max("n") / F.min("n"))
    whole = counts.agg(F.struct(F.sum("n").alias("total"), F.count("*").alias("n_labels"),
                                ratio.alias("ratio"))).scalar()
    return counts.select(
        "label", "n", (F.col("n") * 100.0 / whole["total"]).alias("pct"), whole["n_labels"].alias("n_labels"),
        whole["ratio"].alias("imbalance_ratio"),
        F.coalesce(whole["ratio"] > imbalance_limit, F.lit(False)).alias("imbalanced"))


def _pandas_skew(c: Column) -> Column:
    n = F.count(c).cast("double")
    adjusted = F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n < 3, None).when(F.stddev_pop(c) == 0, 0.0).otherwise(adjusted)


def _pandas_kurtosis(c: Column) -> Column:
    n = F.count(c).cast("double")
    adjusted = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6)
    return F.when(n < 4, None).when(F.stddev_pop(c) == 0, 0.0).otherwise(adjusted)


MEASURES = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "skew": _pandas_skew, "kurtosis": _pandas_kurtosis}
THRESHOLD = 3.0  # deviations beyond which a value is an outlier


def feature_statistics(df: DataFrame, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(column, mean, std, min, max, median, skew, kurtosis) of all numeric columns, or the first ``limit``."""
    columns = (columns or numeric_columns(df))[:limit]
    stats = df.agg(*[F.struct(*[f(_value(df, c)).alias(m) for m, f in MEASURES.items()]).alias(c)
                     for c in columns])
    rows = _long(stats, [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("m")) for c in columns])
    values = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), _value(df, c).alias("value")) for c in columns])).alias("s"))
    middle = medians(values.select("s.*"))
    return rows.join(F.broadcast(middle), "column", "left").select(
        "column", *[F.col(f"m.{m}").alias(m) for m in ("mean", "std", "min", "max")], "median",
        F.col("m.skew").alias("skew"), F.col("m.kurtosis").alias("kurtosis"))


def outliers(df: DataFrame, columns: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(column, outliers, pct) of columns with values more than ``threshold`` deviations off.

    Two passes: moments as a scalar subquery, then one conditional count for all columns.
    """
    columns = columns or numeric_columns(df)
    moments = df.agg(F.struct(*[
        F.struct(F.avg(_value(df, c)).alias("mean"), F.stddev_pop(_value(df, c)).alias("std")).alias(c)
        for c in columns]).alias("m")).scalar()

    def far(c: str) -> Column:
        z = F.try_divide(_value(df, c) - moments[c]["mean"], moments[c]["std"])
        return F.abs(z) > threshold

    counts = df.agg(F.count("*").alias("_rows"), *[F.count(F.when(far(c), 1)).alias(c) for c in columns])
    rows = _long(counts, [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("outliers"),
                                   (F.col(f"`{c}`") * 100.0 / F.col("_rows")).alias("pct")) for c in columns])
    return rows.filter("outliers > 0")


def _co_moments(width: int, shift: np.ndarray, block: int) -> Callable:
    """Per column and block of columns: counts, sums, squares and products over the rows where both cells are there.

    Values of a second list ``middle`` are counted and handed on as they are, under block -1.
    """
    names = ["i", "block", *MOMENTS]

    def counted(middle: np.ndarray) -> pa.RecordBatch:
        found = [np.unique(x[~np.isnan(x)], return_counts=True) for x in middle.T]
        used = [k for k, x in enumerate(found) if len(x[0])]
        lists = [pa.array([found[k][0] for k in used], pa.list_(pa.float64())),
                 pa.array([found[k][1].astype(float) for k in used], pa.list_(pa.float64()))]
        none = pa.nulls(len(used), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array([-1] * len(used), pa.int32()), *lists, *[none] * (len(MOMENTS) - 2)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = list(range(0, width, block))
        total = {(a, b): np.zeros((6, min(block, width - a), block)) for a in edges for b in edges if b >= a}
        for batch in batches:
            if not batch.num_rows:
                continue
            if "middle" in batch.schema.names:
                yield counted(batch.column("middle").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width))
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width) - shift
            there = ~np.isnan(x)
            x[~there] = 0.0
            there = there.astype(float)
            squares = x * x
            for (a, b), t in total.items():
                one, two = slice(a, a + block), slice(b, b + block)
                n = min(block, width - b)
                pairs = ((there, there), (x, there), (there, x), (squares, there), (there, squares), (x, x))
                for k, (left, right) in enumerate(pairs):
                    t[k, :, :n] += left[:, one].T @ right[:, two]
        for (a, b), t in total.items():
            rows = t.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(a, a + rows), pa.int32()), pa.array(np.full(rows, b), pa.int32()),
                 *[pa.ListArray.from_arrays(np.arange(rows + 1, dtype=np.int32) * block, pa.array(t[k].ravel())) for k in range(6)]],
                names)

    return run


def _correlated(names: list[str], shift: np.ndarray, block: int) -> Callable:
    """Adds up rows of equal (i, block), which follow each other, and ends them as correlations."""
    def rows(i: int, first: int, t: np.ndarray) -> pa.RecordBatch:
        n = min(block, len(names) - first)
        count, sx, sy, sxx, syy, sxy = t[:, :n]
        with np.errstate(divide="ignore", invalid="ignore"):
            vx, vy = sxx - sx * sx / count, syy - sy * sy / count
            r = (sxy - sx * sy / count) / np.sqrt(vx * vy)
        noise = (8 * np.finfo(float).eps * np.abs(shift)) ** 2
        known = (count > 0) & (vx > noise[i] * count) & (vy > noise[first:first + n] * count)
        later = np.arange(first, first + n) > i
        picked = [first + k for k in np.flatnonzero(later)]
        values = pa.array(np.clip(r[later], -1, 1), mask=~known[later])
        return pa.RecordBatch.from_arrays([pa.array([names[i]] * len(picked), pa.string()), pa.array([names[k] for k in picked], pa.string()), values],
                                          ["feature1", "feature2", "correlation"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("i", "block")], 1)
            flat = np.stack([batch.column(c).flatten().to_numpy().reshape(len(keys), block) for c in MOMENTS], 1)
            starts = np.concatenate([[0], np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1])
            sums = np.add.reduceat(flat, starts, axis=0)
            for at, own in zip(starts.tolist(), sums):
                now = (int(keys[at, 0]), int(keys[at, 1]))
                if now == key:
                    held = held + own
                    continue
                if key is not None:
                    yield rows(*key, held)
                key, held = now, own
        if key is not None:
            yield rows(*key, held)

    return run


def correlations(df: DataFrame, columns: list[str] | None = None, block: int = 128) -> DataFrame:
    """(feature1, feature2, correlation) of all column pairs; rows with a missing side are left out.

    One way for any number of columns: means first, then each task adds up co-moments of blocks of columns about
    these means, which merge by addition, one row for a column and a block of partners. A constant column has no
    correlation; an empty table gives no rows.
    """
    columns = columns or numeric_columns(df)
    if len(columns) < 2:
        raise ValueError("correlation needs at least two numeric columns")
    values = df.select(F.array(*[_value(df, c) for c in columns]).alias("v"))
    means = df.agg(F.array(*[F.avg(_value(df, c)) for c in columns]).alias("m")).first()["m"]  # one number a column
    return _from_moments(values, columns, _finite(means), min(block, len(columns)))


def _finite(means: list[float | None]) -> np.ndarray:
    return np.array([m if m is not None and math.isfinite(m) else 0.0 for m in means])


def _moment_rows(values: DataFrame, width: int, shift: np.ndarray, block: int) -> DataFrame:
    lists = ", ".join(f"{m} array<double>" for m in MOMENTS)
    return values.mapInArrow(_co_moments(width, shift, block), f"i int, block int, {lists}")


def _from_moments(values: DataFrame, columns: list[str], shift: np.ndarray, block: int, made: DataFrame | None = None) -> DataFrame:
    parts = _moment_rows(values, len(columns), shift, block) if made is None else made
    parts = parts.repartition("i", "block").sortWithinPartitions("i", "block")
    return parts.mapInArrow(_correlated(columns, shift, block), "feature1 string, feature2 string, correlation double")


def high_correlations(df: DataFrame, columns: list[str] | None = None, threshold: float = 0.9) -> DataFrame:
    return correlations(df, columns).filter(F.abs("correlation") > threshold)


def _consistency_checks(df: DataFrame, ignore: list[str] | None = None) -> list[tuple[str, str, Column]]:
    numeric = [c for c in numeric_columns(df) if c not in (ignore or [])]
    checks = [("negative_values", c, F.col(c) < 0) for c in named_like(numeric, COUNT_LIKE)]
    return checks + [("invalid_ranges", c, (F.col(c) < 0) | (F.col(c) > 1)) for c in named_like(numeric, RATE_LIKE)]


def consistency(df: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    """(check, column, n): negatives in count-like and values outside [0, 1] in rate-like columns."""
    checks = _consistency_checks(df, ignore)
    schema = "check string, column string, n bigint"
    if not checks:
        return df.sparkSession.createDataFrame([], schema)
    one = df.agg(*[F.count(F.when(bad, 1)).alias(f"k{i}") for i, (_, _, bad) in enumerate(checks)])
    rows = _long(one, [F.struct(F.lit(k).alias("check"), F.lit(c).alias("column"), F.col(f"k{i}").alias("n"))
                       for i, (k, c, _) in enumerate(checks)])
    return rows.filter("n > 0")


def dataset_info(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total_samples")).select(
        "total_samples", F.lit(len(df.columns)).alias("total_features"),
        F.lit(len(numeric_columns(df))).alias("numeric_features"),
        F.lit(len(text_columns(df))).alias("text_features"))


def _scored(base: DataFrame) -> DataFrame:
    rows = F.nullif(F.col("rows"), F.lit(0)).cast("double")
    score = (F.lit(100.0) - F.least(F.lit(20.0), F.col("missing") / rows * 100)
             - F.least(F.lit(15.0), F.col("duplicate_pct"))
             - F.least(F.lit(10.0), F.col("outliers") / (rows * 0.01))
             - F.when(F.col("imbalance_ratio") > 3, 10.0).otherwise(0.0))
    scored = base.withColumn("quality_score", F.greatest(F.lit(0.0), score))
    s = F.col("quality_score")
    return scored.withColumn("grade", F.when(s >= 80, "GOOD").when(s >= 60, "MODERATE").otherwise("POOR"))


class Profile:
    """What all checks need of a table, in at most four reads of it.

    1. Counts, missing cells, moments and consistency counts in one row. 2. Digests of rows with their label, which
    end as rows and distinct rows per label. 3. A histogram per column, with outliers counted by the moments known
    from the first. 4. Co-moments, together with the values of the buckets that hold the medians.
    """

    def __init__(self, df: DataFrame, label: str = "label") -> None:
        self.df, self.spark, self.label = df, df.sparkSession, label if label in df.columns else None
        self.numeric = numeric_columns(df)
        self.checks = _consistency_checks(df)
        moments = [F.struct(*[f(_value(df, c)).alias(m) for m, f in MEASURES.items()], F.stddev_pop(_value(df, c)).alias("pop"))
                   for c in self.numeric]
        one = df.agg(
            F.count("*").alias("rows"), F.array(*[F.count(F.when(_is_missing(df, c), 1)) for c in df.columns]).alias("missing"),
            F.array(*moments).alias("moments") if moments else F.lit(None).alias("moments"),
            F.array(*[F.count(F.when(bad, 1)) for _, _, bad in self.checks]).cast("array<bigint>").alias("checks"))
        self.one = one.first()  # as long as the table is wide
        own = F.col(f"`{label}`") if self.label else F.lit(None).cast("string")
        groups = df.select(*_digest(df), own.alias("label")).groupBy("_h1", "_h2").agg(F.count("*").alias("n"), F.first("label").alias("label"))
        self.groups = materialise(groups.groupBy("label").agg(F.sum("n").alias("rows"), F.count("*").alias("distinct")), "row-groups")

    @cached_property
    def _histogram(self) -> DataFrame:
        cells = []
        for i, c in enumerate(self.numeric):
            m, v = self.one["moments"][i], _value(self.df, c)
            far = F.lit(False) if m["mean"] is None else F.coalesce(
                F.abs(F.try_divide(v - F.lit(m["mean"]), F.lit(m["pop"]))) > THRESHOLD, F.lit(False))
            cells.append(F.struct(F.lit(i).alias("_name"), bucket_of(v).alias("_b"), far.cast("int").alias("far")))
        found = self.df.select(F.explode(F.array(*cells)).alias("s")).select("s.*").where("_b IS NOT NULL")
        return materialise(found.groupBy("_name", "_b").agg(F.count("*").alias("_s"), F.sum("far").alias("far")), "histograms")

    @cached_property
    def far(self) -> dict[int, int]:
        return {r["_name"]: r["far"] for r in self._histogram.groupBy("_name").agg(F.sum("far").alias("far")).collect()}

    @cached_property
    def _last(self) -> tuple[DataFrame, DataFrame]:
        """Moment rows with the values around the medians, and the buckets of these."""
        hit = middle_buckets(self._histogram.select("_name", "_b", "_s")).collect()  # at most two a column
        wanted: dict[int, list[int]] = {}
        for r in hit:
            wanted.setdefault(r["_name"], []).append(r["_b"])
        cells = [_value(self.df, c) for c in self.numeric]
        middle = [F.when(bucket_of(v).isin(wanted[i]), v) if i in wanted else F.lit(None).cast("double") for i, v in enumerate(cells)]
        shift = _finite([m["mean"] for m in self.one["moments"]])
        rows = _moment_rows(self.df.select(F.array(*cells).alias("v"), F.array(*middle).alias("middle")), len(cells), shift, min(128, len(cells)))
        buckets = self.spark.createDataFrame(hit, "_name int, _b bigint, _base bigint, _t bigint")
        return materialise(rows, "moments"), buckets

    def missing(self) -> list[tuple[str, int]]:
        return [(c, n) for c, n in zip(self.df.columns, self.one["missing"]) if n]

    def medians(self) -> DataFrame:
        rows, buckets = self._last
        values = rows.where("block = -1").select(F.col("i").alias("_name"), F.explode(F.arrays_zip("n", "sx")).alias("z"))
        counted = values.groupBy("_name", F.col("z.n").alias("_v")).agg(F.sum("z.sx").cast("bigint").alias("_n"))
        counted = counted.withColumn("_b", bucket_of(F.col("_v"))).join(F.broadcast(buckets), ["_name", "_b"])
        return middle_values(counted.select("_name", "_b", "_base", "_t", "_v", "_n"))

    def correlations(self) -> DataFrame:
        shift = _finite([m["mean"] for m in self.one["moments"]])
        return _from_moments(self.df, self.numeric, shift, min(128, len(self.numeric)), self._last[0].where("block >= 0"))

    def labels(self) -> DataFrame:
        counts = self.groups.where("label IS NOT NULL").select("label", F.col("rows").alias("n"))
        return _distribution(counts)

    def score(self) -> DataFrame:
        """One row: the totals of the checks, the score and its grade."""
        whole = self.groups.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("d"))
        ratio = F.lit(None).cast("double")
        if self.label:
            ratio = self.labels().agg(F.max("imbalance_ratio")).scalar()
        again = F.col("rows") - F.col("d")
        return _scored(whole.select(
            "rows", again.alias("duplicates"), F.try_divide(again * 100.0, F.col("rows")).alias("duplicate_pct"),
            F.lit(sum(self.one["missing"])).cast("bigint").alias("missing"),
            F.lit(sum(self.far.values()) if self.numeric else 0).cast("bigint").alias("outliers"), ratio.alias("imbalance_ratio")))


def quality_report(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: the totals of the checks, the 0-100 score and its grade, in three reads.

    Score = 100 - min(20, missing cells per 100 rows) - min(15, duplicate %) - min(10, outliers per
    1 % of rows) - 10 for labels out of balance, and never below 0.
    """
    return Profile(df, label).score()


def full_report(df: DataFrame, label: str = "label") -> DataFrame:
    """All checks in one long table (check, column, metric, value), ready for the JSON sink, in four reads."""
    profile = Profile(df, label)
    spark, rows, numeric = df.sparkSession, profile.one["rows"], profile.numeric
    known: list[tuple[str, str | None, str, float | None]] = [
        ("dataset_info", None, m, float(v)) for m, v in (
            ("total_samples", rows), ("total_features", len(df.columns)), ("numeric_features", len(numeric)),
            ("text_features", len(text_columns(df))))]
    for c, n in profile.missing():
        known += [("missing_values", c, "missing", float(n)), ("missing_values", c, "pct", n * 100.0 / rows)]
    for i, c in enumerate(numeric):
        m, far = profile.one["moments"][i], profile.far.get(i, 0)
        known += [("feature_statistics", c, k, m[k]) for k in MEASURES]
        if far:
            known += [("outliers", c, "outliers", float(far)), ("outliers", c, "pct", far * 100.0 / rows)]
    for (_, c, _), n in zip(profile.checks, profile.one["checks"]):
        if n:
            known.append(("consistency", c, "n", float(n)))
    out = spark.createDataFrame(known, "check string, column string, metric string, value double")

    def long(frame: DataFrame, check: str, column: Column, metrics: list[str]) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
        return frame.select(F.lit(check).alias("check"), column.cast("string").alias("column"),
                            F.explode(cells).alias("s")).select("check", "column", "s.metric", "s.value")

    score = profile.score()
    out = out.union(long(score.withColumnRenamed("duplicate_pct", "pct"), "duplicates", F.lit(None), ["duplicates", "pct"]))
    if profile.label:
        out = out.union(long(profile.labels(), "label_distribution", F.col("label"), ["n", "pct"]))
    if numeric:
        middle = profile.medians().withColumn("column", F.get(F.array(*map(F.lit, numeric)), F.col("_name")))
        names = spark.createDataFrame([(c,) for c in numeric], "column string")
        out = out.union(long(names.join(middle, "column", "left"), "feature_statistics", F.col("column"), ["median"]))
    if len(numeric) > 1:
        pair = F.concat("feature1", F.lit("|"), "feature2")
        high = profile.correlations().where(F.abs("correlation") > 0.9)
        out = out.union(long(high, "correlation", pair, ["correlation"]))
    return out.union(long(score, "quality", F.lit(None), ["quality_score"]))
