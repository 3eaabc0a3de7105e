"""Exact ranks, running totals and medians without a global sort in one task.

A window over a whole table (or over one of two class labels) would send it to one or two tasks.
Here rows are first cut into many buckets in order, bucket totals give each bucket its offset,
and only the inside of a bucket is sorted by one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAN_OUT = 65536


def seeded_hash(id_column: str, seed: int | str) -> Column:
    """Hex hash of seed and id: a repeatable random order that other engines can recompute."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_column).cast("string")))


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Null-safe equality over columns that carry an underscore on the right."""
    out = F.lit(True)
    for n in names:
        out = out & left[n].eqNullSafe(right[f"_r_{n}"])
    return out


def hash_rank(df: DataFrame, id_column: str, by: list[str] | None = None, seed: int | str = 42,
              rank: str = "rank", total: str = "group_rows") -> DataFrame:
    """Adds the 1-based rank in hash order within ``by`` and the group's row count.

    The first four hex digits spread even a single group over 65,536 evenly filled buckets.
    """
    by = by or []
    hashed = df.withColumn("_hash", seeded_hash(id_column, seed))
    hashed = hashed.withColumn("_bucket", F.substring("_hash", 1, 4))
    keys = [*by, "_bucket"]
    counts = hashed.groupBy(*keys).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by)  # at most 65,536 counted rows per group
    offsets = counts.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        (F.sum("_n").over(group.orderBy("_bucket")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(group).alias(total))
    inside = Window.partitionBy(*keys).orderBy("_hash", id_column)
    ranked = hashed.withColumn("_in", F.row_number().over(inside))
    out = ranked.join(offsets, _same(ranked, offsets, keys))
    return out.select(*df.columns, (F.col("_before") + F.col("_in")).cast("bigint").alias(rank), total)


def unit_interval(value: Column) -> Column:
    """Order-preserving map of any double into (0, 1)."""
    return F.atan(value) / F.lit(math.pi) + F.lit(0.5)


def _log_unit(value: Column) -> Column:
    """Order-preserving map into (0, 1) that spreads small and huge magnitudes alike."""
    return F.signum(value) * F.log1p(F.abs(value)) / F.lit(1420.0) + F.lit(0.5)


def running_totals(df: DataFrame, by: list[str], key: str, values: list[str], descending: bool = False,
                   unit: Callable[[Column], Column] = unit_interval) -> DataFrame:
    """Adds ``before_<value>``: totals over the rows of the same group that sort earlier.

    ``df`` holds one row per (group, key), as an aggregation leaves it; keys are cut into two
    levels of ordered buckets by ``unit``, so each window sees the buckets of one level or the
    keys of one of 2^32 fine buckets.
    """
    order = F.col(key).desc() if descending else F.col(key).asc()
    place = unit(-F.col(key) if descending else F.col(key))
    cut = df.withColumns({"_b1": F.floor(place * FAN_OUT), "_b2": F.floor(place * FAN_OUT * FAN_OUT)})
    sums = [F.sum(v).alias(v) for v in values]
    fine = cut.groupBy(*by, "_b1", "_b2").agg(*sums)
    coarse = fine.groupBy(*by, "_b1").agg(*sums)
    ahead = (Window.unboundedPreceding, -1)

    def earlier(frame: DataFrame, keys: list[str], order_by, names: dict[str, str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(order_by).rowsBetween(*ahead)
        return frame.withColumns({n: F.coalesce(F.sum(v).over(w), F.lit(0)) for v, n in names.items()})

    level1 = earlier(coarse, by, F.col("_b1"), {v: f"_c_{v}" for v in values}).drop(*values)
    level2 = earlier(fine, [*by, "_b1"], F.col("_b2"), {v: f"_f_{v}" for v in values}).drop(*values)
    rows = earlier(cut, [*by, "_b1", "_b2"], order, {v: f"_i_{v}" for v in values})
    out = rows.join(level2, [*by, "_b1", "_b2"]).join(level1, [*by, "_b1"])
    return out.select(*df.columns, *[
        (F.col(f"_c_{v}") + F.col(f"_f_{v}") + F.col(f"_i_{v}")).alias(f"before_{v}") for v in values])


def bucket_of(value: Column) -> Column:
    """Ordered bucket of a double, one of at most 65,537."""
    return F.floor(_log_unit(value) * FAN_OUT)


def _holds(k: Column, start: Column, n: Column) -> Column:
    return (k >= start) & (k < start + n)


def _middle(start: Column, n: Column) -> Column:
    return _holds(F.floor((F.col("_t") - 1) / 2), start, n) | _holds(F.floor(F.col("_t") / 2), start, n)


def middle_buckets(sizes: DataFrame) -> DataFrame:
    """Of (_name, _b, _s), a histogram per name: the one or two buckets that hold the middle ranks, with their offset."""
    one = Window.partitionBy("_name")
    placed = sizes.withColumns({"_base": F.sum("_s").over(one.orderBy("_b")) - F.col("_s"), "_t": F.sum("_s").over(one)})
    return placed.filter(_middle(F.col("_base"), F.col("_s"))).select("_name", "_b", "_base", "_t")


def middle_values(counted: DataFrame) -> DataFrame:
    """(_name, median) of (_name, _b, _base, _t, _v, _n): counted values of the middle buckets."""
    ranked = running_totals(counted, ["_name", "_b"], "_v", ["_n"], unit=_log_unit)
    found = ranked.filter(_middle(F.col("_base") + F.col("before__n"), F.col("_n")))
    return found.groupBy("_name").agg(((F.max("_v") + F.min("_v")) / 2).alias("median"))


def medians(long: DataFrame, name: str = "column", value: str = "value", count: str | None = None) -> DataFrame:
    """Exact median per name of a (name, value) table; the mean of the two middle values.

    With ``count`` a row stands for that many equal ones.

    A histogram of at most 65,537 ordered buckets per name says which buckets hold the two middle
    ranks. Only the values of those buckets are shuffled, equal ones counted first, and running
    totals find the exact ranks among them.
    """
    copies = (F.lit(1) if count is None else F.col(count)).cast("bigint")
    clean = long.select(F.col(name).alias("_name"), F.col(value).cast("double").alias("_v"), copies.alias("_w"))
    clean = clean.filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    clean = clean.withColumn("_b", bucket_of(F.col("_v")))
    hit = middle_buckets(clean.groupBy("_name", "_b").agg(F.sum("_w").alias("_s")))
    inside = clean.join(F.broadcast(hit), ["_name", "_b"])  # at most two buckets per name
    counted = inside.groupBy("_name", "_b", "_base", "_t", "_v").agg(F.sum("_w").alias("_n"))
    return middle_values(counted).withColumnRenamed("_name", name)
