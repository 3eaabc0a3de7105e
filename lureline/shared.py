"""Session defaults and the shared folder that written intermediate tables go to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side with at most this many rows and bytes may be broadcast; callers check it, see `lookup_join`.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and local runs; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lureline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="lureline-")
    spark.sparkContext.setCheckpointDir(folder)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_recording: list[list[str]] = []


@contextmanager
def recorded(paths: list[str]) -> Iterator[None]:
    """Appends to ``paths`` what ``new_path`` hands out meanwhile, so that it can be deleted later."""
    _recording.append(paths)
    try:
        yield
    finally:
        _recording.remove(paths)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _recording:
        paths.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that this library wrote; on any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


class Tables:
    """Intermediate tables of one computation in the shared folder; each can go once its successor is written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: dict[str, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes under a new path; a table of this name that was written before is deleted afterwards."""
        path = new_path(self.spark, name)
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.paths.pop(name, None)
            if path is not None:
                remove(self.spark, path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rebalance a scan that has fewer splits than the cluster has cores.

    Row-wise text work is bound by CPU, and a small or badly written input may be one single
    split. Large inputs have far more splits than cores and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that are computed exactly once per row.

    The optimizer merges neighbouring projections and may then repeat an expensive expression for
    every use. A one-element generator between them keeps the values; it is row local.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """``body`` over a struct of the values, each computed once however often the body reads it.

    For column functions, and for conditions, where the optimizer repeats an expression at every use.
    """
    row = F.struct(*[c.alias(n) for n, c in values.items()])
    return F.get(F.transform(F.array(row), body), F.lit(0))


def row_hash(df: DataFrame) -> Column:
    """Hash of a row over all columns that can be hashed, for dealing rows out evenly."""
    plain = [f.name for f in df.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    return F.xxhash64(*[df[c] for c in plain])


def is_small(lookup: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether the table is within both bounds; it is read no further than the first row beyond ``max_rows``."""
    sized = [F.coalesce(F.octet_length(f.name), F.lit(0)) if f.dataType.simpleString() in ("string", "binary") else F.lit(16)
             for f in lookup.schema]
    width = sized[0]
    for size in sized[1:]:
        width = width + size
    n, size = lookup.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(width.cast("bigint"))).first()
    return n <= max_rows and (size or 0) <= max_bytes


def lookup_join(
    big: DataFrame, lookup: DataFrame, key: str, salt_by: str | Column, how: str = "left",
    max_rows: int = BROADCAST_ROWS, salts: int = 64, max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join on a key that may be badly skewed in ``big``.

    The lookup side is measured first, so it should be a written table. Up to ``max_rows`` rows and
    ``max_bytes`` bytes it is broadcast; beyond that both sides are salted (each lookup row is repeated
    ``salts`` times), so one hot key spreads over ``salts`` tasks. Both ways give the same rows.
    """
    if is_small(lookup, max_rows, max_bytes):
        return big.join(F.broadcast(lookup), key, how)
    salted_big = big.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)))
    spread = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>"))
    salted_lookup = lookup.withColumn("_salt", spread)
    return salted_big.join(salted_lookup, [key, "_salt"], how).drop("_salt")
