"""Reproducible sharding: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0 to N-1 in the order of a hash of their key, and a keyed permutation of these
numbers gives every row its place: place modulo the shard count is the shard, the quotient is the
slot. Both can be computed from the row number alone, and shard counts differ by one at most. All of
it is DataFrame functions on narrow rows; no text is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lureline.llm.common import documents, narrow

PRIME = 2147483647  # products of two residues stay inside a signed 64-bit number
ROUNDS = 6


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """Multiplier, addend and second addend of each round, from a Lehmer generator."""
    state, keys = (seed * 69621 + 1) % PRIME or 1, []
    for _ in range(rounds):
        row = []
        for _ in range(3):
            state = state * 48271 % PRIME
            row.append(state)
        keys.append((row[0] | 1, row[1], row[2]))
    return keys


def domain(rows: int) -> tuple[int, int]:
    """Radices of the two halves; their product exceeds ``rows`` by less than the first radix."""
    a = max(1, math.isqrt(max(rows - 1, 0)) + 1)
    return a, max(1, -(-rows // a))


def permuted(number: Column, rows: int, seed: int) -> Column:
    """Image of ``number`` under a keyed bijection of 0..rows-1.

    Halves live in mixed radices and a round adds a hash of one half to the other, modulo its radix.
    A place outside the range is permuted again until it falls inside (cycle walking). Places outside
    are fewer than the first radix, so the walk is bounded by them and is never cut short.
    """
    a, b = domain(rows)
    long = lambda x: F.lit(x).cast("bigint")
    keys = F.array(*[
        F.struct(*[long(v).alias(n) for n, v in zip(("m", "c", "d"), k)], F.lit(i % 2 == 0).alias("odd"))
        for i, k in enumerate(round_keys(seed))])

    def scrambled(half: Column, key: Column) -> Column:
        y = (half * key["m"] + key["c"]) % long(PRIME)
        return (y * y + key["d"]) % long(PRIME)

    def one_round(acc: Column, key: Column) -> Column:
        left, right = acc["l"], acc["r"]
        return F.when(key["odd"], F.struct(((left + scrambled(right, key)) % long(a)).alias("l"), right.alias("r"))) \
            .otherwise(F.struct(left.alias("l"), ((right + scrambled(left, key)) % long(b)).alias("r")))

    def step(value: Column) -> Column:
        start = F.struct((value % long(a)).alias("l"), F.floor(value / long(a)).cast("bigint").alias("r"))
        return F.aggregate(keys, start, one_round, lambda acc: acc["r"] * long(a) + acc["l"])

    first = step(number)
    walk = F.array_repeat(F.lit(0), F.when(first >= long(rows), F.lit(a * b - rows)).otherwise(F.lit(0)))
    return F.aggregate(walk, first, lambda value, _: F.when(value < long(rows), value).otherwise(step(value)))


def row_numbers(df: DataFrame, id_column: str, ties: list[str], name: str = "row_number") -> DataFrame:
    """Global numbers from 0 in the order of md5 of the id, then the id and ``ties``; nulls first.

    The first four hex digits cut the rows into 65,536 buckets. Equal rows are counted before the
    shuffle and numbered as a run, so a repeated row is no hot key and the numbering is repeatable.
    """
    keys = list(dict.fromkeys([id_column, *ties]))
    hashed = F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    runs = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_hash", hashed)
    runs = runs.withColumn("_bucket", F.substring("_hash", 1, 4))
    ids = df.select(F.substring(hashed, 1, 4).alias("_bucket"))
    counts = ids.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"))
    inside = Window.partitionBy("_bucket").orderBy("_hash", *[F.col(k).asc_nulls_first() for k in keys])
    placed = runs.withColumn("_end", F.sum("_copies").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.col("_before") + F.col("_end") - F.col("_copies")
    return placed.join(before, "_bucket").select(
        *keys, F.explode(F.sequence(start, start + F.col("_copies") - 1)).alias(name))


def assign(df: DataFrame, id_column: str, ties: list[str], shards: int = 16, seed: int = 20) -> DataFrame:
    """Id, ``ties``, shard and slot of every row of ``df``.

    ``ties`` are narrow columns that tell rows with equal ids apart; rows equal in all of them are
    interchangeable. Null ids are numbered as the empty string. An empty table gives no rows. Other columns are not
    read; join them by the id. Counts of shards differ by one at most, slots are gapless from 0.
    """
    rows = df.count()
    keys = list(dict.fromkeys([id_column, *ties]))
    numbered = row_numbers(df.select(*keys), id_column, ties, "_number")
    place = numbered.withColumn("_place", permuted(F.col("_number"), rows, seed))
    n = F.lit(shards).cast("bigint")
    return place.select(*keys, (F.col("_place") % n).cast("int").alias("shard"),
                        F.floor(F.col("_place") / n).cast("bigint").alias("slot"))


def op2_feistel_shards(spark, sf_dir):
    """Law ``rows``: shard counts at most one apart. The method keeps no groups of equal texts together."""
    docs = narrow(documents(spark, sf_dir), doc_id="doc_id", text="text")
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"),
                        F.crc32(text.cast("binary")).alias("text_crc32"))
    out = assign(sized, "doc_id", ["size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def _crc_table() -> list[int]:
    out = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return out


def _sql_step(source: str, n: str) -> str:
    """One permutation of column ``q``: columns r0 and q of ``source`` become r0 and the new q."""
    sql = f"SELECT r0, q % a AS l, q // a AS r, a, b FROM ({source})"
    for i, (m, c, d) in enumerate(round_keys(20)):
        half, other, radix = ("r", "l", "a") if i % 2 == 0 else ("l", "r", "b")
        sql = f"SELECT *, ({half} * {m}::BIGINT + {c}) % {PRIME} AS y FROM ({sql})"
        sql = f"SELECT r0, a, b, ({other} + (y * y + {d}) % {PRIME}) % {radix} AS {other}, {half} FROM ({sql})"
    return f"SELECT r0, (r * a + l)::BIGINT AS q, {n} AS n FROM ({sql})"


def op2_sql() -> str:
    size = "SELECT greatest(1, floor(sqrt(greatest(count(*) - 1, 0)))::BIGINT + 1) AS a, count(*) AS n FROM documents"
    radices = f"SELECT a, greatest(1, (n + a - 1) // a) AS b, n FROM ({size})"
    crc = ("list_reduce([4294967295::BIGINT] || list_transform(CASE WHEN t = '' THEN [] ELSE "
           "regexp_extract_all(hex(t), '..') END, lambda x: ('0x' || x)::BIGINT), "
           "lambda c, x: xor(c >> 8, table_[(xor(c, x) & 255) + 1]))")
    return f"""WITH RECURSIVE radix AS ({radices}),
 walk AS (
 {_sql_step("SELECT i AS r0, i AS q, a, b, n FROM radix, unnest(range(n)) AS t(i)", "(SELECT n FROM radix)")}
 UNION ALL
 {_sql_step("SELECT r0, q, a, b FROM walk, (SELECT a, b FROM radix) WHERE q >= n", "(SELECT n FROM radix)")}),
 place AS (SELECT r0, q FROM walk WHERE q < n),
 sums AS (SELECT doc_id, strlen(t) + 1 AS size, xor({crc}, 4294967295::BIGINT) AS text_crc32
   FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents), (SELECT {_crc_table()}::BIGINT[] AS table_)),
 numbered AS (SELECT *, row_number() OVER (ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, size,
   text_crc32) - 1 AS r0 FROM sums)
 SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (q % 16)::INTEGER AS shard, (q // 16)::BIGINT AS slot,
   NULL::INTEGER AS grown_shard FROM numbered JOIN place USING (r0)"""


QUERIES = {"op2_feistel_shards": op2_feistel_shards}
SQL = {"op2_feistel_shards": op2_sql()}
