"""CSV whose quoted cells hold line breaks, read in byte ranges by many tasks.

Spark's text reader cuts a file at line ends. Whether a line end also ends a record depends on whether a quoted
cell is open there, so a range of lines is a map of two states: what is open at its end if nothing, or if a
quoted cell, was open at its beginning. A first pass computes the maps, which are composed per file; with the
state at its beginning known, every range then gives its whole records, and at most one piece at each end that is
joined with those of its neighbours. Records are parsed by Spark's own CSV parser.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true"}
_RANGES = "file string, start long, from_closed boolean, from_open boolean, ends_closed boolean, ends_open boolean, crlf boolean"
_ENTRIES = "file string, start long, open boolean, owner long, crlf boolean"
_CELL = r'(?:"(?:[^"]|"")*"(?:[^",][^,]*)?|[^",][^,]*|)'
_CLOSED = re.compile(rf"(?:{_CELL},)*{_CELL}")


def left_open(line: str, was_open: bool) -> bool:
    """Whether a quoted cell is open behind a line; a quote opens a cell only where the cell begins."""
    if '"' not in line:
        return was_open
    return _CLOSED.fullmatch('"' + line if was_open else line) is None


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Rows of one range of one file."""
    files = batch.column("file").dictionary_encode()
    code, start = files.indices.to_numpy(zero_copy_only=False), batch.column("start").to_numpy()
    cuts = [0, *[k for k in range(1, len(start)) if start[k] != start[k - 1] or code[k] != code[k - 1]], len(start)]
    for a, b in pairwise(cuts):
        if b > a:
            yield (files.dictionary[int(code[a])].as_py(), int(start[a])), batch.slice(a, b - a)


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, ends, seen, crlf = None, [False, True], [False, False], False

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{
            "file": key[0], "start": key[1], "from_closed": ends[0], "from_open": ends[1], "ends_closed": seen[0], "ends_open": seen[1], "crlf": crlf}])

    for batch in batches:
        for own, part in _runs(batch):
            if own != key:
                if key is not None:
                    yield row()
                key, ends, seen = own, [False, True], [False, False]
                crlf = own[1] == 0 and (part.column("value")[0].as_py() or "").endswith("\r")
            lines = part.column("value")
            quoted = pc.match_substring(lines, '"')
            if not pc.any(quoted).as_py():
                seen = [seen[k] or not ends[k] for k in (0, 1)]
                continue
            for line, has in zip(lines.to_pylist(), quoted.to_pylist()):
                if has:
                    ends = [left_open(line, e) for e in ends]
                seen = [seen[k] or not ends[k] for k in (0, 1)]
    if key is not None:
        yield row()


def _composed(ranges: pd.DataFrame) -> pd.DataFrame:
    """State at the beginning of each range of one file, and the range in which the record that is open there began."""
    ranges = ranges.sort_values("start")
    rows, is_open, owner, crlf = [], False, -1, bool(ranges["crlf"].any())
    for r in ranges.itertuples():
        rows.append((r.file, r.start, is_open, owner, crlf))
        ended = r.ends_open if is_open else r.ends_closed
        after = r.from_open if is_open else r.from_closed
        if after and (ended or not is_open):
            owner = r.start
        is_open = after
    return pd.DataFrame(rows, columns=["file", "start", "open", "owner", "crlf"])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """record, whole, file, owner, start, head, crlf: records of a range, and pieces of those that reach over its ends."""
    key, pending, owner, is_open, whole, head, crlf = None, [], -1, False, True, False, False
    schema = pa.schema([("record", pa.string()), ("whole", pa.bool_()), ("file", pa.string()), ("owner", pa.int64()),
                        ("start", pa.int64()), ("head", pa.bool_()), ("crlf", pa.bool_())])

    def rows(found: list[tuple[str, bool, int, bool]]) -> pa.RecordBatch:
        columns = [[x[0] for x in found], [x[1] for x in found], [key[0]] * len(found), [x[2] for x in found], [key[1]] * len(found), [x[3] for x in found], [crlf] * len(found)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def rest() -> Iterator[pa.RecordBatch]:
        if pending:
            yield rows([("\n".join(pending), False, key[1] if whole else owner, head)])

    for batch in batches:
        for own, part in _runs(batch):
            if own != key:
                yield from rest()
                key, pending = own, []
                is_open, owner, crlf = (part.column(c)[0].as_py() for c in ("open", "owner", "crlf"))
                whole, head = not is_open, own[1] == 0
            lines, found = part.column("value").to_pylist(), []
            for line in lines:
                pending.append(line)
                is_open = left_open(line, is_open)
                if not is_open:
                    found.append((pending[0] if len(pending) == 1 else "\n".join(pending), whole, owner, head))
                    pending, whole, head = [], True, False
            if found:
                yield rows(found)
    yield from rest()


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record, head) of every CSV record under ``path``; ``head`` marks the first one of a file. Order is not kept."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    entries = lines.mapInArrow(_maps, _RANGES).groupBy("file").applyInPandas(_composed, _ENTRIES)
    known = entries.select(F.col("file").alias("_f"), F.col("start").alias("_s"), "open", "owner", "crlf")
    # one row per range of 128 MB or so: 60 bytes for each of them
    placed = lines.join(F.broadcast(known), (F.col("file") == F.col("_f")) & (F.col("start") == F.col("_s")), "left")
    missing = F.raise_error(F.lit("the files were cut in other places than before"))
    placed = placed.select("value", "file", "start", F.coalesce("open", missing.cast("boolean")).alias("open"), "owner", "crlf")
    found = placed.mapInArrow(_records, "record string, whole boolean, file string, owner long, start long, head boolean, crlf boolean")
    pieces = found.where("NOT whole")
    ordered = F.array_sort(F.collect_list(F.struct("start", "record", "head")))
    joined = pieces.groupBy("file", "owner").agg(ordered.alias("p"), F.first("crlf").alias("crlf")).select(
        F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record"), F.exists("p", lambda x: x["head"]).alias("head"), "crlf")
    both = found.where("whole").select("record", "head", "crlf").unionByName(joined)
    unix = F.regexp_replace(F.replace("record", F.lit("\r\n"), F.lit("\n")), "\r$", "")
    return both.select(F.when(F.col("crlf"), unix).otherwise(F.col("record")).alias("record"), "head").where("record != ''")


def read_split_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of CSV files with a header, as Spark's multi-line reader gives them, but with many tasks a file.

    A quote that opens a cell stands at its beginning, quotes inside are doubled. In a file whose header ends with
    carriage return and line feed, these are one line feed inside cells too, as for Spark's reader. Both passes must see the same
    byte ranges; if files change in between, the query fails rather than lose rows.
    """
    body = records(spark, path).where("NOT head")
    return body.select(F.from_csv("record", _ddl(schema), OPTIONS).alias("r")).select("r.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
