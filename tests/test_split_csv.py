"""Multi-line CSV in byte ranges against Spark's one-task reader."""

import random
from collections import Counter

import pytest
from pyspark.sql import types as T

from lureline.sources.corpora import read_csv
from lureline.sources.split_csv import left_open, records

SCHEMA = "a int, b string, c string"


def cell(rng):
    kind = rng.randint(0, 9)
    if kind < 5:
        return ["", '""', "5 inch", 'a "b" c', str(kind)][kind]
    return '"' + "".join(rng.choice(["a", "b,", "\n", "\r\n", '""', "é", " ", "x" * 30, "\n\n"]) for _ in range(rng.randint(0, 12))) + '"'


@pytest.fixture
def ranges(spark):
    def set_size(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)

    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    yield set_size
    for name in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{name}")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_rows_equal_the_one_task_reader(spark, tmp_path, ranges, end):
    rng = random.Random(len(end))
    for name in "xy":
        rows = ["a,b,c", *[f"{i},{cell(rng)},{cell(rng)}" for i in range(400)], "", '7,"very' + "\n" * 3000 + 'long",z', '9,"open\nto the end"']
        (tmp_path / f"{name}.csv").write_bytes(end.join(rows).encode())
    expected = Counter(map(tuple, read_csv(spark, str(tmp_path), SCHEMA, split=False).collect()))
    for size in ("300", "4000", "10m"):
        ranges(size)
        assert Counter(map(tuple, read_csv(spark, str(tmp_path), SCHEMA).collect())) == expected
    ranges("300")
    assert records(spark, str(tmp_path)).rdd.getNumPartitions() > 50
    assert read_csv(spark, str(tmp_path)).schema == read_csv(spark, str(tmp_path), split=False).schema


def test_empty_files(spark, tmp_path):
    (tmp_path / "head.csv").write_text("a,b,c\n")
    (tmp_path / "nothing.csv").write_text("")
    assert read_csv(spark, str(tmp_path), SCHEMA).count() == 0
    assert read_csv(spark, str(tmp_path), SCHEMA).schema == T.StructType.fromDDL(SCHEMA)


def test_open_cells():
    for line, closed, opened in [("a,b", False, True), ('a,"b', True, False), ('"a""', True, False), ('5" x,1', False, False), ('"a","b"', False, False),
                                 ('a"b","', True, True), ('""', False, True), ('"""', True, False), ('"a"x,y', False, False), (',,"', True, False)]:
        assert left_open(line, False) == closed, line
        assert left_open(line, True) == opened, line
