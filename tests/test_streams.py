"""Counters whose batches fail, run again and pile up."""

import pytest
from pyspark.sql import functions as F

from lureline.shared import new_path
from lureline.streaming import jobs as J


def test_a_failed_batch_is_counted_once_and_old_tables_go(spark, tmp_path, monkeypatch):
    source = tmp_path / "in"
    totals = []
    path, state = new_path(spark, "counters"), new_path(spark, "counters-state")

    def run():
        rows = J.file_stream(spark, str(source), "id long, is_phishing boolean", files_per_trigger=1)
        J.run_to_end(lambda: J.counters_stream(J.running_counters(rows), path, state, once=True))

    for k in range(5):
        spark.range(10 * (k + 1)).select("id", (F.col("id") % 3 == 0).alias("is_phishing")).coalesce(1).write.mode("append").parquet(str(source))
        if k == 2:  # the table of the batch is written, then the sink fails
            with monkeypatch.context() as broken:
                broken.setattr(J, "_batches", lambda *a, **b: 1 / 0)
                with pytest.raises(Exception):
                    run()
        run()
        got = J.latest_counters(spark, path).first()
        totals.append((got.total_predictions, got.phishing_detected))
        assert len(J._batches(spark, path)) <= 2
    sizes = [10, 30, 60, 100, 150]
    flags = [sum(len(range(0, 10 * (j + 1), 3)) for j in range(k + 1)) for k in range(5)]
    assert totals == list(zip(sizes, flags))


def test_an_unfinished_table_is_not_read(spark):
    path = new_path(spark, "counters")
    spark.range(1).write.parquet(f"{path}/batch=3")
    spark.range(2).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/batch=4")
    assert J._batches(spark, path) == [3, 4]
    assert J.latest_counters(spark, path).count() == 1


def test_a_table_in_a_folder_of_part_files_is_streamed_like_one_file(spark, tmp_path):
    table = spark.range(100).select("id", (F.col("id") % 4 == 0).alias("is_phishing"))
    table.repartition(3).write.parquet(str(tmp_path / "parts" / "t.parquet"))
    table.coalesce(1).write.parquet(str(tmp_path / "written"))
    (tmp_path / "one").mkdir()
    next((tmp_path / "written").glob("part-*")).rename(tmp_path / "one" / "t.parquet")
    for folder in ("parts", "one"):
        table.write.mode("overwrite").parquet(str(tmp_path / folder / "other.parquet"))
        path, state = new_path(spark, "streamed"), new_path(spark, "streamed-state")
        rows = J.file_stream(spark, str(tmp_path / folder), "id long, is_phishing boolean", "t.parquet")
        J.run_to_end(lambda: J.append_stream(rows, path, state, once=True))
        assert spark.read.parquet(path).agg(F.count("*"), F.sum("id")).first() == (100, 4950)
