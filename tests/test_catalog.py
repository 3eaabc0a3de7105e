"""Every query with check SQL gives the same rows in Spark and DuckDB on the smallest data."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import compare

SF_DIR = "/root/testdata/sf0.001"
ORACLES = oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    ok, note = compare(name, queries()[name], ORACLES[name], spark, SF_DIR)
    assert ok, note


def test_streams_and_entry(spark):
    assert entry(spark).count() > 0
    assert set(ORACLES) <= set(queries())
    for name in ("scr2_batch_with_errors", "str1_chat_stream", "scr6_chat", "pre6_smote_rows", "ml7_knn_scores",
                 "cv7_learning_curve"):
        assert queries()[name](spark, SF_DIR).count() > 0
