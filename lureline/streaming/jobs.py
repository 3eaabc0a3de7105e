"""Streaming jobs: the batch operators over unbounded input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lureline.functions import risk
from lureline.operators import metrics as M
from lureline.operators import scoring as S
from lureline.operators.models import Trained
from lureline.shared import remove
from lureline.sources.sinks import FEEDBACK_SCHEMA


def file_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_trigger: int = 1000) -> DataFrame:
    """New parquet files of a folder as they arrive, and those of tables in it: a name that fits may be a file or a folder of them."""
    # the braces make any pattern a glob, whose hits are listed anew for every batch and may be single files
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/{{{pattern}}}")


def scored_messages(messages: DataFrame, trained: Trained, message: str = "message", html: str | None = None) -> DataFrame:
    """Stateless: routing, features, verdict and risk of each arriving message, with its captured page if it has one."""
    return S.chat(messages, trained, message, html)


def tiered_probabilities(scores: DataFrame, probability: str = "probability") -> DataFrame:
    """Stateless: risk level and score of each arriving probability."""
    p = F.col(probability)
    return scores.withColumns({"level": risk.risk_level(p), "score": risk.risk_score(p)})


def running_counters(verdicts: DataFrame) -> DataFrame:
    """Running totals and rates. Partial sums combine before the shuffle, and the state is one row.

    Starting over is a new checkpoint folder.
    """
    return M.prediction_counters(verdicts)


def append_stream(df: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Exactly-once append to a parquet folder."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(path)


def counters_stream(df: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """The current totals, kept as one table under the number of the batch that they belong to.

    The totals come from the stream's own state and a batch that runs again has its old number, so it replaces what
    its first attempt left and nothing is counted twice. Once a batch is written, all before its predecessor are
    deleted: two tables at most remain, however long the stream runs.
    """
    spark = df.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        for old in _batches(spark, path):
            if old < number - 1:
                remove(spark, f"{path}/batch={old}")

    writer = df.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _batches(spark: SparkSession, path: str, finished: bool = False) -> list[int]:
    """Numbers of the batches whose tables are under ``path``, or of those that were written to their end."""
    mark = "/_SUCCESS" if finished else ""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*{mark}")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    names = [str(x.getPath().getParent().getName() if finished else x.getPath().getName()) for x in found]
    return sorted(int(n.split("=")[1]) for n in names)


def latest_counters(spark: SparkSession, path: str) -> DataFrame:
    """The totals of the newest batch that was written to its end."""
    return spark.read.parquet(f"{path}/batch={_batches(spark, path, finished=True)[-1]}")


def feedback_stream(rows: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    names = [c.split(" ")[0] for c in FEEDBACK_SCHEMA.split(", ")]
    return append_stream(rows.select(*[F.col(n).cast("string") for n in names]), path, checkpoint, once)


def run_to_end(start: Callable[[], StreamingQuery], timeout: int = 600) -> None:
    """Run an available-now query until its input is used up."""
    query = start()
    if not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError("streaming query did not end in time")
