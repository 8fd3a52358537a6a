"""Streams: an append journal with one row a record, running statistics, and event-time windows. See stateful.py for the rest.

The journal is the resumable form of a judging loop: records that a run has seen are not judged again,
whatever is restarted. Windows over event time are an extension; the rest has a batch counterpart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vectrine.session import cut, remove, shared_path


def journal(source: DataFrame, out: str, checkpoint: str, judge: Callable[[DataFrame], DataFrame], key: str) -> StreamingQuery:
    """Judge each new record once and append it. Keys that were seen are kept in the stream's state; a replayed batch overwrites its own files, so that none is there twice."""

    def put(batch: DataFrame, number: int) -> None:
        judge(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return source.dropDuplicates([key]).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_journal(spark: SparkSession, out: str, schema) -> DataFrame:
    """Rows of the journal's batches; none if nothing has been written."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(out)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.option("basePath", out).parquet(out).drop("batch")


def running_moments(source: DataFrame, by: str, value: str) -> DataFrame:
    """n, total, squares, low and high of each group, kept as state; give it output mode complete or update."""
    v = F.col(value)
    return source.groupBy(by).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"), F.min(v).alias("low"), F.max(v).alias("high"))


def attached(source: DataFrame, attach: Callable[[DataFrame], DataFrame], name: str = "attached") -> DataFrame:
    """What attach makes of each micro-batch, appended; what it leaves out of a batch is kept nowhere."""
    spark = source.sparkSession
    out, state = shared_path(spark, name), shared_path(spark, f"{name}-state")
    put = lambda batch, number: attach(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
    source.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    rows = cut(read_journal(spark, out, attach(spark.createDataFrame([], source.schema)).schema))
    remove(spark, state)
    remove(spark, out)
    return rows


def windowed_counts(source: DataFrame, ts: str, late: str, width: str, *by: str) -> DataFrame:
    """Rows by event-time window; later than the watermark, they are not counted."""
    return source.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(F.count(F.lit(1)).alias("n"))


def run_to_table(rows: DataFrame, name: str) -> DataFrame:
    """Run a stateful stream over all that is available; its whole result. The state and what the batches wrote are removed."""
    spark = rows.sparkSession
    out, state = shared_path(spark, name), shared_path(spark, f"{name}-state")
    query = (
        rows.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
        .outputMode("complete").option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    result = cut(read_journal(spark, out, rows.schema))
    remove(spark, state)
    remove(spark, out)
    return result
