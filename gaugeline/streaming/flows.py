"""Incremental forms of the batch operators as streaming queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_screen(items: DataFrame, key: str, ts: str, delay: str, run: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Screen each batch of new items and append its outcomes; items seen within the delay are not screened again.

    A batch that is retried overwrites its own folder, so outcomes are written once.
    """
    fresh = items.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])

    def write(batch: DataFrame, number: int) -> None:
        run(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_task_board(submissions: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Newest submission of each task and their number; in update mode a batch tells the tasks that changed."""
    rest = [c for c in submissions.columns if c not in keys]
    return submissions.groupBy(*keys).agg(F.count("*").alias("n_submissions"), F.max(F.struct(ts, *(c for c in rest if c != ts))).alias("latest")).select(*keys, "n_submissions", "latest.*")


def stream_histogram(samples: DataFrame, ts: str, delay: str, width: str, keys: Sequence[str]) -> DataFrame:
    """Counts of keys in tumbling windows; rows later than the delay are dropped."""
    counts = samples.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), *keys, "n")


def stream_status(outcomes: DataFrame, ts: str, delay: str, width: str, status: str, reason: str) -> DataFrame:
    """Running counts of status and reason in tumbling windows."""
    return stream_histogram(outcomes.withColumn("reason", F.coalesce(F.col(reason), F.lit(""))), ts, delay, width, [status, "reason"])


def write_changes(stream: DataFrame, out: str, checkpoint: str):
    """Write what each batch of an update-mode stream tells into a folder of its own; a retried batch overwrites its folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_changes(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """The newest row of each key that :func:`write_changes` wrote, whichever batches told it."""
    rows = spark.read.option("basePath", out).parquet(out)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last_"))
    return last.select(*keys, *(F.col(f"last_.{c}").alias(c) for c in rest))
