"""Streaming forms run to the end of the table, to be compared with the batch results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.registry import query, table
from gaugeline.sources.files import shared_folder
from gaugeline.streaming import flows, halves


def _folder(spark) -> str:
    return shared_folder(spark, "streams")


def _stream(spark, sf_dir, name: str) -> DataFrame:
    """The table as a stream over its files; a table of one file is read through a pattern that matches it."""
    path = f"{sf_dir}/{name}.parquet"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    single = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/{name}.parque[t]" if single else path)


def _drained(spark, stream: DataFrame, keys: list[str]) -> DataFrame:
    """Run a stream over what there is; the newest row of each key."""
    out, provider = _folder(spark), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        flows.write_changes(stream, out, _folder(spark)).awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return flows.read_changes(spark, out, keys)


@query("L1_stream_screen", "SELECT event_id, CASE WHEN value > 90 THEN 'SKIP' ELSE 'OK' END AS status FROM events")
def l1(spark, sf_dir):
    out = _folder(spark)
    flows.stream_screen(_stream(spark, sf_dir, "events"), "event_id", "ts", "400 days", lambda b: b.select("event_id", F.when(F.col("value") > 90, "SKIP").otherwise("OK").alias("status")), out, _folder(spark)).awaitTermination()
    return spark.read.parquet(out).select("event_id", "status")


@query("L2_stream_task_board", "SELECT user_id, n AS n_submissions, event_id FROM (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def l2(spark, sf_dir):
    stream = flows.stream_task_board(_stream(spark, sf_dir, "events").select("user_id", "ts", "event_id"), ["user_id"], "ts")
    return _drained(spark, stream, ["user_id"]).select("user_id", "n_submissions", "event_id")


@query("L3_stream_histogram", "SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def l3(spark, sf_dir):
    stream = flows.stream_histogram(_stream(spark, sf_dir, "events"), "ts", "1 day", "1 day", ["event_type"])
    return _drained(spark, stream, ["start", "event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("L4_stream_status", "SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, CASE WHEN value > 90 THEN 'SKIP' ELSE 'OK' END AS status, CASE WHEN value > 90 THEN event_type ELSE '' END AS reason, count(*) AS n FROM events GROUP BY 1, 2, 3")
def l4(spark, sf_dir):
    status = F.when(F.col("value") > 90, "SKIP").otherwise("OK")
    rows = _stream(spark, sf_dir, "events").select("ts", status.alias("status"), F.when(F.col("value") > 90, F.col("event_type")).alias("why"))
    return _drained(spark, flows.stream_status(rows, "ts", "1 day", "1 day", "status", "why"), ["start", "status", "reason"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "L5_stream_moments",
    """WITH p AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS q FROM events)
       SELECT user_id, count(*) AS n, sum(value) AS sum_x, sum(value * value) AS sum_xx, coalesce(sum(value * q), 0) AS sum_lag FROM p GROUP BY 1""",
    "sum_x sum_xx sum_lag",
)
def l5(spark, sf_dir):
    return _drained(spark, halves.stream_ordered_moments(_stream(spark, sf_dir, "events"), "user_id", "event_id", "value"), ["user_id"])


@query(
    "L3_stream_halves",
    """WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= count(*) OVER (PARTITION BY user_id) // 2 AS first FROM events)
       SELECT user_id, event_type, count(*) AS n, count(*) FILTER (first) AS n_first, count(*) FILTER (NOT first) AS n_second FROM r GROUP BY 1, 2""",
)
def l3b(spark, sf_dir):
    return _drained(spark, halves.stream_halves(_stream(spark, sf_dir, "events"), "user_id", "event_id", "event_type"), ["user_id", "event_type"]).drop("n_chain")
