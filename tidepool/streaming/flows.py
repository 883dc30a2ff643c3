"""Streams over the operation log: blob counts, upload sessions, and the periodic sweep."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def log_stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Everything that the stream gives until its input ends, as a table in memory: for tests and small closed inputs."""
    name = f"drained_{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def put_counts(events: DataFrame) -> DataFrame:
    """(hash, puts): running count of puts by blob."""
    puts = events.where(~F.col("event_type").isin("error", "view"))
    return puts.groupBy(F.sha2((F.col("event_id") % 997).cast("string"), 256).alias("hash")).agg(F.count("*").alias("puts"))


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "10 minutes") -> DataFrame:
    """(user_id, started, ended, n): activity parted by gaps; a session is told once the watermark has passed its end."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    s = timed.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n")


def ingest(stream: DataFrame, commit: Callable[[DataFrame, int], None], checkpoint: str, every: str = "5 seconds"):
    """Starts a query that commits each micro-batch once; commit(batch, number) must be idempotent by number."""
    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def idle_uploads(events: DataFrame, expiry: str = "24 hours", late: str = "10 minutes") -> DataFrame:
    """(upload_id, started, last_seen, n): uploads whose activity ended for `expiry`; a user's events stand for an upload's parts."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    s = timed.groupBy(F.session_window("ts", expiry).alias("s"), (F.col("user_id") % 20).alias("upload_id")).agg(F.count("*").alias("n"), F.max("ts").alias("last_seen"))
    return s.select("upload_id", F.col("s.start").alias("started"), "last_seen", "n")


def sweep_every(spark: SparkSession, tick: Callable[[int], None], checkpoint: str, seconds: int = 60):
    """Starts a query that calls tick(number) at most every max(seconds, 5); a failing tick is logged and the loop goes on."""

    def safe(_: DataFrame, number: int) -> None:
        try:
            tick(number)
        except Exception as e:
            print(f"sweep {number} failed: {e}")

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(safe).option("checkpointLocation", checkpoint).trigger(processingTime=f"{max(seconds, 5)} seconds").start()
