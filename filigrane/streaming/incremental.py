"""Incremental ingestion and windowed counts on streams; the same functions serve batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from filigrane.operators.matrix import not_yet
from filigrane.sources.tables import exists

DONE_PARTS = 64


def ingest_new(spark: SparkSession, source: str, schema: str, done_path: str, checkpoint: str, key: str, work: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Work on rows whose key is not in the table at done_path, and append the results there. All available files are taken, then the query ends.

    The table is partitioned by a hash of the key, and a micro-batch reads the keys of its own partitions only. A repeated
    micro-batch finds its keys done and adds nothing, so a restart is safe. work keeps the key column."""

    def batch(rows: DataFrame, _: int) -> None:
        place = F.pmod(F.xxhash64(key), F.lit(DONE_PARTS)).cast("int")
        fresh = rows.dropDuplicates([key])
        if exists(spark, done_path):
            parts = [r.p for r in fresh.select(place.alias("p")).distinct().collect()]  # at most DONE_PARTS
            done = spark.read.parquet(done_path).where(F.col("done_part").isin(*parts) if parts else F.lit(False))
            fresh = not_yet(fresh, done, [key])
        work(fresh).withColumn("done_part", place).write.mode("append").partitionBy("done_part").parquet(done_path)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Events by window and type. On a stream, rows later than the watermark are left out."""
    d = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if d.isStreaming:
        d = d.withWatermark("ts", late)
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return d.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Events of each user by session."""
    d = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if d.isStreaming:
        d = d.withWatermark("ts", late)
    return d.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
