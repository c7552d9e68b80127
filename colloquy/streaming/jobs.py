"""Structured Streaming jobs over a folder of Parquet files, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import streams as ST
from colloquy.sources.versions import Versions


def source(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the files at a path, with the schema they have."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_to_end(stream: DataFrame, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream until its source is used up, into a table in the session's warehouse."""
    name = f"stream_{uuid.uuid4().hex[:12]}"
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).toTable(name).awaitTermination()
    return stream.sparkSession.table(name)


def mixed_windows(events: DataFrame, lateness: str = "500 milliseconds") -> DataFrame:
    """ST1, ST3, J11: both devices' samples in tumbling windows, rows behind the watermark dropped."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    return ST.two_streams(rows, F.when(F.col("user_id") % 2 == 0, "mic").otherwise("system"), F.col("at"), F.col("value"))


def deduplicated(rows: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """ST8: the first of each sequence number of a session stays."""
    return rows.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["session_id", "sequence_id"])


def last_write_wins(stream: DataFrame, store: Versions, name: str, keys: list[str], order: str, checkpoint: str, buckets: int = 64) -> None:
    """ST9, ST11, ST12, K14: each micro-batch is merged into a versioned table, the last row of a key wins.

    The old buckets stay until the new version is published, and a batch that has been published is left out when Spark
    repeats it, so a failure at any point loses and doubles nothing. A stream is known by its checkpoint folder.
    """

    def merge(batch: DataFrame, number: int) -> None:
        Versions(batch.sparkSession, store.root).merge(name, batch, keys, order, checkpoint, number, buckets)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
