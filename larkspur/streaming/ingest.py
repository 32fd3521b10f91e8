"""Incremental ingestion: session traces and acknowledgement events as streams; nothing is dropped as late."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspur.operators.findings import fold_ack_events


def trace_stream(spark: SparkSession, folder: str, pattern: str = "*.jsonl") -> DataFrame:
    """path, text of trace files as they arrive; the checkpoint remembers which were read."""
    source = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return source.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def ingest_traces(files: DataFrame, adapter: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's invocations; a file's own lines stay in one batch, so its carried values are whole."""

    def write(batch: DataFrame, epoch: int) -> None:
        adapter(batch).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fold_acks(events: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Keeps each fingerprint's event of highest server_sequence. Order of arrival and repeats do not matter, so a
    batch that runs again after a failure changes nothing. Each batch writes a new version of the store."""

    def write(batch: DataFrame, epoch: int) -> None:
        fresh = batch.select("fingerprint", "action", "server_sequence")
        if epoch > 0:
            fresh = fresh.unionByName(batch.sparkSession.read.parquet(f"{store}/v={epoch - 1}"))
        fold_ack_events(fresh).write.mode("overwrite").parquet(f"{store}/v={epoch}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def deduplicated(events: DataFrame) -> DataFrame:
    """At-least-once events, each client_event_id once."""
    return events.dropDuplicates(["client_event_id"])
