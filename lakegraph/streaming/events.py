"""Event streams: idempotent append, micro-batch consumer, windowed counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def once_a_day(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Keeps one event for each entity, type, payload and day; events later than the watermark don't count."""
    keyed = stream.withColumn("dedup_key", F.concat_ws(":", "entity_id", "event_type", F.md5("payload"), F.date_format("occurred_at", "yyyy-MM-dd")))
    return keyed.withWatermark("occurred_at", late).dropDuplicatesWithinWatermark(["dedup_key"])


def windowed_counts(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return stream.withWatermark("occurred_at", late).groupBy(F.window("occurred_at", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def consume(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands unprocessed events to ``handle`` in micro-batches and stops when all that is there has been handled."""
    return stream.where("not processed").writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retry_state(events: DataFrame, most: int = 3) -> DataFrame:
    """Status after an attempt: processed, pending, or failed from ``most`` errors on."""
    errors = F.col("error_count") + F.col("failed").cast("int")
    status = F.when(~F.col("failed"), "processed").when(errors >= most, "failed").otherwise("pending")
    return events.withColumns({"error_count": errors, "status": status})


def subscribed(stream: DataFrame, kinds: list[str] | None = None, entities: list[str] | None = None) -> DataFrame:
    """Events of some types and of some entities; None asks for all."""
    out = stream if kinds is None else stream.where(F.col("event_type").isin(kinds))
    return out if entities is None else out.where(F.col("entity_id").isin(entities))


def consumed(stream: DataFrame, error: Column, name: str) -> DataFrame:
    """Unprocessed events, handled in micro-batches and marked: ``error`` is null where an event could be handled.

    One event that fails doesn't hold up the others. A batch that is handed on again overwrites its own folder, so that
    no event counts twice.
    """
    from lakegraph.sources.sinks import new_path

    path = new_path(stream.sparkSession, name)

    def handle(batch: DataFrame, number: int) -> None:  # number -1: no rows, so that a stream without events leaves an empty table
        marked = batch.orderBy(F.desc("occurred_at")).withColumn("error", error).withColumn("processed", F.col("error").isNull())
        marked.write.mode("overwrite").parquet(f"{path}/batches/batch={number}")

    handle(stream.sparkSession.createDataFrame([], stream.schema), -1)
    consume(stream, handle, f"{path}/state").awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/batches").drop("batch")
