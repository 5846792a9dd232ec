"""Streaming ingest into an event table, and windows over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventide.schema import EVENT_SCHEMA
from eventide.sources.json_events import WIRE_SCHEMA, from_wire
from eventide.sources.store import EventTable


def read_stream(spark: SparkSession, path: str, wire: bool = True) -> DataFrame:
    """Events as they arrive in a folder: JSON lines, or Parquet files of events."""
    if wire:
        return from_wire(spark.readStream.schema(WIRE_SCHEMA).json(path))
    return spark.readStream.schema(EVENT_SCHEMA).parquet(path)


def ingest(stream: DataFrame, table: EventTable, checkpoint: str, replaceable: bool = False, every: str | None = None) -> StreamingQuery:
    """Append a stream to a table; a batch that is run again after a failure adds nothing twice.

    However late an event is, it goes to its own period: ids are compared with the table, not with a window.
    """

    def batch(events: DataFrame, _: int) -> None:
        (table.replace if replaceable else table.append)(events)

    out = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def with_time(stream: DataFrame) -> DataFrame:
    return stream.withColumn("at", F.timestamp_seconds("created_at"))


def once_within(stream: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """The stream with ids that repeat within the lateness left out, by bounded state."""
    return with_time(stream).withWatermark("at", lateness).dropDuplicatesWithinWatermark(["id"])


def counts_by_window(stream: DataFrame, length: str = "10 minutes", slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """Events of each kind in tumbling or sliding windows; also for tables."""
    at = with_time(stream)
    at = at.withWatermark("at", lateness) if stream.isStreaming else at
    w = F.window("at", length, slide) if slide else F.window("at", length)
    return at.groupBy(w.alias("w"), "kind").agg(F.count("*").alias("n")).select(F.unix_timestamp("w.start").alias("start"), F.unix_timestamp("w.end").alias("end"), "kind", "n")


def sessions(stream: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Each author's events in sessions that end after a gap; also for tables. An event that comes just when the gap is over begins a session."""
    at = with_time(stream)
    at = at.withWatermark("at", lateness) if stream.isStreaming else at
    # Spark joins a session and an event at its very end, so that its windows are a microsecond shorter than the gap
    w = F.session_window("at", f"{gap} -1 microseconds")
    end = F.timestamp_micros(F.unix_micros("w.end") + 1)
    return at.groupBy(w.alias("w"), "pubkey").agg(F.count("*").alias("n")).select(F.unix_timestamp("w.start").alias("start"), F.unix_timestamp(end).alias("end"), "pubkey", "n")
