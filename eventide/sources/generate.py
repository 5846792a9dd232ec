"""Synthetic events for load tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.functions.scalar import event_id
from eventide.schema import TAGS


def cycle_events(spark: SparkSession, n: int, start: int = 1_700_000_000, authors: int | None = None) -> DataFrame:
    """``n`` events of kinds 0..5 in turn, a minute apart; kind 3 names a person, kind 5 an event and a person."""
    i = F.col("i")
    hexed = lambda c: F.sha2(c.cast("string"), 256)
    author = F.unhex(hexed(F.concat(F.lit("author"), i if authors is None else i % authors)))
    person = F.array(F.lit("p"), hexed(F.concat(F.lit("p"), i)))
    event = F.array(F.lit("e"), hexed(F.concat(F.lit("e"), i)), F.lit("wss://relay.example"))
    tags = F.when(i % 6 == 3, F.array(person)).when(i % 6 == 5, F.array(event, F.concat(person, F.array(F.lit("wss://relay.example"))))).otherwise(F.array().cast(TAGS))
    rows = spark.range(n).select(F.col("id").alias("i")).select(
        author.alias("pubkey"), (F.lit(start) + 60 * i).alias("created_at"), (i % 6).cast("int").alias("kind"), tags.alias("tags"), F.concat(F.lit("event "), i).alias("content"), "i",
    )
    return _finish(rows)


def expand_seeds(seeds: DataFrame, copies: int) -> DataFrame:
    """Each seed ``copies`` times, every copy a second earlier and with an id of its own."""
    rows = seeds.select("pubkey", "created_at", "kind", "tags", "content", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("i"))
    return _finish(rows.withColumn("created_at", F.col("created_at") - F.col("i")))


def _finish(rows: DataFrame) -> DataFrame:
    new = event_id(F.hex("pubkey"), F.col("created_at"), F.col("kind"), F.col("content"), F.col("i"))
    return rows.select(new.alias("id"), "pubkey", "created_at", "kind", "tags", "content", F.lit(b"").alias("sig"), F.lit(False).alias("deleted"), F.lit(False).alias("replaced"))
