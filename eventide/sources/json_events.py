"""Events as JSON: files of an array or of one object, with hex strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.functions.scalar import from_hex, to_hex
from eventide.schema import TAGS

WIRE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("pubkey", T.StringType()),
        T.StructField("created_at", T.LongType()),
        T.StructField("kind", T.IntegerType()),
        T.StructField("tags", TAGS),
        T.StructField("content", T.StringType()),
        T.StructField("sig", T.StringType()),
    ]
)


def from_wire(rows: DataFrame) -> DataFrame:
    """Wire rows as events; rows without a well-formed id, author, time and kind are left out."""
    out = rows.select(
        from_hex(F.col("id")).alias("id"), from_hex(F.col("pubkey")).alias("pubkey"), "created_at", "kind", F.coalesce(F.filter("tags", lambda t: F.size(t) > 0), F.array().cast(TAGS)).alias("tags"),
        F.coalesce("content", F.lit("")).alias("content"), F.coalesce(from_hex(F.col("sig"), 128), F.lit(b"")).alias("sig"), F.lit(False).alias("deleted"), F.lit(False).alias("replaced"),
    )
    return out.where(F.col("id").isNotNull() & F.col("pubkey").isNotNull() & F.col("created_at").between(0, 2**32 - 1) & F.col("kind").between(0, 65535))


def to_wire(events: DataFrame) -> DataFrame:
    return events.select(to_hex(F.col("id")).alias("id"), to_hex(F.col("pubkey")).alias("pubkey"), "created_at", "kind", "tags", "content", to_hex(F.col("sig")).alias("sig"))


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Events of JSON files: each an array, one object, or with ``lines`` an object a line."""
    return from_wire(spark.read.schema(WIRE_SCHEMA).json(path, multiLine=not lines, mode="DROPMALFORMED"))


def write_json(events: DataFrame, path: str, mode: str = "errorifexists") -> None:
    to_wire(events).write.mode(mode).json(path)
