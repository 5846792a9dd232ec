"""The change log: append, read from a sequence number, replay, retention."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.functions.scalar import checksum
from eventide.schema import CHECKPOINT, INSERT, LOG_SCHEMA, OP_NAMES, UPDATE_FLAGS


def append(spark: SparkSession, path: str, entries: DataFrame) -> None:
    """Append (op, timestamp, data) with sequence numbers behind the last; numbers follow time and data."""
    try:
        last = read(spark, path).agg(F.max("lsn")).first()[0] or 0
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        last = 0
    # ranges of time are sorted each by itself; where a range's numbers begin follows from the sizes of those before it
    staged = f"{path.rstrip('/')}/_staged-{uuid.uuid4().hex}"
    ranges = entries.select("op", "timestamp", "data").repartitionByRange("timestamp", "data").sortWithinPartitions("timestamp", "data")
    ranges.withColumn("n", F.monotonically_increasing_id()).write.parquet(staged)
    rows = spark.read.parquet(staged).withColumn("part", F.shiftright("n", 33).cast("int"))
    sizes = sorted((r["part"], r["size"]) for r in rows.groupBy("part").agg(F.count("*").alias("size")).collect())
    begins, at = [], last
    for part, size in sizes:
        begins.append((part, at))
        at += size
    begin = F.broadcast(spark.createDataFrame(begins, "part int, begin long"))
    lsn = F.col("begin") + F.col("n").bitwiseAND((1 << 33) - 1) + 1
    rows.join(begin, "part").select("op", lsn.alias("lsn"), "timestamp", "data", checksum(F.col("data")).alias("checksum")).write.mode("append").parquet(path)
    _fs(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(staged), True)


def _fs(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def checkpoint(spark: SparkSession, path: str, timestamp: int) -> int:
    """Append a checkpoint, from which recovery starts; its number."""
    append(spark, path, spark.createDataFrame([(CHECKPOINT, timestamp, b"")], "op int, timestamp long, data binary"))
    return last_checkpoint(read(spark, path))


def checkpoint_due(log: DataFrame, now: int, seconds: int = 30, entries: int = 5000) -> bool:
    """Whether so much time has passed, or so many entries have come, since the last checkpoint."""
    since = log.where(F.col("lsn") > last_checkpoint(log)).agg(F.count("*").alias("n"), F.min("timestamp").alias("first")).first()
    return since["n"] >= entries or since["n"] > 0 and now - since["first"] >= seconds


def read(spark: SparkSession, path: str, from_lsn: int = 0) -> DataFrame:
    """Entries from a sequence number on, in order."""
    return spark.read.schema(LOG_SCHEMA).parquet(path).where(F.col("lsn") >= from_lsn).orderBy("lsn")


def corrupt(log: DataFrame) -> DataFrame:
    """Entries whose checksum doesn't fit."""
    return log.where(~F.col("checksum").eqNullSafe(checksum(F.col("data"))))


def validate(log: DataFrame) -> DataFrame:
    """One row: entries, corrupt ones, numbers that are missing or there twice, unknown operations."""
    known = F.col("op").isin(list(OP_NAMES))
    bad = ~F.col("checksum").eqNullSafe(checksum(F.col("data")))
    out = log.agg(F.count("*").alias("entries"), F.count_if(bad).alias("corrupt"), F.count_if(~known).alias("unknown"), F.countDistinct("lsn").alias("numbers"), F.min("lsn").alias("first"), F.max("lsn").alias("last"))
    gap = F.coalesce(F.col("last") - F.col("first") + 1 - F.col("numbers"), F.lit(0))
    return out.select("entries", "corrupt", "unknown", gap.alias("missing"), (F.col("entries") - F.col("numbers")).alias("repeated"))


def last_checkpoint(log: DataFrame) -> int:
    return log.where(F.col("op") == CHECKPOINT).agg(F.max("lsn")).first()[0] or 0


def replay(log: DataFrame, after: int | None = None) -> DataFrame:
    """The state that entries behind the last checkpoint lead to: per id, whether it is inserted and deleted.

    Data is the id, with one flag byte behind it for flag updates.
    """
    start = last_checkpoint(log) if after is None else after
    rows = log.where((F.col("lsn") > start) & F.col("op").isin(INSERT, UPDATE_FLAGS))
    rows = rows.select("op", "lsn", F.substring("data", 1, 32).alias("id"), F.substring("data", 33, 1).alias("flag"))
    flag = F.when(F.col("op") == UPDATE_FLAGS, F.conv(F.hex("flag"), 16, 10).cast("int"))
    return rows.groupBy("id").agg(F.max(F.col("op") == INSERT).alias("inserted"), F.coalesce(F.max_by(flag, F.when(flag.isNotNull(), F.col("lsn"))), F.lit(0)).alias("flags"))


def retained(log: DataFrame, before: int) -> DataFrame:
    """What is left of the log if all before a sequence number may go."""
    return log.where(F.col("lsn") >= before)


def retain(spark: SparkSession, path: str, before: int) -> int:
    """Remove files of the log that only have entries before a sequence number; how many."""
    files = spark.read.schema(LOG_SCHEMA).parquet(path).groupBy(F.input_file_name().alias("file")).agg(F.max("lsn").alias("last")).where(F.col("last") < before).collect()
    fs, n = _fs(spark, path), 0
    for r in files:
        n += fs.delete(spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(r["file"])), False)
    return n
