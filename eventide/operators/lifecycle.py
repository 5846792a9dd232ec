"""Deduplication, deletion, replacement, fragmentation and recovery as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventide.functions import scalar
from eventide.operators.retrieve import newest_first
from eventide.schema import is_parameterized_replaceable, is_replaceable


def new_events(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming events, each id once, that aren't there yet."""
    return incoming.dropDuplicates(["id"]).join(existing.select("id"), "id", "left_anti")


def delete(events: DataFrame, ids: DataFrame) -> DataFrame:
    """Events without those whose id is in the column id of ``ids``; unknown ids are passed over."""
    return events.join(ids.select("id"), "id", "left_anti")


def delete_by_author(events: DataFrame, authors: DataFrame) -> DataFrame:
    return events.join(authors.select("pubkey"), "pubkey", "left_anti")


def mark(events: DataFrame, flags: DataFrame) -> DataFrame:
    """Events with flags set by (id, deleted, replaced); flags that are set stay."""
    f = flags.groupBy("id").agg(F.max("deleted").alias("now_deleted"), F.max("replaced").alias("now_replaced"))
    out = events.join(f, "id", "left")
    out = out.withColumn("deleted", F.col("deleted") | F.coalesce("now_deleted", F.lit(False))).withColumn("replaced", F.col("replaced") | F.coalesce("now_replaced", F.lit(False)))
    return out.select(*events.columns)


def live(events: DataFrame) -> DataFrame:
    """Events that are neither deleted nor replaced."""
    return events.where(~F.col("deleted") & ~F.col("replaced"))


def _versions(events: DataFrame) -> DataFrame:
    """Replaceable events with their place ``newest`` among those of their author, kind and (where parameterised) d tag; the smaller id wins a tie."""
    d = F.when(is_parameterized_replaceable(F.col("kind")), scalar.replacement_d(F.col("tags"))).otherwise("")
    w = Window.partitionBy("pubkey", "kind", "replacement_d").orderBy(*newest_first())
    return events.where(is_replaceable(F.col("kind"))).withColumn("replacement_d", d).withColumn("newest", F.row_number().over(w))


def latest(events: DataFrame) -> DataFrame:
    """Replaceable events cut down to the newest per author, kind and (where parameterised) d tag; others stay.

    Only replaceable rows are shuffled.
    """
    return events.where(~is_replaceable(F.col("kind"))).unionByName(_versions(events).where("newest = 1").select(*events.columns))


def replaced_ids(events: DataFrame) -> DataFrame:
    """Ids that ``latest`` leaves out."""
    return _versions(events).where("newest > 1").select("id")


def replace(events: DataFrame, incoming: DataFrame) -> DataFrame:
    """The table after saving events, older versions of replaceable ones gone."""
    return latest(events.unionByName(new_events(incoming, events).select(*events.columns)))


def flag_counts(events: DataFrame, include_deleted: bool = False, include_replaced: bool = False) -> DataFrame:
    """One row n: records, with or without flagged ones."""
    out = events
    if not include_deleted:
        out = out.where(~F.col("deleted"))
    if not include_replaced:
        out = out.where(~F.col("replaced"))
    return out.agg(F.count("*").alias("n"))


def fragmentation(events: DataFrame, segment: str, size: str | None = None) -> DataFrame:
    """Per segment: total_size, live_records, deleted_records, fragmentation_ratio, estimated_reclaimable."""
    gone = (F.col("deleted") | F.col("replaced")).cast("long")
    bytes_ = F.col(size) if size else F.octet_length("content") + F.lit(148)
    out = events.groupBy(F.col(segment).alias("segment")).agg(F.sum(bytes_).cast("long").alias("total_size"), F.sum(1 - gone).alias("live_records"), F.sum(gone).alias("deleted_records"), F.count("*").alias("n"))
    ratio = F.col("deleted_records") / F.col("n")
    return out.select("segment", "total_size", "live_records", "deleted_records", ratio.alias("fragmentation_ratio"), F.floor(F.col("total_size") * ratio).cast("long").alias("estimated_reclaimable"))


def compaction_candidates(stats: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Segments worth rewriting, the worst first."""
    return stats.where(F.col("fragmentation_ratio") >= threshold).orderBy(F.col("fragmentation_ratio").desc(), "segment")


def total_waste(stats: DataFrame, threshold: float = 0.2, recommend_ratio: float = 0.1, least: int = 3) -> DataFrame:
    """One row: total_size, total_waste, waste_ratio, compactable, recommended."""
    out = stats.agg(
        F.coalesce(F.sum("total_size"), F.lit(0)).cast("long").alias("total_size"), F.coalesce(F.sum("estimated_reclaimable"), F.lit(0)).cast("long").alias("total_waste"),
        F.count_if(F.col("fragmentation_ratio") >= threshold).alias("compactable"),
    )
    ratio = F.when(F.col("total_size") > 0, F.col("total_waste") / F.col("total_size")).otherwise(F.lit(0.0))
    return out.withColumn("waste_ratio", ratio).withColumn("recommended", (F.col("waste_ratio") >= recommend_ratio) & (F.col("compactable") >= least))


def last_locations(log: DataFrame, key: str = "id", location: str = "location", lsn: str = "lsn") -> DataFrame:
    """For each key the location that the last log entry names."""
    return log.groupBy(key).agg(F.max_by(location, lsn).alias(location), F.max(lsn).alias(lsn))


def resolve_inserts(log: DataFrame, events: DataFrame) -> DataFrame:
    """Inserts of the log with what is stored of them: lsn, id, and whether the event is there."""
    stored = events.select(F.col("id").alias("stored_id"))
    return log.join(stored, log["id"] == F.col("stored_id"), "left").select("lsn", "id", F.col("stored_id").isNotNull().alias("stored"))
