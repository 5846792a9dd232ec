"""Adapters from other tables to the event model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.schema import TAGS

#: Kinds of the event types of the activity table.
KINDS = {"signup": 0, "view": 1, "click": 6, "error": 7, "purchase": 30023}
COLUMNS = ["id", "pubkey", "created_at", "kind", "tags", "content", "deleted", "replaced"]


def _tag(*parts: Column) -> Column:
    return F.array(*[p.cast("string") for p in parts])


def activity_events(spark: SparkSession, sf_dir: str, texts: bool = False) -> DataFrame:
    """The activity table as events; with ``texts``, their content comes from the documents table."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.lit(None).cast("int")
    for name, k in KINDS.items():
        kind = F.when(F.col("event_type") == name, k).otherwise(kind)
    k = F.get_json_object("props", "$.k")
    topic = F.when(F.col("event_id") % 2 == 1, F.upper("event_type")).otherwise(F.col("event_type"))
    tags = F.array(_tag(F.lit("k"), k), _tag(F.lit("t"), topic), _tag(F.lit("e"), F.floor(F.col("event_id") / 10)), _tag(F.lit("p"), F.col("user_id") % 10))
    d = F.when(F.col("event_type") == "purchase", F.array(_tag(F.lit("d"), k.cast("int") % 10))).otherwise(F.array().cast(TAGS))
    out = raw.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("pubkey"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("created_at"), kind.alias("kind"),
        F.concat(tags, d).alias("tags"), F.concat_ws(" ", F.col("event_type"), k).alias("content"),
        (F.col("event_id") % 97 == 0).alias("deleted"), (F.col("event_id") % 89 == 0).alias("replaced"),
    )
    if texts:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("content_id"), F.col("text").alias("content"))
        n = docs.agg(F.max("content_id") + 1).first()[0]
        out = out.drop("content").join(docs, F.col("id") % n == F.col("content_id")).select(*COLUMNS)
    return out


#: The same in DuckDB's SQL, as a common table expression named ev.
SQL = """ev AS (SELECT event_id AS id, user_id AS pubkey, epoch(date_trunc('second', ts))::BIGINT AS created_at,
  CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 6 WHEN 'error' THEN 7 WHEN 'purchase' THEN 30023 END AS kind,
  list_concat([['k', json_extract_string(props, '$.k')], ['t', CASE WHEN event_id % 2 = 1 THEN upper(event_type) ELSE event_type END],
    ['e', CAST(event_id // 10 AS VARCHAR)], ['p', CAST(user_id % 10 AS VARCHAR)]],
    CASE WHEN event_type = 'purchase' THEN [['d', CAST(CAST(json_extract_string(props, '$.k') AS INT) % 10 AS VARCHAR)]] ELSE [] END) AS tags,
  event_type || ' ' || json_extract_string(props, '$.k') AS content, event_id % 97 = 0 AS deleted, event_id % 89 = 0 AS replaced FROM events)"""
