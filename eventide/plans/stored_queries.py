"""Queries that write a table, a sharded table or a log first and read what is asked from there."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.config import Config, IndexConfig
from eventide.functions import scalar
from eventide.operators import lifecycle, retrieve, shard
from eventide.plans.filter import EventFilter
from eventide.plans.queries import _COLUMNS, _HASHED, _KINDS, RING, SINCE, UNTIL, WIDER, _owner, _ring_sql, _tag, register
from eventide.schema import EVENT_SCHEMA, INDEXED_TAGS
from eventide.sources import changelog, json_events, records
from eventide.sources.adapters import activity_events
from eventide.sources.store import EventTable


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see: below ``spark.checkpoint.dir``, or a temporary one under a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="eventide-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def once(f: Callable) -> Callable:
    """Written once in an application for each data folder."""
    made: dict = {}

    @functools.wraps(f)
    def get(spark: SparkSession, sf_dir: str):
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in made:
            made[key] = f(spark, sf_dir)
        return made[key]

    return get


def _wide(c: str) -> Column:
    """A number as 32 bytes, as ids and authors have them on the wire."""
    return F.unhex(F.lpad(F.hex(F.col(c)), 64, "0"))


def _number(c: str) -> Column:
    return F.conv(F.right(F.hex(c), F.lit(16)), 16, 10).cast("long").alias(c)


def _wire(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """Events with ids and authors of 32 bytes; the condition is on ids as numbers, before they become bytes."""
    ev = activity_events(spark, sf_dir).where(where)
    return ev.withColumns({"id": _wide("id"), "pubkey": _wide("pubkey"), "sig": F.lit(b"")}).select(*[F.col(f.name).cast(f.dataType) for f in EVENT_SCHEMA])


def _unflagged(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    return _wire(spark, sf_dir, where).withColumns({"deleted": F.lit(False), "replaced": F.lit(False)})


def _back(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[_number(c) if c in ("id", "pubkey") else F.col(c) for c in columns])


@once
def _table(spark: SparkSession, sf_dir: str) -> EventTable:
    """All events, in two appends that overlap; then those whose id is divisible by 10 are deleted."""
    t, ev = EventTable(spark, _folder(spark, "table")), functools.partial(_wire, spark, sf_dir)
    t.append(ev("id % 3 <> 0"))
    t.append(ev("id % 3 = 0 OR id % 2 = 0"))
    t.delete_many(ev("id % 10 = 0").select("id"))
    return t


_SEEN = "NOT deleted AND id % 10 <> 0"


def _top(where: str, limit: int) -> str:
    return f"SELECT {', '.join(_COLUMNS)} FROM ev WHERE {_SEEN} AND {where} ORDER BY created_at DESC, id LIMIT {limit}"


@register("q_store_append", "SELECT id, pubkey, created_at, kind, content FROM ev")
def q_store_append(spark, sf_dir):
    """What two appends that overlap have stored, deleted or not."""
    return _back(_table(spark, sf_dir).raw, *_COLUMNS)


@register("q_store_visible", f"SELECT id, kind FROM ev WHERE {_SEEN}")
def q_store_visible(spark, sf_dir):
    return _back(_table(spark, sf_dir).visible, "id", "kind")


@register("q_store_author", _top(f"pubkey IN (8, 46) AND kind IN ({_KINDS})", 50))
def q_store_author(spark, sf_dir):
    authors = tuple(format(a, "064X") for a in (8, 46))
    return _back(_table(spark, sf_dir).query(EventFilter(authors=authors, limit=50)), *_COLUMNS)


@register("q_store_tag", _top(f"kind IN ({_KINDS}) AND {_tag('t', 'view')} AND {_tag('p', '3', '7')} AND created_at BETWEEN {SINCE} AND {UNTIL}", 80))
def q_store_tag(spark, sf_dir):
    """Through the tag table."""
    return _back(_table(spark, sf_dir).query(EventFilter(tags={"t": ("view",), "p": ("3", "7")}, since=SINCE, until=UNTIL, limit=80)), *_COLUMNS)


@register("q_store_count", f"SELECT count(*) AS n FROM ev WHERE {_SEEN} AND kind IN (1, 7) AND created_at BETWEEN {SINCE} AND {UNTIL}")
def q_store_count(spark, sf_dir):
    return spark.createDataFrame([(_table(spark, sf_dir).count(EventFilter(kinds=(1, 7), since=SINCE, until=UNTIL, limit=3)),)], "n long")


@register("q_store_get", f"SELECT {', '.join(_COLUMNS)} FROM ev WHERE {_SEEN} AND id IN (120, 121, 122, 9999999)")
def q_store_get(spark, sf_dir):
    return _back(_table(spark, sf_dir).get_many([format(i, "064x") for i in (120, 121, 122, 9999999)]), *_COLUMNS)


@register("q_store_flags", "SELECT count(*) AS total, count(*) FILTER (deleted OR id % 10 = 0) AS deleted, count(*) FILTER (replaced) AS replaced FROM ev")
def q_store_flags(spark, sf_dir):
    e = _table(spark, sf_dir).events
    return e.agg(F.count("*").alias("total"), F.count_if("deleted").alias("deleted"), F.count_if("replaced").alias("replaced"))


_INDEXED = ", ".join(f"'{t}'" for t in INDEXED_TAGS)


@register("q_store_tags", f"SELECT id, t[1] AS name, t[2] AS value, created_at FROM (SELECT id, created_at, unnest(tags) AS t FROM ev) WHERE len(t) >= 2 AND t[1] IN ({_INDEXED})")
def q_store_tags(spark, sf_dir):
    return _back(_table(spark, sf_dir).tags, "id", "name", "value", "created_at")


@once
def _compacted(spark: SparkSession, sf_dir: str) -> EventTable:
    """Half of a week is deleted, and the table compacted: that week alone is written anew; then some of what is gone comes back."""
    t = EventTable(spark, _folder(spark, "compacted"), Config(index=IndexConfig(granularity="weekly")))
    ev, period = functools.partial(_unflagged, spark, sf_dir), scalar.period(F.col("created_at"), "weekly")
    t.append(ev())
    t.delete_many(ev("id % 2 = 0").where(period == "2024-W02").select("id"))
    t.delete_many(ev("id % 20 = 1").where(period != "2024-W02").unionByName(ev("id = 0")).select("id"))
    t.compact("lazy")
    t.append(ev("id % 40 = 0"))
    return t


_WEEK = "strftime(to_timestamp(created_at) AT TIME ZONE 'UTC', '%G-W%V') = '2024-W02'"


@register("q_store_compacted", f"SELECT id, NOT (({_WEEK} AND id % 2 = 1) OR ({_WEEK} AND id % 40 = 0) OR (NOT {_WEEK} AND id % 20 <> 1 AND id <> 0)) AS deleted FROM ev WHERE NOT {_WEEK} OR id % 2 = 1 OR id % 40 = 0")
def q_store_compacted(spark, sf_dir):
    return _back(_compacted(spark, sf_dir).events, "id", "deleted")


@register("q_store_compacted_tags", f"SELECT id, t[1] AS name, t[2] AS value FROM (SELECT id, created_at, unnest(tags) AS t FROM ev) WHERE len(t) >= 2 AND t[1] IN ({_INDEXED}) AND (NOT {_WEEK} OR id % 2 = 1 OR id % 40 = 0)")
def q_store_compacted_tags(spark, sf_dir):
    return _back(_compacted(spark, sf_dir).tags, "id", "name", "value")


@register("q_store_replace", "SELECT id, kind FROM ev WHERE NOT (kind IN (0, 3) OR kind BETWEEN 10000 AND 19999 OR kind BETWEEN 30000 AND 39999) UNION ALL SELECT id, kind FROM (SELECT *, row_number() OVER (PARTITION BY pubkey, kind, CASE WHEN kind BETWEEN 30000 AND 39999 THEN coalesce(list_filter(tags, lambda t: t[1] = 'd')[1][2], '') ELSE '' END ORDER BY created_at DESC, id) AS k FROM ev WHERE kind IN (0, 3) OR kind BETWEEN 10000 AND 19999 OR kind BETWEEN 30000 AND 39999) WHERE k = 1")
def q_store_replace(spark, sf_dir):
    """Live events after saving them in two batches, the later one with older versions of what is there."""
    t = EventTable(spark, _folder(spark, "replaced"))
    t.replace(_unflagged(spark, sf_dir, "id % 2 = 0"))
    t.replace(_unflagged(spark, sf_dir, "id % 2 = 1"))
    return _back(lifecycle.live(t.events), "id", "kind")


@once
def _sharded(spark: SparkSession, sf_dir: str) -> shard.ShardedTable:
    """All events by shard, added twice over; an author is deleted, then a shard joins in and takes what becomes its own."""
    t, ev = shard.ShardedTable(spark, _folder(spark, "sharded"), RING), activity_events(spark, sf_dir)
    t.append(ev.where(F.col("id") % 3 != 0))
    t.append(ev)
    t.delete_by_author(8)
    t.delete(ev.where("id % 100 = 7").select("id"))
    t.rebalance(WIDER)
    return t


_GONE = "pubkey <> 8 AND id % 100 <> 7"


@register("q_sharded_rebalanced", f", {_ring_sql(WIDER)}, a AS (SELECT DISTINCT pubkey, {_HASHED.format('pubkey')} AS h FROM ev), o AS (SELECT a.pubkey, {_owner('h')} AS shard FROM a) SELECT id, shard FROM ev JOIN o USING (pubkey) WHERE {_GONE}")
def q_sharded_rebalanced(spark, sf_dir):
    return _sharded(spark, sf_dir).events.select("id", "shard")


@register("q_sharded_get", f"SELECT id, pubkey, created_at, kind FROM ev WHERE {_GONE} AND NOT deleted AND id = 124")
def q_sharded_get(spark, sf_dir):
    found = _sharded(spark, sf_dir).get(124)
    return spark.createDataFrame([(found["id"], found["pubkey"], found["created_at"], found["kind"])] if found else [], "id long, pubkey long, created_at long, kind int")


@register("q_sharded_query", f"SELECT {', '.join(_COLUMNS)} FROM ev WHERE {_GONE} AND NOT deleted AND kind IN (1, 6) ORDER BY created_at DESC, id LIMIT 60")
def q_sharded_query(spark, sf_dir):
    """One scan, the newest of each shard first."""
    return shard.gather(_sharded(spark, sf_dir).events, EventFilter(kinds=(1, 6), limit=60)).select(*_COLUMNS)


@register("q_shard_union_all", "SELECT id, kind FROM ev UNION ALL SELECT id, kind FROM ev WHERE kind = 0")
def q_shard_union_all(spark, sf_dir):
    ev = activity_events(spark, sf_dir)
    return shard.union_all([ev.where("kind <> 0"), ev.where("kind = 0"), ev.where("kind = 0")]).select("id", "kind")


@once
def _log(spark: SparkSession, sf_dir: str) -> str:
    """A log of inserts and, in a second append, of deletions of each seventh event."""
    path, ev = _folder(spark, "log"), activity_events(spark, sf_dir)
    changelog.append(spark, path, ev.select(F.lit(1).alias("op"), F.col("created_at").alias("timestamp"), _wide("id").alias("data")))
    changelog.append(spark, path, ev.where("id % 7 = 0").select(F.lit(2).alias("op"), F.col("created_at").alias("timestamp"), F.concat(_wide("id"), F.lit(b"\x01")).alias("data")))
    return path


_ENTRIES = ", l AS (SELECT 1 AS op, id, row_number() OVER (ORDER BY created_at, id) AS lsn FROM ev UNION ALL SELECT 2, id, (SELECT count(*) FROM ev) + row_number() OVER (ORDER BY created_at, id) FROM ev WHERE id % 7 = 0) "


@register("q_log_read", _ENTRIES + "SELECT op, lsn, id FROM l WHERE lsn >= 500")
def q_log_read(spark, sf_dir):
    log = changelog.read(spark, _log(spark, sf_dir), 500)
    return log.select("op", "lsn", F.conv(F.hex(F.substring("data", 25, 8)), 16, 10).cast("long").alias("id"))


@register("q_log_replay", _ENTRIES + "SELECT id, bool_or(op = 1) AS inserted, max(CASE WHEN op = 2 THEN 1 ELSE 0 END)::INTEGER AS flags FROM l WHERE lsn > 300 GROUP BY id")
def q_log_replay(spark, sf_dir):
    """The state that the entries behind a number lead to."""
    return _back(changelog.replay(changelog.read(spark, _log(spark, sf_dir)), after=300), "id", "inserted", "flags")


@register("q_log_validate", _ENTRIES + "SELECT count(*) AS entries, 0::BIGINT AS corrupt, 0::BIGINT AS unknown, 0::BIGINT AS missing, 0::BIGINT AS repeated FROM l")
def q_log_validate(spark, sf_dir):
    return changelog.validate(changelog.read(spark, _log(spark, sf_dir)))


_KEPT = "SELECT id, pubkey, created_at, kind, content, len(tags) AS n_tags FROM ev"


@register("q_json_round_trip", _KEPT)
def q_json_round_trip(spark, sf_dir):
    """Written as JSON lines of the wire format and read again."""
    path = _folder(spark, "json")
    json_events.write_json(_wire(spark, sf_dir), path)
    return _back(json_events.read_json(spark, path, lines=True).withColumn("n_tags", F.size("tags").cast("long")), *_COLUMNS, "n_tags")


@register("q_records_round_trip", _KEPT)
def q_records_round_trip(spark, sf_dir):
    """Packed into checksummed records and unpacked again."""
    return _back(records.from_records(records.to_records(_wire(spark, sf_dir))).withColumn("n_tags", F.size("tags").cast("long")), *_COLUMNS, "n_tags")


@register("q_keys", "SELECT id, sha256(concat_ws('|', pubkey, created_at, kind, content)) AS event_id, printf('%016x%04x%08x', pubkey, kind, created_at) AS key, created_at AS key_time, substring(content, 1, 7) AS cut FROM ev")
def q_keys(spark, sf_dir):
    """Content-derived ids, index keys and the time in them, values cut to a number of bytes."""
    ev = activity_events(spark, sf_dir)
    key = scalar.index_key(F.unhex(F.lpad(F.hex("pubkey"), 16, "0")), F.col("kind"), F.col("created_at"))
    own = scalar.event_id(F.col("pubkey"), F.col("created_at"), F.col("kind"), F.col("content"))
    return ev.select("id", F.lower(F.hex(own)).alias("event_id"), F.lower(F.hex(key)).alias("key"), scalar.key_timestamp(key).alias("key_time"), scalar.cut_bytes(F.col("content"), 7).cast("string").alias("cut"))


@register("q_result_stream", f"SELECT {', '.join(_COLUMNS)} FROM ev WHERE NOT deleted AND kind = 1 AND pubkey < 20")
def q_result_stream(spark, sf_dir):
    """Row by row from an iterator."""
    ev = activity_events(spark, sf_dir)
    rows = [tuple(r[c] for c in _COLUMNS) for r in retrieve.iterate(ev, EventFilter(kinds=(1,), authors=tuple(range(20)), limit=None))]
    return spark.createDataFrame(rows, ev.select(*_COLUMNS).schema)
