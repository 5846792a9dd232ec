"""Registered queries over the event model, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.functions import scalar
from eventide.operators import lifecycle, retrieve, shard, stats
from eventide.plans import filter as filters
from eventide.plans.filter import EventFilter
from eventide.schema import DEFAULT_KINDS, INDEXED_TAGS, is_parameterized_replaceable, is_replaceable, kind_class
from eventide.sources.adapters import SQL as EV
from eventide.sources.adapters import activity_events
from eventide.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: 2024-01-05 and 2024-01-20, UTC.
SINCE, UNTIL = 1704412800, 1705708800
RING = shard.Ring([f"shard-{i}" for i in range(4)])
WIDER = RING.with_shard("shard-4")
_COLUMNS = ["id", "pubkey", "created_at", "kind", "content"]
_KINDS = ", ".join(map(str, DEFAULT_KINDS))
_TAGS = ", ".join(f"'{t}'" for t in INDEXED_TAGS)


def register(name: str, sql: str, bare: bool = False):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        _SQL[name] = sql if bare else f"WITH {EV}{sql}" if sql.startswith(",") else f"WITH {EV} {sql}"
        return f

    return add


def _found(where: str, limit: int | None = 100) -> str:
    end = f" ORDER BY created_at DESC, id LIMIT {limit}" if limit else ""
    return f"SELECT {', '.join(_COLUMNS)} FROM ev WHERE NOT deleted AND {where}{end}"


def _tag(name: str, *values: str) -> str:
    own = "lower(t[2])" if name == "t" else "t[2]"
    listed = ", ".join(f"'{v.lower() if name == 't' else v}'" for v in values)
    return f"len(list_filter(tags, lambda t: len(t) >= 2 AND t[1] = '{name}' AND {own} IN ({listed}))) > 0"


def _filter_query(name: str, f: EventFilter, where: str, limit: int | None = 100, **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return retrieve.query(activity_events(spark, sf_dir), f, **options).select(*_COLUMNS)

    run.__name__ = name
    register(name, _found(where, limit))(run)


_T = f"created_at >= {SINCE} AND created_at <= {UNTIL}"
_filter_query("q_kind_time", EventFilter(kinds=(1, 6), since=SINCE, until=UNTIL), f"kind IN (1, 6) AND {_T}")
_filter_query("q_kind_time_all", EventFilter(kinds=(1, 6), since=SINCE, until=UNTIL, limit=None), f"kind IN (1, 6) AND {_T}", None)
_filter_query("q_kind_time_until_exclusive", EventFilter(kinds=(1,), until=UNTIL, limit=50), f"kind = 1 AND created_at < {UNTIL}", 50, until_inclusive=False)
_filter_query("q_author_time", EventFilter(authors=(8, 46, 7), kinds=(0, 1, 6, 7), since=SINCE, until=UNTIL), f"pubkey IN (8, 46, 7) AND kind IN (0, 1, 6, 7) AND {_T}")
_filter_query("q_author_default_kinds", EventFilter(authors=(8, 46)), f"pubkey IN (8, 46) AND kind IN ({_KINDS})")
_filter_query("q_author_kind_since_until", EventFilter(authors=(16,), kinds=(1,), since=SINCE, until=UNTIL, limit=25), f"pubkey = 16 AND kind = 1 AND {_T}", 25)
_filter_query("q_tag_single", EventFilter(tags={"k": ("69",)}), f"kind IN ({_KINDS}) AND {_tag('k', '69')}")
_filter_query("q_tag_or_values", EventFilter(tags={"k": ("69", "89", "26")}, limit=None), f"kind IN ({_KINDS}) AND {_tag('k', '69', '89', '26')}", None)
_filter_query("q_tag_and_names", EventFilter(tags={"t": ("view", "click"), "p": ("3", "7")}, limit=200), f"kind IN ({_KINDS}) AND {_tag('t', 'view', 'click')} AND {_tag('p', '3', '7')}", 200)
_filter_query("q_tag_or_names_compat", EventFilter(tags={"k": ("69",), "p": ("3",)}, limit=200), f"kind IN ({_KINDS}) AND ({_tag('k', '69')} OR {_tag('p', '3')})", 200, any_tag_name=True)
_filter_query("q_hashtag_ci", filters.hashtag("VieW", 80), f"kind IN ({_KINDS}) AND {_tag('t', 'view')}", 80)
_filter_query("q_unindexed_tag", EventFilter(tags={"zz": ("1",)}), f"kind IN ({_KINDS}) AND {_tag('zz', '1')}")
_filter_query("q_empty_tag_list", EventFilter(tags={"e": ()}, limit=30), f"kind IN ({_KINDS})", 30)
_filter_query("q_full_scan_time", filters.bounded_timeline(SINCE, UNTIL), _T)
_filter_query("q_default_limit", EventFilter(kinds=(0,)), "kind = 0")
_filter_query("q_limit_only", EventFilter(limit=10), "true", 10)
_filter_query("q_get_by_id", filters.event_by_id(123), "id = 123", 1)
_filter_query("q_replies", filters.replies("12"), f"kind IN ({_KINDS}) AND {_tag('e', '12')}")
_filter_query("q_mentions", filters.mentions("5", 60), f"kind IN ({_KINDS}) AND {_tag('p', '5')}", 60)
_filter_query("q_user_timeline", filters.user_timeline(7, 20), f"pubkey = 7 AND kind IN ({_KINDS})", 20)
_filter_query("q_kind_timeline", filters.kind_timeline(7, 40), "kind = 7", 40)
_filter_query("q_bounded_timeline", filters.bounded_timeline(SINCE, SINCE + 86400, 500), f"created_at BETWEEN {SINCE} AND {SINCE + 86400}", 500)
_SEARCH = "(contains(lower(content), '{0}') OR len(list_filter(tags, lambda t: len(list_filter(t[2:], lambda v: contains(lower(v), '{0}'))) > 0)) > 0)"
_filter_query("q_search_tags", EventFilter(search="Purch", limit=70), _SEARCH.format("purch"), 70)
_filter_query("q_kind_search", EventFilter(kinds=(1, 7), search="VIEW 2", limit=None), f"kind IN (1, 7) AND {_SEARCH.format('view 2')}", None)
_filter_query("q_author_tag_search", EventFilter(authors=tuple(range(40)), tags={"p": ("3", "8")}, search="click", limit=None), f"pubkey < 40 AND kind IN ({_KINDS}) AND {_tag('p', '3', '8')} AND {_SEARCH.format('click')}", None)
_filter_query("q_many_authors_joined", EventFilter(authors=tuple(range(10, 4010)), kinds=(1,)), "pubkey BETWEEN 10 AND 4009 AND kind = 1")


@register("q_search_content", f", n AS (SELECT max(doc_id) + 1 AS n FROM documents), e AS (SELECT ev.* EXCLUDE (content), d.text AS content FROM ev, n, documents d WHERE d.doc_id = ev.id % n.n) SELECT id, pubkey, created_at, kind FROM e WHERE NOT deleted AND {_SEARCH.format('license')} ORDER BY created_at DESC, id LIMIT 100")
def q_search_content(spark, sf_dir):
    return retrieve.query(activity_events(spark, sf_dir, texts=True), EventFilter(search="LICENSE")).select("id", "pubkey", "created_at", "kind")


@register("q_tag_sidetable", _found(f"kind IN ({_KINDS}) AND {_tag('t', 'view', 'click')} AND {_tag('p', '3', '7')}", 200))
def q_tag_sidetable(spark, sf_dir):
    """The same as q_tag_and_names, by semi joins on the tag table."""
    ev = activity_events(spark, sf_dir)
    return retrieve.query(ev, EventFilter(tags={"t": ("view", "click"), "p": ("3", "7")}, limit=200), tags=retrieve.explode_tags(ev)).select(*_COLUMNS)


@register("q_get_many", _found("id IN (1, 5, 97, 98, 99999999)", None))
def q_get_many(spark, sf_dir):
    return retrieve.get_many(activity_events(spark, sf_dir), [1, 5, 97, 98, 99999999]).select(*_COLUMNS)


@register("q_page_before", _found(f"kind = 1 AND (created_at < {UNTIL} OR created_at = {UNTIL} AND id > 5)", 25))
def q_page_before(spark, sf_dir):
    return retrieve.page_before(activity_events(spark, sf_dir), EventFilter(kinds=(1,), limit=25), UNTIL, 5).select(*_COLUMNS)


def _count_query(name: str, f: EventFilter, where: str, sql: str = "count(*)", **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return retrieve.count(activity_events(spark, sf_dir), f, **options)

    register(name, f"SELECT CAST({sql} AS BIGINT) AS n FROM ev WHERE NOT deleted AND {where}")(run)


_count_query("q_count_kind", EventFilter(kinds=(1,)), "kind = 1")
_count_query("q_count_author", EventFilter(authors=(8, 46), since=SINCE), f"pubkey IN (8, 46) AND kind IN ({_KINDS}) AND created_at >= {SINCE}")
_count_query("q_count_tag", EventFilter(tags={"p": ("3",)}), f"kind IN ({_KINDS}) AND {_tag('p', '3')}")
_count_query("q_count_ignores_limit", EventFilter(kinds=(0, 1), limit=3), "kind IN (0, 1)")
_count_query("q_count_capped", EventFilter(kinds=(0, 1), limit=3), "kind IN (0, 1)", "least(count(*), 3)", capped=True)


@register("q_flag_counts", "SELECT count(*) FILTER (NOT deleted AND NOT replaced) AS live, count(*) FILTER (NOT replaced) AS with_deleted, count(*) AS everything FROM ev")
def q_flag_counts(spark, sf_dir):
    ev = activity_events(spark, sf_dir)
    parts = [lifecycle.flag_counts(ev, d, r).withColumnRenamed("n", n) for n, d, r in (("live", False, False), ("with_deleted", True, False), ("everything", True, True))]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])


@register("q_key_range_asc", f"SELECT id, created_at FROM ev WHERE created_at BETWEEN {SINCE} AND {SINCE + 7200}")
def q_key_range_asc(spark, sf_dir):
    return retrieve.key_range(activity_events(spark, sf_dir), "created_at", SINCE, SINCE + 7200).select("id", "created_at")


@register("q_key_range_desc", f"SELECT id, created_at FROM ev WHERE created_at >= {SINCE} AND created_at < {SINCE + 7200}")
def q_key_range_desc(spark, sf_dir):
    return retrieve.key_range(activity_events(spark, sf_dir), "created_at", SINCE, SINCE + 7200, descending=True).select("id", "created_at")


@register("q_author_range", _found(f"pubkey = 8 AND kind = 7 AND {_T}", None))
def q_author_range(spark, sf_dir):
    return retrieve.author_range(activity_events(spark, sf_dir), 8, 7, SINCE, UNTIL).select(*_COLUMNS)


@register("q_live_excludes_deleted", "SELECT count(*) AS n, sum(id)::BIGINT AS ids FROM ev WHERE NOT deleted")
def q_live_excludes_deleted(spark, sf_dir):
    return activity_events(spark, sf_dir).where(~F.col("deleted")).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@register("q_live_excludes_replaced", "SELECT count(*) AS n, sum(id)::BIGINT AS ids FROM ev WHERE NOT deleted AND NOT replaced")
def q_live_excludes_replaced(spark, sf_dir):
    return lifecycle.live(activity_events(spark, sf_dir)).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@register("q_delete_batch", f"SELECT {', '.join(_COLUMNS)} FROM ev WHERE kind <> 7")
def q_delete_batch(spark, sf_dir):
    ev = activity_events(spark, sf_dir)
    return lifecycle.delete(ev, ev.where("kind = 7").select("id").unionByName(spark.range(-5, 0))).select(*_COLUMNS)


@register("q_delete_by_author", f"SELECT {', '.join(_COLUMNS)} FROM ev WHERE pubkey NOT IN (SELECT pubkey FROM ev WHERE kind = 0 GROUP BY pubkey HAVING count(*) > 12)")
def q_delete_by_author(spark, sf_dir):
    ev = activity_events(spark, sf_dir)
    often = ev.where("kind = 0").groupBy("pubkey").count().where("count > 12")
    return lifecycle.delete_by_author(ev, often).select(*_COLUMNS)


@register("q_mark_flags", "SELECT id, deleted OR kind = 7 AS deleted, replaced OR kind = 0 AS replaced FROM ev")
def q_mark_flags(spark, sf_dir):
    ev = activity_events(spark, sf_dir)
    flags = ev.where("kind IN (0, 7)").select("id", (F.col("kind") == 7).alias("deleted"), (F.col("kind") == 0).alias("replaced"))
    return lifecycle.mark(ev, flags).select("id", "deleted", "replaced")


@register("q_dedup_ingest", f"SELECT {', '.join(_COLUMNS)} FROM ev WHERE created_at >= {UNTIL}")
def q_dedup_ingest(spark, sf_dir):
    """Events up to a time are stored; all come again, twice."""
    ev = activity_events(spark, sf_dir).select(*_COLUMNS)
    return lifecycle.new_events(ev.unionByName(ev), ev.where(F.col("created_at") < UNTIL))


@register("q_union_distinct", f"SELECT DISTINCT {', '.join(_COLUMNS)} FROM ev WHERE kind = 1 OR pubkey = 8 OR {_tag('p', '3')}")
def q_union_distinct(spark, sf_dir):
    ev = activity_events(spark, sf_dir)
    return retrieve.union_distinct(ev.where("kind = 1"), ev.where("pubkey = 8"), ev.where(scalar.has_tag(F.col("tags"), "p", ["3"]))).select(*_COLUMNS)


_D = "coalesce(list_filter(tags, lambda t: t[1] = 'd')[1][2], '')"


@register("q_replaceable_latest", f"SELECT {', '.join(_COLUMNS)} FROM ev WHERE kind IN (0, 30023) QUALIFY row_number() OVER (PARTITION BY pubkey, kind, CASE WHEN kind = 30023 THEN {_D} ELSE '' END ORDER BY created_at DESC, id) = 1")
def q_replaceable_latest(spark, sf_dir):
    ev = activity_events(spark, sf_dir)
    return lifecycle.latest(ev).where(is_replaceable(F.col("kind"))).select(*_COLUMNS)


@register("q_param_replaceable_latest", f"SELECT pubkey, {_D} AS d, created_at, id FROM ev WHERE kind = 30023 QUALIFY row_number() OVER (PARTITION BY pubkey, {_D} ORDER BY created_at DESC, id) = 1")
def q_param_replaceable_latest(spark, sf_dir):
    ev = activity_events(spark, sf_dir).where(is_parameterized_replaceable(F.col("kind")))
    return lifecycle.latest(ev).select("pubkey", scalar.replacement_d(F.col("tags")).alias("d"), "created_at", "id")


@register("q_replaced_ids", f"SELECT id FROM ev WHERE kind IN (0, 30023) QUALIFY row_number() OVER (PARTITION BY pubkey, kind, CASE WHEN kind = 30023 THEN {_D} ELSE '' END ORDER BY created_at DESC, id) > 1")
def q_replaced_ids(spark, sf_dir):
    return lifecycle.replaced_ids(activity_events(spark, sf_dir))


@register("q_replace_events", f"SELECT {', '.join(_COLUMNS)} FROM ev WHERE kind NOT IN (0, 30023) OR id IN (SELECT id FROM ev WHERE kind IN (0, 30023) QUALIFY row_number() OVER (PARTITION BY pubkey, kind, CASE WHEN kind = 30023 THEN {_D} ELSE '' END ORDER BY created_at DESC, id) = 1)")
def q_replace_events(spark, sf_dir):
    ev = activity_events(spark, sf_dir)
    return lifecycle.replace(ev.where(F.col("created_at") < SINCE), ev).select(*_COLUMNS)


@register("q_kind_class_counts", "SELECT CASE WHEN kind BETWEEN 30000 AND 39999 THEN 'parameterized' WHEN kind IN (0, 3) OR kind BETWEEN 10000 AND 19999 THEN 'replaceable' ELSE 'regular' END AS class, count(*) AS n FROM ev GROUP BY 1")
def q_kind_class_counts(spark, sf_dir):
    return activity_events(spark, sf_dir).groupBy(kind_class(F.col("kind")).alias("class")).agg(F.count("*").alias("n"))


_FRAGMENTS = """, f AS (SELECT created_at // 86400 AS segment, sum(strlen(content) + 148)::BIGINT AS total_size, count(*) FILTER (NOT (deleted OR replaced)) AS live_records,
  count(*) FILTER (deleted OR replaced) AS deleted_records FROM ev GROUP BY 1),
g AS (SELECT *, deleted_records / (live_records + deleted_records) AS fragmentation_ratio, floor(total_size * (deleted_records / (live_records + deleted_records)))::BIGINT AS estimated_reclaimable FROM f) """


def _fragments(spark, sf_dir):
    ev = activity_events(spark, sf_dir).withColumn("segment", F.floor(F.col("created_at") / 86400).cast("long"))
    return lifecycle.fragmentation(ev, "segment")


@register("q_fragmentation", _FRAGMENTS + "SELECT segment, total_size, live_records, deleted_records, round(fragmentation_ratio, 6) AS fragmentation_ratio, estimated_reclaimable FROM g")
def q_fragmentation(spark, sf_dir):
    return _fragments(spark, sf_dir).withColumn("fragmentation_ratio", F.round("fragmentation_ratio", 6))


@register("q_compaction_candidates", _FRAGMENTS + "SELECT segment, deleted_records, total_size FROM g WHERE fragmentation_ratio >= 0.02")
def q_compaction_candidates(spark, sf_dir):
    return lifecycle.compaction_candidates(_fragments(spark, sf_dir), 0.02).select("segment", "deleted_records", "total_size")


@register("q_total_waste", _FRAGMENTS + "SELECT sum(total_size)::BIGINT AS total_size, sum(estimated_reclaimable)::BIGINT AS total_waste, count(*) FILTER (fragmentation_ratio >= 0.02) AS compactable, round(sum(estimated_reclaimable) / sum(total_size), 6) AS waste_ratio, sum(estimated_reclaimable) / sum(total_size) >= 0.01 AND count(*) FILTER (fragmentation_ratio >= 0.02) >= 3 AS recommended FROM g")
def q_total_waste(spark, sf_dir):
    return lifecycle.total_waste(_fragments(spark, sf_dir), 0.02, 0.01).withColumn("waste_ratio", F.round("waste_ratio", 6))


@register("q_compacted_live", f"SELECT {', '.join(_COLUMNS)} FROM ev WHERE NOT deleted AND NOT replaced")
def q_compacted_live(spark, sf_dir):
    return lifecycle.live(activity_events(spark, sf_dir)).select(*_COLUMNS)


_EXPLODED = ", x AS (SELECT id, kind, pubkey, created_at, pos - 1 AS pos, tags[pos] AS t FROM (SELECT *, unnest(range(1, len(tags) + 1)) AS pos FROM ev)) "


@register("q_tag_explode", _EXPLODED + f"SELECT id, t[1] AS name, t[2] AS value, pos::INT AS pos, kind, pubkey, created_at FROM x WHERE len(t) >= 2 AND t[1] IN ({_TAGS})")
def q_tag_explode(spark, sf_dir):
    return retrieve.explode_tags(activity_events(spark, sf_dir))


@register("q_tag_index_entries", _EXPLODED + f"SELECT t[1] AS name, count(*) AS n, count(DISTINCT t[2]) AS n_values FROM x WHERE len(t) >= 2 AND t[1] IN ({_TAGS}) GROUP BY 1")
def q_tag_index_entries(spark, sf_dir):
    return retrieve.explode_tags(activity_events(spark, sf_dir)).groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"))


@register("q_tag_range", _EXPLODED + "SELECT id, created_at FROM x WHERE kind = 1 AND t[1] = 'p' AND t[2] = '3'")
def q_tag_range(spark, sf_dir):
    return retrieve.tag_range(retrieve.explode_tags(activity_events(spark, sf_dir)), 1, "p", "3").select("id", "created_at")


def _period_query(name: str, granularity: str, label: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return retrieve.with_period(activity_events(spark, sf_dir), granularity).groupBy("period").agg(F.count("*").alias("n"))

    register(name, f"SELECT strftime(to_timestamp(created_at) AT TIME ZONE 'UTC', '{label}') AS period, count(*) AS n FROM ev GROUP BY 1")(run)


_period_query("q_period_monthly", "monthly", "%Y-%m")
_period_query("q_period_weekly", "weekly", "%G-W%V")
_period_query("q_period_yearly", "yearly", "%Y")


@register("q_period_pruned_range", _found(_T, 300))
def q_period_pruned_range(spark, sf_dir):
    from eventide.plans.compile import period_predicate

    f = EventFilter(since=SINCE, until=UNTIL, limit=300)
    ev = retrieve.with_period(activity_events(spark, sf_dir), "weekly").where(period_predicate(f, "weekly"))
    return retrieve.query(ev, f).select(*_COLUMNS)


def _ring_sql(ring: shard.Ring, name: str = "ring") -> str:
    values = ", ".join(f"({h}, '{s}')" for h, s in ring.points)
    return f"{name}(point, shard) AS (VALUES {values}), {name}_first AS (SELECT shard FROM {name} ORDER BY point LIMIT 1)"


def _owner(key: str, name: str = "ring") -> str:
    return f"coalesce((SELECT arg_min(shard, point) FROM {name} WHERE point >= h), (SELECT shard FROM {name}_first))"


_HASHED = "('0x' || substr(sha256(CAST({0} AS VARCHAR)), 1, 8))::BIGINT"
_AUTHORS = f", {_ring_sql(RING)}, a AS (SELECT DISTINCT pubkey, {_HASHED.format('pubkey')} AS h FROM ev), o AS (SELECT a.pubkey, {_owner('h')} AS shard FROM a) "


@register("q_shard_distribution", _AUTHORS + "SELECT shard, count(*)::BIGINT AS n FROM ev JOIN o USING (pubkey) GROUP BY 1")
def q_shard_distribution(spark, sf_dir):
    return shard.distribution(activity_events(spark, sf_dir), RING)


@register("q_shard_routed_query", _found(f"pubkey IN (8, 46) AND kind IN ({_KINDS})"))
def q_shard_routed_query(spark, sf_dir):
    return shard.routed_query(shard.assign(activity_events(spark, sf_dir), RING), RING, EventFilter(authors=(8, 46))).select(*_COLUMNS)


@register("q_shard_scatter_gather", _found(f"kind IN (1, 6) AND {_T}", 150))
def q_shard_scatter_gather(spark, sf_dir):
    ev = shard.assign(activity_events(spark, sf_dir), RING)
    return shard.gather(ev, EventFilter(kinds=(1, 6), since=SINCE, until=UNTIL, limit=150)).select(*_COLUMNS)


@register("q_shard_duplicates", "SELECT id, 2::BIGINT AS shards FROM ev WHERE kind = 0")
def q_shard_duplicates(spark, sf_dir):
    ev = shard.assign(activity_events(spark, sf_dir), RING)
    return shard.duplicates(ev.unionByName(ev.where("kind = 0").withColumn("shard", F.lit("shard-x"))))


@register("q_rebalance_moves", f", {_ring_sql(RING)}, {_ring_sql(WIDER, 'wider')}, a AS (SELECT DISTINCT pubkey, {_HASHED.format('pubkey')} AS h FROM ev), o AS (SELECT pubkey, {_owner('h')} AS from_shard, {_owner('h', 'wider')} AS to_shard FROM a) SELECT id, pubkey, from_shard, to_shard FROM ev JOIN o USING (pubkey) WHERE from_shard <> to_shard")
def q_rebalance_moves(spark, sf_dir):
    return shard.moves(activity_events(spark, sf_dir), RING, WIDER)


@register("q_migrating_query", _found(f"kind = 1 AND {_T}", 120))
def q_migrating_query(spark, sf_dir):
    """Events of the later time have moved already, some lie in both places."""
    ev = activity_events(spark, sf_dir)
    return shard.migrating_query(ev.where(F.col("created_at") < (SINCE + 2 * UNTIL) / 3), ev.where(F.col("created_at") >= (SINCE + UNTIL) / 2), EventFilter(kinds=(1,), since=SINCE, until=UNTIL, limit=120)).select(*_COLUMNS)


@register("q_migration_progress", "SELECT count(*) FILTER (kind IN (0, 1)) AS migrated, count(*) FILTER (kind = 6) AS failed, count(*) FILTER (kind = 7) AS skipped, count(*) FILTER (kind = 30023) AS pending, round(count(*) FILTER (kind IN (0, 1)) / count(*) FILTER (kind < 8), 6) AS progress FROM ev")
def q_migration_progress(spark, sf_dir):
    kind = F.col("kind")
    log = activity_events(spark, sf_dir).select(F.when(kind < 6, "migrated").when(kind == 6, "failed").when(kind == 7, "skipped").otherwise("pending").alias("state"))
    return shard.migration_progress(log).withColumn("progress", F.round("progress", 6))


@register("q_latency_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean FROM events GROUP BY 1", bare=True)
def q_latency_percentiles(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    out = stats.latency_percentiles(raw, "value", "event_type")
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99", "mean")])


_LOG = ", l AS (SELECT CASE kind WHEN 0 THEN 4 WHEN 6 THEN 2 WHEN 7 THEN 3 ELSE 1 END AS op, id + 1 AS lsn, pubkey, id * 64 AS location FROM ev) "


def _log(spark, sf_dir):
    i, kind = F.col("id"), F.col("kind")
    op = F.when(kind == 0, 4).when(kind == 6, 2).when(kind == 7, 3).otherwise(1)
    return activity_events(spark, sf_dir).select(op.alias("op"), (i + 1).alias("lsn"), "pubkey", (i * 64).alias("location"))


@register("q_wal_stats", _LOG + "SELECT CASE op WHEN 1 THEN 'insert' WHEN 2 THEN 'update_flags' WHEN 3 THEN 'index_update' ELSE 'checkpoint' END AS op, count(*) AS entries, min(lsn) AS first_lsn, max(lsn) AS last_lsn FROM l GROUP BY 1")
def q_wal_stats(spark, sf_dir):
    return stats.log_stats(_log(spark, sf_dir))


@register("q_wal_from_lsn", _LOG + "SELECT op, lsn, pubkey FROM l WHERE lsn > (SELECT max(lsn) FROM l WHERE op = 4) - 40 AND lsn < (SELECT max(lsn) FROM l WHERE op = 4)")
def q_wal_from_lsn(spark, sf_dir):
    log = _log(spark, sf_dir)
    last = log.where("op = 4").agg(F.max("lsn").alias("last"))
    return log.crossJoin(F.broadcast(last)).where("lsn > last - 40 AND lsn < last").select("op", "lsn", "pubkey")


@register("q_wal_to_end", _LOG + "SELECT op, lsn, pubkey FROM l WHERE lsn > (SELECT min(lsn) FROM l WHERE op = 4)")
def q_wal_to_end(spark, sf_dir):
    """All entries behind the first checkpoint, to the end of the log."""
    log = _log(spark, sf_dir)
    first = log.where("op = 4").agg(F.min("lsn").alias("first"))
    return log.crossJoin(F.broadcast(first)).where("lsn > first").select("op", "lsn", "pubkey")


@register("q_recovery_last_location", _LOG + "SELECT pubkey, arg_max(location, lsn) AS location, max(lsn) AS lsn FROM l WHERE op = 1 GROUP BY 1")
def q_recovery_last_location(spark, sf_dir):
    return lifecycle.last_locations(_log(spark, sf_dir).where("op = 1"), "pubkey")


@register("q_resolve_inserts", "SELECT id + 1 AS lsn, id, kind <> 7 AS stored FROM ev")
def q_resolve_inserts(spark, sf_dir):
    ev = activity_events(spark, sf_dir)
    return lifecycle.resolve_inserts(ev.select((F.col("id") + 1).alias("lsn"), "id"), ev.where("kind <> 7"))


@register("q_integrity", "SELECT created_at // 86400 AS segment, count(*) AS records, 0::BIGINT AS corrupt, 0::BIGINT AS duplicates FROM ev GROUP BY 1")
def q_integrity(spark, sf_dir):
    return stats.integrity(activity_events(spark, sf_dir).withColumn("day", F.floor(F.col("created_at") / 86400).cast("long")), "day")


@register("q_table_stats", "SELECT count(*) AS total, count(*) FILTER (NOT deleted AND NOT replaced) AS live, count(*) FILTER (deleted) AS deleted, count(*) FILTER (replaced) AS replaced, count(DISTINCT pubkey) AS authors, count(DISTINCT kind) AS kinds, min(created_at) AS first, max(created_at) AS last, sum(strlen(content))::BIGINT AS content_bytes FROM ev")
def q_table_stats(spark, sf_dir):
    return stats.table_stats(activity_events(spark, sf_dir))


@register("q_scalar_functions", f"SELECT id, sha256(CAST(pubkey AS VARCHAR)) AS author_hex, {_HASHED.format('id')} AS ring, list_filter(tags, lambda t: t[1] = 'k')[1][2] AS k, coalesce(list_filter(tags, lambda t: t[1] = 'd')[1][2], '') AS d, created_at >= {SINCE} AND created_at < {UNTIL} AS inside FROM ev")
def q_scalar_functions(spark, sf_dir):
    ev = activity_events(spark, sf_dir)
    hexed = scalar.to_hex(scalar.from_hex(F.upper(F.sha2(F.col("pubkey").cast("string"), 256))))
    return ev.select("id", hexed.alias("author_hex"), scalar.ring_hash(F.col("id").cast("string")).alias("ring"), scalar.first_tag(F.col("tags"), "k").alias("k"), scalar.replacement_d(F.col("tags")).alias("d"), scalar.in_period(F.col("created_at"), SINCE, UNTIL).alias("inside"))


@register("q_window_counts", "SELECT created_at // 3600 * 3600 AS start, created_at // 3600 * 3600 + 3600 AS \"end\", kind, count(*) AS n FROM ev GROUP BY ALL")
def q_window_counts(spark, sf_dir):
    return ingest.counts_by_window(activity_events(spark, sf_dir), "1 hour")


@register("q_sessions", ', b AS (SELECT pubkey, created_at, CASE WHEN created_at - lag(created_at) OVER w < 7200 THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY pubkey ORDER BY created_at)), s AS (SELECT *, sum(new) OVER (PARTITION BY pubkey ORDER BY created_at) AS k FROM b) SELECT min(created_at) AS start, max(created_at) + 7200 AS "end", pubkey, count(*) AS n FROM s GROUP BY pubkey, k')
def q_sessions(spark, sf_dir):
    return ingest.sessions(activity_events(spark, sf_dir), "2 hours")


@register("q_thread_edges", _EXPLODED + "SELECT p.id AS parent, count(*) AS replies, max(x.created_at) AS last_reply FROM x JOIN ev p ON x.t[1] = 'e' AND p.id = CAST(x.t[2] AS BIGINT) WHERE x.id <> p.id GROUP BY 1")
def q_thread_edges(spark, sf_dir):
    """Replies per event, by joining the tag table with the events."""
    ev = activity_events(spark, sf_dir)
    edges = retrieve.explode_tags(ev, ["e"]).select(F.col("value").cast("long").alias("parent"), F.col("id").alias("reply"), F.col("created_at").alias("at"))
    both = edges.join(ev.select(F.col("id").alias("parent")), "parent").where(F.col("reply") != F.col("parent"))
    return both.groupBy("parent").agg(F.count("*").alias("replies"), F.max("at").alias("last_reply"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 20 events of kinds 1 and 6 by three authors in a time range."""
    f = EventFilter(kinds=(1, 6), authors=(8, 46, 7), since=SINCE, until=UNTIL, limit=20)
    return retrieve.query(activity_events(spark, sf_dir), f).select(*_COLUMNS)


register("q_flagship", _found(f"kind IN (1, 6) AND pubkey IN (8, 46, 7) AND {_T}", 20))(flagship)


def queries() -> dict[str, Query]:
    from eventide.plans import stored_queries  # noqa: F401  (registers its own)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from eventide.plans import stored_queries  # noqa: F401

    return dict(_SQL)
