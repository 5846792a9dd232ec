"""Retrieval: newest-first top-k, counts, lookups, set operations."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from eventide.functions import scalar
from eventide.plans import compile as plan
from eventide.plans.filter import EventFilter
from eventide.schema import DEFAULT_KINDS, DEFAULT_LIMIT, INDEXED_TAGS



def newest_first() -> list[Column]:
    return [F.col("created_at").desc(), F.col("id").asc()]


def _visible(events: DataFrame) -> DataFrame:
    return events.where(~F.col("deleted")) if "deleted" in events.columns else events


def _semi(events: DataFrame, values: tuple, column: str) -> DataFrame:
    """Rows whose column is among many values: by a join, broadcast by Spark if it is small."""
    kind = events.schema[column].dataType
    raw = [(bytes.fromhex(v) if isinstance(v, str) and kind.typeName() == "binary" else v,) for v in values]
    side = events.sparkSession.createDataFrame(raw, f"value {kind.simpleString()}")
    return events.join(side, events[column] == side["value"], "left_semi")


def matching(events: DataFrame, f: EventFilter, tags: DataFrame | None = None, until_inclusive: bool = True, any_tag_name: bool = False) -> DataFrame:
    """All visible events that match, unordered.

    With ``tags``, the exploded tag table, tag conditions become semi joins on it, which a scan of
    its name and value columns answers; without, they are array predicates. Long lists of authors or ids are
    joined.
    """
    out, rest = _visible(events), f
    for name, column in (("authors", "pubkey"), ("ids", "id")):
        if len(getattr(rest, name)) > plan.MOST_LITERALS:
            out = _semi(out, getattr(rest, name), column)
            rest = dataclasses.replace(rest, **{name: ()})
    indexed = {n: v for n, v in rest.wanted_tags.items() if n in INDEXED_TAGS} if tags is not None and not any_tag_name else {}
    for name, values in sorted(indexed.items()):
        value = F.col("value")
        hit = F.lower(value).isin([v.lower() for v in values]) if name == "t" else value.isin(list(values))
        side = tags.where((F.col("name") == name) & hit)
        if rest.kinds:
            side = side.where(F.col("kind").isin(*rest.kinds))
        if rest.since:
            side = side.where(F.col("created_at") >= rest.since)
        if rest.until:
            side = side.where(F.col("created_at") <= rest.until)
        out = out.join(side.select(F.col("id").alias("tagged_id")), F.col("id") == F.col("tagged_id"), "left_semi")
    rest = dataclasses.replace(rest, tags={n: v for n, v in rest.tags.items() if n not in indexed})
    return out.where(plan.predicate(events, rest, until_inclusive, any_tag_name))


def query(events: DataFrame, f: EventFilter, tags: DataFrame | None = None, default_limit: int = DEFAULT_LIMIT, default_kinds: Iterable[int] = DEFAULT_KINDS, until_inclusive: bool = True, any_tag_name: bool = False) -> DataFrame:
    """The newest events that match: created_at descending, id ascending, up to the limit."""
    f = f.validate().normalize(default_limit, default_kinds)
    out = matching(events, f, tags, until_inclusive, any_tag_name).orderBy(*newest_first())
    return out if f.limit is None else out.limit(f.limit)


def iterate(events: DataFrame, f: EventFilter, **options) -> Iterator[Row]:
    """The result row by row, without holding all of it."""
    return query(events, f, **options).toLocalIterator()


def count(events: DataFrame, f: EventFilter, tags: DataFrame | None = None, default_kinds: Iterable[int] = DEFAULT_KINDS, capped: bool = False) -> DataFrame:
    """One row n: the number of matching events, whatever the limit, unless ``capped``."""
    f = f.validate().normalize(default_kinds=default_kinds)
    n = F.count("*")
    if capped and f.limit is not None:
        n = F.least(n, F.lit(f.limit))
    return matching(events, f, tags).agg(n.cast("long").alias("n"))


def get(events: DataFrame, event: Any) -> DataFrame:
    """The visible event of an id: one row or none."""
    return matching(events, EventFilter(ids=(event,))).limit(1)


def get_many(events: DataFrame, ids: Iterable[Any]) -> DataFrame:
    """The visible events of these ids, newest first."""
    return matching(events, EventFilter(ids=tuple(ids))).orderBy(*newest_first())


def page_before(events: DataFrame, f: EventFilter, created_at: int, event: Any, **options) -> DataFrame:
    """The next page behind the last event of the page before it."""
    last = F.col("created_at") < created_at
    same = (F.col("created_at") == created_at) & (F.col("id") > plan.literal(event, events.schema["id"].dataType))
    return query(events.where(last | same), f, **options)


def key_range(events: DataFrame, column: str, low: Any, high: Any, descending: bool = False, high_inclusive: bool | None = None) -> DataFrame:
    """Rows of a key range in key order; ascending both ends belong to it, descending the upper doesn't unless asked."""
    closed = not descending if high_inclusive is None else high_inclusive
    c = F.col(column)
    out = events.where((c >= low) & (c <= high if closed else c < high))
    return out.orderBy(c.desc() if descending else c.asc(), F.col("id").asc())


def author_range(events: DataFrame, author: Any, kind: int, since: int, until: int) -> DataFrame:
    """An author's events of a kind in a time range, newest first."""
    return query(events, EventFilter(authors=(author,), kinds=(kind,), since=since, until=until, limit=None))


def tag_range(tags: DataFrame, kind: int, name: str, value: str, descending: bool = True) -> DataFrame:
    """Entries of the tag table for one exact value."""
    out = tags.where((F.col("kind") == kind) & (F.col("name") == name) & (F.col("value") == value))
    return out.orderBy(F.col("created_at").desc() if descending else F.col("created_at").asc(), F.col("id").asc())


def union_distinct(*parts: DataFrame) -> DataFrame:
    """All events of the parts, each id once."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["id"])


def explode_tags(events: DataFrame, names: Iterable[str] | None = INDEXED_TAGS) -> DataFrame:
    """One row per tag of two elements or more and, with ``names``, of such a name."""
    own = events.select("id", F.posexplode("tags").alias("pos", "tag"), "kind", "pubkey", "created_at").where(F.size("tag") >= 2)
    own = own.select("id", F.get("tag", F.lit(0)).alias("name"), F.get("tag", F.lit(1)).alias("value"), "pos", "kind", "pubkey", "created_at")
    return own if names is None else own.where(F.col("name").isin(list(names)))


def drop_empty_tags(events: DataFrame) -> DataFrame:
    """Events without their tags of no element (or null); the lambda, which is interpreted, runs for events that have such tags alone."""
    none = ~F.array_contains("tags", F.array().cast("array<string>"))  # null where a tag is null
    return events.withColumn("tags", F.when(none, F.col("tags")).otherwise(F.filter("tags", lambda t: F.size(t) > 0)))


def with_period(events: DataFrame, granularity: str = "monthly") -> DataFrame:
    return events.withColumn("period", scalar.period(F.col("created_at"), granularity))
