"""From a filter to a column predicate, and which access path suits it."""

from __future__ import annotations

import functools
import operator
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.functions import scalar
from eventide.plans.filter import EventFilter
from eventide.schema import INDEXED_TAGS

#: Longer lists of authors or ids are joined instead of compared.
MOST_LITERALS = 1000
COSTS = {"ids": 1, "kind_time": 3, "author_time": 4, "search": 6, "scan": 100}


def literal(value: Any, kind: T.DataType) -> Column:
    """A value as a literal of the column's type; hex strings will do for binary."""
    if isinstance(kind, T.BinaryType) and isinstance(value, str):
        value = bytes.fromhex(value)
    return F.lit(value).cast(kind) if not isinstance(value, (bytes, bytearray)) else F.lit(bytes(value))


def among(column: Column, values: tuple, kind: T.DataType) -> Column:
    return column.isin([literal(v, kind) for v in values])


def predicate(events: DataFrame, f: EventFilter, until_inclusive: bool = True, any_tag_name: bool = False, with_tags: bool = True) -> Column:
    """The filter as one predicate; conditions on plain columns come first and reach the scan.

    ``any_tag_name`` takes tag conditions as alternatives, ``until_inclusive=False`` leaves the end out: what
    an engine that answers from its indexes alone would give.
    """
    schema = events.schema
    parts = []
    if f.ids:
        parts.append(among(F.col("id"), f.ids, schema["id"].dataType))
    if f.kinds:
        parts.append(F.col("kind").isin(*f.kinds))
    if f.authors:
        parts.append(among(F.col("pubkey"), f.authors, schema["pubkey"].dataType))
    if f.since:
        parts.append(F.col("created_at") >= f.since)
    if f.until:
        parts.append(F.col("created_at") <= f.until if until_inclusive else F.col("created_at") < f.until)
    tags = [scalar.has_tag(F.col("tags"), n, list(vs)) for n, vs in sorted(f.wanted_tags.items())] if with_tags else []
    if tags:
        parts += [functools.reduce(operator.or_, tags)] if any_tag_name else tags
    if f.search:
        parts.append(scalar.matches_search(F.col("content"), F.col("tags"), f.search))
    return functools.reduce(operator.and_, parts, F.lit(True))


def strategy(f: EventFilter, indexed: tuple[str, ...] = INDEXED_TAGS) -> dict[str, Any]:
    """The access path for a normalised filter: first match of ids, kinds alone, authors, an indexed tag, scan."""
    tags = f.wanted_tags
    if f.ids:
        return {"strategy": "ids", "cost": COSTS["ids"], "fully_indexed": False}
    if f.kinds and not (f.authors or tags or f.search):
        return {"strategy": "kind_time", "cost": COSTS["kind_time"], "fully_indexed": True}
    if f.authors:
        return {"strategy": "author_time", "cost": COSTS["author_time"] + (len(f.authors) > 1), "fully_indexed": not (tags or f.search)}
    if any(n in indexed for n in tags):
        return {"strategy": "search", "cost": COSTS["search"], "fully_indexed": bool(f.kinds) and all(n in indexed for n in tags) and not f.search}
    return {"strategy": "scan", "cost": COSTS["scan"], "fully_indexed": False}


def explain(f: EventFilter, indexed: tuple[str, ...] = INDEXED_TAGS) -> str:
    """The chosen path in words."""
    s = strategy(f, indexed)
    conditions = ", ".join(f"{name}={getattr(f, name)}" for name in ("ids", "kinds", "authors", "since", "until", "wanted_tags", "search", "limit") if getattr(f, name))
    return f"Plan: {s['strategy']}({conditions})\n  Cost: {s['cost']}\n  Fully indexed: {str(s['fully_indexed']).lower()}\n"


def period_bounds(f: EventFilter, granularity: str) -> tuple[str | None, str | None]:
    """Labels of the first and the last period that the filter's times allow; labels sort like times."""

    def label(seconds: int) -> str:
        d = datetime.fromtimestamp(seconds, UTC)
        if granularity == "monthly":
            return d.strftime("%Y-%m")
        if granularity == "weekly":
            return "{0:04d}-W{1:02d}".format(*d.isocalendar()[:2])
        return d.strftime("%Y")

    return (label(f.since) if f.since else None), (label(f.until) if f.until else None)


def period_predicate(f: EventFilter, granularity: str) -> Column:
    """The bounds as a predicate on the partition column, which prunes partitions."""
    low, high = period_bounds(f, granularity)
    out = F.lit(True)
    if low:
        out = out & (F.col("period") >= low)
    if high:
        out = out & (F.col("period") <= high)
    return out
