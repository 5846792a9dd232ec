"""Statistics, integrity and metrics."""

from __future__ import annotations

from collections import Counter
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.plans.filter import EventFilter
from eventide.schema import INDEXED_TAGS, OP_NAMES


def table_stats(events: DataFrame) -> DataFrame:
    """One row: records by flag, authors, kinds, first and last time, bytes of content."""
    return events.agg(
        F.count("*").alias("total"), F.count_if(~F.col("deleted") & ~F.col("replaced")).alias("live"), F.count_if("deleted").alias("deleted"), F.count_if("replaced").alias("replaced"),
        F.countDistinct("pubkey").alias("authors"), F.countDistinct("kind").alias("kinds"), F.min("created_at").alias("first"), F.max("created_at").alias("last"),
        F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("content_bytes"),
    )


def log_stats(log: DataFrame) -> DataFrame:
    """Per operation of a change log: entries, first and last LSN."""
    name = F.create_map(*[F.lit(x) for kv in OP_NAMES.items() for x in kv])
    return log.groupBy(F.coalesce(F.try_element_at(name, F.col("op")), F.lit("unknown")).alias("op")).agg(F.count("*").alias("entries"), F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"))


def integrity(events: DataFrame, segment: str, indexed: tuple[str, ...] = INDEXED_TAGS) -> DataFrame:
    """Per segment: records, corrupt (a missing field or a tag without name), duplicate ids."""
    missing = F.col("id").isNull() | F.col("pubkey").isNull() | F.col("created_at").isNull() | F.col("kind").isNull() | F.col("tags").isNull() | F.exists("tags", lambda t: F.size(t) == 0)
    out = events.groupBy(F.col(segment).alias("segment")).agg(F.count("*").alias("records"), F.count_if(missing).alias("corrupt"), (F.count("id") - F.countDistinct("id")).alias("duplicates"))
    return out


def latency_percentiles(samples: DataFrame, value: str, by: str | None = None, accuracy: int | None = None) -> DataFrame:
    """p50, p95, p99 and the mean of a column, per group if asked.

    Exact, which holds a group's distinct values in memory; with ``accuracy``, within 1 / accuracy of the rank, in a sketch of bounded size.
    """
    at = lambda p: F.percentile(value, F.lit(p)) if accuracy is None else F.percentile_approx(value, p, accuracy)
    q = [at(p).alias(f"p{int(100 * p)}") for p in (0.5, 0.95, 0.99)]
    grouped = samples.groupBy(by) if by else samples.groupBy()
    return grouped.agg(*q, F.avg(value).alias("mean"))


class Metrics:
    """Counters and latencies of an application, for export."""

    def __init__(self, keep: int = 1000) -> None:
        self.keep, self.counters, self.latencies, self.shapes = keep, Counter(), {}, Counter()

    def add(self, name: str, n: int = 1) -> None:
        self.counters[name] += n

    def observe(self, name: str, seconds: float) -> None:
        own = self.latencies.setdefault(name, [])
        own.append(seconds)
        del own[: -self.keep]

    def saw(self, f: EventFilter) -> None:
        """Count a query by which conditions it has."""
        self.shapes["+".join(n for n in ("ids", "kinds", "authors", "since", "until", "wanted_tags", "search") if getattr(f, n)) or "all"] += 1

    def snapshot(self) -> dict[str, Any]:
        c = self.counters
        out: dict[str, Any] = dict(c)
        asked = c["cache_hits"] + c["cache_misses"]
        out["hit_rate"] = 100.0 * c["cache_hits"] / asked if asked else 0.0
        out["shards_per_query"] = c["shards_queried"] // c["queries"] if c["queries"] else 0
        for name, own in self.latencies.items():
            s = sorted(own)
            for p in (50, 95, 99):
                out[f"{name}_p{p}"] = s[min(len(s) - 1, int(len(s) * p / 100))]
        return out

    def reset(self) -> None:
        self.counters.clear()
        self.latencies.clear()
        self.shapes.clear()

    def prometheus(self, prefix: str = "eventide") -> str:
        """The snapshot in Prometheus' text format."""
        lines = []
        for name, v in sorted(self.snapshot().items()):
            full = f"{prefix}_{name}"
            lines += [f"# TYPE {full} {'counter' if name in self.counters else 'gauge'}", f"{full} {v}"]
        return "\n".join(lines) + "\n"


def prometheus_of(row: DataFrame, prefix: str = "eventide") -> str:
    """A one-row DataFrame of numbers in Prometheus' text format."""
    first = row.first()
    values = first.asDict() if first else {}
    return "".join(f"# TYPE {prefix}_{k} gauge\n{prefix}_{k} {v}\n" for k, v in values.items() if isinstance(v, (int, float)))
