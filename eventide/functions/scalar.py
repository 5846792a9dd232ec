"""Scalar expressions over event columns; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_hex(c: Column) -> Column:
    """Binary as lower-case hex."""
    return F.lower(F.hex(c))


def from_hex(c: Column, digits: int = 64) -> Column:
    """Hex of either case as binary; null for another length or other characters."""
    return F.when(c.rlike(f"^[0-9a-fA-F]{{{digits}}}$"), F.unhex(c))


def tag_values(tags: Column, name: str) -> Column:
    """The values of all tags of a name."""
    own = F.filter(tags, lambda t: (F.size(t) >= 2) & (F.get(t, F.lit(0)) == name))
    return F.transform(own, lambda t: F.get(t, F.lit(1)))


def first_tag(tags: Column, name: str) -> Column:
    """The value of the first tag of a name, or null."""
    return F.get(tag_values(tags, name), F.lit(0))


def replacement_d(tags: Column) -> Column:
    """The d tag of a parameterised replaceable event, '' without one."""
    return F.coalesce(first_tag(tags, "d"), F.lit(""))


def has_tag(tags: Column, name: str, values: list[str]) -> Column:
    """Some tag of the name has its first value among ``values``; hashtags (t) in any case."""
    if name == "t":
        low = [v.lower() for v in values]
        return F.exists(tags, lambda t: (F.size(t) >= 2) & (F.get(t, F.lit(0)) == name) & F.lower(F.get(t, F.lit(1))).isin(low))
    return F.exists(tags, lambda t: (F.size(t) >= 2) & (F.get(t, F.lit(0)) == name) & F.get(t, F.lit(1)).isin(values))


def matches_search(content: Column, tags: Column, needle: str) -> Column:
    """The needle occurs, in any case, in the content or in a tag behind its name."""
    low = needle.lower()
    behind = lambda t: F.when(F.size(t) > 1, F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return F.contains(F.lower(content), F.lit(low)) | F.exists(tags, lambda t: F.exists(behind(t), lambda v: F.contains(F.lower(v), F.lit(low))))


def ring_hash(key: Column) -> Column:
    """The first four bytes of SHA-256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")


def event_id(pubkey: Column, created_at: Column, kind: Column, content: Column, *more: Column) -> Column:
    """A content-derived id: SHA-256 over the parts, as binary."""
    return F.unhex(F.sha2(F.concat_ws("|", *(x.cast("string") for x in (pubkey, created_at, kind, content, *more))), 256))


def checksum(data: Column) -> Column:
    """CRC-32 of a log entry's bytes."""
    return F.crc32(data)


def period(created_at: Column, granularity: str = "monthly") -> Column:
    """The label of the UTC period that holds unix seconds: 2024-01, 2024-W05 (ISO) or 2024."""
    days = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(created_at / 86400).cast("int"))
    if granularity == "monthly":
        return F.date_format(days, "yyyy-MM")
    if granularity == "weekly":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), days).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(days).cast("string"), 2, "0"))
    if granularity == "yearly":
        return F.year(days).cast("string")
    raise ValueError(f"unknown granularity {granularity}")


def in_period(created_at: Column, start: int, end: int) -> Column:
    """Half-open: from ``start`` on, before ``end``."""
    return (created_at >= start) & (created_at < end)


def index_key(pubkey: Column, kind: Column, created_at: Column) -> Column:
    """author, kind and time in one sortable binary key."""
    return F.unhex(F.concat(F.hex(pubkey), F.lpad(F.hex(kind), 4, "0"), F.lpad(F.hex(created_at), 8, "0")))


def key_timestamp(key: Column) -> Column:
    """The time at the end of an index key."""
    return F.conv(F.right(F.hex(key), F.lit(8)), 16, 10).cast("long")


def cut_bytes(value: Column, most: int = 255) -> Column:
    """A value's first bytes, as an index with bounded keys has them."""
    return F.substring(F.encode(value, "UTF-8"), 1, most)
