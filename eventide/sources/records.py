"""Events as self-contained binary records, for exchange with systems without Parquet.

A record is a body of length-prefixed fields and the CRC-32 of that body. Records that don't decode are
counted, not silently dropped.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = 1
MOST_BYTES = 100 * 1024 * 1024
_HEAD = struct.Struct(">BBqi")


def _field(b: bytes) -> bytes:
    return len(b).to_bytes(4, "big") + b


def encode(e: dict) -> bytes:
    """One event as a record."""
    flags = int(bool(e["deleted"])) | int(bool(e["replaced"])) << 1
    out = [_HEAD.pack(VERSION, flags, e["created_at"], e["kind"]), *(_field(bytes(e[c] or b"")) for c in ("id", "pubkey", "sig")), _field((e["content"] or "").encode())]
    out.append(len(e["tags"] or []).to_bytes(4, "big"))
    for t in e["tags"] or []:
        out.append(len(t).to_bytes(4, "big"))
        out += [_field((v or "").encode()) for v in t]
    body = b"".join(out)
    return body + zlib.crc32(body).to_bytes(4, "big")


def decode(record: bytes | None) -> dict | None:
    """The event of a record; None if it is damaged, of another version or too large."""
    if record is None or not _HEAD.size + 4 < len(record) <= MOST_BYTES:
        return None
    body, at = record[:-4], _HEAD.size
    if zlib.crc32(body) != int.from_bytes(record[-4:], "big"):
        return None

    def number() -> int:
        nonlocal at
        at += 4
        if at > len(body):
            raise ValueError
        return int.from_bytes(body[at - 4 : at], "big")

    def take() -> bytes:
        nonlocal at
        n = number()
        at += n
        if at > len(body):
            raise ValueError
        return body[at - n : at]

    try:
        version, flags, created_at, kind = _HEAD.unpack_from(body)
        out = {"id": take(), "pubkey": take(), "created_at": created_at, "kind": kind, "sig": take(), "content": take().decode()}
        out["tags"] = [[take().decode() for _ in range(number())] for _ in range(number())]
    except ValueError:
        return None
    if version != VERSION or at != len(body):
        return None
    return out | {"deleted": bool(flags & 1), "replaced": bool(flags & 2)}


#: Rows, and bytes of them, that are Python objects at a time.
MOST_ROWS, MOST_BYTES_AT_ONCE = 500, 4 * 1024 * 1024


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, so that what a worker holds as Python objects doesn't follow the size of the engine's batches or of the rows."""
    n = batch.num_rows
    step = max(1, min(MOST_ROWS, n * MOST_BYTES_AT_ONCE // max(1, batch.nbytes)))
    for at in range(0, n, step):
        yield batch.slice(at, step)


_FIELDS = ["id", "pubkey", "created_at", "kind", "tags", "content", "sig", "deleted", "replaced"]
_DDL = "id binary, pubkey binary, created_at long, kind int, tags array<array<string>>, content string, sig binary, deleted boolean, replaced boolean"
_ARROW = pa.schema([("id", pa.binary()), ("pubkey", pa.binary()), ("created_at", pa.int64()), ("kind", pa.int32()), ("tags", pa.list_(pa.list_(pa.string()))), ("content", pa.string()), ("sig", pa.binary()), ("deleted", pa.bool_()), ("replaced", pa.bool_()), ("corrupt", pa.bool_())])


def to_records(events: DataFrame) -> DataFrame:
    """One column record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in _pieces(whole)):
            yield pa.RecordBatch.from_arrays([pa.array([encode(e) for e in b.to_pylist()], pa.binary())], names=["record"])

    return events.select(*_FIELDS).mapInArrow(run, "record binary")


def scan_records(records: DataFrame, column: str = "record") -> DataFrame:
    """Events of records, with corrupt true and all else null where a record can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in _pieces(whole)):
            found = [decode(r.as_py()) for r in b.column(0)]
            yield pa.RecordBatch.from_pylist([(e or dict.fromkeys(_FIELDS)) | {"corrupt": e is None} for e in found], schema=_ARROW)

    return records.select(column).mapInArrow(run, f"{_DDL}, corrupt boolean")


def from_records(records: DataFrame, column: str = "record") -> DataFrame:
    """The readable events; ``scan_records`` tells how many aren't."""
    return scan_records(records, column).where(~F.col("corrupt")).drop("corrupt")
