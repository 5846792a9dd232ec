"""The event model: schemas, kind classes and defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAGS = T.ArrayType(T.ArrayType(T.StringType()))

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.BinaryType(), False),
        T.StructField("pubkey", T.BinaryType(), False),
        T.StructField("created_at", T.LongType(), False),
        T.StructField("kind", T.IntegerType(), False),
        T.StructField("tags", TAGS, False),
        T.StructField("content", T.StringType(), False),
        T.StructField("sig", T.BinaryType(), False),
        T.StructField("deleted", T.BooleanType(), False),
        T.StructField("replaced", T.BooleanType(), False),
    ]
)

TAG_SCHEMA = T.StructType(
    [
        T.StructField("id", T.BinaryType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("value", T.StringType(), False),
        T.StructField("pos", T.IntegerType(), False),
        T.StructField("kind", T.IntegerType(), False),
        T.StructField("pubkey", T.BinaryType(), False),
        T.StructField("created_at", T.LongType(), False),
    ]
)

#: Operations of the change log.
INSERT, UPDATE_FLAGS, INDEX_UPDATE, CHECKPOINT = 1, 2, 3, 4
OP_NAMES = {INSERT: "insert", UPDATE_FLAGS: "update_flags", INDEX_UPDATE: "index_update", CHECKPOINT: "checkpoint"}

LOG_SCHEMA = T.StructType(
    [
        T.StructField("op", T.IntegerType(), False),
        T.StructField("lsn", T.LongType(), False),
        T.StructField("timestamp", T.LongType(), False),
        T.StructField("data", T.BinaryType(), True),
        T.StructField("checksum", T.LongType(), True),
    ]
)

#: Tag names with entries in the tag table, case-sensitive.
INDEXED_TAGS = tuple("e p a d P E A g t h i I k K".split())
DEFAULT_KINDS = (0, 1, 3, 6, 16, 20, 30023, 9041, 1111)
DEFAULT_LIMIT = 100


def is_replaceable(kind: Column) -> Column:
    """Kinds of which an author has one current event (per d tag for the parameterised ones)."""
    return kind.isin(0, 3) | kind.between(10000, 19999) | is_parameterized_replaceable(kind)


def is_parameterized_replaceable(kind: Column) -> Column:
    return kind.between(30000, 39999)


def kind_class(kind: Column) -> Column:
    return F.when(is_parameterized_replaceable(kind), "parameterized").when(is_replaceable(kind), "replaceable").otherwise("regular")
