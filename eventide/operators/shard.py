"""Shards by consistent hashing of the author."""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
from collections.abc import Callable, Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventide.errors import EventideError
from eventide.functions import scalar
from eventide.operators import retrieve
from eventide.plans import compile as plan
from eventide.plans.filter import EventFilter


class Ring:
    """Points of the shards on a ring of 32-bit hashes; a key belongs to the first point at or behind its hash."""

    def __init__(self, shards: Sequence[str], virtual_nodes: int = 150) -> None:
        if not shards or virtual_nodes < 1:
            raise ValueError("a ring needs shards and virtual nodes")
        self.shards, self.virtual_nodes = tuple(shards), virtual_nodes
        points = {}
        for s in shards:
            for i in range(virtual_nodes):
                points.setdefault(self.hash(f"{s}#{i}"), s)
        self.points = sorted(points.items())

    @staticmethod
    def hash(key: str | bytes) -> int:
        raw = key.encode() if isinstance(key, str) else bytes(key)
        return int.from_bytes(hashlib.sha256(raw).digest()[:4], "big")

    def shard_of(self, key: str | bytes) -> str:
        i = bisect.bisect_left(self.points, (self.hash(key), ""))
        return self.points[i % len(self.points)][1]

    def column(self, key: Column) -> Column:
        """The shard of a key column; ``lookup`` hashes a key once where the shard is asked in a condition, too."""
        return self._owner(scalar.ring_hash(key))

    def _owner(self, h: Column) -> Column:
        """The shard of a hash.

        The ring is cut into cells by the hash's leading bits, about four for each point, so that a key is
        compared with the points of its own cell only: one by one, as lambdas over arrays would be interpreted.
        """
        points, n = [p for p, _ in self.points], len(self.points)
        bits = min(16, max(1, (4 * n - 1).bit_length()))
        starts = [bisect.bisect_left(points, c << (32 - bits)) for c in range((1 << bits) + 1)]
        # one string literal each, which Catalyst folds into an array
        numbers = lambda x: F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>")
        cell = F.shiftright(h, 32 - bits).cast("int") + 1
        at = F.element_at(numbers(starts[:-1]), cell)
        for k in range(max(b - a for a, b in zip(starts, starts[1:]))):
            # where a cell has no such point, one that is above all hashes
            own = [points[a + k] if a + k < b else 1 << 32 for a, b in zip(starts, starts[1:])]
            at = at + (F.element_at(numbers(own), cell) < h).cast("bigint")
        owners = [self.shards.index(s) for _, s in self.points]
        owner = F.element_at(numbers([*owners, owners[0]]), (at + 1).cast("int"))
        return F.element_at(F.array(*[F.lit(s) for s in self.shards]), (owner + 1).cast("int"))

    def lookup(self, df: DataFrame, key: Column, name: str = "shard") -> DataFrame:
        """``df`` with the shard of each key.

        A condition on it would repeat the hash as often as the ring's cells are asked; it isn't pushed below the generator.
        """
        out = df.withColumn("_ring_hash", F.explode(F.array(scalar.ring_hash(key))))
        return out.withColumn(name, self._owner(F.col("_ring_hash"))).drop("_ring_hash")

    def where(self, df: DataFrame, key: Column, condition: str) -> DataFrame:
        """Rows that fit a condition on ``_owner``, the shard of the key."""
        hashed = df.withColumn("_ring_hash", F.explode(F.array(scalar.ring_hash(key))))
        return hashed.withColumn("_owner", self._owner(F.col("_ring_hash"))).where(condition).drop("_ring_hash", "_owner")

    def with_shard(self, shard: str) -> Ring:
        return Ring((*self.shards, shard), self.virtual_nodes)

    def without_shard(self, shard: str) -> Ring:
        return Ring([s for s in self.shards if s != shard], self.virtual_nodes)


def author_key(pubkey: Column) -> Column:
    return pubkey.cast("string")


def assign(events: DataFrame, ring: Ring, key: Column | None = None) -> DataFrame:
    """Events with the shard of their author; authors are hashed once each where they are few."""
    return ring.lookup(events, author_key(F.col("pubkey")) if key is None else key)


def distribution(events: DataFrame, ring: Ring) -> DataFrame:
    """Events of each shard."""
    by_author = events.groupBy("pubkey").agg(F.count("*").alias("k"))
    return assign(by_author, ring).groupBy("shard").agg(F.sum("k").alias("n"))


def shards_for(ring: Ring, authors: Iterable[Any]) -> list[str]:
    """The shards that these authors' events lie on; all without authors."""
    own = {ring.shard_of(a if isinstance(a, (str, bytes)) else str(a)) for a in authors}
    return sorted(own) if own else sorted(ring.shards)


def routed_query(sharded: DataFrame, ring: Ring, f: EventFilter, **options) -> DataFrame:
    """A query over the shards of its authors alone; ``shard`` is a partition column, so others aren't read."""
    return retrieve.query(sharded.where(F.col("shard").isin(shards_for(ring, f.authors))), f, **options)


def scatter_gather(shards: Sequence[DataFrame], f: EventFilter, **options) -> DataFrame:
    """The query on each shard, results merged: ids once, newest first, one limit over all."""
    f = f.validate().normalize()
    parts = [retrieve.query(s, f, **options) for s in shards]
    out = retrieve.union_distinct(*parts).orderBy(*retrieve.newest_first())
    return out if f.limit is None else out.limit(f.limit)


def gather(sharded: DataFrame, f: EventFilter, **options) -> DataFrame:
    """``scatter_gather`` over a table with the column shard, by one scan: the newest of each shard, ids once, one limit over all."""
    f = f.validate().normalize()
    found = retrieve.matching(sharded, f, **options)
    if f.limit is not None:
        rank = F.row_number().over(Window.partitionBy("shard").orderBy(*retrieve.newest_first()))
        found = found.withColumn("rank_in_shard", rank).where(F.col("rank_in_shard") <= f.limit).drop("rank_in_shard")
    out = found.dropDuplicates(["id"]).orderBy(*retrieve.newest_first())
    return out if f.limit is None else out.limit(f.limit)


def union_all(shards: Sequence[DataFrame]) -> DataFrame:
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    return out


def duplicates(sharded: DataFrame) -> DataFrame:
    """Ids that lie on more than one shard, and how many."""
    return sharded.groupBy("id").agg(F.countDistinct("shard").alias("shards")).where("shards > 1")


def moves(events: DataFrame, old: Ring, new: Ring) -> DataFrame:
    """Events whose shard changes: id, pubkey, from_shard, to_shard."""
    both = old.lookup(events.select("id", "pubkey"), author_key(F.col("pubkey")), "from_shard")
    return new.lookup(both, author_key(F.col("pubkey")), "to_shard").where(F.col("from_shard") != F.col("to_shard"))


def migration_progress(log: DataFrame) -> DataFrame:
    """One row of an operation log (state: migrated, failed, skipped, pending): counts and the share done."""
    out = log.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("migrated", "failed", "skipped", "pending")])
    tried = F.col("migrated") + F.col("failed") + F.col("skipped")
    return out.withColumn("progress", F.when(tried > 0, F.col("migrated") / tried).otherwise(F.lit(0.0)))


def migrating_query(old: DataFrame, new: DataFrame, f: EventFilter, **options) -> DataFrame:
    """A query while events move: both places are asked, ids come once."""
    return scatter_gather([old, new], f, **options)


class MoveStopped(EventideError):
    """A rebalancing was stopped; the old ring is in use."""


class ShardedTable:
    """Events on disk by shard: a folder partitioned by the shard of the author.

    The ring in use lies in ``_ring`` as numbered files, tombstones in ``_deleted``. While events move, those that lie on a shard that isn't
    theirs by the ring in use don't count, so that changing over is writing one file. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, ring: Ring, key: Column | None = None) -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self._jvm_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jvm_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.ring, self._mixed = ring, False
        self._refresh()

    def _refresh(self) -> None:
        """Take over the ring that is in use on disk."""
        stored = self._stored_ring()
        if stored:
            self.ring, self._mixed = Ring(stored["shards"], stored["virtual_nodes"]), stored["mixed"]

    def _names(self, part: str) -> list[str]:
        folder = self._jvm_path(f"{self.path}/{part}")
        return [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []

    def _stored_ring(self) -> dict[str, Any] | None:
        number = max([int(n) for n in self._names("_ring") if n.isdigit()], default=None)
        if number is None:
            return None
        stream = self._fs.open(self._jvm_path(f"{self.path}/_ring/{number}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _use(self, ring: Ring, mixed: bool) -> None:
        self._fs.mkdirs(self._jvm_path(f"{self.path}/_ring"))
        number = max([int(n) for n in self._names("_ring") if n.isdigit()], default=0) + 1
        draft = self._jvm_path(f"{self.path}/_ring/_{number}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps({"shards": list(ring.shards), "virtual_nodes": ring.virtual_nodes, "mixed": mixed}).encode()))
        out.close()
        if not self._fs.rename(draft, self._jvm_path(f"{self.path}/_ring/{number}")):
            raise EventideError(f"{self.path}: another writer committed ring {number}")
        self.ring, self._mixed = ring, mixed

    def _key(self) -> Column:
        return author_key(F.col("pubkey")) if self.key is None else self.key

    @property
    def stored(self) -> DataFrame:
        """All rows that lie there."""
        return self.spark.read.parquet(self.path)

    def _own(self) -> DataFrame:
        """Rows on the shard that is theirs; all are unless a rebalancing has begun."""
        return self.ring.where(self.stored, self._key(), "shard = _owner") if self._mixed else self.stored

    @property
    def events(self) -> DataFrame:
        """Events on the shard that is theirs, without deleted ones."""
        self._refresh()
        out = self._own()
        if self._names("_deleted"):
            out = out.join(self.spark.read.parquet(f"{self.path}/_deleted"), "id", "left_anti").select(*out.columns)
        return out

    def shards(self) -> list[str]:
        """The shards of the ring in use."""
        return sorted(self.ring.shards)

    def append(self, events: DataFrame) -> None:
        """Add events, each id once, to their shards; ids that are there stay as they are, so that a job that died may run again.

        Where something is there, the events are read twice, and so written down first. Shards are found for rows that are new alone.
        """
        self._refresh()
        staged = None
        if any(n.startswith("shard=") for n in self._names("")):
            staged = f"{self.path}/_staged-{uuid.uuid4().hex}"
            events.select(*[c for c in self.stored.columns if c in events.columns]).write.parquet(staged)
            events = self.spark.read.parquet(staged)
            known = self._own().select("id").join(events.select("id"), "id", "left_semi")
            events = events.repartition("id").dropDuplicates(["id"]).join(known, "id", "left_anti").select(*events.columns)
        else:
            events = events.repartition("id").dropDuplicates(["id"])
        # as many tasks and files as the data asks for, a shard in several where it is large
        assign(events, self.ring, self.key).hint("rebalance", "shard").write.mode("append").partitionBy("shard").parquet(self.path)
        if staged is not None:
            self._fs.delete(self._jvm_path(staged), True)

    def get(self, event: Any):
        """The event of an id, wherever it lies; None if there is none."""
        return retrieve.get(self.events, event).first()

    def delete(self, ids: DataFrame) -> int:
        """Delete events by the column id, on whichever shard they are; the number of them that were there."""
        own = self.events.select("id").join(ids.select("id").distinct(), "id", "left_semi")
        return self._delete(own)

    def delete_by_author(self, author: Any) -> int:
        """Delete an author's events, which lie on one shard."""
        own = self.events.where(F.col("shard").isin(shards_for(self.ring, [author])) & (F.col("pubkey") == plan.literal(author, self.stored.schema["pubkey"].dataType)))
        return self._delete(own.select("id"))

    def _delete(self, ids: DataFrame) -> int:
        before = self.spark.read.parquet(f"{self.path}/_deleted").count() if self._names("_deleted") else 0
        ids.write.mode("append").parquet(f"{self.path}/_deleted")
        return self.spark.read.parquet(f"{self.path}/_deleted").count() - before

    def query(self, f: EventFilter, **options) -> DataFrame:
        """Only the shards of the filter's authors are read."""
        return routed_query(self.events, self.ring, f, **options)

    def count(self, f: EventFilter) -> int:
        own = shards_for(self.ring, f.authors)
        return retrieve.count(self.events.where(F.col("shard").isin(own)), f).first()["n"]

    def distribution(self) -> DataFrame:
        return self.events.groupBy("shard").agg(F.count("*").alias("n"))

    def add_shard(self, shard: str, **options) -> int:
        """Take a shard into the ring and move what becomes its own."""
        return self.rebalance(self.ring.with_shard(shard), **options)

    def remove_shard(self, shard: str, **options) -> int:
        """Take a shard out of the ring and move its events to the others."""
        return self.rebalance(self.ring.without_shard(shard), **options)

    def rebalance(self, new: Ring, path: str | None = None, dry_run: bool = False, progress: Callable[[int, int], None] | None = None, stop: Callable[[], bool] | None = None) -> int:
        """Change over to another ring; the number of events that change shards.

        Only events that change shards are written, one old shard after the other, to their new ones; ids that a
        run which died has put there already aren't written again. Then what lies on the new shards is compared with what should, and
        only if nothing is missing the new ring comes into use. ``progress`` is told (shards done, all shards); where ``stop`` says so, the
        rebalancing ends before the next shard and the old ring stays in use. ``clean`` removes what was left behind.

        With ``path``, all events are written to that folder instead. With ``dry_run`` only the number is found.
        """
        events, key = self.events, self._key()
        moving = new.where(events, key, "shard <> _owner")
        n = moving.count()
        if dry_run:
            return n
        if path is not None:
            out = new.lookup(events.drop("shard"), key)
            out.hint("rebalance", "shard").write.partitionBy("shard").parquet(path)
            self.path = path.rstrip("/")
            self._use(new, False)
            return n
        # only where a rebalancing has begun before, rows may lie on shards that aren't theirs
        begun = self._mixed
        # from now on, readers leave out what isn't theirs by the old ring
        self._use(self.ring, True)
        shards = sorted({*self.ring.shards} | {s.removeprefix("shard=") for s in self._names("") if s.startswith("shard=")})
        for k, shard in enumerate(shards):
            if stop is not None and stop():
                raise MoveStopped(f"{k} of {len(shards)} shards done")
            own = new.lookup(moving.where(F.col("shard") == shard).drop("shard"), key)
            if begun:
                there = self.stored.select("id", "shard").where(F.col("shard") != shard)
                own = own.join(there, ["id", "shard"], "left_anti")
            own.select(*self.stored.columns).hint("rebalance", "shard").write.mode("append").partitionBy("shard").parquet(self.path)
            if progress is not None:
                progress(k + 1, len(shards))
        wanted = new.lookup(moving.select("id", "pubkey"), key).select("id", "shard")
        missing = wanted.join(self.stored.select("id", "shard"), ["id", "shard"], "left_anti").count()
        if missing:
            raise EventideError(f"{missing} events are missing on their new shards; the old ring is in use")
        self._use(new, True)
        return n

    def clean(self) -> None:
        """Write the shards that hold events of others or deleted ones anew, and let others be. Not while the table is read: for a moment, a shard's events are there twice."""
        live = self.events
        stale = self.stored.select("id", "shard").join(live.select("id", "shard"), ["id", "shard"], "left_anti")
        for shard in [r["shard"] for r in stale.select("shard").distinct().collect()]:
            draft = f"{self.path}/_clean/{uuid.uuid4().hex}"
            live.where(F.col("shard") == shard).drop("shard").write.parquet(draft)
            old = self._names(f"shard={shard}")
            for name in self._names(f"_clean/{draft.rpartition('/')[2]}"):
                if name.startswith("part-"):
                    self._fs.rename(self._jvm_path(f"{draft}/{name}"), self._jvm_path(f"{self.path}/shard={shard}/{name}"))
            for name in old:
                self._fs.delete(self._jvm_path(f"{self.path}/shard={shard}/{name}"), True)
        for name in ["_clean", *[n for n in self._names("") if n.startswith("_staged-")]]:  # the latter of a job that died
            self._fs.delete(self._jvm_path(f"{self.path}/{name}"), True)
        self._use(self.ring, False)
