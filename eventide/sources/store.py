"""The event table on disk: events by period, a tag table, tombstones, and their upkeep."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.config import STRATEGIES, Config
from eventide.errors import EventAlreadyExists, EventDeleted, EventNotFound, InvalidConfig, ReadOnlyTable, TableCorrupted
from eventide.functions import scalar
from eventide.operators import lifecycle, retrieve, stats
from eventide.plans import compile as plan
from eventide.plans.filter import EventFilter
from eventide.schema import EVENT_SCHEMA, TAG_SCHEMA, is_replaceable

FLAG_SCHEMA = T.StructType([T.StructField("id", T.BinaryType()), T.StructField("deleted", T.BooleanType()), T.StructField("replaced", T.BooleanType())])


class EventTable:
    """A table of events in Parquet, under one folder.

    Each append writes a batch: ``events/batch=...``, partitioned by period and sorted by author, kind and time within
    files, with a Bloom filter on the id, and ``tags-N/batch=...`` with an entry per indexed tag, partitioned by period and
    name. ``flags-N`` holds tombstones (id, deleted, replaced). Readers see events less their tombstones.

    What counts is what the newest manifest names: its batches, the periods of them that were written anew since,
    and which tags and flags. A manifest appears by renaming a file, so a batch's events and tags come to be at
    once, and a job that dies, wherever it does, leaves the table as it was; run again, it adds the batch whole. Data that a
    manifest no longer names stays until the next compaction, for readers that are under way. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None, read_only: bool = False) -> None:
        self.spark, self.path, self.read_only = spark, path.rstrip("/"), read_only
        self.config = (config or Config()).validate()
        self._jvm_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jvm_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.metrics: stats.Metrics | None = None

    # files

    def _exists(self, part: str) -> bool:
        return self._fs.exists(self._jvm_path(f"{self.path}/{part}"))

    def _names(self, part: str) -> list[str]:
        """What lies in a folder."""
        folder = self._jvm_path(f"{self.path}/{part}")
        return [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []

    def _state(self) -> dict[str, Any]:
        """The newest manifest: batches with the periods that don't count any more, the numbers of the tags and flags, batches of tags, what is out of use."""
        number = max([int(n) for n in self._names("generations") if n.isdigit()], default=0)
        if not number:
            return {"number": 0, "batches": {}, "tags": 0, "tag_batches": {}, "flags": 0, "old": []}
        stream = self._fs.open(self._jvm_path(f"{self.path}/generations/{number}"))
        try:
            raw = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(raw) | {"number": number}

    def _commit(self, state: dict[str, Any]) -> None:
        """Make a state the newest one; fails if another writer was faster."""
        folder = f"{self.path}/generations"
        self._fs.mkdirs(self._jvm_path(folder))
        draft = self._jvm_path(f"{folder}/_{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        number = state["number"] + 1
        if self._exists(f"generations/{number}") or not self._fs.rename(draft, self._jvm_path(f"{folder}/{number}")):
            self._fs.delete(draft, False)
            raise TableCorrupted(f"{self.path}: another writer committed {number}")
        for name in self._names("generations"):  # some are kept for readers that are under way
            if name.isdigit() and int(name) < number - 10:
                self._fs.delete(self._jvm_path(f"{folder}/{name}"), False)

    def _folder(self, name: str) -> str:
        return f"{self.path}/{name}" if name == "events" else f"{self.path}/{name}-{self._state()[name]}"

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        """The batches of the newest state, without periods that don't count; their folders are told apart before any data is read."""
        state = self._state()
        root = "events" if name == "events" else f"tags-{state['tags']}"
        batches = state["batches" if name == "events" else "tag_batches"]
        there = set(self._names(root)) if batches else set()
        paths = []
        for batch, without in batches.items():
            if f"batch={batch}" in there:
                inner = [f"/{p}" for p in self._names(f"{root}/batch={batch}") if p.startswith("period=") and p.removeprefix("period=") not in without] if without else [""]
                paths += [f"{self.path}/{root}/batch={batch}{x}" for x in inner]
        if not paths:
            return self.spark.createDataFrame([], schema)
        full = T.StructType([*schema.fields, T.StructField("batch", T.StringType())])
        return self.spark.read.schema(full).option("basePath", f"{self.path}/{root}").parquet(*paths).select(*schema.names)

    def _write_events(self, events: DataFrame, batch: str) -> None:
        # as many tasks and files as the data asks for, split where a period is large
        out = retrieve.with_period(events.select(*EVENT_SCHEMA.names), self.config.index.granularity).hint("rebalance", "period")
        (
            out.sortWithinPartitions("period", "pubkey", "kind", "created_at").write.mode("append").partitionBy("period").option("maxRecordsPerFile", self.config.storage.max_records_per_file)
            .option("parquet.bloom.filter.enabled#id", "true").parquet(f"{self.path}/events/batch={batch}")
        )

    def _write_tags(self, events: DataFrame, version: int, batch: str) -> None:
        tags = retrieve.explode_tags(events, self.config.index.tags)
        tags = retrieve.with_period(tags, self.config.index.granularity).hint("rebalance", "period", "name")
        tags.sortWithinPartitions("period", "name", "value", "created_at").write.mode("append").partitionBy("period", "name").parquet(f"{self.path}/tags-{version}/batch={batch}")

    def _may_write(self) -> None:
        if self.read_only:
            raise ReadOnlyTable(self.path)

    # reading

    @property
    def raw(self) -> DataFrame:
        """All stored events with their period, flags as stored with them."""
        return self._read("events", T.StructType([*EVENT_SCHEMA.fields, T.StructField("period", T.StringType())]))

    @property
    def flags(self) -> DataFrame:
        folder = self._folder("flags")
        return self.spark.read.schema(FLAG_SCHEMA).parquet(folder) if self._fs.exists(self._jvm_path(folder)) else self.spark.createDataFrame([], FLAG_SCHEMA)

    @property
    def events(self) -> DataFrame:
        """All events with their present flags."""
        return lifecycle.mark(self.raw, self.flags) if self._exists(self._folder("flags").rpartition("/")[2]) else self.raw

    @property
    def visible(self) -> DataFrame:
        """Events that aren't deleted; tombstones, if there are any, are taken out by an anti join, which keeps the scan's pruning."""
        if not self._exists(self._folder("flags").rpartition("/")[2]):
            return self.raw.where(~F.col("deleted"))
        gone = self.flags.where("deleted").select("id")
        return self.raw.where(~F.col("deleted")).join(gone, "id", "left_anti").select(*self.raw.columns)

    @property
    def tags(self) -> DataFrame:
        return self._read("tags", T.StructType([*TAG_SCHEMA.fields, T.StructField("period", T.StringType())]))

    def query(self, f: EventFilter, use_tags: bool = True) -> DataFrame:
        """The newest matching events; times prune periods, indexed tags go through the tag table."""
        f = f.validate().normalize(self.config.query.default_limit, self.config.query.default_kinds)
        events = self.visible.where(plan.period_predicate(f, self.config.index.granularity))
        return retrieve.query(events, f, self.tags if use_tags and f.wanted_tags else None, self.config.query.default_limit, self.config.query.default_kinds).select(*EVENT_SCHEMA.names)

    def query_all(self, f: EventFilter) -> list:
        return self.query(f).collect()

    def count(self, f: EventFilter) -> int:
        f = f.validate().normalize(self.config.query.default_limit, self.config.query.default_kinds)
        events = self.visible.where(plan.period_predicate(f, self.config.index.granularity))
        return retrieve.count(events, f, self.tags if f.wanted_tags else None).first()["n"]

    def get(self, event: Any):
        """The event of an id, or None if there is none or it is deleted."""
        return retrieve.get(self.visible, event).select(*EVENT_SCHEMA.names).first()

    def require(self, event: Any):
        """The event of an id; an unknown one and a deleted one are errors."""
        found = self.get(event)
        if found is None:
            stored = self.raw.where(F.col("id") == plan.literal(event, T.BinaryType())).isEmpty()
            raise EventNotFound(str(event)) if stored else EventDeleted(str(event))
        return found

    def get_many(self, ids: Iterable[Any]) -> DataFrame:
        return retrieve.get_many(self.visible, ids).select(*EVENT_SCHEMA.names)

    def latest(self) -> DataFrame:
        """Visible events, replaceable ones in their newest version."""
        return lifecycle.latest(self.visible.select(*EVENT_SCHEMA.names))

    def explain(self, f: EventFilter) -> str:
        return plan.explain(f.validate().normalize(self.config.query.default_limit, self.config.query.default_kinds), self.config.index.tags)

    # writing

    def append(self, events: DataFrame) -> None:
        """Add events, each new id once; empty tags are left out. Events and tags are there from one moment on.

        The new ids are looked for in the id column of what is stored, so what is shuffled follows the new events, not the table. For that they are
        read twice, and so written down first, as they come; an empty table has nothing to look in. Rows are shuffled by id before repeated
        ones go, once for that and for the ids that are there.
        """
        self._may_write()
        incoming = retrieve.drop_empty_tags(events.select(*EVENT_SCHEMA.names))
        state = self._state()
        if not state["batches"]:
            self._add(incoming.repartition("id").dropDuplicates(["id"]), state)
            return
        staged = self._staged(incoming)
        incoming = self.spark.read.schema(EVENT_SCHEMA).parquet(staged)
        self._add(lifecycle.new_events(incoming.repartition("id"), self.raw.select("id").join(incoming.select("id"), "id", "left_semi")), state)
        self._fs.delete(self._jvm_path(staged), True)

    def _staged(self, rows: DataFrame) -> str:
        """The folder that rows are written to for the time of an operation."""
        staged = f"{self.path}/staged-{uuid.uuid4().hex}"
        rows.write.parquet(staged)
        return staged

    def _add(self, events: DataFrame, state: dict[str, Any]) -> None:
        """Write events and their tags as a batch, then name it in the manifest."""
        batch = f"{state['number'] + 1:09d}-{uuid.uuid4().hex[:8]}"
        self._write_events(events, batch)
        if f"batch={batch}" not in self._names("events") or not any(n.startswith("period=") for n in self._names(f"events/batch={batch}")):
            self._fs.delete(self._jvm_path(f"{self.path}/events/batch={batch}"), True)
            if not state["number"]:
                self._commit(state)
            return
        stored = self.spark.read.schema(EVENT_SCHEMA).parquet(f"{self.path}/events/batch={batch}")
        self._write_tags(stored, state["tags"], batch)
        self._commit(state | {"batches": state["batches"] | {batch: []}, "tag_batches": state["tag_batches"] | {batch: []}})

    def write(self, events: DataFrame) -> None:
        """Add events; an id that is there already is an error."""
        found = events.join(self.raw.select("id"), "id", "left_semi").select(scalar.to_hex(F.col("id")).alias("id")).first()
        if found:
            raise EventAlreadyExists(found["id"])
        self.append(events)

    def _flag(self, ids: DataFrame, deleted: bool, replaced: bool) -> None:
        ids.select("id", F.lit(deleted).alias("deleted"), F.lit(replaced).alias("replaced")).write.mode("append").parquet(self._folder("flags"))

    def delete(self, event: Any) -> None:
        """Delete one event; an unknown id is an error."""
        self._may_write()
        own = self.visible.where(F.col("id") == plan.literal(event, T.BinaryType())).select("id")
        if own.first() is None:
            raise EventNotFound(str(event))
        self._flag(own, True, False)

    def delete_many(self, ids: DataFrame) -> int:
        """Delete events by the column id; unknown ids are passed over, but one must be known."""
        self._may_write()
        staged = self._staged(self.visible.join(ids.select("id").distinct(), "id", "left_semi").select("id"))
        own = self.spark.read.schema("id binary").parquet(staged)
        n = own.count()
        if n:
            self._flag(own, True, False)
        self._fs.delete(self._jvm_path(staged), True)
        if not n:
            raise EventNotFound("none of the ids is there")
        return n

    def delete_range(self, since: int, until: int, author: Any = None, kind: int | None = None) -> None:
        """Delete the events of a range of time, the end included, of an author or a kind if these are given; only its periods are read."""
        self._may_write()
        f = EventFilter(since=since, until=until, limit=None, authors=() if author is None else (author,), kinds=() if kind is None else (kind,))
        own = self.visible.where(plan.period_predicate(f, self.config.index.granularity)).where(F.col("created_at").between(since, until))
        if author is not None:
            own = own.where(F.col("pubkey") == plan.literal(author, T.BinaryType()))
        self._flag((own if kind is None else own.where(F.col("kind") == kind)).select("id"), True, False)

    def delete_by_author(self, author: Any) -> None:
        self._may_write()
        self._flag(self.visible.where(F.col("pubkey") == plan.literal(author, T.BinaryType())).select("id"), True, False)

    def update_flags(self, event: Any, deleted: bool, replaced: bool) -> None:
        """Set flags of an event; a flag that is set stays set."""
        self._may_write()
        self._flag(self.raw.where(F.col("id") == plan.literal(event, T.BinaryType())).select("id"), deleted, replaced)

    def replace(self, events: DataFrame) -> None:
        """Add events and flag the older versions of replaceable ones as replaced; only events of the same authors and kinds are compared."""
        self.append(events)
        keys = events.where(is_replaceable(F.col("kind"))).select("pubkey", "kind").distinct()
        self._flag(lifecycle.replaced_ids(lifecycle.live(self.events).join(keys, ["pubkey", "kind"], "left_semi")), False, True)

    # upkeep

    def fragmentation(self) -> DataFrame:
        return lifecycle.fragmentation(self.events, "period")

    def compact(self, strategy: str | None = None) -> int:
        """Write the periods that are fragmented enough anew, with their live events alone; the number of such periods.

        Other periods aren't touched. Tombstones of events that are gone go with them. What the last compaction put out of use is
        removed, what this one does stays for readers that are under way.
        """
        self._may_write()
        if strategy is not None and strategy not in STRATEGIES:
            raise InvalidConfig(f"unknown strategy {strategy}")
        threshold = STRATEGIES[strategy] if strategy else self.config.compaction.fragmentation
        periods = sorted(r["segment"] for r in lifecycle.compaction_candidates(self.fragmentation(), threshold).collect())
        if not periods:
            return 0
        state = self._state()
        live = lifecycle.live(self.events).where(F.col("period").isin(periods))
        batch = f"{state['number'] + 1:09d}-{uuid.uuid4().hex[:8]}"
        self._write_events(live, batch)
        there = f"batch={batch}" in self._names("events") and any(n.startswith("period=") for n in self._names(f"events/batch={batch}"))
        new = state | {k: {b: sorted({*without, *periods}) for b, without in state[k].items()} for k in ("batches", "tag_batches")}
        if there:
            stored = self.spark.read.schema(EVENT_SCHEMA).parquet(f"{self.path}/events/batch={batch}")
            self._write_tags(stored, state["tags"], batch)
            new |= {k: new[k] | {batch: []} for k in ("batches", "tag_batches")}
        # batches of which no period counts any more aren't named
        for k, root in (("batches", "events"), ("tag_batches", f"tags-{state['tags']}")):
            left = {b: w for b, w in new[k].items() if b == batch or {n.removeprefix("period=") for n in self._names(f"{root}/batch={b}") if n.startswith("period=")} - set(w)}
            new |= {k: left}
        old = [f"{root}/batch={b}/period={p}" for k, root in (("batches", "events"), ("tag_batches", f"tags-{state['tags']}")) for b in state[k] for p in periods]
        if self._exists(f"flags-{state['flags']}"):
            kept = self.flags.join(self.raw.where(~F.col("period").isin(periods)).select("id"), "id", "left_semi")
            if there:
                # live events have neither flag, so a tombstone of a period written anew is of an event that is gone
                kept = kept.join(stored.select("id"), "id", "left_anti")
            kept.write.parquet(f"{self.path}/flags-{state['flags'] + 1}")
            old.append(f"flags-{state['flags']}")
            new |= {"flags": state["flags"] + 1}
        self._commit(new | {"old": old})
        for part in state["old"]:
            self._fs.delete(self._jvm_path(f"{self.path}/{part}"), True)
        return len(periods)

    def rebuild_tags(self) -> None:
        """Write the tag table anew from the live events, and change over to it."""
        self._may_write()
        state = self._state()
        batch = f"{state['number'] + 1:09d}-{uuid.uuid4().hex[:8]}"
        self._write_tags(lifecycle.live(self.events), state["tags"] + 1, batch)
        self._commit(state | {"tags": state["tags"] + 1, "tag_batches": {batch: []}, "old": [*state["old"], f"tags-{state['tags']}"]})

    def recover(self) -> list[str]:
        """Put right what a job that died may have left: staged folders, batches that no manifest names, missing tags."""
        self._may_write()
        done, state = [], self._state()
        for name in self._names(""):
            stem, _, number = name.rpartition("-")
            if stem == "staged" or stem in ("tags", "flags") and number.isdigit() and int(number) > state[stem]:
                self._fs.delete(self._jvm_path(f"{self.path}/{name}"), True)
                done.append(f"removed {name}")
        for root, named in (("events", state["batches"]), (f"tags-{state['tags']}", state["tag_batches"])):
            for name in self._names(root):
                if name.startswith("batch=") and name.removeprefix("batch=") not in named and not any(x.startswith(f"{root}/{name}/") for x in state["old"]):
                    if any(x.startswith("period=") for x in self._names(f"{root}/{name}")):  # else a compaction has emptied it
                        done.append(f"removed {root}/{name}")
                    self._fs.delete(self._jvm_path(f"{self.path}/{root}/{name}"), True)
        missing = retrieve.explode_tags(lifecycle.live(self.events), self.config.index.tags).join(self.tags, ["id", "name", "value", "pos"], "left_anti")
        if not missing.isEmpty():
            self.rebuild_tags()
            done.append("rebuilt tags")
        return done

    def validate(self) -> dict[str, Any]:
        """Health: records, corrupt ones, duplicate ids, tags without entry and entries without event."""
        row = stats.integrity(self.raw, "period").agg(F.sum("records").alias("records"), F.sum("corrupt").alias("corrupt"), F.sum("duplicates").alias("duplicates")).first()
        own = retrieve.explode_tags(lifecycle.live(self.events), self.config.index.tags)
        out = {k: row[k] or 0 for k in ("records", "corrupt", "duplicates")}
        out["missing_tags"] = own.join(self.tags, ["id", "name", "value", "pos"], "left_anti").count()
        out["stray_tags"] = self.tags.join(self.raw.select("id"), "id", "left_anti").count()
        out["healthy"] = not any(out[k] for k in ("corrupt", "duplicates", "missing_tags", "stray_tags"))
        return out

    def check(self) -> None:
        found = self.validate()
        if not found["healthy"]:
            raise TableCorrupted(str(found))

    def stats(self) -> dict[str, Any]:
        """Counts by flag and the bytes on disk."""
        out = stats.table_stats(self.events).first().asDict()
        size = lambda n: self._fs.getContentSummary(self._jvm_path(self._folder(n))).getLength() if self._fs.exists(self._jvm_path(self._folder(n))) else 0
        return out | {f"{n}_bytes": size(n) for n in ("events", "tags", "flags")}

    def close(self) -> None:
        """Nothing is held open."""
