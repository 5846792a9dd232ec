"""Longest-processing-time scheduling of document groups onto shards."""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventide.llm.common import cut


class Runs:
    """Shards in turn, in stretches of (first rank, shards that are visited in a cycle)."""

    def __init__(self, stretches: list[tuple[int, list[int]]], count: int) -> None:
        self.stretches, self.count = stretches, count

    def __len__(self) -> int:
        return self.count

    def __getitem__(self, k: int) -> int:
        first, cycle = self.stretches[bisect.bisect_right(self.stretches, k, key=lambda x: x[0]) - 1]
        return cycle[(k - first) % len(cycle)]


def _level(loads: list[int], size: int, count: int) -> tuple[Runs, list[int]]:
    """Where LPT puts up to ``count`` groups of ``size`` while loads differ by a size or more, and the loads after that.

    Shards are visited in the order of (load, number), and each again a size later. Between the loads of one shard and
    the next one, those that have joined in take turns in one cycle, so that the stretches are at most as
    many as shards, however many groups it takes to get level.
    """
    order = sorted(range(len(loads)), key=lambda s: (loads[s], s))
    limits = [*((loads[s], s) for s in order[1:]), (loads[order[-1]] - size + 1, -1)]
    limits = [min(x, limits[-1]) for x in limits]
    now, stretches, done = list(loads), [], 0
    for j, (load, number) in enumerate(limits):
        if done == count or loads[order[j]] > limits[-1][0]:
            break
        cycle = sorted(order[: j + 1], key=lambda s: (now[s], s))
        total = sum(-(-(load - now[s]) // size) + (s < number and (load - now[s]) % size == 0) for s in cycle if now[s] < load or now[s] == load and s < number)
        total = min(total, count - done)
        if total:
            stretches.append((done, cycle[:total]))
            whole, rest = divmod(total, len(cycle))
            for k, s in enumerate(cycle):
                now[s] += size * (whole + (k < rest))
            done += total
    return Runs(stretches, done), now


def lpt_runs(sizes: list[tuple[int, int]], n_shards: int) -> tuple[dict[int, tuple[Runs, list[int]]], list[int]]:
    """Schedule a histogram of (size, number of groups) exactly as group-by-group LPT would.

    Groups go largest first to the least-loaded shard, the lowest number on ties. The least-loaded shards take groups of a size
    until all loads lie closer than that to each other; further ones visit the shards in a cycle. Both are told in
    stretches, so work and memory follow the distinct sizes and the shards, not the groups.
    Returns for each size (head, cycle), and the loads.
    """
    heap = [(0, s) for s in range(n_shards)]
    out: dict[int, tuple[Runs, list[int]]] = {}
    for size, count in sorted(sizes, reverse=True):
        if size == 0:
            out[size] = (Runs([], 0), [heap[0][1]])
            continue
        head = Runs([], 0)
        if max(heap)[0] - heap[0][0] >= size:
            loads = [0] * n_shards
            for load, s in heap:
                loads[s] = load
            head, loads = _level(loads, size, count)
            heap = [(load, s) for s, load in enumerate(loads)]
            heapq.heapify(heap)
            count -= len(head)
        cycle: list[int] = []
        if count < n_shards:
            for _ in range(count):
                load, s = heap[0]
                heapq.heapreplace(heap, (load + size, s))
                cycle.append(s)
            cycle = cycle or [heap[0][1]]
        else:
            order = sorted(heap)
            cycle = [s for _, s in order]
            whole, rest = divmod(count, n_shards)
            # a cycle of one whole turn keeps the order of (load, shard) as it was
            heap = [(load + size * (whole + (i < rest)), s) for i, (load, s) in enumerate(order)]
            heapq.heapify(heap)
        out[size] = (head, cycle)
    loads = [0] * n_shards
    for load, s in heap:
        loads[s] = load
    return out, loads


class Places:
    """The shards by size and rank, as arrays."""

    def __init__(self, runs: dict[int, tuple[Runs, list[int]]]) -> None:
        self.sizes = np.array(sorted(runs), dtype=np.int64)
        key, first, cycles = [], [], []
        for i, size in enumerate(self.sizes.tolist()):
            head, cycle = runs[size]
            for at, part in [*head.stretches, (len(head), cycle)]:
                key.append((i << 40) + at)
                first.append(at)
                cycles.append(part)
        self.key, self.first = np.array(key, dtype=np.int64), np.array(first, dtype=np.int64)
        self.length = np.array([len(c) for c in cycles], dtype=np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.shard = np.array([s for c in cycles for s in c], dtype=np.int32)

    def of(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.key, (np.searchsorted(self.sizes, size) << 40) + rank, side="right") - 1
        return self.shard[self.begin[k] + (rank - self.first[k]) % self.length[k]].astype(np.int64)


def shard_groups(docs: DataFrame, group: F.Column, weight: F.Column, n_shards: int = 64, doc_id: str = "doc_id") -> DataFrame:
    """Assign documents to shards: (doc_id, group_key, group_size, shard).

    Rows of one ``group`` value stay together. Groups are taken by total ``weight``, largest first, equal
    sizes by md5 of the key and then the key, and each goes to the least-loaded shard (lowest number on
    ties) through a heap. The heap works on the histogram of group sizes, which has at most
    sqrt(2 * total weight) bars whatever the number of groups, of 24 bytes and at most ``n_shards`` numbers each; which place a group has among those of its
    size is found in parallel, by counts over 256 md5 slices.

    A null group value means that a row is in no group: it stands alone, under the key 'row:' plus its
    id. Null weight counts as 0 and a negative one as 0; groups of size 0 go to the shard that is least loaded at the end. Null doc_id is kept;
    rows with null in both group and id share one key. Repeated rows each count and stay together.
    Empty table: empty result. Other columns are ignored.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(group.cast("string"), F.concat(F.lit("row:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))).alias("group_key"),
        F.greatest(F.coalesce(weight.cast("long"), F.lit(0)), F.lit(0)).alias("w"),
    )
    groups = rows.groupBy("group_key").agg(F.sum("w").alias("group_size"))
    groups = groups.withColumn("h", F.md5("group_key")).withColumn("slice", F.substring("h", 1, 2))
    groups = cut(groups)
    slices = groups.groupBy("group_size", "slice").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("group_size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slices = slices.select("group_size", "slice", before.alias("before"))
    histogram = groups.groupBy("group_size").agg(F.count("*").alias("n")).toPandas()
    runs, _ = lpt_runs(list(zip(histogram["group_size"].tolist(), histogram["n"].tolist())), n_shards)
    shared = docs.sparkSession.sparkContext.broadcast(Places(runs))

    @F.pandas_udf("long")
    def place(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for size, rank in parts:
            yield pd.Series(shared.value.of(size.to_numpy(dtype=np.int64), rank.to_numpy(dtype=np.int64)))

    inside = F.row_number().over(Window.partitionBy("group_size", "slice").orderBy("h", "group_key")) - 1
    ranked = groups.withColumn("inside", inside).join(slices, ["group_size", "slice"])
    placed = ranked.withColumn("shard", place("group_size", F.col("inside") + F.col("before")))
    return rows.join(placed.select("group_key", "group_size", "shard"), "group_key").select("doc_id", "group_key", "group_size", "shard")


SQL = """
WITH RECURSIVE g AS (SELECT md5(text) AS group_key, sum(strlen(text))::BIGINT AS group_size FROM documents GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY group_size DESC, md5(group_key), group_key) AS i FROM g),
s(i, loads, shard) AS (
  SELECT 0::BIGINT, list_resize([0::BIGINT], 64, 0::BIGINT), -1::BIGINT
  UNION ALL
  SELECT o.i, list_concat(list_concat(loads[1:p-1], [loads[p] + o.group_size]), loads[p+1:]), (p - 1)::BIGINT
  FROM (SELECT i, loads, list_position(loads, list_min(loads)) AS p FROM s) q JOIN o ON o.i = q.i + 1)
SELECT d.doc_id, o.group_key, o.group_size, s.shard
FROM documents d JOIN o ON o.group_key = md5(d.text) JOIN s ON s.i = o.i
"""
